"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of a text, or several neighbouring lines that a notice is wrapped over:
where lines in a row hold word pairs of templates (SEEDS each, or one across them and SEEDS on
either side), all windows of such lines of at most LONGEST words are paragraphs too.  Of likely paragraphs that overlap the one
with the most word pairs in common with its template counts.  A multinomial logistic regression over hashed words and
word pairs gives each paragraph the probabilities of the licence families and of "unknown".
It is trained here from TEMPLATES: seeded variations of them (words lost, other years and
holders, prose before and after) and, for "unknown", prose, made-up words and licence
vocabulary in other orders.  A temperature, fitted on variations left out of the training,
calibrates the probabilities.  A paragraph whose most probable family is likelier than
CERTAIN is compared with that family's templates: it is confirmed if its word pairs cover
COVERED of a template's, or the reverse for long paragraphs.

Every paragraph of every text is scored, as matrix rows in numpy, without an exchange; the
model has a fixed size (BUCKETS x families).

Comment signs aren't words, so commented notices are read like others.

Edge cases: null, empty and white texts have no paragraphs and family "none"; a paragraph that
is likely but not confirmed gives "unknown"; of several confirmed families the most probable
names the text, ties going to the first by name; repeated rows each give a row; further
columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .frames import ddl
from .storage import read

BUCKETS_BITS = 13
#: Least probability of a family for a comparison, and least share of common word pairs.
CERTAIN, COVERED = 0.6, 0.6
SEED, VARIATIONS = 5, 40
#: Template pairs in a line that may be a part of a notice, and most words of a paragraph of several lines.
SEEDS, LONGEST = 2, 96
_PAIR_BITS = 16

#: Short notices and characteristic sentences of public licences, by family.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.', "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
FAMILIES = [*sorted(TEMPLATES), "unknown"]

#: Sentences that share words with licences or are plain prose.
PROSE = [
    "The driver showed a license and was released under police supervision.",
    "All the seats were reserved for the public and the general.",
    "The terms of the contract were modified under the law of the state.",
    "She works in a library of free books and reads the source of the river.",
    "Version two of the report was published by the foundation last year.",
    "They were granted permission to use the common hall without any charge.",
    "The university released a new version of the software and the documents.",
    "Rights and duties of the citizens are written in the constitution.",
    "We walked along the lake and the weather was fine all day.",
    "The license of the restaurant expired in the spring.",
    "Public transport in the city is free of charge on sundays.",
    "An apache helicopter flew over the creative district near the commons.",
    "He published a general work on attribution theory and its use.",
    "This work is part of a series about the history of the town.",
]


class Words:
    """The words of a chunk by line: lines with words, hashes of words and of each word with the one after it."""

    def __init__(self, chunk: A.Chunk):
        data = A.LOWER[chunk.data]
        ends = np.flatnonzero(data == 10)
        self.start, self.end = chunk.runs(A.WORDLIKE)
        line = np.searchsorted(ends, self.start)
        #: The number of each line with words, and its first word (and, in the end, how many words there are).
        self.line, first = np.unique(line, return_index=True)
        self.first = np.append(first, len(line))
        self.words = A.slice_hasher(data)(self.start, self.end) if len(line) else np.zeros(0, np.uint64)
        self.pairs = A.combine(self.words[:-1], self.words[1:]) if len(line) else np.zeros(0, np.uint64)
        self.doc = chunk.doc_of(self.start[first])

    def features(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words low:high and of their pairs, and the paragraph of each, ordered by paragraph; once each."""
        rows = np.arange(len(low))
        keys = [values[_ragged(low, n)] >> np.uint64(64 - BUCKETS_BITS) for values, n in ((self.words, high - low), (self.pairs, high - low - 1))]
        owner = np.concatenate((np.repeat(rows, high - low), np.repeat(rows, high - low - 1)))
        own = np.unique(owner << BUCKETS_BITS | np.concatenate(keys).astype(np.int64))
        return own & ((1 << BUCKETS_BITS) - 1), own >> BUCKETS_BITS

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of all lines, and of the windows of lines that may be parts of one notice."""
        low, high = self.first[:-1], self.first[1:]
        if not len(low):
            return low, high
        known = _template_pair_table()[(self.pairs >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)]
        across = known[high[:-1] - 1]
        known[high[:-1] - 1] = False
        seed = np.add.reduceat(np.append(known, False), low) >= SEEDS
        joined = seed[:-1] & seed[1:] | across & (seed[:-1] | seed[1:])
        joined &= (np.diff(self.line) == 1) & (self.doc[:-1] == self.doc[1:])
        windows = []
        for i in np.flatnonzero(joined):
            j = i
            while j < len(joined) and joined[j] and high[j + 1] - low[i] <= LONGEST:
                j += 1
                windows.append((low[i], high[j]))
        more = np.array(windows, np.int64).reshape(-1, 2)
        return np.concatenate((low, more[:, 0])), np.concatenate((high, more[:, 1]))


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start : start + length of all, end to end."""
    at = np.cumsum(length)
    return np.repeat(start - (at - length), length) + np.arange(at[-1] if len(at) else 0)


@cache
def _template_pair_table() -> np.ndarray:
    """Which hashes (their first bits) are those of a template's word pairs."""
    own = Words(A.Chunk(range(1), [memoryview("\n".join(t for texts in TEMPLATES.values() for t in texts).encode())]))
    out = np.zeros(1 << _PAIR_BITS, bool)
    inner = np.ones(len(own.pairs), bool)
    inner[own.first[1:-1] - 1] = False
    out[(own.pairs[inner] >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)] = True
    return out


def _variation(text: str, draw: random.Random) -> str:
    words = text.split()
    if len(words) > 8 and draw.random() < 0.5:
        words = words[: max(8, int(len(words) * draw.uniform(0.5, 1)))]
    words = [w for w in words if draw.random() > (0.06 if len(words) > 6 else 0)]
    made = lambda n: [_made_up(draw) for _ in range(n)]
    if draw.random() < 0.3:
        words = ["Copyright", "(c)", str(draw.randint(1990, 2025)), *made(draw.randint(1, 2)), *words]
    if draw.random() < 0.15:
        words = made(draw.randint(1, 3)) + words
    if draw.random() < 0.15:
        words = words + made(draw.randint(1, 3))
    return " ".join(words)


def _made_up(draw: random.Random) -> str:
    return "".join(draw.choice("bcdfghlmnprstvwz") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))


def training_set(draw: random.Random) -> list[tuple[str, int]]:
    rows = [(_variation(t, draw), FAMILIES.index(f)) for f, texts in sorted(TEMPLATES.items()) for t in texts for _ in range(VARIATIONS)]
    legal = [w for texts in TEMPLATES.values() for t in texts for w in t.split()]
    unknown = FAMILIES.index("unknown")
    for _ in range(20 * VARIATIONS):
        kind = draw.random()
        if kind < 0.3:
            words = draw.choice(PROSE).split()
            words = [w for w in words if draw.random() > 0.1]
        elif kind < 0.7:
            words = [_made_up(draw) for _ in range(draw.randint(1, 40))]
        else:
            words = draw.sample(legal, draw.randint(1, 12)) + [_made_up(draw) for _ in range(draw.randint(2, 20))]
            draw.shuffle(words)
        rows.append((" ".join(words), unknown))
    draw.shuffle(rows)
    return rows


@cache
def trained() -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x families) and biases, divided by the calibrating temperature."""
    rows = training_set(random.Random(SEED))
    chunk = A.Chunk(range(len(rows)), [memoryview(t.encode()) for t, _ in rows])
    words = Words(chunk)
    keys, row = words.features(words.first[:-1], words.first[1:])
    row = words.line[row]
    label = np.array([y for _, y in rows])
    held = np.arange(len(rows)) % 4 == 0
    # (row, bucket) in order of rows and, for gradients, of buckets.
    used, index = np.unique(keys, return_inverse=True)
    value = (1 / np.sqrt(np.bincount(row)))[row].astype(np.float32)[:, None]
    by_row = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    order = np.argsort(index, kind="stable")
    by_bucket = np.searchsorted(index[order], np.arange(len(used)))
    y = np.eye(len(FAMILIES), dtype=np.float32)[label[row[by_row]]]
    label, held = label[row[by_row]], held[row[by_row]]
    position = np.repeat(np.arange(len(by_row)), np.diff(np.append(by_row, len(row))))
    w, b = np.zeros((len(used), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    scores = lambda: np.add.reduceat(w[index] * value, by_row) + b
    for _ in range(150):
        gap = (softmax(scores()) - y) * (~held / (~held).sum()).astype(np.float32)[:, None]
        speed_w = 0.9 * speed_w - 8 * (np.add.reduceat((gap[position] * value)[order], by_bucket) + 1e-5 * w)
        speed_b = 0.9 * speed_b - 8 * gap.sum(0)
        w += speed_w
        b += speed_b
    z, label = scores()[held], label[held]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), label] + 1e-9).mean()
    temperature = min(np.linspace(0.5, 3, 26), key=loss)
    whole = np.zeros((1 << BUCKETS_BITS, len(FAMILIES)), np.float32)
    whole[used] = w
    return whole / np.float32(temperature), b / np.float32(temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pairs(text: str) -> set[tuple[str, str]]:
    words = ["^", *"".join(c.lower() if c.isalnum() else " " for c in text).split(), "$"]
    return set(zip(words, words[1:]))


@cache
def _template_pairs(family: str) -> list[set]:
    return [_pairs(t) for t in TEMPLATES[family]]


def similarity(text: str, family: str) -> tuple[float, int]:
    """The largest share of a template's word pairs that the text has, or of the text's that a template has; and the most pairs in common."""
    own = _pairs(text)
    share = lambda t: len(own & t) / (len(t) if len(own) >= 6 else max(len(t), len(own)))
    back = lambda t: len(own & t) / len(own) if len(own) >= 12 else 0
    templates = _template_pairs(family)
    return max(max(share(t), back(t)) for t in templates), max(len(own & t) for t in templates)


def find(chunk: A.Chunk, weights: np.ndarray, bias: np.ndarray) -> list[tuple[int, int, int, str, float, float]]:
    """(text, start, end, family, probability, similarity) of all paragraphs that are likely licences and don't overlap."""
    words = Words(chunk)
    low, high = words.paragraphs()
    found = []
    for at in range(0, len(low), 1 << 16):
        a, b = low[at : at + (1 << 16)], high[at : at + (1 << 16)]
        p = probabilities(words, a, b, weights, bias)
        best = p[:, :-1].argmax(1)
        for k in np.flatnonzero(p[np.arange(len(p)), best] >= CERTAIN):
            d = int(chunk.doc_of(words.start[a[k]]))
            # From the begin of its first line to the end of its last.
            begin, end = int(words.start[a[k]]), int(words.end[b[k] - 1])
            begin = int(chunk.starts[d]) + chunk.data[chunk.starts[d] : begin].tobytes().rfind(b"\n") + 1
            end += chunk.data[end : chunk.ends[d] + 1].tobytes().find(b"\n")
            family = FAMILIES[best[k]]
            s, common = similarity(chunk.data[begin:end].tobytes().decode("utf-8", "replace"), family)
            found.append((s >= COVERED, common, s, d, begin - int(chunk.starts[d]), end - int(chunk.starts[d]), family, float(p[k, best[k]]), s))
    kept: dict[int, list[tuple]] = {}
    for *_, d, begin, end, family, p, s in sorted(found, key=lambda f: (-f[0], -f[1], -f[2], f[3:5])):
        row = begin, end, family, p, s
        others = kept.setdefault(d, [])
        if all(row[1] <= o[0] or row[0] >= o[1] for o in others):
            others.append(row)
    return [(d, *row) for d in sorted(kept) for row in sorted(kept[d])]


def probabilities(words: Words, low: np.ndarray, high: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Of each paragraph (words low:high) and family."""
    keys, row = words.features(low, high)
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n = np.diff(np.append(begin, len(row)))
    return softmax(np.add.reduceat(weights[keys], begin) / np.sqrt(n)[:, None] + bias)


def _scan(frame: DataFrame, key: str, column: str, schema: str, rows_of) -> DataFrame:
    model = frame.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in A.chunks(batch.column(1), 2 << 20):
                yield from rows_of(batch.column(0).slice(at, chunk.n), chunk, find(chunk, *model.value))
                at += chunk.n

    return frame.select(key, column).mapInArrow(run, schema)


def scan_paragraphs(frame: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per likely licence paragraph, with its byte range in the text and its words."""
    names = ["start_byte", "end_byte", "family", "probability", "similarity", "confirmed", "paragraph"]

    def rows_of(keys, chunk, found):
        if found:
            doc, start, end, family, p, s = zip(*found)
            texts = [chunk.data[chunk.starts[d] + a : chunk.starts[d] + b].tobytes().decode("utf-8", "replace") for d, a, b in zip(doc, start, end)]
            columns = [keys.take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(family), pa.array(p), pa.array(s, pa.float64()), pa.array([x >= COVERED for x in s]), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, [key, *names])

    schema = f"{ddl(frame, [key])[0]}, start_byte long, end_byte long, family string, probability double, similarity double, confirmed boolean, paragraph string"
    return _scan(frame, key, column, schema, rows_of)


def scan(frame: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per text: its family, probability and similarity, and how many paragraphs are likely and confirmed."""
    names = ["family", "probability", "similarity", "n_paragraphs", "n_likely", "n_confirmed"]

    def rows_of(keys, chunk, found):
        line_end = np.flatnonzero(chunk.data == 10)
        start, _ = chunk.words()
        real = line_end[np.unique(np.searchsorted(line_end, start))] if len(start) else line_end[:0]
        n_paragraphs = chunk.counts(np.searchsorted(chunk.ends, real)).astype(np.int64)
        out = [["none", 0.0, 0.0, int(n), 0, 0] for n in n_paragraphs]
        for d, _, _, family, p, s in sorted(found, key=lambda f: (f[0], f[5] < COVERED, -f[4], f[3])):
            row = out[d]
            if not row[4]:
                row[:3] = family if s >= COVERED else "unknown", p, s
            row[4] += 1
            row[5] += s >= COVERED
        if out:
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())))], [key, *names])

    return _scan(frame, key, column, f"{ddl(frame, [key])[0]}, family string, probability double, similarity double, n_paragraphs long, n_likely long, n_confirmed long", rows_of)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
