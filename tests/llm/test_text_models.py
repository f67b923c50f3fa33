import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from iontide.llm import license_scan, quality_rules, toxicity

from .conftest import WORDS


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    repeats = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(repeats) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeats), failed


def labelled(spark, make_good, make_bad, n=400, column="quality"):
    draw = random.Random(1)
    rows = [(i, make_bad(draw) if i % 4 == 0 else make_good(draw), int(i % 4 != 0) if column == "quality" else int(i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, k) for i, _, k in rows], f"doc_id long, {column} int"), {i: k for i, _, k in rows}


def test_base_counts(docs, texts):
    out = quality_rules.LikelihoodRatio.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("quality"))).annotate(docs)
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert r.kept == (not r.base_failed)


def test_quality_verdicts(spark):
    good = lambda d: " ".join(d.choices(WORDS, k=40))
    bad = lambda d: " | ".join(d.choices(WORDS, k=40))
    docs, labels, true = labelled(spark, good, bad)
    rows = quality_rules.LikelihoodRatio.fit(docs, labels).annotate(docs).collect()
    assert all(r.kept == bool(true[r.doc_id]) for r in rows if not r.base_failed)


def test_threshold_keeps_the_trusted():
    import numpy as np

    label, score = np.array([1] * 1000 + [0] * 100), np.concatenate([np.linspace(0, 1, 1000), np.linspace(-1, 0.5, 100)])
    cut = quality_rules.best_threshold(label, score)
    assert (score[label == 1] >= cut).mean() >= quality_rules.KEEP
    assert quality_rules.best_threshold(label[:0], score[:0]) == -np.inf


def test_toxicity_on_held_out_rows(spark):
    plain = lambda d: " ".join(d.choices(WORDS, k=60))

    def toxic(d):
        words = d.choices(WORDS, k=60)
        for _ in range(6):
            words[d.randrange(60)] = d.choice(["gronk", "blarf", "zwick"])
        return " ".join(words)

    docs, labels, true = labelled(spark, plain, toxic, 600, "toxic")
    learned = labels.filter(~toxicity.held_out())
    rows = toxicity.scored(docs.withColumn("held_out", toxicity.held_out()), learned).collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == true[r.doc_id] for r in unseen) / len(unseen) > 0.97


def test_toxicity_learns_from_all_rows_and_finds_few_words(spark):
    """Four toxic words in long texts; one text in eight is toxic."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abdegilmnorstu", k=7)) for _ in range(400)]

    def text(toxic):
        words = draw.choices(WORDS + vocabulary, k=300)
        for at in draw.sample(range(300), 4 if toxic else 0):
            words[at] = draw.choice(["gronk", "blarf"]) + draw.choice(["", "s", "ed"])
        return " ".join(words)

    true = {i: int(i % 8 == 0) for i in range(800)}
    docs = spark.createDataFrame([(i, text(y)) for i, y in true.items()], "doc_id long, text string")
    labels = spark.createDataFrame(list(true.items()), "doc_id long, toxic int").filter(~toxicity.held_out())
    rows = toxicity.scored(docs.withColumn("held_out", toxicity.held_out()), labels).filter("held_out").collect()
    caught = [r.predicted for r in rows if true[r.doc_id]]
    assert sum(caught) / len(caught) > 0.8
    assert sum(r.predicted for r in rows if not true[r.doc_id]) <= 0.02 * len(rows)


def test_toxicity_scores_follow_the_texts_alone(spark):
    """Order, partitions, repeated rows and the neighbours of a text change no score; clashing columns stay."""
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choices(WORDS, k=30) + ["gronk"] * (2 * (i % 5 == 0))), 7.0, -1) for i in range(200)] + [(500, "", 7.0, -1), (501, None, 7.0, -1), (None, "gronk the", 7.0, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.Model.fit(docs.select("doc_id", "text"), labels)
    scores = lambda d: {r.doc_id: r.score for r in model.score(d).collect()}
    one = scores(docs.coalesce(1))
    assert one == scores(docs.orderBy("text").repartition(7)) and one[500] == one[501]
    again = toxicity.Model.fit(docs.select("doc_id", "text").orderBy("text").repartition(5), labels)
    assert (again.words == model.words).all()
    out = model.score(docs)
    assert out.columns == ["doc_id", "score_before", "predicted_before", "score", "predicted"] and out.filter("score_before = 7 and predicted_before = -1").count() == len(rows)
    kept = model.kept(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.score) for r in kept.collect() if r.doc_id is not None) == sorted((i, 7.0) for i, p in one.items() if i is not None and p < toxicity.CUT)


def test_kneser_ney_against_plain_counts():
    """Log ratios of words by the formulas of the docstring, over a few texts."""
    import numpy as np
    from iontide.llm import arrays as A

    texts = [(0, "a b a c a b"), (0, "b c d"), (1, "a x b x x c"), (1, "d a x y")]
    counts = toxicity.Counts((2, 2))
    slot, pairs = {}, [set(), set()]
    for y, t in texts:
        words, before, _ = toxicity.tokens(A.Chunk(range(1), [memoryview(t.encode())]))
        slot.update(zip(t.split(), words.tolist()))
        pairs[y] |= set(zip([None, *t.split()], t.split()))
        keys = np.unique(np.uint64(y) << toxicity._CLASS | words.astype(np.uint64) << np.uint64(toxicity.WORD_BITS) | before)
        counts.add(keys[~np.isin(keys, getattr(counts, "seen", np.zeros(0, np.uint64)))])
        counts.seen = np.append(getattr(counts, "seen", np.zeros(0, np.uint64)), keys)
    model = counts.closed()
    n = [Counter(w for _, w in p) for p in pairs]
    every = set(n[0]) | set(n[1])
    whole = sum(2 * min(n[0][w], n[1][w]) + 1 for w in every) + 0.1 * (toxicity._WORDS - len(every))
    p = []
    for c in n:
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos)
        total = sum(c.values())
        p.append({w: (max(c[w] - d, 0) + sum(min(d, v) for v in c.values()) * (2 * min(n[0][w], n[1][w]) + 1) / whole) / total for w in every})
    for w in every:
        assert model.words[slot[w]] == pytest.approx(np.log(p[1][w] / p[0][w]), rel=1e-5)


def test_likelihoods_of_whole_texts_against_plain_counts():
    """p(w | v) over p(w) by the formulas of the docstring, and its mean over all tokens of a text, repeated ones too."""
    import numpy as np
    from iontide.llm import arrays as A

    texts = [(0, "a b a c a b"), (0, "b c d b c"), (1, "a x b x x c x b"), (1, "d a x y")]
    counts, slot, pairs = toxicity.Counts((2, 2)), {}, [Counter(), Counter()]
    for y in (0, 1):
        keys = []
        for t in (t for k, t in texts if k == y):
            words, before, _ = toxicity.tokens(A.Chunk(range(1), [memoryview(t.encode())]))
            slot.update(zip(t.split(), words.tolist()))
            pairs[y].update(zip([None, *t.split()], t.split()))
            keys.append(np.uint64(y) << toxicity._CLASS | words.astype(np.uint64) << np.uint64(toxicity.WORD_BITS) | before)
        counts.add(*np.unique(np.concatenate(keys), return_counts=True))
    model = counts.closed()
    lower = toxicity.smoothed(counts.before)
    ones, twos = (sum(v == k for v in pairs[1].values()) for k in (1, 2))
    d = ones / (ones + 2 * twos)

    def p(y, v, w):
        after = sum(n for (u, _), n in pairs[y].items() if u == v)
        if not after:
            return lower[y][slot[w]]
        return (max(pairs[y][v, w] - d, 0) + sum(min(n, d) for (u, _), n in pairs[y].items() if u == v) * lower[y][slot[w]]) / after

    new = ["x b x b x b d y", "c c c", "y", ""]
    whole, _ = model.measures(A.Chunk(range(4), [memoryview(t.encode()) for t in new]))
    for t, found in zip(new, whole):
        ratios = [np.log(p(1, v, w) / p(0, v, w)) for v, w in zip([None, *t.split()], t.split())]
        assert found == pytest.approx(np.mean(ratios) if ratios else 0, rel=1e-5)


def test_weights_of_measures():
    import numpy as np

    draw = np.random.default_rng(5)
    label = np.repeat([0, 1], (900, 100))
    useful, noise = label * 2 + draw.normal(size=1000), draw.normal(size=1000)
    a, b, c = toxicity.weights(label, np.stack((useful, noise, -useful)))
    assert a > 1 and abs(b) < 0.3 * a and c == 0
    assert (toxicity.weights(label[:5], np.ones((2, 5))) == 1).all()


def test_toxicity_without_labels(docs, empty, texts, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.scored(docs.select("doc_id", "text"), none).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.scored(docs, one).count() == len(texts) + 1
    assert toxicity.scored(empty, one).count() == 0


def test_licences(spark, docs, empty, texts):
    notes = {
        0: ("Words.\nLicensed under the Apache License, Version 2.0.", "apache-2.0"),
        1: ("Released under the MIT License.", "mit"),
        2: ("This work is licensed under the GNU General Public License, version 3.\nmore", "gpl"),
        3: ("The license of the bar was released by the public office.", "none"),
        4: ("All rights reserved.", "proprietary"),
        5: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        6: (None, "none"),
        7: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    }
    frame = spark.createDataFrame([(i, t) for i, (t, _) in notes.items()], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(frame).collect()}
    for i, (_, family) in notes.items():
        assert rows[i].family == family or family == "none" and rows[i].n_confirmed == 0, notes[i]
    assert rows[0].n_paragraphs == 2 and rows[0].n_confirmed == 1
    found = license_scan.scan_paragraphs(frame).filter("doc_id = 0").first()
    assert found.paragraph == notes[0][0].split("\n")[1] and found.start_byte == 7
    assert license_scan.scan(docs).count() == len(texts) + 1
    assert license_scan.scan(empty).count() == 0


def wrapped(text, width, sign=""):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join(sign + x for x in [*lines, line])


def test_wrapped_notices(spark):
    """Notices wrapped at 40 to 80 columns, commented or not, among prose; paragraphs are cut out whole."""
    notices = {f: texts[0] for f, texts in license_scan.TEMPLATES.items() if f in ("gpl", "agpl", "lgpl", "apache-2.0", "bsd", "isc")} | {"mit": license_scan.TEMPLATES["mit"][2]}
    rows, true = [], {}
    for width in (40, 55, 70, 80):
        for sign in ("", "# ", " * "):
            for family, text in notices.items():
                true[len(rows)] = family
                rows.append((len(rows), f"int main() of x\n{sign}\n" + wrapped(text, width, sign) + f"\n{sign}\nThe weather was fine and they went on.\n"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan(frame).collect()}
    wrong = [(i, true[i], found[i].family) for i in true if found[i].family != true[i]]
    assert not wrong and all(r.n_confirmed == 1 for r in found.values())
    parts = license_scan.scan_paragraphs(frame.filter("doc_id = 0")).collect()
    assert parts[0].paragraph == rows[0][1].split("\n\n")[1]


def test_licence_probabilities_against_plain_sums():
    import numpy as np
    from iontide.llm import arrays as A

    weights, bias = license_scan.trained()
    texts = ["Released under the MIT License.\nmore words", "", "All rights reserved. the the the", "Ünï 日本"]
    words = license_scan.Words(A.Chunk(range(4), [memoryview(t.encode()) for t in texts]))
    p = license_scan.probabilities(words, words.first[:-1], words.first[1:], weights, bias)
    lines = [x for t in texts for x in t.split("\n") if x.strip()]
    assert len(p) == len(lines)
    h = lambda w: A.slice_hasher(np.frombuffer(w.encode(), np.uint8))(np.array([0]), np.array([len(w.encode())]))
    for line, own in zip(lines, p):
        tokens = re.findall(r"[\w]+", line.lower())
        keys = {int(h(w)[0]) >> 51 for w in tokens} | {int(A.combine(h(a), h(b))[0]) >> 51 for a, b in zip(tokens, tokens[1:])}
        z = sum(weights[k] for k in keys) / len(keys) ** 0.5 + bias
        assert np.allclose(own, np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_licence_variations_left_out_of_training():
    draw = random.Random(99)
    import numpy as np
    from iontide.llm import arrays as A

    rows = [r for r in license_scan.training_set(draw) if r[0]][:1500]
    chunk = A.Chunk(range(1), [memoryview("\n\n".join(t for t, _ in rows).encode())])
    found = {a: f for _, a, _, f, _, _ in license_scan.find(chunk, *license_scan.trained())}
    at, hits = 0, []
    for t, y in rows:
        hits.append(found.get(at, "unknown") == license_scan.FAMILIES[y])
        at += len(t.encode()) + 2
    assert np.mean(hits) > 0.9


@pytest.mark.parametrize("rows", [0, 1, 2, 3])
def test_quality_on_tiny_tables(spark, rows):
    docs = spark.createDataFrame([(i, "one two three") for i in range(rows)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality_rules.LikelihoodRatio.fit(docs, labels).annotate(docs).count() == rows


def test_likelihood_ratio_against_plain_counts(spark):
    """Scores by the formulas of the docstring, ties at the threshold, and columns of any name."""
    import numpy as np

    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(WORDS[:8] if i % 3 else WORDS, k=15)), 9.0, "x") for i in range(90)] + [(None, " ".join(WORDS), 9.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, llr double, kept string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    model = quality_rules.LikelihoodRatio.fit(docs, labels)
    half = {r.doc_id: r.half for r in labels.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'half'), 2) AS half").collect()}

    def grams(text):
        w = text.split()
        return [*w, *zip(w, w[1:])]

    raw, trusted = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if i is not None and i % 3 and not half[i]:
            trusted.update(grams(t))
    n, m, b = raw.total(), trusted.total(), quality_rules.BUCKETS
    p = {g: (raw[g] + 0.5) / (n + 0.5 * b) for g in raw}
    weight = {g: np.log((trusted[g] + b * p[g]) / (m + b) / p[g]) for g in raw}
    out = model.annotate(docs)
    assert {"llr_before", "kept_before"} <= set(out.columns)
    for r in out.collect():
        own = grams(next(t for i, t, *_ in rows if i == r.doc_id))
        assert r.llr == pytest.approx(sum(weight[g] for g in own) / (len(own) + quality_rules.NEUTRAL), abs=1e-5)
        assert r.llr_before == 9.0 and r.kept_before == "x" and r.kept == (not r.base_failed and r.llr >= model.threshold)
    kept = model.kept(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in out.collect() if r.kept)
    assert model.kept(docs.limit(0)).count() == 0
