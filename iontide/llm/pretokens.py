"""The pre-tokens of byte-level BPE, found for whole chunks of text at once.

The published pattern of these vocabularies (``public_tokenizers.PATTERN``) splits text
into contractions, runs of letters, numbers and other signs with one space before them,
and white space.  Every boundary follows from the classes of neighbouring characters, so
the split needs no regex engine: see ``split`` for the rules.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

from . import arrays as A

LETTER, NUMBER, OTHER, WHITE, EDGE, SPECIAL = range(1, 7)

_SURROGATES = range(0xD800, 0xE000)


@cache
def character_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    low = "".join(map(chr, range(_SURROGATES.start)))
    high = "".join(map(chr, range(_SURROGATES.stop, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for text, shift in ((low, 0), (high, _SURROGATES.stop)):
            for m in regex.finditer(pattern, text):
                out[shift + m.start() : shift + m.end()] = kind
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = character_classes()
    out = np.where(np.arange(256) < 128, table[:256], OTHER).astype(np.uint8)[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        b = [np.append(data, np.zeros(3, np.uint8))[at + k].astype(np.int64) for k in range(4)]
        two = (b[0] & 0x1F) << 6 | b[1] & 0x3F
        three = (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
        four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
        kind = table[np.minimum(np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)), 0x10FFFF)]
        out[at] = kind
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            longer = (b[0] >= least) & (at + k < len(data))
            out[at[longer] + k] = kind[longer]
    return out


def _occurrences(data: np.ndarray, special: bytes) -> np.ndarray:
    text, found, at = data.tobytes(), [], -len(special)
    while (at := text.find(special, at + len(special))) >= 0:
        found.append(at)
    return np.array(found, np.int64)


def split(chunk: A.Chunk, special: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens, and which are the special token.

    A pre-token begins where the class changes, but a space before a letter, number or
    other sign begins the pre-token of what follows; the last character of white space
    before such a sign stands alone if it isn't a space; contractions are cut out where an
    apostrophe begins a pre-token.  Text on both sides of a special token is split apart.
    """
    data = chunk.data
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = byte_classes(data)
    kind[chunk.ends] = EDGE
    at = _occurrences(data, special) if special else np.zeros(0, np.int64)
    for k in range(len(special) if len(at) else 0):
        kind[at + k] = SPECIAL
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[at] = True
    sign = kind <= OTHER
    after_white = np.flatnonzero(sign[1:] & (kind[:-1] == WHITE)) + 1
    spaced = data[after_white - 1] == 32
    begins[after_white[spaced]] = False
    begins[after_white[spaced] - 1] = True
    last = after_white[~spaced] - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    begins[last] = True
    quote = np.flatnonzero((data[:-1] == 39) & begins[:-1] & (kind[1:] == LETTER))
    if len(quote):
        one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[quote[short | long] + 1] = False
        for which, n in ((short, 2), (long, 3)):
            end = quote[which] + n
            begins[end[kind[end] == LETTER]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))
    real = kind[start] != EDGE
    start, end = start[real], end[real]
    return start, end, kind[start] == SPECIAL
