import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from iontide.llm import arrays as A


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8), st.integers(1, 60))
def test_chunks_hold_all_texts(texts, limit):
    seen = {}
    for c in A.chunks(pa.array(texts, pa.string()), limit):
        for i, r in enumerate(c.rows):
            seen[r] = c.data[c.starts[i] : c.ends[i]].tobytes().decode()
    assert seen == {i: t or "" for i, t in enumerate(texts)}


def test_equal_slices_have_equal_hashes():
    data = np.frombuffer(b"abcxabcxabd" + bytes(range(200)), np.uint8)
    h = A.slice_hasher(data)(np.array([0, 4, 8, 0]), np.array([3, 7, 11, 4]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_tally_sums_counts():
    keys, counts = A.tally(np.array([5, 3, 5], np.uint64), np.array([1, 2, 3]))
    assert keys.tolist() == [3, 5] and counts.tolist() == [2, 4]


def letters(n, first):
    """A sequence of Thue and Morse, which confuses polynomial hashes modulo powers of two."""
    return bytes(97 + (bin(i).count("1") + first) % 2 for i in range(n))


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=30))
def test_hashes_and_comparisons_follow_the_bytes(slices):
    data = np.frombuffer(b"".join(slices), np.uint8)
    end = np.cumsum([len(s) for s in slices])
    start = end - [len(s) for s in slices]
    h = A.slice_hasher(data)(start, end)
    assert len(set(h.tolist())) == len(set(slices))
    for k, s in enumerate(slices):
        same = [t == s for t in slices]
        assert (h == h[k]).tolist() == same
        alike = np.flatnonzero(end - start == len(s))
        assert A.same_slices(data, start[alike], data, np.full(len(alike), start[k]), np.full(len(alike), len(s))).tolist() == [same[i] for i in alike]


def test_hashes_of_patterned_texts():
    texts = [letters(n, k) for n in (8, 1024, 2048, 4096) for k in (0, 1)]
    texts += [bytes(8) * k for k in range(1, 6)] + [b"abcdefgh" * 2 + b"x" * 8, b"x" * 8 + b"abcdefgh" * 2, b"abcdefgh" + b"x" * 8 + b"abcdefgh"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    assert len(set(A.slice_hasher(data)(end - [len(t) for t in texts], end).tolist())) == len(texts)
