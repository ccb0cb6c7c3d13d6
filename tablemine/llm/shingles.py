"""Sets of word shingles as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers of the shingle hash.
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_in(texts: Sequence[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word numbers of all texts in a row, the distinct words, where each text's words begin); A-Z lower-cased, NULL empty.

    Words are runs of other characters than the six ASCII blanks.
    """
    # a new array: the kernels below misread slices of another
    clean = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    split = pc.ascii_split_whitespace(clean)
    counts = np.where(np.asarray(pc.equal(clean, "")), 0, np.asarray(pc.list_value_length(split)))
    flat = pc.list_flatten(split)
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary, np.r_[0, np.cumsum(counts)].astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; the same in every process."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64) if len(words) else np.empty(0, np.uint64)


def stirred(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * ODD[0]
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    """The distinct shingles of ``width`` words of every text, sorted; a text of fewer words is one shingle, without words none.

    Two shingles count as equal if their 64-bit hashes are; within the sets of one pair that never matters in practice.
    """
    index, words, begin = words_in(texts)
    h = word_hashes(words)[index] if len(index) else np.empty(0, np.uint64)
    m = max(0, len(h) - width + 1)
    s = np.full(m, width, np.uint64)
    for k in range(width):
        s = stirred(s * ODD[1] + h[k : k + m])
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = stirred(one * ODD[1] + x)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out
