"""Words of whole texts as arrays, and hashes of word sequences by doubling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Odd multiplier of the sequence hash, 5 modulo 8.
BASE = 0x9E3779B97F4A7C15


@dataclass
class Words:
    """All words of some texts, end to end."""

    flat: pa.Array  # the words
    doc: np.ndarray  # row of the text each word is in
    count: np.ndarray  # words per text

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.count) - self.count


def words_of(text: pa.Array, lower: bool = False) -> Words:
    """Words of each text (none for null), A-Z in lower case on request."""
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    split = pc.ascii_split_whitespace(text)
    flat = split.flatten()
    doc = np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = pc.not_equal(pc.binary_length(flat), 0)
    doc = doc[real.to_numpy(zero_copy_only=False)]
    return Words(flat.filter(real), doc, np.bincount(doc, minlength=len(text)).astype(np.int64))


def word_hashes(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    coded = flat.dictionary_encode()
    each = coded.dictionary.cast(pa.binary()).to_pylist()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in each), dtype=np.uint64, count=len(each))
    return known[coded.indices.to_numpy()]


def power(exponent: int) -> np.uint64:
    return np.uint64(pow(BASE, exponent, 1 << 64))


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` items from each position on, by doubling: O(log length) passes."""
    if len(hashes) < length:
        return np.empty(0, np.uint64)
    done, out, size, block = 0, None, 1, hashes
    n = len(hashes) - length + 1
    while True:
        if length & size:
            part = block[done:done + n]
            out = part.copy() if out is None else out * power(size) + part
            done += size
        size *= 2
        if size > length:
            return out
        half = size // 2
        block = block[:-half] * power(half) + block[half:]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
