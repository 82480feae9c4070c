"""Words of a batch of texts as numbers, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACE_BYTES = " \t\n\x0b\x0c\r"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def split_batch(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the batch one after another, and the place where each text's words begin (one more at the end)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    texts = pc.ascii_trim(texts, characters=SPACE_BYTES)
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    words = lists.flatten()
    none = np.asarray(pc.equal(texts, "")).astype(bool)
    if none.any():
        words = words.filter(pa.array(np.repeat(~none, sizes)))
        sizes = np.where(none, 0, sizes)
    return words, np.concatenate([[0], np.cumsum(sizes)])


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes of text, one text at least."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64))
        at = 0
        while at < b.num_rows:
            begun = ends[at - 1] if at else 0
            to = min(b.num_rows, max(at + 1, int(np.searchsorted(ends, begun + most, side="right"))))
            yield b.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word; equal words have equal hashes in every batch."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    values = np.asarray(coded.dictionary.to_numpy(zero_copy_only=False), dtype=object)
    table = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)
    return table[np.asarray(coded.indices)]
