"""What the text operators share: vectorised word tables over Arrow string buffers, hashing, tables in the shared folder.

Nulls count as empty texts everywhere. Memory of the numpy helpers follows one chunk of documents
(``CHUNK_BYTES``, or the longest single document where that is larger), never a whole partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ionweave.tables import delete_folder, written

CHUNK_BYTES = 2 << 20
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again. The files go with ``discard``, or when the driver's JVM ends."""
    return written(df, name)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        delete_folder(df.sparkSession, df.written_at)


def quoted(names: list[str]) -> list[str]:
    """Column names for ``select`` and ``struct``, dots and backticks in them included."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of documents of about ``most`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_class(word: str) -> np.ndarray:
    """Lookup table of bytes that belong to words; ``word`` is 'alnum' (letters, digits and all non-ASCII) or 'nonspace'."""
    table = np.ones(256, dtype=bool)
    if word == "alnum":
        for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
            table[lo : hi + 1] = False
    else:
        table[[0x20, *range(0x09, 0x0E)]] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM, NONSPACE = byte_class("alnum"), byte_class("nonspace")


@dataclass
class Words:
    """Words of a run of documents: byte spans, 64-bit hashes, and ``docs[i]:docs[i+1]`` the words of document i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    docs: np.ndarray


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time over all spans."""
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))
    h = length.astype(np.uint64) * C1
    which, j = np.arange(len(start)), 0
    while len(which):
        s = start[which] + 8 * j
        h[which] = mix(h[which] ^ (at[s] & _MASKS[np.minimum(end[which] - s, 8)]))
        j += 1
        which = which[length[which] > 8 * j]
    return h


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> Words:
    """Maximal runs of the table's bytes within each document; ``lower`` folds A-Z first."""
    if lower:
        data = LOWER[data]
    is_word = table[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    inner = offsets[(offsets < n)]
    before[inner] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    inner = offsets[offsets > 0]
    after[inner - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    return Words(data, start, end, hash_spans(data, start, end), np.searchsorted(start, offsets))


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, with the total last."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
