"""Benchmark decontamination with an FM-index per shard of training documents.

A benchmark item's phrases are its windows of ``window`` consecutive words (the whole item where it has fewer). Every
shard of documents becomes a word-level FM-index: suffix order, a wavelet matrix over its Burrows-Wheeler transform,
and suffix positions sampled every ``SAMPLE`` words and after each break. All phrases are searched backwards at once;
their rows walk back to sampled positions, and the words that they cover are merged into removal spans.

The alphabet is the benchmark's words. A run of other words, and the end of a document, is one break symbol: no phrase
holds it, so nothing is lost, and the index is as much smaller. Breaks count as different from each other and are
ordered by position. Words are compared by 64-bit hash.

Defined cases: nulls and empty texts have no words, and such items no phrase; repeated rows and equal doc_ids stay
separate rows; equal items or item_ids count once each by id; an item_id that is null hits but isn't listed; empty
tables give no hits or no rows; other columns are ignored, whatever their names. ``clean`` judges each row by itself:
rows of null or equal doc_ids, and repeated rows, stay or go by their own texts, and rows without words stay. The phrases
are held in memory and sent to the executors only in blocks of at most ``BLOCK_WINDOWS`` windows; a larger benchmark takes
several passes over the documents, each written before the next block is read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ionweave.llm.common import ALNUM, Words, chunks, code_points, materialize, quoted, text_buffers, words_of

SAMPLE, SHARD_BYTES, BLOCK_WINDOWS = 16, 2 << 20, 1_000_000
OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


class WaveletMatrix:
    """rank(symbol, i): how often the symbol is among the first i, for arrays of queries."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = ((symbols >> level) & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        begin = np.zeros_like(i)
        for k, level in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[k], self.zeros[k]
            up = ((symbol >> level) & 1).astype(bool)
            a, b = ones[begin], ones[i]
            begin, i = np.where(up, zeros + a, begin - a), np.where(up, zeros + b, i - b)
        return i - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros(len(i), np.int64)
        for k, level in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = ones[i + 1] > ones[i]
            out |= bit.astype(np.int64) << level
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return out


def suffix_array(text: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; each break is a symbol of its own below all words, in order of position."""
    n = len(text)
    rank = text.astype(np.int64) + int(breaks.sum())
    rank[breaks] = np.arange(int(breaks.sum()))
    order = np.argsort(rank, kind="stable")
    width = 1
    unsettled = np.arange(n)  # places in order whose group isn't alone
    key = rank[order]
    while True:
        same = np.zeros(len(unsettled), bool)
        same[1:] = key[1:] == key[:-1]
        group = np.maximum.accumulate(np.where(same, 0, np.arange(len(unsettled))))
        rank[order[unsettled]] = unsettled[group]
        alone = ~same
        alone[:-1] &= ~same[1:]
        unsettled, group = unsettled[~alone], unsettled[group[~alone]]
        if not len(unsettled):
            return order
        at = order[unsettled]
        beyond = at + width
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        by = np.lexsort((second, group))
        order[unsettled] = at[by]
        key = group[by] * (n + 1) + second[by] + 1
        width *= 2


class FMIndex:
    """text: symbols from 1; 0 is a break."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        order = suffix_array(text, text == 0)
        before = text[order - 1]  # the text starts with a break, whose own predecessor is its last break
        self.bwt = WaveletMatrix(before, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.sampled = (before == 0) | (order % SAMPLE == 0)
        self.samples = order[self.sampled]
        self.before_sample = np.concatenate([[0], np.cumsum(self.sampled)])

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo:hi of the suffixes that start with each phrase (rows of ``phrases``, as long as ``lengths``)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            symbol = phrases[live, lengths[live] - 1 - step]
            lo[live] = self.first[symbol] + self.bwt.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.bwt.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            found = self.sampled[rows]
            out[live[found]] = self.samples[self.before_sample[rows[found]]] + steps
            live, rows = live[~found], rows[~found]
            symbol = self.bwt.access(rows)
            rows = self.first[symbol] + self.bwt.rank(symbol, rows)
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of the items, as symbols of their words, and the items that hold each."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases_of(items: list[tuple[str | None, str | None]], window: int) -> Phrases:
    data, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
    words = words_of(data, offsets, ALNUM, True)
    vocabulary = np.unique(words.hash)
    symbol = np.searchsorted(vocabulary, words.hash) + 1
    holders: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for (item, _), a, b in zip(items, words.docs[:-1].tolist(), words.docs[1:].tolist()):
        own = symbol[a:b].tolist()
        for k in range(max(1, len(own) - window + 1) if own else 0):
            holders[tuple(own[k : k + window])] |= {item} if item is not None else set()
    table = np.zeros((len(holders), window), np.int64)
    for k, w in enumerate(holders):
        table[k, : len(w)] = w
    return Phrases(vocabulary, symbol, table, np.fromiter(map(len, holders), np.int64, len(holders)), [sorted(x) for x in holders.values()])


def hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Which words any phrase covers, and the items found in each document."""
    docs, n = len(words.docs) - 1, len(words.start)
    found: list[set[str]] = [set() for _ in range(docs)]
    covered = np.zeros(n, bool)
    if not n or not len(phrases.windows):
        return covered, found
    at = np.searchsorted(phrases.vocabulary, words.hash)
    at[at == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[at] == words.hash
    # Breaks: one before each document's first known word and before each known word that follows another word.
    fresh = known.copy()
    fresh[1:] &= ~known[:-1]
    first = words.docs[:-1][words.docs[:-1] < n]
    fresh[first] = known[first]
    where = np.flatnonzero(known)
    place = np.arange(len(where)) + np.cumsum(fresh[where])
    text = np.zeros(len(where) + int(fresh.sum()), np.int64)
    source = np.zeros(len(text), np.int64)
    text[place], source[place] = at[where] + 1, where
    if not len(text):
        return covered, found
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.windows, phrases.lengths)
    count = hi - lo
    if not count.sum():
        return covered, found
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    begin = source[index.locate(rows)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + phrases.lengths[which], -1)
    covered = np.cumsum(edge[:-1]) > 0
    doc = np.searchsorted(words.docs, begin, side="right") - 1
    for pair in np.unique(doc * len(count) + which).tolist():
        found[pair // len(count)].update(phrases.items[pair % len(count)])
    return covered, found


def _search(docs: DataFrame, phrases: Phrases, with_items: bool, carried: str = "doc_id") -> DataFrame:
    """``carried``: a column that stands beside each row's result. ``with_items``: the items themselves instead of their digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, SHARD_BYTES):
                raw = data[offsets[i] : offsets[j]]
                words = words_of(raw, offsets[i : j + 1] - offsets[i], ALNUM, True)
                covered, found = hits(words, phrases)
                total = np.concatenate([[0], np.cumsum(covered)])
                n_hit = total[words.docs[1:]] - total[words.docs[:-1]]
                points = code_points(raw) if covered.any() else None
                spans = []
                for d, (a, b) in enumerate(zip(words.docs[:-1].tolist(), words.docs[1:].tolist())):
                    if not n_hit[d]:
                        spans.append([])
                        continue
                    c = np.concatenate([[False], covered[a:b], [False]])
                    lo, hi = np.flatnonzero(c[1:] & ~c[:-1]), np.flatnonzero(~c[1:] & c[:-1]) - 1
                    base = points[offsets[i + d] - offsets[i]]
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(points[words.start[a + lo]] - base, points[words.end[a + hi]] - base)])
                lists = [sorted(x) for x in found]
                cols = [
                    batch.column(0).slice(i, j - i), pa.array(np.diff(words.docs)), pa.array(n_hit), pa.array([len(x) for x in lists], pa.int64()),
                    pa.array(lists, pa.list_(pa.string())) if with_items else pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()), pa.array(n_hit > 0),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[carried, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    rows = docs.select(F.col(carried), F.col("text").cast("string"))
    out = OUT.replace("items_sha256 string", "items_sha256 array<string>") if with_items else OUT
    return rows.mapInArrow(scan, StructType([StructField(carried, rows.schema[0].dataType), *StructType.fromDDL(out)]))


def item_blocks(benchmark: DataFrame, window: int, most: int = BLOCK_WINDOWS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items a block at a time, of about ``most`` words each (a longer item alone)."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").toLocalIterator():
        words = len(r.t) // 2 + 1
        if block and size + words > most:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += words
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its words, hit words, items found and merged removal spans (code points).

    One pass over the documents where the benchmark fits a block, with no shuffle. Several blocks are searched one
    after another and their spans merged: there, what a block finds in each document is one row, and rows are told
    apart by a number that is written with them.
    """
    blocks = item_blocks(benchmark, window, block_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _search(docs.select(F.col("doc_id").cast("long"), "text"), phrases_of(first, window), False)
    from itertools import chain

    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")), "rows")
    passes = None
    for block in chain([first, second], blocks):
        # Written, so that the driver holds one block's phrases.
        own = materialize(_search(keyed, phrases_of(block, window), True, "row").where("contaminated").select("row", "spans", "items_sha256"), "pass")
        passes = own if passes is None else passes.unionByName(own)
    spans = passes.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items_sha256")).alias("items"))
    return _merged(keyed.join(spans, "row", "left"))


def _merged(rows: DataFrame) -> DataFrame:
    """Spans of several passes over the same text become one set, and what they cover is counted again."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            words = words_of(data, offsets, ALNUM, True)
            points = code_points(data)
            out = []
            for k, (doc_id, spans, items) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = words.docs[k], words.docs[k + 1]
                start, end = points[words.start[a:b]] - points[offsets[k]], points[words.end[a:b]] - points[offsets[k]]
                edge = np.zeros(b - a + 1, np.int64)
                for s in spans or []:
                    edge[np.searchsorted(start, s["start"])] += 1
                    edge[np.searchsorted(end, s["end"]) + 1] -= 1
                c = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                lo, hi = np.flatnonzero(c[1:] & ~c[:-1]), np.flatnonzero(~c[1:] & c[:-1]) - 1
                names = sorted(set(items or []))
                out.append({"doc_id": doc_id, "n_words": int(b - a), "n_hit": int(c.sum()), "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "contaminated": bool(c.any()), "spans": [{"start": int(start[x]), "end": int(end[y])} for x, y in zip(lo, hi)]})
            if out:
                kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.select("doc_id", "text", "spans", "items").mapInArrow(merge, f"doc_id long, {OUT}")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no phrase of the benchmark. No shuffle: each block of the
    benchmark is one pass that lets the rows it doesn't hit through; what passes all blocks but the last is written."""
    blocks = item_blocks(benchmark, window, block_windows)
    block = next(blocks)
    while True:
        whole = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col("text"))
        kept = _search(whole, phrases_of(block, window), True, "row").where("not contaminated").select("row.*")
        block = next(blocks, None)
        if block is None:
            return kept
        docs = materialize(kept, "kept")
