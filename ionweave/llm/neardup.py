"""Near duplicates by Order MinHash, verified by banded alignment.

Words (letters and digits, A-Z folded) form shingles of five; each carries its occurrence number within the text. Each of
``SKETCHES`` seeds takes the ``TUPLE`` least shingles by hash and keeps them in text order; texts that share a tuple meet
in a bucket. Equal texts are one node from the start, so copies never meet as pairs. A link counts if a banded alignment
of the words finds an edit similarity (one less the edit distance over the longer text's words) of ``SIMILARITY`` or more;
lower bounds of the distance from common words and word pairs only spare alignments that can't succeed.

In each bucket a hub, the text that shares most with others, stands for it: texts are first tried against the two hubs
that they meet most often. Buckets that still hold several classes are then searched whole, in blocks of ``BLOCK`` texts
against ``BLOCK``: counts of words by hash bound the distance of each two texts of different classes, which the bound
rules out or the alignment decides, and what leaves a block is at most one link a text. No pair is tried in two buckets.
That is exact, and its memory is one block's; where many texts of a bucket are alike in a passage but not as a whole, its
time is the square of their number, at about a microsecond a pair. Classes are connected components by alternating stars.

Defined cases: a null text, or one without words, equals no other; texts of under five words equal only the same words;
repeated rows are rows of the result; rows are told apart by a number that is written with them, so that doc_ids may be
null or repeat; a class without any doc_id has a null class_id; an empty table gives an empty result; other columns are
ignored. Nothing of the documents is collected; loops read one sum a round.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ionweave.llm.common import ALNUM, C1, chunks, discard, materialize, mix, quoted, text_buffers, words_of

SHINGLE, TUPLE, SKETCHES, SIMILARITY, FIRST_HUBS = 5, 3, 24, 0.8, 2
#: Texts of a block, counters of each, and copies of a hub's words, so that its pairs are not all in one task.
BLOCK, COUNTERS, COPIES = 512, 512, 8


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hash of every five consecutive words of one text."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * C1
    for k in range(1, SHINGLE):
        h = mix(h ^ words[k : k + n]) if k % 2 == 0 else (h ^ words[k : k + n]) * C1
    return mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles made distinct by their occurrence number, counted in text order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(s))
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    out = h.copy()
    out[order] = np.where(number > 0, mix(s + number.astype(np.uint64) * C1), s)
    return out


def order_minhash(words: np.ndarray, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """One hash for each seed: the ``size`` least labelled shingles, in text order."""
    h = labelled(shingles(words))
    if not len(h):
        return np.zeros(0, np.uint64)
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * C1)
    k = min(size, len(h))
    chosen = np.empty((sketches, k), np.int64)
    rows = max(1, (1 << 20) // len(h))
    for i in range(0, sketches, rows):
        v = (h[None, :] ^ seeds[i : i + rows, None]) * C1
        v ^= v >> np.uint64(32)
        chosen[i : i + rows] = np.argpartition(v, k - 1, axis=1)[:, :k] if k < len(h) else np.arange(k)
    chosen.sort(axis=1)
    out = seeds.copy()
    for j in range(k):
        out = mix(out ^ h[chosen[:, j]])
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """row, doc_id, node (128-bit hash of the words), number of words, their 32-bit hashes and the sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in chunks(offsets):
                words = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM, True)
                rows = batch.column(0).slice(i, j - i)
                nodes, keys, short = [], [], []
                for row, a, b in zip(rows.to_pylist(), words.docs[:-1].tolist(), words.docs[1:].tolist()):
                    own = words.hash[a:b]
                    nodes.append(xxhash.xxh128_digest(own.tobytes() if b > a else f"none {row}".encode()))
                    keys.append(order_minhash(own).view(np.int64))
                    short.append((own >> np.uint64(32)).astype(np.uint32).tobytes() if len(keys[-1]) else None)
                flat = np.concatenate([np.zeros(0, np.int64), *keys])
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows, batch.column(1).slice(i, j - i), pa.array(nodes, pa.binary()), pa.array(np.diff(words.docs), pa.int64()), pa.array(short, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["row", "doc_id", "node", "n_words", "words", "keys"],
                )

    kept = docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "row long, doc_id long, node binary, n_words long, words binary, keys array<long>")


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else ``most`` + 1: bit-parallel dynamic programming
    (Hyyrö 2003) in a band of that half-width around the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    lo = 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    a, b = a[lo:ha], b[lo:hb]
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    most = min(most, len(a))
    width = 2 * most + 2
    full = (1 << width) - 1
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    vp, vn = (full << (width - most - 1)) & full, 0
    distance, start = most, most + 1 - width
    diagonal, horizontal = 1 << (width - 1), 1 << (width - 2)
    for i, y in enumerate(b):
        match, own = 0, places.get(y)
        if own:
            for p in own[bisect_left(own, start) :] if start > 0 else own:
                if p - start >= width:
                    break
                match |= 1 << (p - start)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp, hn = vn | (~(d0 | vp) & full), d0 & vp
        if i < len(a) - most:
            distance += not d0 & diagonal
        else:
            distance += bool(hp & horizontal) - bool(hn & horizontal)
            horizontal >>= 1
        half = d0 >> 1
        vp, vn = (hn | ~(half | hp)) & full, half & hp
        start += 1
    return distance if distance <= most else most + 1


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: an edit takes one common word at most, and two common pairs of words."""
    bound = 0
    for x, y, taken in ((a, b, 1), (_pairs(a), _pairs(b), 2)):
        kinds, which = np.unique(np.concatenate([x, y]), return_inverse=True)
        common = np.minimum(np.bincount(which[: len(x)], minlength=len(kinds)), np.bincount(which[len(x) :], minlength=len(kinds))).sum()
        bound = max(bound, -(-(max(len(x), len(y)) - int(common)) // taken))
    return bound


def _pairs(words: np.ndarray) -> np.ndarray:
    w = words.astype(np.uint64)
    return (w[:-1] << np.uint64(32)) | w[1:]


def most_edits(n: np.ndarray | int, least: float = SIMILARITY):
    """Edits that texts of up to ``n`` words may differ by."""
    return np.floor((1 - least) * n + 1e-9).astype(np.int64) if isinstance(n, np.ndarray) else int((1 - least) * n + 1e-9)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two texts (32-bit word hashes) are near duplicates; bands widen up to the widest that could pass."""
    limit = most_edits(max(len(a), len(b)), least)
    bound = least_distance(a, b)
    if bound > limit:
        return False
    a, b, band = a.tolist(), b.tolist(), max(8, bound)
    while True:
        band = min(band, limit)
        if edit_distance(a, b, band) <= band:
            return True
        if band == limit:
            return False
        band *= 4


def _words(column: pa.Scalar) -> np.ndarray:
    return np.frombuffer(column.as_buffer(), np.uint32)


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (node, hub) whose words align, as links (u, v). Words are copied for hubs, which have many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([similar(_words(a), _words(b)) for a, b in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    part = F.pmod(F.xxhash64("node"), F.lit(COPIES)).cast("int").alias("part")
    own = pairs.join(words, "node").select("node", "hub", F.col("words").alias("a"), part)
    hubs = words.join(pairs.select(F.col("hub").alias("node")).distinct(), "node", "left_semi")
    hubs = hubs.select(F.col("node").alias("hub"), F.col("words").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("part"))
    return own.join(hubs, ["hub", "part"]).select("node", "hub", "a", "b").mapInArrow(run, "u binary, v binary")


def _marked(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``edges`` written, with their number and the sum of their hashes, which are counted as they are written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), name)
    return out, (seen.get["n"], seen.get["s"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node in ``links`` (u, v) but the roots: alternating large and small stars, until a round changes nothing."""
    edges, seen = _marked(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after, now = _marked(small, "stars")
        discard(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(rows: DataFrame, found: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    return rows.join(found.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col(node) == F.col("_n"), "left").withColumn(root, F.coalesce("_r", node)).drop("_n", "_r")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links: components of the classes that they join, put in place of those classes' roots."""
    between = _rooted(_rooted(links, found, "u", "ru"), found, "v", "rv").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    more = components(between)
    moved = _rooted(found.withColumnRenamed("root", "old"), more, "old", "root").select("node", "root")
    return materialize(moved.unionByName(more), "classes")


def counters(words: list[np.ndarray]) -> np.ndarray:
    """Each text's words counted by hash in COUNTERS places, to 255 at most."""
    out = np.zeros((len(words), COUNTERS), np.int16)
    for k, w in enumerate(words):
        out[k] = np.minimum(np.bincount(w % COUNTERS, minlength=COUNTERS), 255)
    return out


def block_links(key: int, words: list[np.ndarray], keys: np.ndarray, classes: np.ndarray, left: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join the classes of a block's texts: all pairs of different classes are tried that have no bucket before
    this one (``keys``: buckets of each text, in order of seeds). ``left``: with two blocks, which texts are of the first;
    only pairs between the blocks are tried then."""
    n = np.array([len(w) for w in words])
    order = np.argsort(n, kind="stable")
    n, keys, classes = n[order], keys[order], classes[order].copy()
    left = None if left is None else left[order]
    sizes = counters([words[k] for k in order])
    edits = most_edits(n)
    shortest = n - edits  # rises with n: texts of up to these words may be similar
    out = []
    for k in range(len(n) - 1):
        near = np.arange(k + 1, int(np.searchsorted(shortest, n[k], side="right")))
        near = near[classes[near] != classes[k]]
        if left is not None:
            near = near[left[near] != left[k]]
        if not len(near):
            continue
        apart = np.abs(sizes[near] - sizes[k]).sum(axis=1, dtype=np.int64)
        bound = (n[near] - n[k] + apart + 1) // 2
        near, bound = near[bound <= edits[near]], bound[bound <= edits[near]]
        if len(near):
            same = keys[near] == keys[k]
            first = keys[k][same.argmax(axis=1)] == key
            near, bound = near[first], bound[first]
        for x in near[np.argsort(bound, kind="stable")].tolist():
            if classes[x] != classes[k] and similar(words[order[k]], words[order[x]]):
                out.append((int(order[k]), int(order[x])))
                classes[classes == classes[x]] = classes[k]
    return out


def bucket_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links among ``members`` (key, node, root) of each bucket that join different roots. ``texts``: node, words, keys.

    Each block of a bucket meets each other once, in one task's memory; what is shuffled is a text's words for each of its
    bucket's blocks.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.select("key", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    own = own.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("left"), "node", "root")
    dealt = own.join(texts, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def links_of(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        node, root = t["node"].to_pylist(), t["root"].to_pylist()
        number = {r: k for k, r in enumerate(dict.fromkeys(root))}
        left = None if t["i"][0].as_py() == t["j"][0].as_py() else t["left"].to_numpy()
        keys = np.stack([x.values.to_numpy() for x in t["keys"]])
        found = block_links(t["key"][0].as_py(), [_words(w) for w in t["words"]], keys, np.array([number[r] for r in root]), left)
        return pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in found], pa.binary()), pa.array([node[y] for _, y in found], pa.binary())], names=["u", "v"]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def groups(table: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
            """Links of the groups that have ended; the last one waits for the next batch."""
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            ends = [*cuts[1:], table.num_rows]
            for a, b in zip(cuts, ends) if final else zip(cuts[:-1], ends[:-1]):
                if (out := links_of(table.slice(a, b - a))) is not None:
                    yield out
            held[:] = [] if final else [table.slice(cuts[-1])]

        for batch in batches:
            if batch.num_rows:
                yield from groups(pa.concat_tables([*held, pa.Table.from_batches([batch])]), False)
        if held:
            yield from groups(held[0], True)

    return dealt.select("key", "i", "j", "left", "node", "root", "words", "keys").mapInArrow(run, "u binary, v binary")


def classed(nodes: DataFrame, words_of_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (u, v), and (node, root) of what they connect: in the end every two texts of a bucket are in one
    class or have been tried. ``nodes``: node, n_words, keys and row, whose words are in ``words_of_rows`` (row, words)."""
    keyed = nodes.select("node", "n_words", F.explode(F.array_distinct("keys")).alias("key"))
    met = materialize(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "met")
    # A text that many others derive from shares more and larger buckets than they do among themselves.
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    members = materialize(met.drop("n").join(weight, "node"), "members")
    discard(met)
    wanted = nodes.select("node", "row", "keys").join(members.select("node").distinct(), "node", "left_semi")
    texts = materialize(words_of_rows.select("row", "words").join(wanted, "row").select("node", "words", "keys"), "texts")
    # A bucket's hub, and with each other text the hubs that it meets most often.
    best = F.max_by(F.struct("node", "n_words"), F.struct("weight", F.xxhash64("node", "key"), "node"))
    hubs = members.groupBy("key").agg(best.alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.n_words").alias("hub_words"))
    longer = F.greatest("n_words", "hub_words")
    pairs = members.join(hubs, "key").where((F.col("node") != F.col("hub")) & (longer - F.least("n_words", "hub_words") <= F.floor((1 - SIMILARITY) * longer + 1e-9)))
    ranked = pairs.groupBy("node", "hub").agg(F.count("*").alias("n")).withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "hub")))
    # Of two hubs that name each other one pair stays.
    chosen = ranked.where(F.col("nth") <= FIRST_HUBS).groupBy(F.greatest("node", "hub"), F.least("node", "hub")).agg(F.min(F.struct("node", "hub")).alias("p"))
    chosen = materialize(chosen.select("p.*"), "pairs")
    links = materialize(verified(chosen, texts.select("node", "words")), "verified")
    discard(chosen)
    found = components(links)
    now = _rooted(members.select("key", "node"), found)
    open_keys = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    rest = materialize(bucket_links(now.join(open_keys, "key", "left_semi"), texts), "verified")
    discard(members, texts)
    every = links.unionByName(rest).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return every, merged(found, rest)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written rows of ``docs`` (row, doc_id, text) with their node, and by node: class_id, class_size, n_links and
    ``keep``, the class's one row of the least doc_id."""
    sketches = materialize(sketched(docs), "sketches")
    rows = materialize(sketches.select("row", "doc_id", "node"), "rows")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "row"))
    nodes = sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"), first.alias("first"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    nodes = materialize(nodes.withColumn("row", F.col("first.row")), "nodes")
    links, found = classed(nodes, sketches)
    discard(sketches)
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    rooted = _rooted(nodes.select("node", "doc_id", "first", "n"), found)
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"), F.min("first").alias("keep"))
    by_node = rooted.select("node", "root").join(classes, "root").join(degree, "node", "left")
    return rows, by_node.select("node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("keep.row").alias("keep"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size (rows) and n_links (verified links that joined its text to others) of each row."""
    rows, by_node = _classes(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    return rows.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "class_size", "n_links")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, with all its columns: the one of the least doc_id (null last; of several rows with
    it, the first as read). A row without words is a class of its own."""
    whole = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*quoted(docs.columns)).alias("doc")), "rows")
    rows, by_node = _classes(whole.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")))
    others = rows.select("row", "node").join(by_node.select("node", "keep"), "node").where("row <> keep").select("row")
    return whole.join(others, "row", "left_anti").select("doc.*")
