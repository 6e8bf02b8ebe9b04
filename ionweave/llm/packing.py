"""Best-fit packing of tokenised documents by length histogram.

The plan is made over counts of pieces per length, at most ``capacity`` of them, whatever the number of documents; the
pieces then take the planned slots by joining on their rank within their length. Only the histogram (at most
``capacity`` rows) comes to the driver.

Defined cases: a null or empty text is one piece that holds the end token alone; a text over ``capacity`` tokens is cut
from its end into full pieces, so that its first piece may be shorter; equal lengths are ranked by (doc_id, piece, ids),
rows that are equal in all of it are exchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import materialize
from ionweave.llm.tokens import encoder, merges_agree, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that are ranked together, and slots that one planned row stands for, at most about.
RANK_ROWS, SLOT_ROWS = 5_000, 20_000


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece of each document: its place in the document's ids, its length and their checksum."""
    same = merges_agree(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, same)
        for batch in batches:
            doc_id = batch.column(0)
            for ids, offsets, i, j in enc.encode(batch.column(1)):
                sizes = np.diff(offsets)
                full = np.insert(ids, offsets[1:], end_id).astype("<u4")
                begin = (offsets[:-1] + np.arange(j - i)).tolist()
                row, piece, start, length, crc = [], [], [], [], []
                raw = memoryview(full.tobytes())
                for d, n in enumerate((sizes + 1).tolist()):
                    at, k, short = 0, 0, n % capacity or capacity
                    while at < n:
                        size = short if at == 0 else capacity
                        row.append(d)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * (begin[d] + at) : 4 * (begin[d] + at + size)]))
                        at, k = at + size, k + 1
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(i, j - i).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, slots, first sequence, offset) of runs of slots.

    Sequences with the same room left are runs of consecutive numbers; a run of pieces takes whole runs of the least room
    that holds it and splits the last.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect.bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[at]
            used = min(n, left)
            out.append((length, rank, used, first, capacity - room))
            leave(room - length, first, used)
            if used < n:
                leave(room, first + used, n - used)
            rank, left = rank + used, left - used
        each = capacity // length
        whole, part = divmod(left, each)
        for first, n, k in ((sequences, whole, each), (sequences + whole, 1, part)):
            if n and k:
                for i in range(k):
                    out.append((length, rank, n, first, i * length))
                    rank += n
                leave(capacity - k * length, first, n)
                sequences += n
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and the offset that each takes."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary or vocabulary_path(), capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    # At most ``capacity`` rows: a common length is ranked in many blocks.
    blocks = F.broadcast(spark.createDataFrame([(length, -(-n // RANK_ROWS)) for length, n in counts.items()], "length long, blocks long"))
    runs = spark.createDataFrame(plan(counts, capacity), "length long, rank long, n long, first long, offset long")
    # Runs are split into parts of SLOT_ROWS slots, which are dealt evenly, and then into slots.
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_ROWS).cast("long"))).alias("at")
    parts = runs.select("*", step).select("length", F.col("rank") + F.col("at"), F.least(F.col("n") - F.col("at"), F.lit(SLOT_ROWS)), F.col("first") + F.col("at"), "offset").toDF("length", "rank", "n", "first", "offset")
    slots = (
        parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        .select("length", "rank", "first", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
        .select("length", (F.col("rank") + F.col("k")).alias("rank"), (F.col("first") + F.col("k")).alias("sequence_id"), "offset")
    )
    dealt = pieces.join(blocks, "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks"))).drop("blocks")
    before = (
        dealt.groupBy("length", "block")
        .count()
        .select("length", "block", (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    )
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        dealt.withColumn("in_block", F.row_number().over(within) - 1)
        .join(before, ["length", "block"])
        .withColumn("rank", F.col("before") + F.col("in_block"))
        .drop("block", "before", "in_block")
    )
    return ranked.join(slots, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
