"""Token counts of flat token files without an index, by scanning for the end-of-document id.

A flat file is a run of unsigned ids; documents are what end ids close. Files are read by byte ranges of a fixed number of
ids, each range by whichever task has it and scanned at once with numpy; what a document has in several ranges is stitched
by a prefix scan over the ranges' summaries (ids after the last end, ends so far), never by reading a file in order. One
row a document leaves. A task holds one range, whatever a file's size. Ranges are read through ``pyarrow.fs`` (local paths,
HDFS, S3, GCS); files in another store are read whole by Spark's ``binaryFile``, which takes up to 2 GB a file.

Defined cases: a file that doesn't end with an end id has an open last document, which is counted and marked; two end
ids in a row close an empty document; an empty file has no documents; a file that ends within an id, or an id too large
for ``width``, is an error; a null or empty text is a document of 0 ids; special tokens' strings in texts are ordinary
text, so that only ends are end ids; repeated rows and null doc_ids are documents of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.llm.common import materialize
from ionweave.llm.tokens import encoder, merges_agree, vocabulary_path
from ionweave.tables import delete_folder, new_folder

BLOCK_IDS = 1 << 18
FOUND = "file string, block long, n_ends long, n_ids long, tail long, doc_no long, at long, gap long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; an ArrowInvalid or NotImplementedError where pyarrow has none."""
    return fs.FileSystem.from_uri(re.sub(r"^([a-z][a-z0-9+.-]*):/(?!/)", r"\1:///", path))


def reachable(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, NotImplementedError, OSError):
        return False
    return True


def write_flat(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 50256, width: str = "<u2") -> DataFrame:
    """Writes ``docs`` as flat token files under ``folder``, one file a task, and returns the writer's log (file, doc_no, doc_id).

    A task that is run again writes another file; the log, which is a written table, names only those that count.
    """
    path = vocabulary or vocabulary_path()
    same, most = merges_agree(path), np.iinfo(np.dtype(width)).max

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, same, False)
        store, inside = opened(folder)
        file, out, doc_no = f"{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            for ids, offsets, _, _ in enc.encode(batch.column(1)):
                if out is None:
                    store.create_dir(inside, recursive=True)
                    out = store.open_output_stream(f"{inside}/{file}")
                flat = np.insert(ids, offsets[1:], end_id)
                if flat.max(initial=0) > most:
                    raise ValueError(f"id {flat.max()} doesn't fit {width}")
                out.write(flat.astype(width).tobytes())
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([file] * batch.num_rows), pa.array(np.arange(doc_no, doc_no + batch.num_rows)), batch.column(0)], names=["file", "doc_no", "doc_id"])
            doc_no += batch.num_rows
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(write, "file string, doc_no long, doc_id long"), "log")


def flat_blocks(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, width: str = "<u2") -> DataFrame:
    """(path, block, length, content) of each range of the flat files under ``path``; content is null where ranges are read by path."""
    size = block_ids * np.dtype(width).itemsize
    files = spark.read.format("binaryFile").load(path)
    whole = F.lit(None).cast("binary") if reachable(path) else F.col("content")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))
    ranges = files.where("length > 0").select("path", "length", whole.alias("content"), blocks.alias("block"))
    part = F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})")
    return ranges.select("path", "block", "length", part.alias("content")).repartition(F.col("path"), F.col("block"))


def count_documents(blocks: DataFrame, end_id: int = 50256, block_ids: int = BLOCK_IDS, width: str = "<u2") -> DataFrame:
    """(file, doc_no, start, n_tokens, open) of each document in ``blocks``; the end id isn't counted. ``file`` is a path's last name."""
    item = np.dtype(width).itemsize
    size = block_ids * item

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, length, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if length % item:
                    raise ValueError(f"{path}: {length} bytes are no whole ids of {item}")
                if content.is_valid:
                    raw = content.as_buffer()
                else:
                    store, inside = opened(path)
                    with store.open_input_file(inside) as f:
                        f.seek(number * size)
                        raw = f.read_buffer(min(size, length - number * size))
                ids = np.frombuffer(raw, dtype=width)
                at = np.flatnonzero(ids == end_id)
                k = len(at)
                # One row for each end, and one more for the block itself with what follows its last end.
                gap = np.diff(at, prepend=-1) - 1
                cols = [
                    pa.array([path.rsplit("/", 1)[-1]] * (k + 1)), pa.array(np.full(k + 1, number)), pa.array(np.full(k + 1, k)), pa.array(np.full(k + 1, len(ids))),
                    pa.array(np.full(k + 1, len(ids) - (at[-1] + 1 if k else 0))),
                    pa.array(np.append(np.arange(k), -1)), pa.array(np.append(at, -1)), pa.array(np.append(gap, -1)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) if i else c for i, c in enumerate(cols)], names=[x.split()[0] for x in FOUND.split(", ")])

    found = materialize(blocks.select("path", "block", "length", "content").mapInArrow(scan, FOUND), "ends")
    summary = found.where("doc_no = -1").select("file", "block", "n_ends", "n_ids", "tail")
    in_order = Window.partitionBy("file").orderBy("block")
    stitched = (
        summary.withColumn("group", F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).over(in_order))
        .withColumn("docs_before", F.sum("n_ends").over(in_order) - F.col("n_ends"))
        .withColumn("ids_before", F.sum("n_ids").over(in_order) - F.col("n_ids"))
        # Ids left open after a block: its tail, and before it those of the blocks back to the last one with an end.
        .withColumn("left_open", F.sum("tail").over(Window.partitionBy("file", "group").orderBy("block")))
        .withColumn("carried", F.lag("left_open", 1, 0).over(in_order))
    )
    ends = (
        found.where("doc_no >= 0")
        .join(stitched.select("file", "block", "docs_before", "ids_before", "carried"), ["file", "block"])
        .withColumn("carry", F.when(F.col("doc_no") == 0, F.col("carried")).otherwise(F.lit(0)))
        .select("file", (F.col("docs_before") + F.col("doc_no")).alias("doc_no"), (F.col("ids_before") + F.col("at") - F.col("gap") - F.col("carry")).alias("start"), (F.col("gap") + F.col("carry")).alias("n_tokens"), F.lit(False).alias("open"))
    )
    last = (
        stitched.withColumn("later", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))))
        .where("later = 1")
        .withColumn("n_tokens", F.col("left_open"))
        .where("n_tokens > 0")
        .select("file", (F.col("docs_before") + F.col("n_ends")).alias("doc_no"), (F.col("ids_before") + F.col("n_ids") - F.col("n_tokens")).alias("start"), "n_tokens", F.lit(True).alias("open"))
    )
    return ends.unionByName(last)


def document_tokens(docs: DataFrame, vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, file, doc_no, start, n_tokens) of ``docs`` after writing them flat and scanning the files, which are then deleted."""
    spark = docs.sparkSession
    folder = new_folder(spark, "flat")
    log = write_flat(docs, folder, vocabulary)
    if log.isEmpty():
        return log.select("doc_id", "file", "doc_no", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    counts = count_documents(flat_blocks(spark, folder, block_ids), block_ids=block_ids)
    delete_folder(spark, folder)
    return counts.join(log, ["file", "doc_no"]).select("doc_id", "file", "doc_no", "start", "n_tokens")
