"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Each text gives counts (words, symbols, repeated lines and words); each group (lang, source) gives one sketch for every
rate made of them: counts by logarithmic bucket, whose sums are the sketch of the union, whatever the order (relative
error ``ERROR``). Groups under ``min_rows`` texts take the sketch of their language, and that failing the one of all texts;
both are sums of the groups' sketches. Fences around the median replace fixed cutoffs, and texts are judged by a join
with their group's fences.

Defined cases: a null or empty text has no words and fails the base rule; a null lang or source is a group of its own;
repeated rows count and are judged each; an empty table gives an empty result; a rate without words is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import C1, NONSPACE, chunks, code_points, hash_spans, mix, text_buffers, words_of

ERROR, SCALE = 0.01, 1000.0
GAMMA = math.log((1 + ERROR) / (1 - ERROR))
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Rate: the least spread that its fences take (absolute, relative to the median), where quartiles are closer, and whether
#: there is a lower fence. With SPREADS of them: 4% symbols, half the lines, 0.4 of the words repeated, and 0.8 letters
#: and 0.16 of the median off the usual length of a word.
RATES = {"symbol_rate": (0.005, 0.0, False), "dup_line_rate": (0.0625, 0.0, False), "repeat_rate": (0.05, 0.0, False), "word_length": (0.1, 0.02, True)}
SPREADS = 8.0


def text_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of COUNTS for each document."""
    docs = len(offsets) - 1
    words = words_of(data, offsets, NONSPACE, False)
    n = np.diff(words.docs)
    points = code_points(data)
    chars = np.concatenate([[0], np.cumsum(points[words.end] - points[words.start])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    own = np.repeat(np.arange(docs), n)
    # Words in three-word windows that the text holds twice or more.
    begin = np.flatnonzero(own[2:] == own[:-2]) if len(own) > 2 else np.zeros(0, np.int64)
    h = words.hash
    key = mix(mix(mix(h[begin] + C1) ^ h[begin + 1]) ^ h[begin + 2]) ^ mix(own[begin].astype(np.uint64))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = begin[count[inverse] > 1]
    covered = np.zeros(len(own) + 2, bool)
    for k in range(3):
        covered[twice + k] = True
    repeated = np.concatenate([[0], np.cumsum(covered[: len(own)])])
    # Lines with a word that equal an earlier line of the text.
    filled = offsets[:-1][np.diff(offsets) > 0]
    start = np.unique(np.concatenate([filled, np.flatnonzero(data == 10) + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data)).astype(np.int64)
    end -= (end > start) & (data[end - 1] == 10) if len(end) else 0
    nonspace = np.concatenate([[0], np.cumsum(NONSPACE[data])])
    has = nonspace[end] > nonspace[start]
    start, end = start[has], end[has]
    line_doc = np.searchsorted(offsets, start, side="right") - 1
    line_key = hash_spans(data, start, end) ^ mix(line_doc.astype(np.uint64))
    _, first = np.unique(line_key, return_index=True)
    later = np.ones(len(start), bool)
    later[first] = False
    return [n, chars[words.docs[1:]] - chars[words.docs[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], np.bincount(line_doc, minlength=docs), np.bincount(line_doc[later], minlength=docs), repeated[words.docs[1:]] - repeated[words.docs[:-1]]]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for i, j in chunks(offsets):
                counts = text_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["doc_id", "lang", "source", *(x.split()[0] for x in COUNTS.split(", "))])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return kept.mapInArrow(count, f"doc_id long, lang string, source string, {COUNTS}")


def rates() -> dict[str, Column]:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_rate": over("n_symbols", "word_chars"), "dup_line_rate": over("n_dup_lines", "n_lines"), "repeat_rate": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words")}


def bucket_of(rate: Column) -> Column:
    return F.ceil(F.log(rate * SCALE + 1.0) / GAMMA).cast("int")


def value_of(bucket: Column) -> Column:
    """The middle of a bucket."""
    return F.when(bucket == 0, F.lit(0.0)).otherwise((F.exp(bucket * GAMMA) * F.lit(2 / (1 + math.exp(GAMMA))) - 1.0) / SCALE)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): one mergeable sketch for each group and rate; only sums are shuffled."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), bucket_of(v).alias("bucket")) for k, v in rates().items())))
    return counts.select("lang", "source", pairs.alias("x")).groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str], least_rows: int) -> DataFrame:
    """Lower and upper fence for each group of ``keys`` with at least ``least_rows`` texts, from merged sketches."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "rate").orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*keys, "rate"))
    ranked = merged.withColumn("upto", upto).withColumn("total", total)
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, value_of(F.col("bucket"))))
    kinds = F.col("rate")
    quart = ranked.where(F.col("total") >= least_rows).groupBy(*keys, "rate").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    floor_of = F.coalesce(*(F.when(kinds == k, F.lit(a) + F.lit(r) * F.col("q2")) for k, (a, r, _) in RATES.items()))
    return quart.select(
        *keys, "rate",
        F.when(kinds.isin([k for k, (*_, low) in RATES.items() if low]), F.col("q2") - SPREADS * F.greatest(F.col("q2") - F.col("q1"), floor_of)).otherwise(F.lit(-1.0)).alias("lower"),
        (F.col("q2") + SPREADS * F.greatest(F.col("q3") - F.col("q2"), floor_of)).alias("upper"),
    )


def group_fences(counts: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, fences): a map of rate to its fences for each group that occurs."""
    sketch = sketches(counts)
    own, language, everything = fences(sketch, ["lang", "source"], min_rows), fences(sketch, ["lang"], min_rows), fences(sketch, [], 1)
    groups = sketch.select("lang", "source", "rate").distinct()
    named = lambda f, p: f.select(*(F.col(c).alias(f"{p}_{c}") for c in f.columns))
    o, l, e = named(own, "o"), named(language, "l"), named(everything, "e")
    joined = (
        groups.join(o, groups.lang.eqNullSafe(F.col("o_lang")) & groups.source.eqNullSafe(F.col("o_source")) & (groups.rate == F.col("o_rate")), "left")
        .join(l, groups.lang.eqNullSafe(F.col("l_lang")) & (groups.rate == F.col("l_rate")), "left")
        .join(e, groups.rate == F.col("e_rate"), "left")
    )
    pair = F.struct("rate", F.coalesce("o_lower", "l_lower", "e_lower").alias("lower"), F.coalesce("o_upper", "l_upper", "e_upper").alias("upper"))
    return joined.groupBy("lang", "source").agg(F.collect_list(pair).alias("fences"))  # four of them


def judge(docs: DataFrame, min_rows: int = 50) -> DataFrame:
    """Each row of ``docs`` (doc_id, lang, source, text) with its counts and verdict. The counts are made once for each of
    two uses; they are a few numbers a text."""
    from ionweave.llm.common import materialize

    counts = materialize(measured(docs), "counts")
    limits = group_fences(counts, min_rows)
    limits = limits.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "fences")
    judged = counts.join(limits, counts.lang.eqNullSafe(F.col("g_lang")) & counts.source.eqNullSafe(F.col("g_source")), "left")
    for k, v in rates().items():
        judged = judged.withColumn(k, v)
    outside = F.exists("fences", lambda f: F.coalesce(*(F.when(f["rate"] == k, (F.col(k) < f["lower"]) | (F.col(k) > f["upper"])) for k in RATES)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce(outside, F.lit(False))).alias("kept"), *RATES,
    )
