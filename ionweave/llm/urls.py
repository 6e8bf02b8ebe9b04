"""URL filter: host and path rules, then a ratio of character language models for urls that no rule fits.

Two smoothed Markov models of variable order (Witten-Bell interpolation from order ``ORDER`` down) are counted over all
accepted and all rejected urls of the table; digits count as one character. A url is scored by the difference of their
log-likelihoods over its length, against the threshold that parts accepted from rejected best on a fifth of the labelled
urls that the counts leave out. Labels are the rules' verdicts. All counts stay, however rare: equal strings are counted
once with their number, counts are summed per task, then by context. Where they are at most ``MODEL_ROWS`` rows, which is
checked, they are sent to the tasks; beyond that they stay a table, the probability of each distinct (context, next) of the
urls comes from joins with it, one level of context at a time, and urls from sums of those. Both ways give the same scores.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty string scores 0 and is allowed,
as is every unruled url where one class has no labelled url; equal rules count once; among fitting rules the longest wins,
then the first by text; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import materialize

ORDER, MODEL_ROWS, HELD_COUNTS = 5, 400_000, 200_000
#: The rules of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DIGITS, ZEROS = "123456789", "0" * 9


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, upper, upper.lower()), path


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, the rule's verdict (null where none fits) and the folded string that models see. A few rules: they stand in the plan."""
    host, path = host_and_path(F.col("url").cast("string"))
    df = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    best = sorted({(v, h, p) for v, h, p in rules}, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    pick = lambda value: F.coalesce(*(F.when(fits(h, p), F.lit(value(v, h, p))) for v, h, p in best), F.lit(None).cast("string"))
    string = F.translate(F.concat("host", "path"), DIGITS, ZEROS).alias("string")
    return df.select("*", pick(lambda v, h, p: h + p).alias("rule"), pick(lambda v, h, p: v).alias("ruled"), string)


def grams(text: str, order: int) -> Iterator[tuple[str, str]]:
    """(context, next) of every order at every place of a folded text, with its start and end marked."""
    s = "\x02" + text + "\x03"
    for i in range(1, len(s)):
        for k in range(min(i, order) + 1):
            yield s[i - k : i], s[i]


def counted(labelled: DataFrame, order: int) -> DataFrame:
    """(context, next, allow, block): how often each class has them, over all rows. Equal strings are read once, sums made in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(sums)
            out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([sums[k] for k in keys], pa.int64())], names=["verdict", "context", "next", "n"])
            sums.clear()
            return out

        for batch in batches:
            for verdict, text, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for c, x in grams(text, order):
                    sums[verdict, c, x] += n
                if len(sums) > HELD_COUNTS:
                    yield flush()
        yield flush()

    strings = labelled.groupBy("ruled", "string").agg(F.count("*").alias("n"))
    of = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v)
    return strings.mapInArrow(count, "verdict string, context string, next string, n long").groupBy("context", "next").agg(of("allow"), of("block"))


class Model:
    """Witten-Bell interpolation of orders 0 to ``order``."""

    def __init__(self, rows: list[tuple[str, str, int]], order: int):
        self.order, self.n = order, {(c, x): n for c, x, n in rows}
        self.total, self.kinds = Counter(), Counter()
        for c, _, n in rows:
            self.total[c] += n
            self.kinds[c] += 1
        self.alphabet = max(2, self.kinds[""] + 1)

    def prob(self, context: str, x: str) -> float:
        p = 1.0 / self.alphabet
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            if not (total := self.total.get(c)):
                break
            p = (self.n.get((c, x), 0) + self.kinds[c] * p) / (total + self.kinds[c])
        return p

    def logs(self, text: str) -> float:
        s = "\x02" + text + "\x03"
        return sum(math.log(self.prob(s[max(0, i - self.order) : i], s[i])) for i in range(1, len(s)))


def scorer(accepted: Model, rejected: Model):
    """Mean log-likelihood ratio a character: above 0 like accepted urls. Equal strings are scored once a task."""
    cache: dict[str, float] = {}

    def score(text: str) -> float:
        if text not in cache:
            if len(cache) > 100_000:
                cache.clear()
            cache[text] = (accepted.logs(text) - rejected.logs(text)) / (len(text) + 1) if text else 0.0
        return cache[text]

    return score


def sent_scores(strings: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """(string, score) with both models in each task; ``table`` is small."""
    rows = table.collect()
    accepted, rejected = (Model([(r.context, r.next, r[v]) for r in rows if r[v]], order) for v in ("allow", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(accepted, rejected)
        for batch in batches:
            values = np.array([score(t) for t in batch.column(0).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["string", "score"])

    return strings.select("string").mapInArrow(run, "string string, score double")


def joined_scores(strings: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """The same scores with the counts as a table of any size."""
    text = F.concat(F.lit("\x02"), "string", F.lit("\x03"))
    at = F.explode(F.sequence(F.lit(2), F.length("string") + 2)).alias("at")
    placed = strings.select("string", text.alias("text"), at)
    begin = F.greatest(F.col("at") - order, F.lit(1))
    seen = placed.select("string", F.substring("text", begin, F.col("at") - begin).alias("context"), F.substring("text", F.col("at"), F.lit(1)).alias("next"))
    seen = materialize(seen.groupBy("string", "context", "next").agg(F.count("*").alias("times")), "grams")
    totals = table.groupBy("context").agg(*(f(v) for v in ("allow", "block") for f in (lambda v: F.sum(v).alias(f"{v}_total"), lambda v: F.count_if(F.col(v) > 0).alias(f"{v}_kinds"))))
    kinds = totals.where("context = ''").first()
    df = seen.select("context", "next").distinct().select("*", F.length("context").alias("size"))
    for v in ("allow", "block"):
        df = df.withColumn(f"{v}_p", F.lit(1.0 / max(2, kinds[f"{v}_kinds"] + 1))).withColumn(f"{v}_on", F.lit(True))
    for k in range(order + 1):
        own = lambda d, columns: d.where(F.length("context") == k).select(F.col("context").alias("_c"), *columns)  # noqa: B023, E731
        df = df.withColumn("_k", F.when(F.col("size") >= k, F.right("context", F.lit(k))))
        df = df.join(own(totals, [f"{v}_{x}" for v in ("allow", "block") for x in ("total", "kinds")]), F.col("_k") == F.col("_c"), "left").drop("_c")
        df = df.join(own(table, [F.col("next").alias("_x"), "allow", "block"]), (F.col("_k") == F.col("_c")) & (F.col("next") == F.col("_x")), "left").drop("_c", "_x")
        for v in ("allow", "block"):
            total, kind, p = (F.coalesce(f"{v}_total", F.lit(0)), F.col(f"{v}_kinds"), F.col(f"{v}_p"))
            on = F.col(f"{v}_on") & (total > 0)
            df = df.withColumn(f"{v}_p", F.when(on, (F.coalesce(v, F.lit(0)) + kind * p) / (total + kind)).otherwise(p)).withColumn(f"{v}_on", on | (F.col(f"{v}_on") & F.col("_k").isNull()))
        df = df.drop("_k", *(f"{v}{x}" for v in ("allow", "block") for x in ("", "_total", "_kinds")))
    ratio = df.select("context", "next", (F.log("allow_p") - F.log("block_p")).alias("ratio"))
    sums = seen.join(ratio, ["context", "next"]).groupBy("string").agg(F.sum(F.col("ratio") * F.col("times")).alias("sum"))
    return sums.select("string", F.when(F.col("string") == "", 0.0).otherwise(F.col("sum") / (F.length("string") + 1)).alias("score"))


def threshold_of(held: DataFrame) -> float:
    """The score that parts ``held`` (ruled, score, n) best, classes weighted evenly. Collected: a count for each class and hundredth."""
    bins = held.groupBy("ruled", F.round("score", 2).alias("s")).agg(F.sum("n").alias("n")).collect()
    sums: Counter = Counter()
    for r in bins:
        sums[r.ruled] += r.n

    def balanced(cut: float) -> float:
        return sum(r.n / sums[r.ruled] for r in bins if (r.s >= cut) == (r.ruled == "allow"))

    return max(sorted({r.s for r in bins}), key=lambda c: (balanced(c), -abs(c)), default=0.0)


def filter_urls(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (null for ruled urls) of each row of ``pages`` (page_id, url)."""
    df = ruled(pages, rules)
    held = F.pmod(F.crc32(F.col("string").cast("binary")), F.lit(5)) == 0
    table = materialize(counted(df.where(F.col("ruled").isNotNull() & ~held), order), "grams")
    sizes = table.where("context = ''").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    out = df.withColumn("score", F.lit(0.0))
    threshold = 0.0
    if sizes.allow and sizes.block:
        scores = sent_scores if table.count() <= MODEL_ROWS else joined_scores
        asked = df.where(held & F.col("ruled").isNotNull()).groupBy("ruled", "string").agg(F.count("*").alias("n"))
        known = scores(asked.select("string").distinct(), table, order)
        threshold = threshold_of(asked.join(known, "string"))
        free = materialize(scores(df.where("ruled is null").select("string").distinct(), table, order), "scores")
        out = df.join(free, "string", "left")
    judged = F.when((F.col("host") == "") & (F.col("path") == ""), "allow").when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))
