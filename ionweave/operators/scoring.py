"""Scores and what is made of them: sparse dot products, histograms, top-K, ranks, regression, q-values, alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.config import ION_SHIFTS, PROTON, Config
from ionweave.functions import chemistry as chem
from ionweave.tables import written


def dot_products(pairs: DataFrame, cand_bins: DataFrame, query_bins: DataFrame) -> DataFrame:
    """xcorr of each (qid, cand_id): sum of fx over the candidate's distinct bins, scaled and rounded; no hit scores 0."""
    hits = pairs.join(cand_bins, "cand_id").join(query_bins, ["qid", "bin"]).groupBy("qid", "cand_id").agg(F.sum("fx").alias("s"))
    return pairs.join(hits, ["qid", "cand_id"], "left").withColumn("xcorr", F.round(F.coalesce("s", F.lit(0.0)) * 0.005, 3)).drop("s")


def histogram_bin(xcorr: Column, first_residue: Column, floor_bin: Column) -> Column:
    raw = F.least(F.greatest((xcorr * 10.0 + 0.5).cast("int"), F.lit(0)), F.lit(151))
    return F.when(first_residue.between("A", "H") & (raw < floor_bin), floor_bin).otherwise(raw)


def histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("qid", histogram_bin(F.col("xcorr"), F.col("first_residue"), F.col("floor_bin")).alias("hbin")).agg(F.count("*").alias("n"))


def match_counts(scored: DataFrame) -> DataFrame:
    """Targets and decoys that each query was scored against."""
    return scored.groupBy("qid").agg(F.count_if(~F.col("is_decoy")).alias("n_targets"), F.count_if(F.col("is_decoy")).alias("n_decoys"))


def merged_duplicates(scored: DataFrame) -> DataFrame:
    """Equal (canon, sites) of a query become one row: text of the first protein, targets before decoys, all proteins."""
    first = F.min_by("peptide", F.struct("is_decoy", "prot_id"))
    return scored.groupBy("qid", "canon", "sites").agg(first.alias("peptide"), F.max("xcorr").alias("xcorr"), F.min("is_decoy").alias("is_decoy"), F.array_sort(F.collect_set("prot_id")).alias("prot_ids"))


def top_k(scored: DataFrame, k: int, by: list, within: list[str]) -> DataFrame:
    """The k best a group; ``by`` is a total order."""
    return scored.withColumn("nth", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("nth") <= k)


def dense_ranks(psms: DataFrame, score: str, out: str, within: str = "qid") -> DataFrame:
    return psms.withColumn(out, F.dense_rank().over(Window.partitionBy(within).orderBy(F.desc(score))))


def sp_scores(matches: DataFrame) -> DataFrame:
    """Sp of each psm from its ions (psm_id, series, charge, pos, sp; sp 0 or null: no match): matched intensity, with a
    bonus for positions matched in a row within a series and charge."""
    hit = (F.coalesce("sp", F.lit(0.0)) > 0).cast("int")
    w = Window.partitionBy("psm_id", "series", "charge").orderBy("pos")
    df = matches.withColumn("hit", hit).withColumn("row", F.col("hit") * F.coalesce(F.lag("hit").over(w), F.lit(0)))
    total, n, run = F.sum(F.coalesce("sp", F.lit(0.0))), F.sum("hit"), F.sum("row")
    return df.groupBy("psm_id").agg(F.round(total * n * (1.0 + 0.075 * run) / F.count("*"), 2).alias("sp_score"), n.alias("matched"), F.count("*").alias("total_ions"))


def similar_share(a: Column, b: Column) -> Column:
    """Share of equal residues over the shorter peptide, I as L and Q as K."""
    fold = lambda c: F.translate(c, "IQ", "LK")
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(fold(a), i, F.lit(1)) == F.substring(fold(b), i, F.lit(1))))
    return same / n


def delta_cn(ranked: DataFrame, explicit: bool = False) -> DataFrame:
    """ranked: (qid, nth, peptide, xcorr), a few rows a query. Relative distance to the next entry that differs in over a
    quarter of its residues, or with ``explicit`` to the next of all; 0 if there is none."""
    later = Window.partitionBy("qid").orderBy("nth").rowsBetween(1, Window.unboundedFollowing)
    df = ranked.withColumn("later", F.collect_list(F.struct("peptide", "xcorr")).over(later))
    other = F.get("later" if explicit else F.filter("later", lambda o: similar_share(F.col("peptide"), o["peptide"]) < 0.75), F.lit(0))
    gap = F.when(F.col("xcorr") > 0, 1.0 - other["xcorr"] / F.col("xcorr")).otherwise(F.lit(0.0))
    return df.withColumn("delta_cn", F.round(F.coalesce(gap, F.lit(0.0)), 4)).drop("later")


def last_delta_cn(ranked: DataFrame) -> DataFrame:
    """Relative distance to the last stored entry above zero."""
    whole = Window.partitionBy("qid").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.last(F.when(F.col("xcorr") > 0, F.col("xcorr")), ignorenulls=True).over(whole)
    return ranked.withColumn("last_delta_cn", F.round(F.coalesce(F.when(F.col("xcorr") > 0, 1.0 - low / F.col("xcorr")), F.lit(1.0)), 4))


def survival(hist: DataFrame) -> DataFrame:
    """Counts at or above each histogram bin, and their log."""
    w = Window.partitionBy("qid").orderBy(F.desc("hbin"))
    return hist.withColumn("cum", F.sum("n").over(w)).withColumn("log_cum", F.round(F.log10("cum"), 6))


#: Fixed values of the survival fit: bins of a histogram; the first bin that a gap may part off, the highest bin from which
#: empty ones near the top end the tail, how many under the top are looked at, and bins that a line has at first.
BINS_OF_HISTOGRAM, LEAST_GAP, HIGH, NEAR_TOP, LINE = 152, 10, 20, 6, 5


def tail_end(counts: np.ndarray) -> int:
    """Last bin of a histogram that a line may use: before the first gap of two bins (or of one before the highest), which
    parts off outliers; without such a gap a bin under the highest, or the lowest empty one close to it."""
    filled = np.flatnonzero(counts[: BINS_OF_HISTOGRAM - 1])
    if not len(filled):
        return 0
    top = int(filled[-1])
    for i in range(max(LEAST_GAP, int(filled[0]) + 1), top):
        if counts[i] == 0 and (counts[i + 1] == 0 or i + 1 == top):
            return i - 1
    if top < LEAST_GAP:
        return top
    empty = [i for i in range(top, top - NEAR_TOP, -1) if counts[i] == 0]
    if not empty:
        return top - 1
    return empty[0] if top <= HIGH else empty[-1]


def fit_survival(counts: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the log survival over bins, up to the tail's end: from five bins under it, fewer the more of
    them are zero, leftwards until the slope is negative."""
    end = tail_end(counts)
    own = counts[: end + 1].astype(float)
    survivors = np.cumsum(own[::-1])[::-1]
    logs = np.log10(np.maximum(survivors, 1.0))
    start = max(0, end - LINE)
    start = max(0, start - int((logs[start:] == 0).sum()))
    slope = intercept = 0.0
    while start >= 0 and end > start + 2:
        x, y = np.arange(start, end + 1), logs[start:]
        use = survivors[start:] > 0
        mx, my = (x[use].mean(), y[use].mean()) if use.any() else (0.0, 0.0)
        up = y > 0
        spread = ((x[up] - mx) ** 2).sum()
        slope = float(((x[up] - mx) * (y[up] - my)).sum() / spread) if spread > 0 else 0.0
        intercept = float(my - slope * mx)
        if slope < 0:
            break
        start -= 1
    return slope, intercept


def fitted(hist: DataFrame) -> DataFrame:
    """(qid, slope, intercept) from (qid, hbin, n): a query's at most 152 bins are one row, fitted many rows a call."""

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = [fit_survival(np.bincount(hbin, n, BINS_OF_HISTOGRAM)) for hbin, n in zip(df["hbin"], df["n"])]
            yield pd.DataFrame({"qid": df["qid"], "slope": [a for a, _ in out], "intercept": [b for _, b in out]})

    rows = hist.groupBy("qid").agg(F.collect_list(F.struct("hbin", "n")).alias("h")).select("qid", "h.hbin", "h.n")
    return rows.mapInPandas(fit, "qid long, slope double, intercept double")


def synthetic_ions(cfg: Config, n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, charge, peptide number) of the fragments of ``n`` peptides drawn from a seed: 8 to 24 residues, the last K or R.
    A stand-in: such peptides are this library's own, so e-values of small searches are too."""
    rng = np.random.default_rng(seed)
    table = chem.masses(cfg.residue_mods)
    inner, last = np.array([table[c] for c in "ACDEFGHILMNPQSTVWY"]), np.array([table[c] for c in "KR"])
    shift = {s: x for s, x in ION_SHIFTS.items() if s in cfg.ion_series}
    bins, charges, owners = [], [], []
    for k in range(n):
        m = np.append(rng.choice(inner, rng.integers(7, 24)), rng.choice(last))
        ladder = {True: np.cumsum(m)[:-1] + PROTON, False: np.cumsum(m[::-1])[:-1] + chem.WATER + PROTON}
        for s, x in shift.items():
            for z in range(1, cfg.max_fragment_charge + 1):
                mz = (ladder[s in "abc"] + x + (z - 1) * PROTON) / z
                bins.append((mz / cfg.bin_width + 1.0 - cfg.bin_offset).astype(np.int64))
                charges.append(np.full(len(mz), z))
                owners.append(np.full(len(mz), k))
    return np.concatenate(bins), np.concatenate(charges), np.concatenate(owners)


def fitted_with_fill(hist: DataFrame, arrays: DataFrame, limits: DataFrame, cfg: Config) -> DataFrame:
    """``fitted``, after histograms of under ``cfg.fill_histogram`` entries are topped up with scores of synthetic peptides.

    ``arrays``: (qid, bins, ys, floor_bin) of ``tiles.spectrum_arrays``; ``limits``: (qid, max_frag_charge). Only spectra with
    small histograms are sent; scores are one weighted count over the synthetic fragments, whose number the settings fix.
    """
    from ionweave.operators.tiles import correlation

    wanted = cfg.fill_histogram
    counts = hist.groupBy("qid").agg(F.collect_list(F.struct("hbin", "n")).alias("h"), F.sum("n").alias("total"))
    small = counts.where(F.col("total") < wanted).select("qid")
    df = counts.join(arrays.join(small, "qid", "left_semi"), "qid", "left").join(limits, "qid", "left")
    df = df.select("qid", "total", F.coalesce("max_frag_charge", F.lit(1)).alias("z"), F.coalesce("floor_bin", F.lit(0)).alias("floor"), "h.hbin", "h.n", "bins", "ys")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, charges, owners = synthetic_ions(cfg, wanted)
        of_charge = {z: (bins[charges <= z], owners[charges <= z]) for z in range(1, cfg.max_fragment_charge + 1)}
        for df in frames:
            out = []
            for total, z, floor, hbin, n, at, weights in zip(df["total"], df["z"], df["floor"], df["hbin"], df["n"], df["bins"], df["ys"]):
                h = np.bincount(hbin, n, BINS_OF_HISTOGRAM)
                if total < wanted:
                    b, own = of_charge[int(z)]
                    own, b = (own[own < wanted - total], b[own < wanted - total])
                    score = np.zeros(wanted - int(total))
                    if at is not None and len(at):
                        score = np.bincount(own, correlation(np.asarray(at), np.asarray(weights), cfg, int(b.max(initial=0)) + 1)[0][b], wanted - int(total))
                    k = np.clip((score * 0.05 + 0.5).astype(int), 0, BINS_OF_HISTOGRAM - 1)
                    even = np.arange(len(k)) % 2 == 0
                    k[even] = np.maximum(k[even], floor)  # half of what is under the floor is counted there
                    h += np.bincount(np.minimum(k, BINS_OF_HISTOGRAM - 1), minlength=BINS_OF_HISTOGRAM)
                out.append(fit_survival(h))
            yield pd.DataFrame({"qid": df["qid"], "slope": [a for a, _ in out], "intercept": [b for _, b in out]})

    return df.mapInPandas(fit, "qid long, slope double, intercept double")


def evalue(xcorr: Column, slope: Column, intercept: Column) -> Column:
    """Expectation from the fitted survival; 999 where the fit has no falling slope, or above it."""
    return F.when(slope >= 0, F.lit(999.0)).otherwise(F.least(F.pow(F.lit(10.0), 10.0 * slope * xcorr + intercept), F.lit(999.0)))


def q_values(psms: DataFrame, by: list, buckets: int | None = None) -> DataFrame:
    """Target-decoy q-values over rows in the order ``by`` (a total order): cumulative decoys over targets, then the least from
    the end. ``psms``: is_decoy and what ``by`` names.

    The order is global. Instead of one window over all rows, rows are dealt by range of the whole order, written with the
    number of their range, and each range's sums come before the next: every window stays within a range.
    """
    n = buckets or int(psms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(c) if d else F.asc(c) for c, d in by]
    df = written(psms.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy("_part").agg(F.sum(F.col("is_decoy").cast("long")).alias("d"), F.sum((~F.col("is_decoy")).cast("long")).alias("t"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select("_part", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    df = df.join(F.broadcast(sums), "_part")  # at most ``n`` rows
    d = F.sum(F.col("is_decoy").cast("long")).over(within) + F.col("d0")
    t = F.sum((~F.col("is_decoy")).cast("long")).over(within) + F.col("t0")
    df = df.withColumn("fdr", F.when(t > 0, d / t).otherwise(F.lit(1.0))).drop("d0", "t0")
    least = df.groupBy("_part").agg(F.min("fdr").alias("m"))
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    least = least.select("_part", F.min("m").over(after).alias("m_after"))
    # A frame that grows from the end, as one that shrinks towards it would be summed anew for each row.
    turned = [F.asc(c) if d else F.desc(c) for c, d in by]
    backwards = Window.partitionBy("_part").orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(F.broadcast(least), "_part")
    q = F.least(F.min("fdr").over(backwards), F.coalesce("m_after", F.lit(float("inf"))))
    return df.withColumn("q", q).drop("_part", "m_after", "fdr")


def passing(q: DataFrame, thresholds: list[float]) -> DataFrame:
    return q.agg(*(F.count_if(~F.col("is_decoy") & (F.col("q") <= t)).alias(f"q_{str(t).replace('.', '_')}") for t in thresholds))


def robust_lines(points: DataFrame, by: str) -> DataFrame:
    """(by, slope, intercept, n): least squares of y on x, again without points whose absolute residual exceeds twice the
    residuals' deviation about their mean; the first fit where under three points stay."""
    first = points.groupBy(by).agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"))
    res = points.join(first, by).withColumn("r", F.abs(F.col("y") - F.col("a") * F.col("x") - F.col("b")))
    limit = res.groupBy(by).agg((2 * F.stddev_samp("r")).alias("limit"))
    kept = res.join(limit, by).where(F.coalesce(F.col("r") <= F.col("limit"), F.lit(True)))
    second = kept.groupBy(by).agg(F.regr_slope("y", "x").alias("a2"), F.regr_intercept("y", "x").alias("b2"), F.count("*").alias("n2"))
    out = first.join(second, by, "left")
    ok = F.col("n2") >= 3
    return out.select(by, F.when(ok, F.col("a2")).otherwise(F.col("a")).alias("slope"), F.when(ok, F.col("b2")).otherwise(F.col("b")).alias("intercept"), F.col("n2").alias("n"))


def align_history(x: list[float], y: list[float], at: float, default: float, least: int = 10) -> float:
    """Robust line over earlier matches, at ``at``; ``default`` under ``least`` matches."""
    if len(x) < least:
        return default
    a, b = np.polyfit(x, y, 1)
    r = np.abs(np.array(y) - a * np.array(x) - b)
    keep = r <= 2 * r.std(ddof=1)
    if keep.sum() >= 3:
        a, b = np.polyfit(np.array(x)[keep], np.array(y)[keep], 1)
    return float(a * at + b)


def retention_alignment(matches: DataFrame, run: str, history: int = 250) -> DataFrame:
    """Predicted reference time of each match of a run from the last ``history`` earlier ones, in order of query time."""

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = [align_history([p["q"] for p in h], [p["r"] for p in h], q, r) for h, q, r in zip(df["earlier"], df["query_rt"], df["ref_rt"])]
            yield df.drop(columns="earlier").assign(predicted=out)

    w = Window.partitionBy(run).orderBy("query_rt", "ref_rt").rowsBetween(-history, -1)
    df = matches.withColumn("earlier", F.collect_list(F.struct(F.col("query_rt").alias("q"), F.col("ref_rt").alias("r"))).over(w))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in matches.schema) + ", predicted double"
    return df.mapInPandas(predict, schema)


def cosine_top1(queries: DataFrame, library: DataFrame, most_apart: float, width: float | None = None) -> DataFrame:
    """Best library entry of each query by dot product of unit vectors (id, rt, bin, v), within a band of retention time."""
    w = width or max(most_apart, 1e-9)
    q = queries.select(F.col("id").alias("qid"), F.col("rt").alias("q_rt"), "bin", F.col("v").alias("qv"), F.explode(F.sequence(F.floor((F.col("rt") - most_apart) / w), F.floor((F.col("rt") + most_apart) / w))).alias("_b"))
    e = library.select(F.col("id").alias("lib_id"), F.col("rt").alias("l_rt"), "bin", F.col("v").alias("lv"), F.floor(F.col("rt") / w).alias("_b"))
    dots = q.join(e, ["_b", "bin"]).where(F.abs(F.col("q_rt") - F.col("l_rt")) <= most_apart).groupBy("qid", "lib_id").agg(F.round(F.sum(F.col("qv") * F.col("lv")), 5).alias("dot"))
    return dots.groupBy("qid").agg(F.max_by("lib_id", F.struct("dot", -F.col("lib_id"))).alias("lib_id"), F.max("dot").alias("dot"))


def cuts_between(left: Column, right: Column, rule: tuple[str, str, bool]) -> Column:
    """Whether an enzyme (residues, blocking neighbours, whether it cuts before) cuts between two residues."""
    residues, blocked, before = rule
    own, other = (right, left) if before else (left, right)
    among = lambda c, letters: c.isin(*letters) if letters else F.lit(False)
    return among(own, residues) & ~among(other, blocked)


def tolerable_termini(peptide: Column, prev: Column, nxt: Column, rule: tuple[str, str, bool] = ("KR", "P", False)) -> Column:
    n = (prev == "-") | cuts_between(prev, F.left(peptide, F.lit(1)), rule)
    c = (nxt == "-") | cuts_between(F.right(peptide, F.lit(1)), nxt, rule)
    return n.cast("int") + c.cast("int")


def missed_cleavages(peptide: Column, rule: tuple[str, str, bool] = ("KR", "P", False)) -> Column:
    letter = lambda i: F.substring(peptide, i, F.lit(1))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(peptide) - 1, F.lit(1))), lambda i: cuts_between(letter(i), letter(i + 1), rule) & (i < F.length(peptide))))
