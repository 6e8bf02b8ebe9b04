"""Spectrum preprocessing: peaks in long form (qid, mz, inten), windows partitioned by spectrum, no dense arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.config import ISOTOPES, PROTON, Config, isotope_step
from ionweave.functions.chemistry import AMMONIA, WATER, bin_of


def clear_range(peaks: DataFrame, lo: float, hi: float) -> DataFrame:
    """Peaks inside [lo, hi] get intensity 0, where hi is positive."""
    return peaks.withColumn("inten", F.when((F.lit(hi) > 0) & F.col("mz").between(lo, hi), 0.0).otherwise(F.col("inten")))


def with_enough_peaks(peaks: DataFrame, least: int) -> DataFrame:
    """Spectra with at least ``least`` peaks of some intensity."""
    n = F.count(F.when(F.col("inten") > 0, 1)).over(Window.partitionBy("qid"))
    return peaks.withColumn("n_peaks", n).where(F.col("n_peaks") >= least).drop("n_peaks")


def with_activation(spectra: DataFrame, method: str) -> DataFrame:
    """Spectra of one activation method (ALL: of any); those of an unknown one stay."""
    return spectra if method.upper() == "ALL" else spectra.where(F.col("activation").isNull() | (F.upper("activation") == method.upper()))


def precursor_mz(mono: Column, selected: Column, lower: Column, correct: bool) -> Column:
    """m/z to search: the monoisotopic one, else the selected one, which with ``correct`` also replaces a monoisotopic one below the selection window."""
    chosen = F.when(mono + 0.1 < lower, selected).otherwise(mono) if correct else mono
    return F.coalesce(F.nullif(chosen, F.lit(0.0)), selected, mono)


def guessed_charges(below_share: Column, total: Column) -> Column:
    """Charge states of a spectrum of unknown charge: 1 if nearly all intensity lies below the precursor, else 2 and 3."""
    return F.when((total == 0) | (below_share > 0.95), F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3)))


def expand_charges(spectra: DataFrame, override: int, lo: int, hi: int) -> DataFrame:
    """One row for each charge state; columns file_charge (0 unknown), below_share and total_inten."""
    guess, own, span = guessed_charges(F.col("below_share"), F.col("total_inten")), F.array("file_charge"), F.sequence(F.lit(lo), F.lit(hi))
    known = F.col("file_charge") > 0
    if override == 1:
        states = span
    elif override == 2:
        states = F.when(known & F.col("file_charge").between(lo, hi), own).when(known, F.array().cast("array<int>")).otherwise(guess)
    elif override == 3:
        states = F.when(known, own).otherwise(span)
    else:
        states = F.when(known, own).otherwise(guess)
    return spectra.withColumn("charge", F.explode(states))


def neutralised(mz: Column, z: Column) -> Column:
    """MH+ of a precursor."""
    return mz * z - F.lit(PROTON) * (z - 1)


def gated(queries: DataFrame, cfg: Config) -> DataFrame:
    """Precursors inside the digest mass and charge ranges, with their fragment charge limit."""
    kept = queries.where(F.col("exp_mass").between(*cfg.digest_mass) & F.col("charge").between(*cfg.precursor_charge))
    return kept.withColumn("max_frag_charge", max_fragment_charge(F.col("charge"), cfg.max_fragment_charge))


def max_fragment_charge(charge: Column, most: int) -> Column:
    return F.when(charge == 1, 1).otherwise(F.least(charge - 1, F.lit(most)))


def tolerance_windows(queries: DataFrame, cfg: Config) -> DataFrame:
    """Inner window tol_low..tol_high and the outer one, lo..hi, that isotopes and offsets widen."""
    m, z = F.col("exp_mass"), F.col("charge")
    if cfg.tolerance_unit == "ppm":
        mz = (m + (z - 1) * PROTON) / z
        tol = mz * cfg.tolerance * 1e-6 * z
    else:
        tol = F.lit(cfg.tolerance * (0.001 if cfg.tolerance_unit == "mmu" else 1.0)) * (z if cfg.tolerance_on_mz else F.lit(1))
    steps, step = ISOTOPES[cfg.isotope_error], isotope_step(cfg.isotope_error)
    lo = m - tol - max(steps) * step - max(cfg.mass_offsets)
    hi = m + tol - min(steps) * step - min(0.0, *cfg.mass_offsets)
    clamp = lambda c: F.least(F.greatest(c, F.lit(max(100.0, cfg.digest_mass[0]))), F.lit(cfg.digest_mass[1]))
    return queries.withColumns({"tol_low": m - tol, "tol_high": m + tol, "lo": clamp(lo), "hi": clamp(hi)})


def mass_cushion(mass: Column, cfg: Config) -> Column:
    """Room above a precursor's mass that its arrays keep."""
    if cfg.tolerance_unit == "ppm":
        return mass * cfg.tolerance * 1e-6 + 5.0
    return F.lit(cfg.tolerance * (0.001 if cfg.tolerance_unit == "mmu" else 1.0) * (8 if cfg.tolerance_on_mz else 1) + 5.0)


def above_cutoff(peaks: DataFrame, least: float, share: float) -> DataFrame:
    """Peaks of at least ``least`` and that share of the spectrum's highest."""
    top = F.max("inten").over(Window.partitionBy("qid"))
    return peaks.withColumn("top", top).where(F.col("inten") >= F.greatest(F.lit(least), F.col("top") * share)).drop("top")


def most_intense(peaks: DataFrame, n: int, lo: float, hi: float) -> DataFrame:
    """The n most intense peaks strictly inside (lo, hi), ties by ascending m/z."""
    order = Window.partitionBy("qid").orderBy(F.desc("inten"), "mz", *[c for c in ("peak_id",) if c in peaks.columns])
    return peaks.where((F.col("mz") > lo) & (F.col("mz") < hi)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def without_precursor(peaks: DataFrame, mode: int, tol: float) -> DataFrame:
    """Drops peaks at the precursor (1), at any charge-reduced precursor (2), or at its phosphate losses (3); columns prec_mz, exp_mass, charge."""
    near = lambda x: F.abs(F.col("mz") - x) <= tol
    m, z = F.col("exp_mass"), F.col("charge")
    if mode == 1:
        gone = near(F.col("prec_mz"))
    elif mode == 2:
        gone = F.exists(F.sequence(F.lit(1), z), lambda k: F.abs(F.col("mz") - (m + (k - 1) * PROTON) / k) <= tol)
    elif mode in (3, 4):
        losses = (79.9799, 97.9952) if mode == 3 else (18.010565, 36.021129, 63.997737)
        gone = F.exists(F.array(*map(F.lit, losses)), lambda x: F.abs(F.col("mz") - (F.col("prec_mz") - x / z)) <= tol)
    else:
        return peaks
    return peaks.where(~gone)


def binned(peaks: DataFrame, cfg: Config) -> DataFrame:
    """Per bin the highest square root of intensity, of peaks under exp_mass + 50; ``hi_bin``: the spectrum's highest bin."""
    kept = peaks.where((F.col("inten") > 0) & (F.col("mz") < F.col("exp_mass") + 50.0)).withColumn("bin", bin_of(F.col("mz"), cfg.bin_width, cfg.bin_offset))
    out = kept.groupBy("qid", "bin").agg(F.max(F.sqrt("inten")).alias("y"))
    return out.withColumn("hi_bin", F.max("bin").over(Window.partitionBy("qid")))


def ten_window_normalised(bins: DataFrame) -> DataFrame:
    """Scales each of ten windows so that its highest bin is 50; bins of at most 5 % of the spectrum's highest go."""
    width = (F.col("hi_bin") / 10).cast("int") + 1
    df = bins.withColumn("win", (F.col("bin") / width).cast("int")).withColumn("top", F.max("y").over(Window.partitionBy("qid")))
    df = df.withColumn("win_top", F.max("y").over(Window.partitionBy("qid", "win")))
    return df.where((F.col("y") > 0.05 * F.col("top")) & (F.col("win") < 10)).select("qid", "bin", (F.col("y") * 50.0 / F.col("win_top")).alias("y"))


def scattered(bins: DataFrame, reach: int = 75) -> DataFrame:
    """Fast cross-correlation: y minus the mean of its neighbours. A bin adds to every bin in reach, empty ones too."""
    k = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k")
    spread = bins.select("qid", (F.col("bin")).alias("at"), "y", k)
    share = F.when(F.col("k") == 0, F.col("y")).otherwise(-F.col("y") / (2.0 * reach))
    return spread.withColumn("bin", F.col("at") + F.col("k")).where("bin >= 0").groupBy("qid", "bin").agg(F.sum(share).alias("fx"))


def shifted_sum(bins: DataFrame, shifts: list[tuple[int, float]]) -> DataFrame:
    """fx at each bin plus weighted fx of other bins (flanking peaks, neutral losses): a few rows a bin, one sum."""
    moves = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in [(0, 1.0), *shifts]))).alias("m")
    return bins.select("qid", "bin", "fx", moves).groupBy("qid", (F.col("bin") + F.col("m.s")).alias("bin")).agg(F.sum(F.col("fx") * F.col("m.w")).alias("fx")).where("bin >= 0")


def xcorr_array(bins: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(bins of the correlation array, bins of the array with neutral losses) of normalised bins."""
    fx = scattered(bins)
    if cfg.flanking:
        fx = shifted_sum(fx, [(1, 0.5), (-1, 0.5)])
    loss = lambda m: int(m / cfg.bin_width + 0.5)
    return fx, shifted_sum(fx, [(loss(AMMONIA), 0.2), (loss(WATER), 0.2)]) if cfg.use_nl_ions else fx


def sp_array(bins: DataFrame) -> DataFrame:
    """Bins as a percentage of the spectrum's highest."""
    return bins.withColumn("sp", 100.0 * F.col("y") / F.max("y").over(Window.partitionBy("qid"))).select("qid", "bin", "sp")


def histogram_floor(top_fx: Column) -> Column:
    return (top_fx * 10.0 * 0.005 + 0.5).cast("int")


def ms1_unit_vectors(peaks: DataFrame, lo: float, hi: float, width: float) -> DataFrame:
    """(id, bin, v): highest root intensity a bin, scaled to length 1."""
    df = peaks.where(F.col("mz").between(lo, hi) & (F.col("inten") > 0)).groupBy("id", (F.col("mz") / width).cast("int").alias("bin")).agg(F.max(F.sqrt("inten")).alias("v"))
    return df.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id"))))


def mango_tags(queries: DataFrame, order: list[str]) -> DataFrame:
    """Running tag of each scan's precursors, in pairs A and B."""
    k = F.row_number().over(Window.partitionBy("scan").orderBy(*order)) - 1
    return queries.withColumn("tag", F.format_string("%03d_%s", (k / 2).cast("int"), F.when(k % 2 == 0, "A").otherwise("B")))


def isotope_match(exp: Column, tol: Column, calc: Column, cfg: Config) -> Column:
    """Whether a mass plus an offset and whole isotope steps lies in the inner window."""
    shifts = sorted({o + k * isotope_step(cfg.isotope_error) for o in cfg.mass_offsets for k in ISOTOPES[cfg.isotope_error]})
    return F.exists(F.array(*map(F.lit, shifts)), lambda s: F.abs(calc + s - exp) <= tol)


