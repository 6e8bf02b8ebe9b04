"""Limits on modifications, annotated and compound masses, neutral losses, histogram fill: small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import PROTON, Config, Mod, config_from_params, read_params
from ionweave.functions import chemistry as chem
from ionweave.operators import peptides, scoring, spectra
from ionweave.plans.search import candidates_of
from ionweave.sources import readers

WIDE = {"digest_mass": (0.0, 1e9), "missed_cleavages": 0, "length": (4, 50)}


def proteins(spark, *rows):
    return spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(rows)], "prot_id long, name string, seq string")


def placed(spark, prot, cfg):
    return sorted((r.peptide, r.sites) for r in candidates_of(prot, cfg).collect() if any(r.sites))


@pytest.mark.parametrize(
    "term, distance, want",
    [
        (0, 1, [("SSAAK", 1), ("SSAAK", 2)]),  # protein N: the first two residues
        (1, 1, [("AASS", 4), ("AASS", 3)]),
        (2, 0, [("SSAAK", 1), ("SSSSK", 1)]),
        (3, 1, [("SSSSK", 4), ("AASS", 4), ("AASS", 3)]),
        (0, -2, [("SSAAK", 1), ("SSAAK", 2), ("AASS", 3), *(("SSSSK", i) for i in (1, 2, 3, 4))]),
    ],
)
def test_distance_from_ends(spark, term, distance, want):
    cfg = Config(variable_mods=(Mod(80.0, "S", 1, term_distance=distance, which_term=term),), **WIDE)
    got = placed(spark, proteins(spark, ("a", "SSAAKSSSSKAASS")), cfg)
    assert sorted((p, s.index(1) + 1) for p, s in got) == sorted(want)


def test_distance_of_terminal_mods(spark):
    cfg = Config(variable_mods=(Mod(42.0, "n", 1, term_distance=0, which_term=0),), **WIDE)
    assert [p for p, _ in placed(spark, proteins(spark, ("a", "AAGAKAAAAK")), cfg)] == ["AAGAK"]


def test_protein_filter(spark):
    cfg = Config(variable_mods=(Mod(80.0, "S", 1), Mod(16.0, "M", 1)), mod_filter=((1, "HUMAN"), (1, "MOUSE")), **WIDE)
    got = placed(spark, proteins(spark, ("sp|x|YEAST", "AASMK"), ("sp|y|HUMAN", "GGSMK")), cfg)
    assert got == [("AASMK", [0, 0, 0, 2, 0, 0, 0]), ("GGSMK", [0, 0, 0, 2, 0, 0, 0]), ("GGSMK", [0, 0, 1, 0, 0, 0, 0]), ("GGSMK", [0, 0, 1, 2, 0, 0, 0])]


def test_least_count_and_rare(spark):
    assert list(peptides.placements("SSS", (Mod(80.0, "S", 3, min_per_peptide=3),), 5)) == [[0, 0, 0], [1, 1, 1]]
    mods = (Mod(1.0, "S", 1, rare=True), Mod(2.0, "M", 1, rare=True))
    assert list(peptides.placements("SM", mods, 5)) == [[0, 0], [1, 0], [0, 2]]


def test_compound_masses(spark):
    cfg = Config(compound_masses=(100.0, 200.0), decoys=1, **WIDE)
    rows = [r for r in candidates_of(proteins(spark, ("a", "AJGJAK")), cfg).collect() if not r.is_decoy]
    base = sum(chem.MASS[c] for c in "AGAK") + chem.WATER + PROTON
    assert sorted((round(r.mass - base, 6), [i for i, x in enumerate(r.extra) if x]) for r in rows) == [(0.0, []), (100.0, [1]), (100.0, [3]), (200.0, [1]), (200.0, [3])]
    ions = peptides.fragment_ions(candidates_of(proteins(spark, ("a", "AJGJAK")), cfg).where("not is_decoy"), cfg, most_charge=1).where("series = 'b' and pos = 2")
    assert {round(r.mz - chem.MASS["A"] - PROTON, 4) for r in ions.collect()} == {0.0, 100.0, 200.0}


def test_annotations(spark):
    text = r"x \VariantSimple=(3|R) \VariantComplex=(7|8|) \ModResPsi=(2|MOD:1)"
    prot = readers.peff_annotations(spark.createDataFrame([(0, "p", "AGSGAKLLMNPVWK", text)], "prot_id long, name string, seq string, description string"))
    obo = spark.createDataFrame([("MOD:1", 14.0, 14.0)], "id string, mono double, avg double")
    cfg = Config(digest_mass=(0.0, 1e9), missed_cleavages=0, length=(3, 50))
    found = candidates_of(readers.with_peff_masses(prot, obo), cfg).collect()
    assert {r.peptide for r in found} == {"AGSGAK", "AGR", "GAK", "LLMNPVWK", "MNPVWK"}
    assert [(r.peptide, r.extra.index(14.0)) for r in found if any(r.extra)] == [("AGSGAK", 1)]
    none = candidates_of(readers.with_peff_masses(prot, obo.limit(0)), cfg)
    assert none.where("exists(extra, x -> x > 0)").count() == 0


def test_static_ends(spark):
    cfg = config_from_params(read_params("add_Nterm_peptide = 10\nadd_Cterm_protein = 5\nallowed_missed_cleavage = 0\npeptide_length_range = 4 9\ndigest_mass_range = 0 99999"))
    assert cfg.static_ends == (10.0, 0.0, 0.0, 5.0)
    found = candidates_of(proteins(spark, ("a", "AAAAKGGGG")), cfg)
    assert {r.peptide: round(r.mass - sum(chem.MASS[c] for c in r.peptide) - chem.WATER - PROTON, 6) for r in found.collect()} == {"AAAAK": 10.0, "GGGG": 15.0}
    y = peptides.fragment_ions(found, cfg, most_charge=1).where("series = 'y' and pos = 1").collect()
    assert {round(r.mz - chem.WATER - PROTON, 6) for r in y} == {round(chem.MASS["K"], 6), round(chem.MASS["G"] + 5, 6)}


@pytest.mark.parametrize("scaled", [False, True])
def test_fragment_losses(spark, scaled):
    cfg = Config(variable_mods=(Mod(80.0, "S", 2, neutral_loss=98.0, neutral_loss2=20.0),), scale_fragment_loss=scaled, ion_series="by")
    df = spark.createDataFrame([(1, "SASK", [1, 0, 1, 0, 0, 0])], "cand_id long, peptide string, sites array<int>")
    rows = {(r.series, r.pos, r.loss): r.mz for r in peptides.fragment_ions(df, cfg, most_charge=1).collect()}
    assert {k for k in rows if k[2]} == {(s, p, x) for s, p in (("b", 1), ("b", 2), ("b", 3), ("y", 2), ("y", 3)) for x in (1, 2)}
    assert rows["b", 3, 0] - rows["b", 3, 1] == pytest.approx(98 * (2 if scaled else 1)) and rows["y", 2, 0] - rows["y", 2, 2] == pytest.approx(20)


def test_precursor_losses(spark):
    pairs = spark.createDataFrame([(1, 2, 1000.0 + PROTON, 2)], "qid long, cand_id long, mass double, charge int")
    got = peptides.precursor_loss_bins(pairs, Config(precursor_losses=(100.0,), bin_width=1.0, bin_offset=0.0)).collect()
    assert sorted(r.bin for r in got) == [int(450 + PROTON) + 1, int(900 + PROTON) + 1]


def test_precursor_choice_and_activation(spark):
    df = spark.createDataFrame([(500.0, 501.0, 500.5, "HCD"), (500.0, 501.0, 499.0, "cid"), (0.0, 501.0, None, None)], "m double, s double, lo double, activation string")
    pick = lambda on: [r.x for r in df.select(spectra.precursor_mz(F.col("m"), F.col("s"), F.col("lo"), on).alias("x")).collect()]
    assert pick(True) == [501.0, 500.0, 501.0] and pick(False) == [500.0, 500.0, 501.0]
    assert spectra.with_activation(df, "CID").count() == 2 and spectra.with_activation(df, "ALL").count() == 3


def test_explicit_distance(spark):
    df = spark.createDataFrame([(1, 1, "AAAAK", 4.0), (1, 2, "AAAAR", 3.0), (1, 3, "GGGGK", 1.0)], "qid int, nth int, peptide string, xcorr double")
    get = lambda on: [r.delta_cn for r in scoring.delta_cn(df, on).orderBy("nth").collect()]
    assert get(False) == [0.75, 0.6667, 0.0] and get(True) == [0.25, 0.6667, 0.0]


def test_histogram_fill(spark):
    cfg = Config(fill_histogram=300)
    hist = spark.createDataFrame([(1, 3, 2), (1, 7, 1), (2, 1, 400), (2, 2, 90), (2, 3, 20), (2, 4, 4), (3, 2, 1)], "qid long, hbin int, n long")
    rng = np.random.default_rng(0)
    peaks, y = rng.choice(np.arange(100, 1500), 200, replace=False), rng.uniform(5, 50, 200)
    arrays = spark.createDataFrame([(1, peaks.tolist(), y.tolist(), 1)], "qid long, bins array<int>, ys array<double>, floor_bin int")
    limits = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "qid long, max_frag_charge int")
    got = {r.qid: (r.slope, r.intercept) for r in scoring.fitted_with_fill(hist, arrays, limits, cfg).collect()}
    plain = {r.qid: (r.slope, r.intercept) for r in scoring.fitted(hist).collect()}
    assert got[2] == plain[2] and got[1][0] < 0 and set(got) == {1, 2, 3}
    # The same top-up by a loop over peptides.
    bins, charges, owners = scoring.synthetic_ions(cfg, 300)
    normalised = spark.createDataFrame([(1, int(b), float(v)) for b, v in zip(peaks, y)], "qid long, bin int, y double")
    at = {r.bin: r.fx for r in spectra.xcorr_array(normalised, cfg)[0].collect()}
    h = np.bincount([3, 7], [2, 1], 152)
    for k in range(297):
        s = sum(at.get(int(b), 0.0) for b in bins[(owners == k) & (charges <= 2)])
        v = max(0, int(s * 0.05 + 0.5))
        h[min(151, max(v, 1) if k % 2 == 0 else v)] += 1
    assert got[1] == pytest.approx(scoring.fit_survival(h))


def test_tail_of_histogram():
    h = np.zeros(152)
    h[:12], h[20] = 5, 1
    assert scoring.tail_end(h) == 11
    assert scoring.tail_end(np.zeros(152)) == 0 and scoring.fit_survival(np.zeros(152)) == (0.0, 0.0)
    h[20] = 0
    assert scoring.tail_end(h) == 10


@pytest.mark.parametrize("termini", [1, 2, 8, 9])
@pytest.mark.parametrize("missed", [0, 1, 3])
def test_digest_by_every_pair(spark, termini, missed):
    rng = np.random.default_rng(termini * 10 + missed)
    seqs = ["".join(rng.choice(list("AKRPG*D"), n)) for n in (1, 3, 30, 60, 200)] + ["", None, "K", "KKKK", "AAAAAA"]
    cfg = Config(termini=termini, missed_cleavages=missed, length=(2, 9))
    want = []
    for p, s in enumerate(seqs):
        s = s or ""
        cuts = {0, len(s)} | {i for i in range(1, len(s)) if (s[i - 1] in "KR" and s[i] != "P") or "*" in s[i - 1 : i + 1]}
        for a in range(len(s)):
            for b in range(a + 2, min(a + 9, len(s)) + 1):
                n_end, c_end = a in cuts, b in cuts
                ok = {2: n_end and c_end, 1: n_end or c_end, 8: n_end, 9: c_end}[termini]
                inner = sum(a < c < b for c in cuts)
                if ok and inner <= missed and "*" not in s[a:b]:
                    want.append((p, a, s[a:b], inner, s[a - 1] if a else "-", s[b : b + 1] or "-"))
    df = spark.createDataFrame(list(enumerate(seqs)), "prot_id long, seq string")
    assert sorted(map(tuple, peptides.digest(df, cfg).collect())) == sorted(want)
