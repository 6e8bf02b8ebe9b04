"""Registered queries over sources, sinks and whole searches: files written from the test tables and read back, and searches
against SQL that scores every peptide in a window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.config import PROTON, Config
from ionweave.operators import peptides
from ionweave.plans.catalogue import _FLANK, _FX, _IONS, BIN, BINS, MASS_OF, ORACLE_SQL, PROT, QUERIES, TEN, UNIQUE, T, d, query
from ionweave.plans.search import build_index, search, search_index
from ionweave.sources import readers, writers
from ionweave.tables import new_folder

__all__ = ["ORACLE_SQL", "QUERIES"]  # with those of ``catalogue``: a registry for both


def _text(df: DataFrame, value, name: str) -> str:
    """Writes one column of text under the shared folder and returns the path."""
    path = new_folder(df.sparkSession, name)
    df.select(value.alias("value")).write.text(path)
    return path


def _spectra(spark, sf) -> DataFrame:
    """(scan, mz, z, peaks) of users' events: peaks in order of their number."""
    peaks = T(spark, sf).peaks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("peak_id", "mz", "inten"))).alias("peaks"))
    return peaks.select(F.col("qid").cast("int").alias("scan"), (F.lit(500.0) + F.col("qid") % 200).alias("mz"), (F.col("qid") % 3 + 1).cast("int").alias("z"), "peaks")


def _lines(peaks: Column) -> Column:
    return F.array_join(F.transform(peaks, lambda p: F.concat_ws(" ", F.format_string("%.4f", p["mz"]), F.format_string("%.1f", p["inten"]))), "\n")


def _read_back(scans: DataFrame) -> DataFrame:
    first = F.get("zstates", F.lit(0))
    total = lambda x: F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p[x].cast("double"))
    return scans.select(
        "scan", F.round("precursor_mz", 3).alias("precursor_mz"), first["z"].alias("z"), F.round(first["mh"], 3).alias("mh"), F.round(F.col("rt_sec").cast("double"), 1).alias("rt_sec"),
        F.size("peaks").cast("long").alias("n_peaks"), F.round(total("mz"), 1).alias("sum_mz"), F.round(total("inten"), 1).alias("sum_inten"),
    )


_BACK = f"""SELECT CAST(user_id AS INT) AS scan, round(500 + user_id % 200, 3)::DOUBLE AS precursor_mz, CAST(user_id % 3 + 1 AS INT) AS z,
  round((500 + user_id % 200) * (user_id % 3 + 1) - (user_id % 3) * {d(PROTON)}, 3) AS mh, 90.0::DOUBLE AS rt_sec, count(*) AS n_peaks,
  round(sum(round(value * 4, 4)), 1) AS sum_mz, round(sum(event_id % 1000 + 1), 1)::DOUBLE AS sum_inten FROM events GROUP BY user_id"""


@query(_BACK)
def source_ms2(spark, sf):
    df = _spectra(spark, sf)
    head = F.concat_ws("\t", F.lit("S"), "scan", "scan", F.format_string("%.5f", "mz"))
    state = F.concat_ws("\t", F.lit("Z"), "z", F.format_string("%.6f", F.col("mz") * F.col("z") - (F.col("z") - 1) * PROTON))
    return _read_back(readers.read_ms2(spark, _text(df, F.concat_ws("\n", head, F.lit("I\tRTime\t1.5"), state, _lines("peaks")), "ms2")))


@query(_BACK)
def source_mgf(spark, sf):
    df = _spectra(spark, sf)
    head = F.concat(F.lit("BEGIN IONS\nTITLE=run."), "scan", F.lit("."), "scan", F.lit("."), "z", F.lit("\nRTINSECONDS=90.0\nPEPMASS="), F.format_string("%.5f", "mz"), F.lit(" 1\nCHARGE="), "z", F.lit("+\n"))
    return _read_back(readers.read_mgf(spark, _text(df, F.concat(head, _lines("peaks"), F.lit("\nEND IONS\n")), "mgf")))


def _xml(format: str):
    """Text of one mzML or mzXML document for each task's spectra."""
    import base64
    import struct

    def packed(values: list[float], order: str, kind: str) -> str:
        return base64.b64encode(struct.pack(f"{order}{len(values)}{kind}", *values)).decode()

    def scan(r: dict) -> str:
        mz, inten = [p["mz"] for p in r["peaks"]], [p["inten"] for p in r["peaks"]]
        if format == "mzxml":
            flat = [x for p in zip(mz, inten) for x in p]
            return f'<scan num="{r["scan"]}" msLevel="2" retentionTime="PT1M30S"><precursorMz precursorCharge="{r["z"]}">{r["mz"]}</precursorMz><peaks precision="64">{packed(flat, ">", "d")}</peaks></scan>'
        cv = lambda a, v="", u="": f'<cvParam accession="{a}" value="{v}" unitName="{u}"/>'
        array = lambda a, v: f'<binaryDataArray>{cv(a)}{cv("MS:1000523")}<binary>{packed(v, "<", "d")}</binary></binaryDataArray>'
        own = cv("MS:1000511", 2) + cv("MS:1000016", 1.5, "minute") + cv("MS:1000744", r["mz"]) + cv("MS:1000041", r["z"])
        return f'<spectrum index="0" id="scan={r["scan"]}">{own}{array("MS:1000514", mz)}{array("MS:1000515", inten)}</spectrum>'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([scan(r)])], names=["value"])

    return run


def _xml_source(spark, sf, format: str) -> DataFrame:
    name = {"mzml": "mzML", "mzxml": "mzXML"}[format]
    rows = _spectra(spark, sf).mapInArrow(_xml(format), "value string")
    # A document is a file of its own: here of ten groups of scans.
    files = rows.groupBy(F.pmod(F.xxhash64("value"), F.lit(10))).agg(F.concat(F.lit(f"<{name}>"), F.array_join(F.collect_list("value"), ""), F.lit(f"</{name}>")).alias("value")).select("value")
    path = new_folder(spark, format)
    files.repartition(10, F.col("value")).write.option("maxRecordsPerFile", 1).text(path)
    return _read_back(readers.read_xml(spark, path))


_BACK_EXACT = _BACK.replace("round(value * 4, 4)", "value * 4")


@query(_BACK_EXACT)
def source_mzml(spark, sf):
    return _xml_source(spark, sf, "mzml")


@query(_BACK_EXACT)
def source_mzxml(spark, sf):
    return _xml_source(spark, sf, "mzxml")


@query(f"SELECT 'doc' || prot_id AS name, 'doc' || prot_id || ' of ' || prot_id AS description, CAST(length(seq) AS INT) AS n, md5(seq) AS seq FROM {PROT}")
def source_fasta(spark, sf):
    df = T(spark, sf).proteins
    name = F.concat(F.lit("doc"), "prot_id")
    folded = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    path = _text(df, F.concat(F.lit(">"), name, F.lit(" of "), "prot_id", F.lit("\n"), folded), "fasta")
    found = readers.read_fasta(spark, path)
    return found.select("name", "description", F.length("seq").alias("n"), F.md5("seq").alias("seq"))


@query("""SELECT 'c' || c_custkey AS name, CAST(c_custkey % 30 + 1 AS INT) AS at, CAST(1 + c_custkey % 3 AS INT) AS n_simple, CAST((c_custkey % 2)::INT AS INT) AS n_complex, 'MOD:' || lpad((c_custkey % 50)::VARCHAR, 5, '0') AS mod,
  (c_custkey % 50) + 0.5::DOUBLE AS mono FROM customer""")
def source_peff_obo(spark, sf):
    """PEFF headers with variants and mods, and the ontology that gives the mods' masses."""
    t = T(spark, sf)
    key = F.col("c_custkey")
    simple = F.array_join(F.transform(F.sequence(F.lit(0), (key % 3).cast("int")), lambda k: F.concat(F.lit("("), key % 30 + 2 + k, F.lit("|W)"))), "")
    complex_ = F.when(key % 2 == 1, F.lit("\\VariantComplex=(3|5|AA) ")).otherwise(F.lit(""))
    code = F.concat(F.lit("MOD:"), F.lpad((key % 50).cast("string"), 5, "0"))
    head = F.concat(F.lit(">c"), key, F.lit(" \\VariantSimple="), simple, F.lit(" "), complex_, F.lit("\\ModResPsi=(7|"), code, F.lit("|phospho)"))
    proteins = readers.peff_annotations(readers.read_fasta(spark, _text(t.read("customer"), F.concat(head, F.lit("\n" + "ACDEFGHIK" * 6)), "peff")))
    terms = spark.range(50).select(F.concat(F.lit("[Term]\nid: MOD:"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit('\nxref: DiffMono: "'), F.col("id") + 0.5, F.lit('"\n')).alias("value"))
    found = readers.with_peff_masses(proteins, readers.read_obo(spark, _text(terms, F.col("value"), "obo")))
    first = F.get("peff_masses", F.lit(0))
    return found.select("name", F.get("var_simple", F.lit(0))["pos"].alias("at"), F.size("var_simple").alias("n_simple"), F.size("var_complex").alias("n_complex"), F.get("peff_mods", F.lit(0))["id"].alias("mod"), first["mass"].alias("mono"))


@query(f"""SELECT 'P' || user_id || '/' || (user_id % 3 + 1) AS name, CAST(user_id % 3 + 1 AS INT) AS charge, round(1000 + user_id - (user_id % 3 + 1) * {d(PROTON)}, 3) AS neutral_mass, count(*) AS n_peaks, round(sum(round(value * 4, 4)), 1) AS sum_mz FROM events GROUP BY user_id""")
def source_msp(spark, sf):
    df = _spectra(spark, sf)
    name = F.concat(F.lit("P"), "scan", F.lit("/"), "z")
    text = F.concat(F.lit("Name: "), name, F.lit("\nMW: "), F.format_string("%.4f", F.col("scan") + F.lit(1000.0)), F.lit("\nComment: Charge="), "z", F.lit("\nNum peaks: "), F.size("peaks"), F.lit("\n"), F.replace(_lines("peaks"), F.lit(" "), F.lit("\t")), F.lit("\n"))
    found = readers.read_msp(spark, _text(df, text, "msp"))
    return found.select("name", "charge", F.round("neutral_mass", 3).alias("neutral_mass"), F.size("peaks").cast("long").alias("n_peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p["mz"]), 1).alias("sum_mz"))


@query("SELECT CAST(s_suppkey % 5 + 1 AS INT) AS mod, s_name AS accession FROM supplier")
def source_mod_filter(spark, sf):
    df = T(spark, sf).read("supplier")
    return readers.read_mod_filter(spark, _text(df, F.concat_ws(" ", (F.col("s_suppkey") % 5 + 1).cast("string"), "s_name"), "filter"))


@query("SELECT DISTINCT round(p_retailprice, 2) AS mass FROM part")
def source_compounds(spark, sf):
    return readers.read_compound_masses(spark, _text(T(spark, sf).read("part"), F.format_string("%.2f", "p_retailprice"), "compounds"))


def _psms(spark, sf) -> DataFrame:
    """Orders as a search's result, with every column that the sinks read."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return T(spark, sf).read("orders").select(
        F.lit("run.mzML").alias("file"), k.cast("int").alias("scan"), F.lit(1).alias("num"), (k % 3 + 1).cast("int").alias("charge"), (price / 100 + 2).alias("exp_mass"), (price / 100 + 2 + (k % 5) / 64.0).alias("mass"),
        (F.lit(1.0) / (k % 8 + 1)).alias("expect"), (k % 64 / 16.0 + 1).alias("xcorr"), (k % 8 / 8.0).alias("delta_cn"), (k % 4 / 4.0).alias("last_delta_cn"), (k % 128 / 2.0).alias("sp_score"), (k % 9 + 1).cast("int").alias("sp_rank"), F.lit(1).alias("xcorr_rank"),
        (k % 13).alias("matched"), F.lit(16).alias("total_ions"), F.lit("PEPMTIDEK").alias("peptide"), F.lit("PEPM[16.0000]TIDEK").alias("modified_peptide"), F.lit("4_V_16.000000").alias("modifications"),
        F.when(k % 2 == 0, "K").otherwise("-").alias("prev_aa"), F.lit("A").alias("next_aa"), F.array(F.concat(F.lit("sp|"), "o_custkey"), F.lit("x<&>")).alias("names"), F.array(F.col("o_custkey"), F.lit(-1).cast("long")).alias("prot_ids"), (F.col("o_orderstatus") == "F").alias("is_decoy"),
        (k % 100 + 1).alias("n_matches"), (k % 1000 / 2.0).cast("float").alias("rt_sec"), F.lit(None).cast("double").alias("ascore"),
    )


_P = f"""(SELECT o_orderkey AS k, o_custkey, o_orderstatus = 'F' AS is_decoy, CAST(o_orderkey % 3 + 1 AS INT) AS charge, o_totalprice / 100 + 2 AS exp_mass, o_totalprice / 100 + 2 + (o_orderkey % 5) / 64.0::DOUBLE AS mass, 1.0::DOUBLE / (o_orderkey % 8 + 1) AS expect,
  o_orderkey % 64 / 16.0::DOUBLE + 1 AS xcorr, o_orderkey % 8 / 8.0::DOUBLE AS delta_cn, o_orderkey % 128 / 2.0::DOUBLE AS sp_score, o_orderkey % 1000 / 2.0::DOUBLE AS rt FROM orders)"""


@query(f"""SELECT k::VARCHAR AS scan, charge::VARCHAR AS charge, round(exp_mass - {d(PROTON)}, 3) AS exp_neutral_mass, round(mass - {d(PROTON)}, 3) AS calc_neutral_mass, printf('%.2E', expect) AS expect, printf('%.4f', xcorr) AS xcorr, printf('%.4f', delta_cn) AS delta_cn, printf('%.1f', sp_score) AS sp_score,
  (k % 13)::VARCHAR AS ions_matched, CASE WHEN k % 2 = 0 THEN 'K' ELSE '-' END || '.PEPM[16.0000]TIDEK.A' AS modified_peptide, 'sp|' || o_custkey || ',x<&>' AS protein, printf('%.1f', rt) AS retention_time_sec FROM {_P}""")
def sink_text(spark, sf):
    path = new_folder(spark, "text")
    writers.write_text(_psms(spark, sf), path)
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select("scan", "charge", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("exp_neutral_mass", "calc_neutral_mass")), F.col("e-value").alias("expect"), "xcorr", "delta_cn", "sp_score", "ions_matched", "modified_peptide", "protein", "retention_time_sec")


@query(f"""SELECT 'run.mzML_' || k || '_' || charge || '_1' AS SpecId, CASE WHEN is_decoy THEN -1 ELSE 1 END AS label, round(exp_mass - {d(PROTON)}, 3) AS ExpMass, round(ln(k % 9 + 1), 5) AS lnrSp, round(ln(expect), 5) AS lnExpect, round((k % 13) / 16.0::DOUBLE, 5) AS IonFrac,
  (charge = 2)::INT AS charge2, (k % 2 = 1)::INT AS enzN, 1 AS enzC, 0 AS enzInt, round((exp_mass - mass) / exp_mass, 8) + 0.0::DOUBLE AS dM, 'sp|' || o_custkey AS first_protein FROM {_P}""")
def sink_pin(spark, sf):
    path = new_folder(spark, "pin")
    writers.write_pin(_psms(spark, sf), path)
    df = spark.read.text(path).where(~F.col("value").startswith("SpecId"))
    cells, names = F.split("value", "\t"), writers.pin_rows(_psms(spark, sf)).columns
    at = lambda n: F.get(cells, F.lit(names.index(n)))
    number = lambda n, places: F.round(at(n).cast("double"), places).alias(n)
    return df.select(
        at("SpecId").alias("SpecId"), at("Label").cast("int").alias("label"), number("ExpMass", 3), number("lnrSp", 5), number("lnExpect", 5), number("IonFrac", 5), *(at(n).cast("int").alias(n) for n in ("charge2", "enzN", "enzC", "enzInt")),
        (F.round(at("dM").cast("double"), 8) + F.lit(0.0)).alias("dM"), at("Proteins").alias("first_protein"),
    )


@query(f"SELECT k::VARCHAR AS scan, charge::VARCHAR AS charge, printf('%.4f', xcorr) AS xcorr, 'sp|' || o_custkey AS locus, 2 AS n_loci FROM {_P}")
def sink_sqt(spark, sf):
    path = new_folder(spark, "sqt")
    writers.write_sqt(_psms(spark, sf), path)
    v = spark.read.text(path, lineSep="\nS\t").select(F.concat(F.lit("\n"), F.regexp_replace("value", r"^S\t", "")).alias("v"))
    get = lambda p: F.regexp_extract("v", p, 1)
    return v.select(get(r"^\n(\d+)\t").alias("scan"), get(r"^\n\d+\t\d+\t(\d+)\t").alias("charge"), get(r"\nM\t1\t\d+\t[0-9.]+\t[0-9.]+\t([0-9.]+)\t").alias("xcorr"), get(r"\nL\t([^\n]*)").alias("locus"), F.size(F.regexp_extract_all("v", F.lit(r"\nL\t"), F.lit(0))).alias("n_loci"))


def _elements(spark, path: str, name: str) -> DataFrame:
    """(v) of every element of a written document, each of which is a line: a part file is never one value."""
    return spark.read.text(path).where(F.col("value").startswith(f"<{name} ")).withColumnRenamed("value", "v")


@query(f"SELECT k::VARCHAR AS scan, charge::VARCHAR AS charge, printf('%.3f', xcorr + 1e-9) AS xcorr, 'sp|' || o_custkey AS protein, 'x&lt;&amp;&gt;' AS other, '4' AS mod_at FROM {_P}")
def sink_pepxml(spark, sf):
    path = new_folder(spark, "pepxml")
    writers.write_pepxml(_psms(spark, sf), path, "gzip")
    v = _elements(spark, path, "spectrum_query")
    get = lambda p: F.regexp_extract("v", p, 1)
    return v.select(get(r'start_scan="(\d+)"').alias("scan"), get(r'assumed_charge="(\d+)"').alias("charge"), get(r'name="xcorr" value="([^"]*)"').alias("xcorr"), get(r' protein="([^"]*)"').alias("protein"), get(r'<alternative_protein protein="([^"]*)"').alias("other"), get(r'mod_aminoacid_mass position="(\d+)"').alias("mod_at"))


@query(f"SELECT k::VARCHAR AS scan, charge::VARCHAR AS charge, printf('%.4f', xcorr) AS xcorr, 2 AS n_evidences, round((exp_mass + (charge - 1) * {d(PROTON)}) / charge, 5) AS mz FROM {_P}")
def sink_mzidentml(spark, sf):
    path = new_folder(spark, "mzid")
    writers.write_mzidentml(_psms(spark, sf), path, "gzip")
    v = _elements(spark, path, "SpectrumIdentificationResult")
    get = lambda p: F.regexp_extract("v", p, 1)
    return v.select(get(r'spectrumID="scan=(\d+)"').alias("scan"), get(r'chargeState="(\d+)"').alias("charge"), get(r'name="xcorr" value="([^"]*)"').alias("xcorr"), F.size(F.regexp_extract_all("v", F.lit("<PeptideEvidenceRef "), F.lit(0))).alias("n_evidences"), F.round(get(r'experimentalMassToCharge="([^"]*)"').cast("double"), 5).alias("mz"))


@query("SELECT o_orderstatus = 'F' AS is_decoy, count(*) AS n FROM orders GROUP BY 1")
def sink_decoys_apart(spark, sf):
    path = new_folder(spark, "split")
    writers.write_split(_psms(spark, sf), path)
    return spark.read.csv([path, f"{path}.decoy"], sep="\t", header=True).select(F.input_file_name().contains(".decoy/").alias("is_decoy")).groupBy("is_decoy").agg(F.count("*").alias("n"))


# Whole searches: spectra of users' events, precursors by user, tryptic peptides of documents.
_EXP = f"((500 + user_id % 200) * 2 - {d(PROTON)})"
_SBINS = BINS.replace("WHERE inten > 0 AND mz < 5050", f"JOIN (SELECT user_id, {_EXP} + 50 AS most FROM events GROUP BY user_id HAVING count(*) >= 10) ON qid = user_id WHERE inten > 0 AND mz < most")
_SFLANK = _FLANK.replace(_FX, _FX.replace(TEN, TEN.replace(BINS, _SBINS)))
_SUNIQUE = UNIQUE.replace("BETWEEN 6 AND 30", "BETWEEN 6 AND 20")
_SIONS = _IONS.replace(UNIQUE, _SUNIQUE)
_SEARCH = f"""WITH u AS MATERIALIZED (SELECT canon, peptide, {MASS_OF("peptide")} AS mass FROM {_SUNIQUE}),
q AS (SELECT DISTINCT user_id AS qid, {_EXP} AS exp_mass FROM events),
pairs AS (SELECT qid, canon, peptide FROM q JOIN u ON abs(mass - exp_mass) <= 3 WHERE mass BETWEEN 600 AND 5000),
fx AS MATERIALIZED (SELECT * FROM {_SFLANK}),
ions AS (SELECT DISTINCT canon, pos, {BIN("mz")} AS bin FROM {_SIONS} WHERE charge = 1 AND canon IN (SELECT canon FROM pairs)),
bins AS MATERIALIZED (SELECT DISTINCT canon, bin FROM ions),
scored AS (SELECT qid, canon, any_value(peptide) AS peptide, round(sum(fx) * 0.005::DOUBLE, 3) AS xcorr FROM pairs JOIN bins USING (canon) JOIN fx USING (qid, bin) GROUP BY qid, canon)"""
_TOP1 = "SELECT CAST(qid AS INT) AS scan, peptide, round(xcorr, 2) AS xcorr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY xcorr DESC, canon) AS k FROM scored {} WHERE xcorr > 0) WHERE k = 1"
_CFG = Config(length=(6, 20), missed_cleavages=0, fill_histogram=0, index_min_ions=2, index_min_reported=0, index_candidates=1 << 30)


def _scans(spark, sf) -> DataFrame:
    peaks = T(spark, sf).peaks.groupBy("qid").agg(F.collect_list(F.struct("mz", F.col("inten").cast("float").alias("inten"))).alias("peaks"))
    mz = F.lit(500.0) + F.col("qid") % 200
    none = F.lit(None).cast("string")
    return peaks.select(F.lit("events").alias("file"), F.col("qid").cast("int").alias("scan"), F.lit(2).alias("ms_level"), F.lit(0.0).cast("float").alias("rt_sec"), none.alias("activation"), none.alias("native_id"), mz.alias("precursor_mz"), F.array(F.struct(F.lit(2).alias("z"), (mz * 2 - PROTON).alias("mh"))).alias("zstates"), "peaks")


def _proteins(spark, sf) -> DataFrame:
    return T(spark, sf).proteins.select("prot_id", F.concat(F.lit("doc"), "prot_id").alias("name"), "seq")


def _first(psms: DataFrame) -> DataFrame:
    return psms.where("num = 1").select("scan", "peptide", F.round("xcorr", 2).alias("xcorr"))


def _index(spark, sf, mode: str) -> DataFrame:
    path = new_folder(spark, "index")
    build_index(_proteins(spark, sf), _CFG, path)
    return _first(search_index(spark, _scans(spark, sf), path, _CFG, mode))


@query(f"{_SEARCH} {_TOP1.format('')}")
def search_best(spark, sf):
    return _first(search(_scans(spark, sf), _proteins(spark, sf), _CFG))


@query(f"{_SEARCH} {_TOP1.format('')}")
def search_index_mass(spark, sf):
    """The same through a written index, by mass windows."""
    return _index(spark, sf, "PI")


@query(f"""{_SEARCH}, peaks AS (SELECT qid, mz FROM (SELECT user_id AS qid, value * 4 AS mz, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 1000 + 1 DESC, value) AS k FROM events WHERE value * 4 > 200 AND value * 4 < 2000) WHERE k <= 150),
shared AS (SELECT qid, canon FROM (SELECT DISTINCT qid, {BIN("mz")} AS bin FROM peaks) JOIN (SELECT DISTINCT canon, bin FROM ions WHERE pos > 2) USING (bin) JOIN pairs USING (qid, canon) GROUP BY qid, canon HAVING count(*) >= 2)
{_TOP1.format("JOIN shared USING (qid, canon)")}""")
def search_index_fragments(spark, sf):
    """The same index, by shared fragments: the best of those that share two bins or more."""
    return _index(spark, sf, "FI")


_LIBRARY = Config(tolerance=1.5, isotope_error=1, num_output=1)


@query(f"""WITH q AS (SELECT DISTINCT user_id AS qid, {_EXP} AS exp_mass FROM events WHERE user_id % 2 = 1), fx AS MATERIALIZED (SELECT * FROM {_SFLANK}),
l AS (SELECT DISTINCT user_id AS lib_id, {_EXP} + 0.25::DOUBLE AS mass FROM events WHERE user_id % 2 = 0),
pairs AS (SELECT DISTINCT qid, lib_id FROM q, l, (VALUES (0.0::DOUBLE), ({d(1.00335483)})) AS i(s) WHERE floor(exp_mass) BETWEEN floor(mass + s - 1.5) AND floor(mass + s + 1.5)),
scored AS (SELECT qid, lib_id, round(sum(fx) * 0.005::DOUBLE, 3) AS xcorr FROM pairs JOIN (SELECT user_id AS lib_id, {BIN("(value * 4)")} AS bin FROM events WHERE user_id % 2 = 0) USING (lib_id) JOIN fx USING (qid, bin) GROUP BY qid, lib_id)
SELECT CAST(qid AS INT) AS scan, 'lib' || lib_id AS name, xcorr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY xcorr DESC, lib_id) AS k FROM scored WHERE xcorr > 0) WHERE k = 1""")
def search_library_best(spark, sf):
    """Odd users' spectra against a library of even users' ones."""
    from ionweave.plans.library import search_library

    scans = _scans(spark, sf)
    mass = F.get("zstates", F.lit(0))["mh"] + 0.25 - PROTON
    entries = scans.where("scan % 2 = 0").select(F.col("scan").cast("long").alias("lib_id"), F.concat(F.lit("lib"), "scan").alias("name"), mass.alias("neutral_mass"), "peaks")
    found = search_library(scans.where("scan % 2 = 1"), entries, _LIBRARY)
    return found.select("scan", "name", "xcorr")


def _cut(marks: str) -> str:
    return f"""SELECT prot_id, count(*) AS n, min(p) AS first, max(p) AS last FROM (SELECT prot_id, unnest(string_split({marks}, '|')) AS p FROM {PROT}) WHERE length(p) BETWEEN 5 AND 50 GROUP BY prot_id"""


def _digested(spark, sf, **enzyme) -> DataFrame:
    df = peptides.digest(T(spark, sf).proteins, Config(missed_cleavages=0, length=(5, 50), **enzyme))
    return df.groupBy("prot_id").agg(F.count("*").alias("n"), F.min("peptide").alias("first"), F.max("peptide").alias("last"))


@query(_cut("replace(replace(seq, 'K', 'K|'), 'K|P', 'KP')"))
def digest_lys_c(spark, sf):
    return _digested(spark, sf, cut_after="K")


@query(_cut("replace(seq, 'D', '|D')"))
def digest_cut_before(spark, sf):
    return _digested(spark, sf, cut_after="", no_cut_before="", cut_before="D")


@query(_cut("replace(replace(replace(replace(seq, 'K', 'K|'), 'K|P', 'KP'), 'F', 'F|'), 'L', 'L|')"))
def digest_two_enzymes(spark, sf):
    return _digested(spark, sf, cut_after="K", second=("FL", "", False))


@query(f"""SELECT canon, CAST((right(peptide, 1) = 'K')::INT AS INT) AS lys_c, CAST((left(peptide, 1) = 'D')::INT AS INT) AS asp_n, CAST(length(peptide) - length(replace(peptide, 'D', '')) - (left(peptide, 1) = 'D')::INT AS INT) AS inside FROM {UNIQUE}""")
def sample_enzyme_termini(spark, sf):
    from ionweave.operators import scoring

    p, x = F.col("peptide"), F.lit("A")
    return T(spark, sf).short_peptides.select("canon", scoring.tolerable_termini(p, x, x, ("K", "P", False)).alias("lys_c"), scoring.tolerable_termini(p, x, x, ("D", "", True)).alias("asp_n"), scoring.missed_cleavages(p, ("D", "", True)).alias("inside"))


@query("""WITH e AS (SELECT event_id, user_id AS run, epoch(ts) - 1704067200 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), value) AS k FROM events),
h AS (SELECT a.event_id, a.x AS at, b.x, b.y FROM e a JOIN e b ON a.run = b.run AND b.k BETWEEN a.k - 250 AND a.k - 1),
f AS (SELECT event_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM h GROUP BY event_id),
r AS (SELECT h.*, s, i, abs(y - s * x - i) AS r FROM h JOIN f USING (event_id) WHERE n >= 10),
m AS (SELECT event_id, 2 * stddev_samp(r) AS most FROM r GROUP BY event_id),
g AS (SELECT event_id, regr_slope(y, x) AS s2, regr_intercept(y, x) AS i2, count(*) AS n2 FROM r JOIN m USING (event_id) WHERE r <= most GROUP BY event_id)
SELECT e.event_id, round(CASE WHEN n < 10 OR n IS NULL THEN e.y WHEN n2 >= 3 THEN s2 * e.x + i2 ELSE s * e.x + i END, 2) AS predicted FROM e LEFT JOIN f USING (event_id) LEFT JOIN g USING (event_id)""")
def rt_history_alignment(spark, sf):
    from ionweave.operators import scoring

    p = T(spark, sf).read("events").select(F.col("user_id").alias("run"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0).alias("query_rt"), F.col("value").alias("ref_rt"))
    return scoring.retention_alignment(p, "run").select("event_id", F.round("predicted", 2).alias("predicted"))


@query(f"SELECT name, CAST(max(CASE WHEN low LIKE '%.mgf' THEN 2 WHEN low LIKE '%.mzml' OR low LIKE '%.mzml.gz' THEN 3 ELSE 1 END) AS INT) AS kind FROM (SELECT 'r' || o_orderkey || (['.ms2', '.MGF', '.mzML', '.mzML.gz', '.MS1'])[o_orderkey % 5 + 1] AS name, lower('r' || o_orderkey || (['.ms2', '.MGF', '.mzML', '.mzML.gz', '.MS1'])[o_orderkey % 5 + 1]) AS low FROM orders) GROUP BY name")
def format_dispatch(spark, sf):
    endings = F.array(*map(F.lit, (".ms2", ".MGF", ".mzML", ".mzML.gz", ".MS1")))
    name = F.concat(F.lit("r"), "o_orderkey", F.get(endings, (F.col("o_orderkey") % 5).cast("int")))
    kinds = {"ms2": 1, "mgf": 2, "mzml": 3}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kinds[readers.format_of(n)] for n in batch.column(0).to_pylist()], pa.int32())], names=["name", "kind"])

    return T(spark, sf).read("orders").select(name.alias("name")).mapInArrow(run, "name string, kind int")

