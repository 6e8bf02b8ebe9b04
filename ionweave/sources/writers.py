"""Sinks: tab-separated text, Percolator input, SQT, and the two XML formats. Files are written by Spark, one folder each.

An XML document is a folder whose part files, in order of their names, follow each other: a section's rows are dealt by
ranges of a key and become text after that, an element a line, so no task and no driver holds the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.chemistry import log_or

#: The columns of the text output, in order.
TEXT_COLUMNS = ("scan", "num", "charge", "exp_neutral_mass", "calc_neutral_mass", "e-value", "xcorr", "delta_cn", "sp_score", "ions_matched", "ions_total", "plain_peptide", "modified_peptide", "prev_aa", "next_aa", "protein", "protein_count", "modifications", "retention_time_sec", "sp_rank")


def fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


def label(is_decoy: Column) -> Column:
    return F.when(is_decoy, -1).otherwise(1)


def one_hot_charge(charge: Column, lo: int, hi: int) -> list[Column]:
    return [(charge == z).cast("int").alias(f"charge{z}") for z in range(lo, hi + 1)]


def text_rows(psms: DataFrame, most: int = 5) -> DataFrame:
    """The text output's columns of a search's result, at most ``most`` lines a query."""
    df = psms.where((F.col("num") <= most) & (F.col("xcorr") > 0))
    from ionweave.config import PROTON

    value = {
        "exp_neutral_mass": fixed(F.col("exp_mass") - PROTON, 6), "calc_neutral_mass": fixed(F.col("mass") - PROTON, 6), "e-value": F.format_string("%.2E", F.col("expect")), "xcorr": fixed(F.col("xcorr"), 4), "delta_cn": fixed(F.col("delta_cn"), 4),
        "sp_score": fixed(F.col("sp_score"), 1), "ions_matched": F.col("matched"), "ions_total": F.col("total_ions"), "plain_peptide": F.col("peptide"), "modified_peptide": F.concat_ws(".", "prev_aa", "modified_peptide", "next_aa"),
        "protein": F.array_join("names", ","), "protein_count": F.size("prot_ids"), "retention_time_sec": fixed(F.col("rt_sec").cast("double"), 1),
    }
    return df.select(*((value[c] if c in value else F.col(c)).alias(c) for c in TEXT_COLUMNS))


def write_text(psms: DataFrame, path: str, most: int = 5) -> None:
    text_rows(psms, most).write.csv(path, sep="\t", header=True, mode="overwrite")


def write_split(psms: DataFrame, path: str, write=write_text) -> None:
    """Targets and decoys apart, each ranked among its own, as separate decoys are reported: ``path`` and ``path``.decoy."""
    own = psms.withColumn("num", F.row_number().over(Window.partitionBy("file", "scan", "charge", "is_decoy").orderBy("num")))
    write(own.where(~F.col("is_decoy")), path)
    write(own.where("is_decoy"), f"{path}.decoy")


def pin_rows(psms: DataFrame, charges: tuple[int, int] = (1, 6), sample: tuple[str, str, bool] = ("KR", "P", False)) -> DataFrame:
    """Percolator features; the log of what isn't positive is -20. ``sample``: the enzyme of termini and missed cleavages."""
    from ionweave.config import PROTON
    from ionweave.operators.scoring import cuts_between, missed_cleavages

    enz = lambda c: c.cast("int")
    n_end = (F.col("prev_aa") == "-") | cuts_between(F.col("prev_aa"), F.left("peptide", F.lit(1)), sample)
    c_end = (F.col("next_aa") == "-") | cuts_between(F.right("peptide", F.lit(1)), F.col("next_aa"), sample)
    return psms.select(
        F.concat_ws("_", "file", "scan", "charge", "num").alias("SpecId"), label(F.col("is_decoy")).alias("Label"), F.col("scan").alias("ScanNr"), (F.col("exp_mass") - PROTON).alias("ExpMass"), (F.col("mass") - PROTON).alias("CalcMass"),
        log_or(F.col("sp_rank").cast("double")).alias("lnrSp"), F.col("last_delta_cn").alias("deltLCn"), F.col("delta_cn").alias("deltCn"), log_or(F.col("expect")).alias("lnExpect"), F.col("xcorr").alias("Xcorr"), F.col("sp_score").alias("Sp"),
        F.when(F.col("total_ions") > 0, F.col("matched") / F.col("total_ions")).otherwise(0.0).alias("IonFrac"), F.col("exp_mass").alias("Mass"), F.length("peptide").alias("PepLen"), *one_hot_charge(F.col("charge"), *charges),
        enz(n_end).alias("enzN"), enz(c_end).alias("enzC"), missed_cleavages(F.col("peptide"), sample).alias("enzInt"), log_or(F.col("n_matches").cast("double")).alias("lnNumSP"),
        ((F.col("exp_mass") - F.col("mass")) / F.col("exp_mass")).alias("dM"), F.abs((F.col("exp_mass") - F.col("mass")) / F.col("exp_mass")).alias("absdM"), F.concat_ws(".", "prev_aa", "modified_peptide", "next_aa").alias("Peptide"), F.array_join("names", "\t").alias("Proteins"),
    )


def write_pin(psms: DataFrame, path: str, sample: tuple[str, str, bool] = ("KR", "P", False)) -> None:
    """Lines of text, since the proteins of a line are columns of their own; the header stands once, in the first part file."""
    rows = pin_rows(psms, sample=sample)
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    ordered = rows.repartitionByRange("SpecId").select("SpecId", line.alias("value")).sortWithinPartitions("SpecId", "value")
    _document(["\t".join(rows.columns), ordered], path)


def write_sqt(psms: DataFrame, path: str) -> None:
    """S, M and L lines of each query, kept together and in order within a file."""
    line = lambda *c: F.concat_ws("\t", *c)
    m = line(F.lit("M"), "num", "sp_rank", fixed(F.col("mass"), 6), fixed(F.col("delta_cn"), 4), fixed(F.col("xcorr"), 4), F.format_string("%.2E", F.col("expect")), "matched", "total_ions", F.concat_ws(".", "prev_aa", "modified_peptide", "next_aa"), F.lit("U"))
    body = F.concat_ws("\n", m, F.array_join(F.transform("names", lambda n: F.concat(F.lit("L\t"), n)), "\n"))
    df = psms.groupBy("scan", "charge", "exp_mass").agg(F.array_sort(F.collect_list(F.struct("num", body.alias("b")))).alias("l"))
    text = F.concat_ws("\n", line(F.lit("S"), "scan", "scan", "charge", F.lit("0"), F.lit("spark"), fixed(F.col("exp_mass"), 6)), F.array_join(F.transform("l", lambda x: x["b"]), "\n"))
    df.sort("scan", "charge").select(text.alias("value")).write.mode("overwrite").text(path)


def escaped(x: Column) -> Column:
    """Text as it may stand in an XML attribute, without line breaks."""
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(x.rlike("[&<>\"'\\n\\r\\t]"), out).otherwise(x)


def element(name: str, attributes: dict[str, Column | str], inner: Column | None = None) -> Column:
    """One XML element as text; null attributes are left out."""
    column = lambda v: F.col(v) if isinstance(v, str) else v
    parts = [F.coalesce(F.concat(F.lit(f' {k}="'), escaped(column(v).cast("string")), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    head = F.concat(F.lit(f"<{name}"), *parts)
    return F.concat(head, F.lit("/>")) if inner is None else F.concat(head, F.lit(">"), inner, F.lit(f"</{name}>"))


def _document(parts: list[DataFrame | str], path: str, compression: str | None = None) -> None:
    """Writes lines and rows (value) in their order: a union keeps that of its partitions, and each is a part file."""
    spark = next(p for p in parts if isinstance(p, DataFrame)).sparkSession
    rows = [spark.createDataFrame([(p,)], "value string").coalesce(1) if isinstance(p, str) else p.select("value") for p in parts]
    reduce(DataFrame.union, rows).write.mode("overwrite").option("compression", compression or "none").text(path)


def _section(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """Rows in order of ``key``, which then become text: what is dealt and sorted are their columns."""
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).select(value.alias("value"))


def write_pepxml(psms: DataFrame, path: str, compression: str | None = None) -> None:
    """pepXML: a spectrum_query for each scan and charge, its hits in order of rank."""
    from ionweave.config import PROTON

    score = lambda name, v: element("search_score", {"name": F.lit(name), "value": v})

    def hit(h: Column) -> Column:
        scores = F.concat(score("xcorr", fixed(h["xcorr"], 3)), score("deltacn", fixed(h["delta_cn"], 3)), score("deltacnlast", fixed(h["last_delta_cn"], 3)), score("spscore", fixed(h["sp_score"], 1)), score("sprank", h["sp_rank"]), score("expect", F.format_string("%.2E", h["expect"])), F.when(h["ascore"].isNotNull(), score("site_score", fixed(h["ascore"], 2))).otherwise(F.lit("")))
        at, by = (F.regexp_extract_all(h["modifications"], F.lit(p), F.lit(1)) for p in (r"(\d+)_[A-Z]_-?[0-9.]+", r"\d+_[A-Z]_(-?[0-9.]+)"))
        mods = F.zip_with(at, by, lambda pos, mass: element("mod_aminoacid_mass", {"position": pos, "variable": fixed(mass.cast("double"), 6)}))
        mods = F.when(F.size(at) > 0, F.concat(F.lit("<modification_info>"), F.array_join(mods, ""), F.lit("</modification_info>"))).otherwise(F.lit(""))
        others = F.array_join(F.transform(F.slice(h["names"], 2, 1 << 20), lambda n: element("alternative_protein", {"protein": n})), "")
        return element("search_hit", {
            "hit_rank": h["num"], "peptide": h["peptide"], "peptide_prev_aa": h["prev_aa"], "peptide_next_aa": h["next_aa"], "protein": F.get(h["names"], F.lit(0)), "num_tot_proteins": h["n_prot"], "num_matched_ions": h["matched"], "tot_num_ions": h["total_ions"],
            "calc_neutral_pep_mass": fixed(h["mass"] - PROTON, 6), "massdiff": fixed(F.col("exp_mass") - h["mass"], 6), "num_matched_peptides": h["n_matches"],
        }, F.concat(others, mods, scores))

    own = ("num", "peptide", "prev_aa", "next_aa", "names", "matched", "total_ions", "mass", "n_matches", "modifications", "xcorr", "delta_cn", "last_delta_cn", "sp_score", "sp_rank", "expect", "ascore")
    key = ["file", "scan", "charge"]
    df = psms.select(*key, "exp_mass", "rt_sec", F.size("prot_ids").alias("n_prot"), *own)
    grouped = df.groupBy(*key, "exp_mass", "rt_sec").agg(F.array_sort(F.collect_list(F.struct(*own, "n_prot"))).alias("hits"))
    query = element("spectrum_query", {
        "spectrum": F.concat_ws(".", F.regexp_extract("file", r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1), F.lpad(F.col("scan").cast("string"), 5, "0"), F.lpad(F.col("scan").cast("string"), 5, "0"), "charge"), "start_scan": "scan", "end_scan": "scan",
        "precursor_neutral_mass": fixed(F.col("exp_mass") - PROTON, 6), "assumed_charge": "charge", "retention_time_sec": fixed(F.col("rt_sec").cast("double"), 1),
    }, F.concat(F.lit("<search_result>"), F.array_join(F.transform("hits", hit), ""), F.lit("</search_result>")))
    body = _section(grouped, key, query)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<msms_pipeline_analysis xmlns="http://regis-web.systemsbiology.net/pepXML" summary_xml="search.pep.xml"><msms_run_summary base_name="search" raw_data_type="raw" raw_data=".mzML">'
    _document([head, body, "</msms_run_summary></msms_pipeline_analysis>"], path, compression)


def write_mzidentml(psms: DataFrame, path: str, compression: str | None = None) -> None:
    """mzIdentML: distinct proteins, peptides and evidences, then a result for each spectrum with an item for each match."""
    from ionweave.config import PROTON

    pep_id = lambda m: F.concat(F.lit("pep_"), F.sha1(F.concat_ws("|", m["peptide"], m["modifications"], m["is_decoy"].cast("string"))))
    df = psms.select("*", pep_id(psms).alias("pep_id"))
    cv = lambda accession, name, v=None: element("cvParam", {"cvRef": F.lit("PSI-MS"), "accession": F.lit(accession), "name": F.lit(name)} | ({} if v is None else {"value": v}))
    named = df.select("pep_id", "is_decoy", "prev_aa", "next_aa", F.explode("names").alias("name"))
    db_id = lambda c: F.concat(F.lit("db_"), F.sha1(c))
    proteins = _section(named.select("name").distinct(), ["name"], element("DBSequence", {"id": db_id(F.col("name")), "accession": "name", "searchDatabase_ref": F.lit("DB")}))
    at = F.split(F.when(F.col("modifications") == "-", "").otherwise(F.col("modifications")), ",")
    mods = F.array_join(F.transform(F.filter(at, lambda m: m != ""), lambda m: element("Modification", {"location": F.get(F.split(m, "_"), F.lit(0)), "monoisotopicMassDelta": F.get(F.split(m, "_"), F.lit(2))}, cv("MS:1001460", "unknown modification"))), "")
    peptides = _section(df.select("pep_id", "peptide", "modifications").distinct(), ["pep_id"], element("Peptide", {"id": "pep_id"}, F.concat(F.lit("<PeptideSequence>"), F.col("peptide"), F.lit("</PeptideSequence>"), mods)))
    evidence_id = lambda pep, name: F.concat(F.lit("ev_"), F.sha1(F.concat_ws("|", pep, name)))
    evidences = named.groupBy("pep_id", "name", "is_decoy").agg(F.min(F.struct("prev_aa", "next_aa")).alias("f"))
    evidences = _section(evidences, ["pep_id", "name"], element("PeptideEvidence", {"id": evidence_id(F.col("pep_id"), F.col("name")), "isDecoy": "is_decoy", "pre": F.col("f.prev_aa"), "post": F.col("f.next_aa"), "peptide_ref": "pep_id", "dBSequence_ref": db_id(F.col("name"))}))
    user = lambda name, v: element("userParam", {"name": F.lit(name), "value": v})

    def item(m: Column) -> Column:
        mz = lambda x: fixed((x + (m["charge"] - 1) * PROTON) / m["charge"], 6)
        refs = F.array_join(F.transform(m["names"], lambda n: element("PeptideEvidenceRef", {"peptideEvidence_ref": evidence_id(pep_id(m), n)})), "")
        scores = F.concat(user("xcorr", fixed(m["xcorr"], 4)), user("deltacn", fixed(m["delta_cn"], 4)), user("spscore", fixed(m["sp_score"], 1)), user("sprank", m["sp_rank"]), user("expectation value", F.format_string("%.2E", m["expect"])))
        return element("SpectrumIdentificationItem", {"id": F.concat_ws("_", F.lit("SII"), F.col("scan").cast("string"), m["charge"].cast("string"), m["num"].cast("string")), "rank": m["num"], "chargeState": m["charge"], "peptide_ref": pep_id(m), "experimentalMassToCharge": mz(m["exp_mass"]), "calculatedMassToCharge": mz(m["mass"]), "passThreshold": F.lit("true")}, F.concat(refs, scores))

    own = ("charge", "num", "peptide", "modifications", "is_decoy", "names", "exp_mass", "mass", "xcorr", "delta_cn", "sp_score", "sp_rank", "expect")
    grouped = psms.select("file", "scan", *own).groupBy("file", "scan").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("items"))
    result = element("SpectrumIdentificationResult", {"id": F.concat(F.lit("SIR_"), F.sha1(F.concat_ws("|", "file", "scan"))), "spectrumID": F.concat(F.lit("scan="), F.col("scan")), "spectraData_ref": F.lit("SD")}, F.array_join(F.transform("items", item), ""))
    results = _section(grouped, ["file", "scan"], result)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<MzIdentML id="search" version="1.2.0" xmlns="http://psidev.info/psi/pi/mzIdentML/1.2"><cvList><cv id="PSI-MS" fullName="PSI-MS" uri="https://raw.githubusercontent.com/HUPO-PSI/psi-ms-CV/master/psi-ms.obo"/></cvList><SequenceCollection>'
    middle = '</SequenceCollection><AnalysisCollection><SpectrumIdentification id="SI" spectrumIdentificationProtocol_ref="SIP" spectrumIdentificationList_ref="SIL"><InputSpectra spectraData_ref="SD"/><SearchDatabaseRef searchDatabase_ref="DB"/></SpectrumIdentification></AnalysisCollection><DataCollection><Inputs><SearchDatabase id="DB" location="sequences"/><SpectraData id="SD" location="spectra"/></Inputs><AnalysisData><SpectrumIdentificationList id="SIL">'
    _document([head, proteins, peptides, evidences, middle, results, "</SpectrumIdentificationList></AnalysisData></DataCollection></MzIdentML>"], path, compression)
