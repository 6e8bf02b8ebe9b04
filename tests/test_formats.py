"""Compressed arrays by round trip, XML documents by parsing them again."""

import glob
import gzip
import math
import random
import struct
import xml.etree.ElementTree as ET
import zlib

import pytest
from pyspark.sql import functions as F

from ionweave.plans import catalogue_files as catalogue
from ionweave.sources import numpress, writers


def halves(v):
    """The half bytes of one integer, by the published rule."""
    bits = v & 0xFFFFFFFF
    own = [(bits >> (4 * i)) & 15 for i in range(8)]
    lead = 15 if v < 0 else 0
    n = 0
    while n < (7 if v < 0 else 8) and own[7 - n] == lead:
        n += 1
    if v < 0 and n == 0:
        return [0, *own]
    return [(n + 8 if v < 0 else n), *own[: 8 - n]]


def packed(values):
    h = [x for v in values for x in halves(v)]
    h += [0] * (len(h) % 2)
    return bytes(a << 4 | b for a, b in zip(h[::2], h[1::2]))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 101])
def test_numpress(n):
    rng = random.Random(n)
    ints = [rng.choice([0, 1, 15, 16, 255, 70000, -1, -16, -300]) for _ in range(n)]
    assert list(numpress.integers(packed(ints))) == ints
    counts = [float(abs(x)) for x in ints]
    assert numpress.decode(packed([int(x) for x in counts]), {"MS:1002313"}) == counts
    mz = sorted(rng.uniform(100, 2000) for _ in range(n))
    point = 100000.0
    q = [round(x * point) for x in mz]
    raw = struct.pack(">d", point) + b"".join(struct.pack("<I", x) for x in q[:2]) + packed([q[i] - 2 * q[i - 1] + q[i - 2] for i in range(2, n)])
    assert numpress.decode(zlib.compress(raw), {"MS:1002746"}) == pytest.approx(mz, abs=1e-5)
    raw = struct.pack(">d", 3000.0) + b"".join(struct.pack("<H", round(math.log(c + 1) * 3000)) for c in counts)
    assert numpress.decode(raw, {"MS:1002314"}) == pytest.approx(counts, rel=1e-3, abs=1e-9) and numpress.decode(b"", {"MS:1000523"}) is None


PSMS = [
    ("x/a.mzML", 7, 1, 2, 1000.5, 1000.4, 1e-5, 3.2, 0.1, 0.4, 200.0, 1, 1, 9, 20, "PEPTK", "PEPT[80.0]K", "4_V_79.966331,5_V_1.000000", "K", "A", ["p<1>", "p2"], [1, 2], False, 40, 12.5, 25.0),
    ("x/a.mzML", 7, 2, 2, 1000.5, 1000.3, 0.5, 2.0, 0.0, 0.4, 90.0, 2, 2, 4, 20, "AAAAK", "AAAAK", "-", "-", "G", ["D_p2"], [2], True, 40, 12.5, None),
    ("x/a.mzML", 11, 1, 3, 900.5, 900.4, 0.1, 2.2, 0.1, 0.4, 80.0, 1, 1, 5, 20, "PEPTK", "PEPTK", "-", "K", "A", ["p<1>"], [1], False, 30, 13.5, None),
]
SCHEMA = "file string, scan int, num int, charge int, exp_mass double, mass double, expect double, xcorr double, delta_cn double, last_delta_cn double, sp_score double, sp_rank int, xcorr_rank int, matched int, total_ions int, peptide string, modified_peptide string, modifications string, prev_aa string, next_aa string, names array<string>, prot_ids array<long>, is_decoy boolean, n_matches long, rt_sec double, ascore double"


def document(path):
    root = ET.fromstring("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*"))))
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def test_xml_documents(spark, tmp_path):
    df = spark.createDataFrame(PSMS, SCHEMA).repartition(3)
    writers.write_pepxml(df, str(tmp_path / "p"))
    queries = list(document(tmp_path / "p").iter("spectrum_query"))
    assert [(q.get("spectrum"), q.get("assumed_charge")) for q in queries] == [("a.00007.00007.2", "2"), ("a.00011.00011.3", "3")]
    first, second = queries[0].iter("search_hit")
    assert (first.get("peptide"), first.get("protein"), [a.get("protein") for a in first.iter("alternative_protein")], second.get("hit_rank")) == ("PEPTK", "p<1>", ["p2"], "2")
    assert [(m.get("position"), m.get("variable")) for m in first.iter("mod_aminoacid_mass")] == [("4", "79.966331"), ("5", "1.000000")]
    assert {s.get("name"): s.get("value") for s in first.iter("search_score")} == {"xcorr": "3.200", "deltacn": "0.100", "deltacnlast": "0.400", "spscore": "200.0", "sprank": "1", "expect": "1.00E-05", "site_score": "25.00"}
    writers.write_mzidentml(df, str(tmp_path / "m"))
    root = document(tmp_path / "m")
    ids = {n: {e.get("id") for e in root.iter(n)} for n in ("DBSequence", "Peptide", "PeptideEvidence", "SpectrumIdentificationItem")}
    assert [len(v) for v in ids.values()] == [3, 3, 4, 3]
    assert all(e.get("peptide_ref") in ids["Peptide"] and e.get("dBSequence_ref") in ids["DBSequence"] for e in root.iter("PeptideEvidence"))
    assert {e.get("peptideEvidence_ref") for e in root.iter("PeptideEvidenceRef")} == ids["PeptideEvidence"]
    assert [e.get("spectrumID") for e in root.iter("SpectrumIdentificationResult")] == ["scan=7", "scan=11"]
    empty = spark.createDataFrame([], SCHEMA)
    writers.write_pepxml(empty, str(tmp_path / "e"))
    writers.write_mzidentml(empty, str(tmp_path / "f"))
    assert not list(document(tmp_path / "e").iter("spectrum_query")) and not list(document(tmp_path / "f").iter("Peptide"))


def test_decoys_apart(spark, tmp_path):
    writers.write_split(spark.createDataFrame(PSMS, SCHEMA), str(tmp_path / "t"))
    read = lambda p: sorted((r.plain_peptide, r.num) for r in spark.read.csv(p, sep="\t", header=True).collect())
    assert read(str(tmp_path / "t")) == [("PEPTK", "1"), ("PEPTK", "1")] and read(str(tmp_path / "t.decoy")) == [("AAAAK", "1")]


def test_xml_elements_are_lines_in_order(spark, tmp_path):
    """A reader never needs a part file as one value, whatever a name holds, and parts follow each other as one document."""
    psms = catalogue._psms(spark, "/root/testdata/sf0.001").withColumn("names", F.array(F.lit("a\n<spectrum_query b\t\"c"), F.lit("d\r&")))
    for write, name, scan in ((writers.write_pepxml, "spectrum_query", "start_scan"), (writers.write_mzidentml, "SpectrumIdentificationResult", "spectrumID")):
        path = str(tmp_path / name)
        write(psms, path, "gzip")
        parts = sorted((tmp_path / name).glob("part-*.gz"))
        text = "".join(gzip.decompress(p.read_bytes()).decode() for p in parts)
        assert len(parts) > 2 and sum(x.startswith(f"<{name} ") for x in text.split("\n")) == psms.count()
        found = [x for x in ET.fromstring(text.encode()).iter() if x.tag.endswith("}" + name)]
        scans = [int(x.get(scan).removeprefix("scan=")) for x in found]
        assert scans == sorted(scans) and len(scans) == psms.count() == catalogue._elements(spark, path, name).count()
        assert {x.get("protein") or x.get("accession") for x in ET.fromstring(text.encode()).iter() if x.tag.endswith(("search_hit", "DBSequence"))} >= {"a\n<spectrum_query b\t\"c"}
