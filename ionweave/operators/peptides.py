"""Candidate peptides: digestion, clipping, de-duplication, decoys, modifications and fragment ions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice, product
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.config import ION_SHIFTS, PROTON, Config, Mod
from ionweave.functions.chemistry import WATER, bin_of, canonical, decoy, peptide_mass, residue_masses
from ionweave.sources.readers import variant_sequences

#: Starts of peptides in one block of a sequence, and placements that a task holds at once.
BLOCK, PLACED = 1024, 10_000
ASCII = np.arange(128)


def cut_pattern(cfg: Config) -> str:
    """Matches the empty place of a cut: where any of the enzymes cuts, and around *."""
    places = [r"(?<=\*)", r"(?=\*)"]
    for residues, blocked, before in cfg.rules:
        here, beside = ("(?=[{}])", "(?<![{}])") if before else ("(?<=[{}])", "(?![{}])")
        places.append(here.format(residues) + (beside.format(blocked) if blocked else ""))
    return "|".join(places)


def digest(proteins: DataFrame, cfg: Config) -> DataFrame:
    """(prot_id, start, peptide, missed, prev_aa, next_aa): peptides of ``proteins`` (prot_id, seq) in the length range.

    With an enzyme, cut sites are found once and each is combined with those up to the missed cleavages further on; ends
    that need no cut run over the lengths. Peptides with * go.
    """
    lo, hi = cfg.length
    n = F.length("seq")
    if not cfg.enzyme:
        # A substring takes time up to its place, so long sequences are first cut into overlapping blocks, with their flanks.
        cut = F.substring(F.concat(F.lit("-"), F.col("seq"), F.lit("-")), F.col("block") + 1, F.lit(BLOCK + hi + 1))
        blocks = proteins.where(n >= lo).select("prot_id", "seq", n.alias("n"), F.explode(F.sequence(F.lit(0), n - lo, F.lit(BLOCK))).alias("block")).select("prot_id", "n", "block", cut.alias("text"))
        at = blocks.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK - 1), F.col("n") - lo - F.col("block")))).alias("i")).withColumn("start", F.col("block") + F.col("i"))
        at = at.select("*", F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("n") - F.col("start")))).alias("len"))
        piece = lambda k, size: F.substring("text", F.col("i") + k, size)
        out = at.select("prot_id", "start", piece(2, F.col("len")).alias("peptide"), F.lit(0).alias("missed"), piece(1, F.lit(1)).alias("prev_aa"), piece(F.col("len") + 2, F.lit(1)).alias("next_aa"))
        return out.where(~F.col("peptide").contains("*"))
    # Sites are the ends of the pieces between cuts. Each takes the text that its peptides can reach, joined from whole pieces
    # (a substring of a long sequence takes time up to its place); further sites, up to the missed cleavages, bound where the
    # other end may lie, whether it is free or a site too.
    pieces = proteins.where(n > 0).select("prot_id", F.filter(F.split("seq", cut_pattern(cfg)), lambda x: x != "").alias("pieces"))
    sites = F.aggregate("pieces", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x))))
    around = pieces.select("prot_id", "pieces", sites.alias("sites"))
    most, count = cfg.missed_cleavages + 1, F.size("pieces")
    before = lambda i: F.when(i > 0, F.right(F.get("pieces", i - 1), F.lit(1))).otherwise(F.lit("-"))
    after = lambda i: F.coalesce(F.left(F.get("pieces", i), F.lit(1)), F.lit("-"))
    joined = lambda i, k: F.array_join(F.slice("pieces", i + 1, k), "")
    found = []
    if cfg.termini in (1, 2, 8):
        own = lambda i: F.struct(F.get("sites", i).alias("site"), F.slice("sites", i + 2, F.lit(most)).alias("others"), F.left(F.concat(before(i), joined(i, F.lit(most)), after(i + most)), F.lit(hi + 2)).alias("text"))
        ahead = around.select("prot_id", F.explode(F.transform(F.sequence(F.lit(0), count - 1), own)).alias("s")).select("prot_id", "s.*")
        site = F.col("site")
        ends = F.filter("others", lambda e: (e - site).between(lo, hi))
        if cfg.termini != 2:
            last = F.least(site + hi, F.element_at("others", -1))
            ends = F.when(site + lo <= last, F.sequence(site + lo, F.greatest(last, site + lo)))
        ahead = ahead.select("*", F.explode(ends).alias("end")).withColumn("len", F.col("end") - site)
        missed = F.size(F.filter("others", lambda s: s < F.col("end")))
        found.append(ahead.select("prot_id", site.alias("start"), F.substring("text", F.lit(2), F.col("len")).alias("peptide"), missed.alias("missed"), F.left("text", F.lit(1)).alias("prev_aa"), F.substring("text", F.col("len") + 2, F.lit(1)).alias("next_aa")))
    if cfg.termini in (1, 9):
        k = lambda i: F.least(i, F.lit(most))
        own = lambda i: F.struct(F.get("sites", i).alias("site"), F.slice("sites", i + 1 - k(i), k(i)).alias("others"), F.right(F.concat(before(i - k(i)), joined(i - k(i), k(i)), after(i)), F.lit(hi + 2)).alias("text"))
        back = around.select("prot_id", F.explode(F.transform(F.sequence(F.lit(1), count), own)).alias("s")).select("prot_id", "s.*")
        site = F.col("site")
        first = F.greatest(site - hi, F.get("others", F.lit(0)))
        starts = F.when(first <= site - lo, F.sequence(F.least(first, site - lo), site - lo))
        if cfg.termini == 1:  # those between two sites are found from the first
            starts = F.filter(starts, lambda s: ~F.array_contains("others", s))
        back = back.select("*", F.explode(starts).alias("start")).withColumn("at", F.length("text") - 1 - (site - F.col("start")))
        missed = F.size(F.filter("others", lambda s: s > F.col("start")))
        found.append(back.select("prot_id", "start", F.substring("text", F.col("at") + 1, site - F.col("start")).alias("peptide"), missed.alias("missed"), F.substring("text", F.col("at"), F.lit(1)).alias("prev_aa"), F.right("text", F.lit(1)).alias("next_aa")))
    return reduce(DataFrame.unionByName, found).where(~F.col("peptide").contains("*"))


def window_counts(text: str, lo: int, hi: int) -> tuple[int, int, str | None]:
    """Number of all stretches of ``lo`` to ``hi`` residues without *, of distinct ones, and the first in order."""
    kinds, codes = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True) if not text.isascii() else (ASCII, np.frombuffer(text.encode(), np.uint8))
    codes = codes.astype(np.int64) + 1
    if len(kinds) == 128 and (len(codes) == 0 or 65 < codes.min() and codes.max() < 92):
        codes, kinds = codes - 65, kinds[:26]  # capital letters: five bits
    bits = int(len(kinds)).bit_length()
    if bits * hi > 63:
        found = [[w for i in range(len(text) - k + 1) if "*" not in (w := text[i : i + k])] for k in range(lo, hi + 1)]
        return sum(map(len, found)), sum(len(set(f)) for f in found), min(found[0], default=None)
    if "*" in text:
        codes[np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord("*")] = 0
    # A stretch from each residue, as one number: from its end or a * on it holds zeros.
    n = len(codes)
    if n < lo:
        return 0, 0, None
    ahead = np.concatenate([codes, np.zeros(hi, np.int64)])
    own, there = codes.copy(), codes > 0
    gaps = "*" in text
    for j in range(1, hi):
        own <<= bits
        if gaps:
            there &= ahead[j : j + n] > 0
            own |= np.where(there, ahead[j : j + n], 0)
        else:
            own |= ahead[j : j + n]
    own.sort()
    total = distinct = 0
    first = None
    for k in range(lo, hi + 1):
        heads = own >> (bits * (hi - k))
        heads = heads[heads & ((1 << bits) - 1) > 0]  # those that reach so far
        total += len(heads)
        distinct += int(np.count_nonzero(heads[1:] != heads[:-1])) + (len(heads) > 0)
        if k == lo and len(heads):
            base = 65 if len(kinds) == 26 else None
            digits = [(int(heads[0]) >> (bits * (k - 1 - j)) & ((1 << bits) - 1)) - 1 for j in range(k)]
            first = "".join(chr(base + x) if base else chr(int(kinds[x])) for x in digits)
    return total, distinct, first


def digest_counts(proteins: DataFrame, cfg: Config) -> DataFrame:
    """(prot_id, n, n_distinct, first) of a digest without an enzyme: peptides, distinct ones and the first in order.

    A sequence has about as many peptides of a length as residues: they are counted where it is, in arrays, and never
    become rows. Only ids that stand more than once, whose sequences may share peptides, take the digest's rows.
    """
    lo, hi = cfg.length
    again = F.broadcast(proteins.groupBy("prot_id").count().where("count > 1").select(F.col("prot_id").alias("_again")))
    same = F.col("prot_id").eqNullSafe(F.col("_again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [window_counts(s or "", lo, hi) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["prot_id", "n", "n_distinct", "first"])

    schema = f"prot_id {proteins.schema['prot_id'].dataType.simpleString()}, n long, n_distinct long, first string"
    once = proteins.join(again, same, "left_anti").select("prot_id", "seq").mapInArrow(run, schema).where("n > 0")
    rows = digest(proteins.join(again, same, "left_semi"), cfg).groupBy("prot_id").agg(F.count("*").alias("n"), F.countDistinct("peptide").alias("n_distinct"), F.min("peptide").alias("first"))
    return once.unionByName(rows)


def with_clipped(proteins: DataFrame, cfg: Config) -> DataFrame:
    """Digest, and with a leading M clipped the peptides that then start the protein."""
    whole = digest(proteins, cfg).withColumn("clipped", F.lit(False))
    if not cfg.clip_met:
        return whole
    short = proteins.where(F.col("seq").startswith("M")).withColumn("seq", F.expr("substring(seq, 2)"))
    first = digest(short, cfg).where("start = 0").withColumn("start", F.lit(1)).withColumn("prev_aa", F.lit("M")).withColumn("clipped", F.lit(True))
    return whole.unionByName(first).dropDuplicates(["prot_id", "start", "peptide"])


def with_variants(proteins: DataFrame, cfg: Config) -> DataFrame:
    """Digest of proteins and of each of their annotated variants, one at a time: of those, peptides that hold the changed
    stretch or end beside it, where it may have made a cut. Starts are places in the sequence that was digested."""
    whole = with_clipped(proteins, cfg)
    if "var_simple" not in proteins.columns:
        return whole
    changed = variant_sequences(proteins).withColumn("own", F.struct("prot_id", "at", "until"))
    near = with_clipped(changed.select(F.col("own").alias("prot_id"), "seq"), cfg)
    end = F.col("start") + F.length("peptide")
    near = near.where((F.col("start") <= F.col("prot_id.until")) & (end >= F.col("prot_id.at"))).withColumn("prot_id", F.col("prot_id.prot_id"))
    return whole.unionByName(near)


def unique_peptides(digested: DataFrame, cfg: Config) -> DataFrame:
    """One row for each peptide, I and L alike where set: text, flanks and place of the first protein, all proteins' ids."""
    first = F.min_by(F.struct("peptide", "prev_aa", "next_aa", "start"), F.struct("prot_id", "start"))
    grouped = digested.groupBy(canonical(F.col("peptide"), cfg.equal_il).alias("canon")).agg(first.alias("f"), F.array_sort(F.collect_set("prot_id")).alias("prot_ids"))
    mass = peptide_mass(F.col("f.peptide"), cfg.residue_mods)
    if any(cfg.static_ends):
        mass = mass + sum(end_masses(F.col("f.prev_aa"), F.col("f.next_aa"), cfg), F.lit(0.0))
    return grouped.select("canon", F.col("f.peptide").alias("peptide"), F.col("f.prev_aa").alias("prev_aa"), F.col("f.next_aa").alias("next_aa"), mass.alias("mass"), "prot_ids", F.col("f.start").alias("start"))


def end_masses(prev: Column, nxt: Column, cfg: Config) -> tuple[Column, Column]:
    """Static masses of a peptide's N and C end; a protein's own ends have more."""
    n, c, first, last = map(F.lit, cfg.static_ends)
    return n + F.when(prev == "-", first).otherwise(0.0), c + F.when(nxt == "-", last).otherwise(0.0)


def placed_in_proteins(found: DataFrame, proteins: DataFrame, cfg: Config) -> DataFrame:
    """Adds what limits on mods need of a peptide's first protein: its length, and the mods that it doesn't take."""
    listed: dict[int, list[str]] = {}
    for k, accession in cfg.mod_filter:
        listed.setdefault(k, []).append(accession)
    if not listed and all(m.term_distance < 0 or m.which_term > 1 for m in cfg.variable_mods):
        return found
    blocked = F.filter(F.array(*(F.when(~reduce(or_, (F.col("name").contains(a) for a in names)), F.lit(k)) for k, names in sorted(listed.items()))), lambda k: k.isNotNull())
    own = proteins.select(F.col("prot_id").alias("_first"), F.length("seq").alias("seq_len"), (blocked if listed else F.array().cast("array<int>")).alias("blocked"))
    return found.join(own, F.get("prot_ids", F.lit(0)) == F.col("_first")).drop("_first")


def annotated(found: DataFrame, digested: DataFrame, proteins: DataFrame, cfg: Config) -> DataFrame:
    """Adds ``peff``: (pos, mass) of the annotated mods, 1-based in the peptide, of all its places. Proteins have ``peff_masses``."""
    mods = proteins.select("prot_id", F.explode("peff_masses").alias("p")).select(F.col("prot_id").alias("_prot"), "p.pos", F.col("p.mass").alias("by"))
    inside = (F.col("prot_id") == F.col("_prot")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.length("peptide"))
    at = F.struct((F.col("pos") - F.col("start") + 1).cast("int").alias("pos"), F.col("by").alias("mass"))
    own = digested.join(mods, inside).groupBy(canonical(F.col("peptide"), cfg.equal_il).alias("canon")).agg(F.array_sort(F.collect_set(at)).alias("peff"))
    return found.join(own, "canon", "left")


def with_decoys(peptides: DataFrame, keep_last: bool = True) -> DataFrame:
    both = peptides.withColumn("is_decoy", F.lit(False))
    return both.unionByName(peptides.withColumn("peptide", decoy(F.col("peptide"), keep_last)).withColumn("is_decoy", F.lit(True)))


def modifiable(peptide, mods: tuple[Mod, ...]):
    """The peptide's modifiable residues alone: peptides that share them share their placements."""
    letters = "".join(sorted({c for m in mods for c in m.residues if c.isupper()}))
    return F.regexp_replace(peptide, f"[^{letters}]", "") if letters else F.lit("")


def placements(residues: str, mods: tuple[Mod, ...], most: int) -> Iterator[list[int]]:
    """Mod number (1-based) of each residue, or 0, for every allowed placement, one at a time; the unmodified one comes first."""
    options = [[0, *(k + 1 for k, m in enumerate(mods) if c in m.residues)] for c in residues]
    free = [i for i, o in enumerate(options) if len(o) > 1]
    for n in range(min(most, len(free)) + 1):
        for where in combinations(free, n):
            for kinds in product(*(options[i][1:] for i in where)):
                used = [kinds.count(k + 1) for k in range(len(mods))]
                if any(u > m.max_per_peptide or 0 < u < m.min_per_peptide for u, m in zip(used, mods)) or sum(u > 0 and m.rare for u, m in zip(used, mods)) > 1:
                    continue
                groups = {m.binary for m in mods if m.binary}
                if any(0 < sum(used[k] for k, m in enumerate(mods) if m.binary == g) != sum(any(c in mods[k].residues for k in range(len(mods)) if mods[k].binary == g) for c in residues) for g in groups):
                    continue
                row = [0] * len(residues)
                for i, k in zip(where, kinds):
                    row[i] = k
                yield row


def modified(peptides: DataFrame, cfg: Config) -> DataFrame:
    """(peptide row, sites, mod_mass, mass) for each placement of variable mods and terminal mods on each peptide.

    Placements are made once for each distinct string of modifiable residues and joined back.
    """
    mods, lo, hi = cfg.variable_mods, *cfg.digest_mass
    letters = "".join(sorted({c for m in mods for c in m.residues if c.isupper()})) or "~"
    pos = F.filter(F.transform(F.split("peptide", ""), lambda c, i: F.when(c.rlike(f"[{letters}]"), i + 1)), lambda i: i.isNotNull())
    base = peptides.withColumn("mod_seq", modifiable(F.col("peptide"), mods)).withColumn("_pos", pos)
    if not mods:
        plain = base.select(*peptides.columns, F.array_repeat(F.lit(0), F.length("peptide") + 2).alias("sites"), F.lit(0.0).alias("mod_mass"))
        return with_extra(plain, cfg).where(F.col("mass").between(lo, hi))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("mod_seq", pa.string()), ("placement", pa.list_(pa.int32()))])
        for batch in batches:
            every = ({"mod_seq": s, "placement": p} for s in batch.column(0).to_pylist() for p in placements(s, mods, cfg.max_mods))
            while rows := list(islice(every, PLACED)):
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    placed = base.select("mod_seq").distinct().mapInArrow(permute, "mod_seq string, placement array<int>")
    ends = {e: [0, *(k + 1 for k, m in enumerate(mods) if e in m.residues)] for e in "nc"}
    term = F.explode(F.array(*(F.struct(F.lit(a).alias("n"), F.lit(b).alias("c")) for a in ends["n"] for b in ends["c"]))).alias("t")
    df = base.join(placed, "mod_seq").select(*peptides.columns, "placement", "_pos", term)
    own = F.transform(F.sequence(F.lit(1), F.length("peptide")), lambda i: F.coalesce(F.get("placement", F.array_position("_pos", i).cast("int") - 1), F.lit(0)))
    df = df.withColumn("sites", F.concat(own, F.array(F.col("t.n"), F.col("t.c"))))
    delta = F.array(F.lit(0.0), *(F.lit(m.mass) for m in mods))
    df = df.withColumn("mod_mass", F.aggregate("sites", F.lit(0.0), lambda s, k: s + F.element_at(delta, k + 1)))
    df = df.where(F.size(F.filter("sites", lambda k: k > 0)) <= cfg.max_mods)
    for k, m in enumerate(mods):
        if m.required:
            df = df.where(F.array_contains("sites", k + 1))
        if m.term_distance != -1:
            df = df.where(allowed_places(k + 1, m))
    if sum(m.rare for m in mods) > 1:  # terminal mods aren't in a placement
        df = df.where(sum((F.array_contains("sites", k + 1).cast("int") for k, m in enumerate(mods) if m.rare), F.lit(0)) <= 1)
    if cfg.mod_filter and "blocked" in df.columns:
        df = df.where(~F.arrays_overlap("sites", "blocked"))
    df = df.withColumn("mass", F.col("mass") + F.col("mod_mass")).drop("placement", "t", "_pos")
    return with_extra(df, cfg).where(F.col("mass").between(lo, hi))


def allowed_places(k: int, mod: Mod) -> Column:
    """Whether every site of mod ``k`` lies within its distance of the end that it names."""
    n, far = F.length("peptide"), mod.term_distance
    if far == -2:
        return F.element_at("sites", n) != k
    # 0-based place in the peptide: the ends stand on the first and the last residue.
    place = lambda i: F.when(i == n, F.lit(0)).when(i == n + 1, n - 1).otherwise(i)
    if mod.which_term == 0:
        near = lambda i: F.col("start") + place(i) <= far
    elif mod.which_term == 1:
        near = lambda i: F.col("start") + place(i) + far >= F.col("seq_len") - 1
    elif mod.which_term == 2:
        near = lambda i: place(i) <= far
    else:
        near = lambda i: n - 1 - place(i) <= far
    return F.forall(F.transform("sites", lambda s, i: (s != k) | near(i)), lambda ok: ok)


def with_extra(df: DataFrame, cfg: Config) -> DataFrame:
    """For each row also those with one mass more: an annotated mod, or a compound on a J, on a residue that is free.
    ``extra`` has the added mass of each place; the column is there only if the settings or annotations ask for it."""
    kind = "array<struct<pos:int,mass:double>>"
    options = [F.coalesce("peff", F.array().cast(kind))] if "peff" in df.columns else []
    if cfg.compound_masses:
        js = F.filter(F.sequence(F.lit(1), F.length("peptide")), lambda i: F.substring("peptide", i, F.lit(1)) == "J")
        weights = F.array(*map(F.lit, cfg.compound_masses))
        options.append(F.flatten(F.transform(js, lambda i: F.transform(weights, lambda m: F.struct(i.alias("pos"), m.alias("mass"))))))
    if not options:
        return df
    every = F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit(0.0).alias("mass"))).cast(kind), *(o.cast(kind) for o in options))
    free = F.filter(every, lambda e: F.when(e["pos"] == 0, True).otherwise(F.get("sites", F.greatest(e["pos"], F.lit(1)) - 1) == 0))
    df = df.withColumn("_e", F.explode(F.array_distinct(free)))
    extra = F.transform("sites", lambda _, i: F.when(i + 1 == F.col("_e.pos"), F.col("_e.mass")).otherwise(0.0))
    return df.withColumn("extra", extra).withColumn("mass", F.col("mass") + F.col("_e.mass")).withColumn("mod_mass", F.col("mod_mass") + F.col("_e.mass")).drop("_e", "peff")


def fragment_ions(candidates: DataFrame, cfg: Config, key: str = "cand_id", most_charge: int | None = None) -> DataFrame:
    """(key, charge, series, pos, loss, mz, bin) of every fragment of candidates (key, peptide, sites).

    Prefix sums come from one ordered pass over the residues; series and charges are exploded after. Fragments that hold a
    mod with a neutral loss come once more for each loss (``loss`` 1 and on; 0: whole).
    """
    placed = "sites" in candidates.columns
    delta = F.array(F.lit(0.0), *(F.lit(m.mass) for m in cfg.variable_mods))
    own = residue_masses(F.col("peptide"), cfg.residue_mods)
    if placed:
        own = F.zip_with(own, F.slice("sites", F.lit(1), F.length("peptide")), lambda m, k: m + F.element_at(delta, k + 1))
    if "extra" in candidates.columns:
        own = F.zip_with(own, F.slice("extra", F.lit(1), F.length("peptide")), lambda m, x: m + x)
    n_mod = F.element_at(delta, F.element_at("sites", F.length("peptide") + 1) + 1) if placed else F.lit(0.0)
    c_mod = F.element_at(delta, F.element_at("sites", F.length("peptide") + 2) + 1) if placed else F.lit(0.0)
    if any(cfg.static_ends):
        n_end, c_end = end_masses(F.col("prev_aa"), F.col("next_aa"), cfg)
        n_mod, c_mod = n_mod + n_end, c_mod + c_end
    losses = [(k + 1, x) for k, m in enumerate(cfg.variable_mods) for x in (m.neutral_loss, m.neutral_loss2) if x] if placed else []
    df = candidates.select(key, F.length("peptide").alias("n"), own.alias("m"), n_mod.alias("n_mod"), c_mod.alias("c_mod"), *(["sites"] if losses else []))
    prefix = F.aggregate("m", F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    df = df.withColumn("prefix", prefix).withColumn("total", F.element_at("prefix", -1))
    df = df.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("pos")).where("n > 1")
    forward = F.element_at("prefix", F.col("pos") + 1) + F.col("n_mod") + PROTON
    backward = F.col("total") - F.element_at("prefix", F.col("n") - F.col("pos") + 1) + F.col("c_mod") + WATER + PROTON
    head = F.concat(F.slice("sites", F.lit(1), F.col("pos")), F.slice("sites", F.col("n") + 1, F.lit(1))) if losses else None
    tail = F.concat(F.slice("sites", F.col("n") - F.col("pos") + 1, F.col("pos")), F.slice("sites", F.col("n") + 2, F.lit(1))) if losses else None
    rows = []
    for i, s in enumerate(cfg.ion_series):
        mh = (forward if s in "abc" else backward) + ION_SHIFTS[s]
        for nth, (k, x) in enumerate([(0, 0.0), *losses]):
            if k:
                held = head if s in "abc" else tail
                times = F.size(held) - F.size(F.array_remove(held, k))
                lost = F.when(times > 0, mh - x * (times if cfg.scale_fragment_loss else F.lit(1)))
            rows.append(F.struct(F.lit(i).alias("order"), F.lit(s).alias("series"), F.lit(nth).alias("loss"), (lost if k else mh).alias("mh")))
    df = df.select(key, "pos", F.explode(F.array(*rows)).alias("ion"))
    if losses:
        df = df.where("ion.mh is not null")
    df = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(most_charge or cfg.max_fragment_charge))).alias("charge"))
    mz = (F.col("ion.mh") + (F.col("charge") - 1) * PROTON) / F.col("charge")
    return df.select(key, "charge", F.col("ion.order").alias("order"), F.col("ion.series").alias("series"), "pos", F.col("ion.loss").alias("loss"), mz.alias("mz"), bin_of(mz, cfg.bin_width, cfg.bin_offset).alias("bin"))


def first_of_bin(ions: DataFrame, key: str = "cand_id") -> DataFrame:
    """A bin counts once for each candidate: the ion of least charge, then series, then position."""
    first = F.min(F.struct("charge", "order", "series", "pos", *(["loss"] if "loss" in ions.columns else []), "mz")).alias("i")
    return ions.groupBy(key, "bin").agg(first).select(key, "bin", "i.charge", "i.order", "i.series", "i.pos", "i.mz")


def precursor_loss_bins(pairs: DataFrame, cfg: Config) -> DataFrame:
    """(qid, cand_id, bin) of the precursor without each of the losses, at its charge and below; pairs have mass and charge."""
    df = pairs.select("qid", "cand_id", "mass", F.explode(F.sequence(F.lit(1), F.col("charge"))).alias("z"), F.explode(F.array(*map(F.lit, cfg.precursor_losses))).alias("x"))
    mz = (F.col("mass") - PROTON - F.col("x") + F.col("z") * PROTON) / F.col("z")
    return df.select("qid", "cand_id", bin_of(mz, cfg.bin_width, cfg.bin_offset).alias("bin")).where("bin > 0").distinct()
