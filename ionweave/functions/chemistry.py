"""Masses and sequence expressions, all on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionweave.config import PROTON

#: Monoisotopic element masses and residue compositions.
ELEMENTS = {"H": 1.007825035, "C": 12.0, "N": 14.0030740, "O": 15.9949146, "S": 31.9720707, "Se": 79.9165196}
RESIDUES = {
    "G": {"C": 2, "H": 3, "N": 1, "O": 1}, "A": {"C": 3, "H": 5, "N": 1, "O": 1}, "S": {"C": 3, "H": 5, "N": 1, "O": 2}, "P": {"C": 5, "H": 7, "N": 1, "O": 1}, "V": {"C": 5, "H": 9, "N": 1, "O": 1},
    "T": {"C": 4, "H": 7, "N": 1, "O": 2}, "C": {"C": 3, "H": 5, "N": 1, "O": 1, "S": 1}, "L": {"C": 6, "H": 11, "N": 1, "O": 1}, "I": {"C": 6, "H": 11, "N": 1, "O": 1}, "N": {"C": 4, "H": 6, "N": 2, "O": 2},
    "D": {"C": 4, "H": 5, "N": 1, "O": 3}, "Q": {"C": 5, "H": 8, "N": 2, "O": 2}, "K": {"C": 6, "H": 12, "N": 2, "O": 1}, "E": {"C": 5, "H": 7, "N": 1, "O": 3}, "M": {"C": 5, "H": 9, "N": 1, "O": 1, "S": 1},
    "H": {"C": 6, "H": 7, "N": 3, "O": 1}, "F": {"C": 9, "H": 9, "N": 1, "O": 1}, "R": {"C": 6, "H": 12, "N": 4, "O": 1}, "Y": {"C": 9, "H": 9, "N": 1, "O": 2}, "W": {"C": 11, "H": 10, "N": 2, "O": 1},
    "U": {"C": 3, "H": 5, "N": 1, "O": 1, "Se": 1}, "O": {"C": 12, "H": 19, "N": 3, "O": 2},
}
UNKNOWN = 999999.0
MASS = {c: UNKNOWN for c in "BJXZ"} | {r: round(sum(ELEMENTS[e] * n for e, n in parts.items()), 7) for r, parts in RESIDUES.items()}
WATER = 2 * ELEMENTS["H"] + ELEMENTS["O"]
AMMONIA = 3 * ELEMENTS["H"] + ELEMENTS["N"]
#: The standard genetic code in TCAG order; @ is a stop.
CODONS = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYY@@CC@WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"))


def literal_map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def masses(static: dict[str, float] | None = None) -> dict[str, float]:
    """Residue masses with static ones added; a letter without a mass takes a static one as its own."""
    static = static or {}
    return {k: static[k] if v == UNKNOWN and k in static else v + static.get(k, 0.0) for k, v in MASS.items()}


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def residue_masses(peptide: Column, static: dict[str, float] | None = None) -> Column:
    table = literal_map(masses(static))
    return F.transform(letters(peptide), lambda c: F.coalesce(F.element_at(table, c), F.lit(UNKNOWN)))


def peptide_mass(peptide: Column, static: dict[str, float] | None = None) -> Column:
    """MH+: residues, water and a proton, from how often each residue occurs."""
    n = lambda c: F.length(peptide) - F.length(F.replace(peptide, F.lit(c), F.lit("")))
    return reduce(lambda a, b: a + b, (n(c) * F.lit(m) for c, m in sorted(masses(static).items())), F.lit(WATER + PROTON))


def bin_of(mass: Column, width: float, offset: float) -> Column:
    """Bin number: truncation, as the casts of a double do."""
    return (mass * F.lit(1.0 / width) + F.lit(1.0 - offset)).cast("int")


def canonical(peptide: Column, equal_il: bool = True) -> Column:
    return F.translate(peptide, "L", "I") if equal_il else peptide


def decoy(peptide: Column, keep_last: bool = True) -> Column:
    """Reversed but for the last residue, or the first."""
    n = F.length(peptide)
    if keep_last:
        return F.concat(F.reverse(F.substring(peptide, F.lit(1), n - 1)), F.right(peptide, F.lit(1)))
    return F.concat(F.left(peptide, F.lit(1)), F.reverse(F.substring(peptide, F.lit(2), n - 1)))


def translated(dna: Column, frame: int) -> Column:
    """Reading frame 1 to 3, or 4 to 6 of the reverse complement; unknown codons are *."""
    strand = dna if frame <= 3 else F.reverse(F.translate(dna, "ACGT", "TGCA"))
    table = literal_map(CODONS)
    codons = F.regexp_extract_all(F.substring(strand, (frame - 1) % 3 + 1, 1 << 30), F.lit("..."), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(table, c), F.lit("*"))), "")


def modified_string(peptide: Column, sites: Column, deltas: Column) -> Column:
    """Residues with their modification masses in brackets; ``sites`` are 1-based positions, ``deltas`` the masses."""
    where = F.map_from_arrays(sites, deltas)
    return F.array_join(F.transform(letters(peptide), lambda c, i: F.concat(c, F.when(F.element_at(where, i + 1).isNotNull(), F.concat(F.lit("["), F.format_string("%.4f", F.element_at(where, i + 1)), F.lit("]"))).otherwise(F.lit("")))), "")


def modification_list(sites: Column, deltas: Column, kind: str = "V") -> Column:
    return F.when(F.size(sites) > 0, F.array_join(F.zip_with(sites, deltas, lambda p, d: F.concat(p.cast("string"), F.lit(f"_{kind}_"), F.format_string("%.6f", d))), ",")).otherwise(F.lit("-"))


def log_or(x: Column, otherwise: float = -20.0) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(otherwise))
