"""Search parameters, validated once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

#: Physical constants.
PROTON, C13_GAP, WATER_H, WATER_O = 1.00727646688, 1.00335483, 1.007825035, 15.9949146
#: Offsets of the ion series from b and y.
ION_SHIFTS = {"a": -27.9949146, "b": 0.0, "c": 17.0265491, "x": 25.9792649, "y": 0.0, "z": -16.0187241}


@dataclass(frozen=True)
class Mod:
    """A variable modification. ``residues``: letters, with n and c for the peptide's ends; ``binary`` groups are all or nothing.

    ``term_distance`` limits how far from an end a site may lie (-1 anywhere, -2 anywhere but on the last residue);
    ``which_term`` names the end: 0 protein N, 1 protein C, 2 peptide N, 3 peptide C. Of all ``rare`` mods a peptide has one at most.
    """

    mass: float
    residues: str
    max_per_peptide: int = 3
    binary: int = 0
    required: bool = False
    neutral_loss: float = 0.0
    neutral_loss2: float = 0.0
    min_per_peptide: int = 0
    term_distance: int = -1
    which_term: int = 0
    rare: bool = False


@dataclass(frozen=True)
class Config:
    tolerance: float = 3.0
    tolerance_unit: str = "amu"  # amu, mmu or ppm
    tolerance_on_mz: bool = False
    isotope_error: int = 0
    mass_offsets: tuple[float, ...] = (0.0,)
    digest_mass: tuple[float, float] = (600.0, 5000.0)
    length: tuple[int, int] = (5, 50)
    cut_after: str = "KR"
    no_cut_before: str = "P"
    cut_before: str = ""
    no_cut_after: str = ""  # residues that keep ``cut_before`` from cutting behind them
    second: tuple[str, str, bool] = ("", "", False)  # another enzyme's cuts too: its residues, those that block it, whether it cuts before
    sample: tuple[str, str, bool] = ("KR", "P", False)  # the enzyme of tolerable termini and missed cleavages in outputs
    enzyme: bool = True
    termini: int = 2  # 2 full, 1 semi, 8 N only, 9 C only
    missed_cleavages: int = 2
    clip_met: bool = False
    equal_il: bool = True
    static_mods: dict[str, float] = field(default_factory=dict)
    static_ends: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # peptide N and C, protein N and C
    variable_mods: tuple[Mod, ...] = ()
    max_mods: int = 5
    mod_filter: tuple[tuple[int, str], ...] = ()  # (number of a mod, part of an accession): other proteins don't take that mod
    compound_masses: tuple[float, ...] = ()  # masses that one J of a peptide may carry
    bin_width: float = 1.0005
    bin_offset: float = 0.4
    flanking: bool = True
    use_nl_ions: bool = False
    ion_series: str = "by"
    max_fragment_charge: int = 3
    scale_fragment_loss: bool = False
    precursor_losses: tuple[float, ...] = ()
    activation: str = "ALL"
    override_charge: int = 0
    correct_mass: bool = False
    precursor_charge: tuple[int, int] = (2, 6)
    min_peaks: int = 10
    min_intensity: float = 0.0
    min_intensity_share: float = 0.0
    clear_range: tuple[float, float] = (0.0, 0.0)
    remove_precursor: int = 0
    remove_tolerance: float = 1.5
    decoys: int = 0  # 0 none, 1 concatenated, 2 separate
    decoy_prefix: str = "DECOY_"
    num_results: int = 100
    num_output: int = 5
    explicit_delta_cn: bool = False
    fill_histogram: int = 3000  # synthetic peptides top up smaller histograms to so many entries
    localise: bool = False
    max_proteins: int = 20
    index_peaks: int = 150
    index_min_ions: int = 3
    index_min_reported: int = 3
    index_candidates: int = 100

    def __post_init__(self):
        if self.tolerance_unit not in ("amu", "mmu", "ppm"):
            raise ValueError(f"tolerance_unit: {self.tolerance_unit}")
        if not 0 <= self.isotope_error <= 7:
            raise ValueError("isotope_error is 0 to 7")
        for name in ("digest_mass", "length", "precursor_charge"):
            lo, hi = getattr(self, name)
            if lo > hi:
                raise ValueError(f"{name}: {lo} > {hi}")
        if len(self.precursor_losses) > 5:
            raise ValueError("at most 5 precursor losses")
        if any(m.which_term not in (0, 1, 2, 3) or m.term_distance < -2 for m in self.variable_mods):
            raise ValueError("which_term is 0 to 3, term_distance -2 or more")
        if self.bin_width <= 0:
            raise ValueError("bin_width must be positive")

    @property
    def residue_mods(self) -> dict[str, float]:
        """Masses added to residues; J weighs nothing of its own where compounds sit on it."""
        return {"J": 0.0} | self.static_mods if self.compound_masses else self.static_mods

    @property
    def rules(self) -> list[tuple[str, str, bool]]:
        """(residues, blocking neighbours, whether the cut is before) of all enzymes."""
        own = [(self.cut_after, self.no_cut_before, False), (self.cut_before, self.no_cut_after, True), self.second]
        return [r for r in own if r[0]]

    def narrowed(self, stored: dict) -> Config:
        """With an index's stored settings: masses, mods and enzyme from the index, ranges only narrower."""
        known = {f.name for f in fields(self)}
        out = {k: v for k, v in stored.items() if k in known and k in ("static_mods", "static_ends", "mod_filter", "compound_masses", "cut_after", "no_cut_before", "cut_before", "no_cut_after", "second", "sample", "enzyme", "decoys", "equal_il")}
        for name in ("digest_mass", "length"):
            if name in stored:
                out[name] = (max(getattr(self, name)[0], stored[name][0]), min(getattr(self, name)[1], stored[name][1]))
        out |= {k: tuple(map(tuple, out[k])) if k == "mod_filter" else tuple(out[k]) for k in ("static_ends", "mod_filter", "compound_masses", "second", "sample") if k in out}
        if "variable_mods" in stored:
            out["variable_mods"] = tuple(Mod(**m) for m in stored["variable_mods"])
        return replace(self, **out)


#: Which isotope steps each isotope error setting allows, and the size of a step.
ISOTOPES = {0: (0,), 1: (0, 1), 2: (0, 1, 2), 3: (0, 1, 2, 3), 4: (-1, 0, 1, 2, 3), 5: (-1, 0, 1), 6: (-3, -2, -1, 0, 1, 2, 3), 7: (-2, -1, 0, 1, 2)}


def isotope_step(setting: int) -> float:
    return 4.0070995 if setting == 7 else C13_GAP


def read_params(text: str) -> dict[str, str]:
    """``name = value # comment`` lines of a parameter file; the last setting of a name wins. The enzyme table at the end is
    read with ``read_enzymes``."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line.startswith("["):
            break
        if "=" in line:
            name, value = line.split("=", 1)
            out[name.strip()] = value.strip()
    return out


def read_enzymes(text: str) -> dict[int, tuple[str, str, bool]]:
    """The enzyme table of a parameter file by number: residues, blocking neighbours, whether the cut is before them.
    Lines are ``number. name sense residues blocking``; sense 1 cuts after, 0 before, ``-`` is none."""
    table = text.partition("[COMET_ENZYME_INFO]")[2]
    out = {}
    for line in table.splitlines():
        part = line.split()
        if len(part) == 5 and part[0].rstrip(".").isdigit():
            out[int(part[0].rstrip("."))] = (part[3].replace("-", ""), part[4].replace("-", ""), part[2] == "0")
    return out


def enzymes_of(params: dict[str, str], table: dict[int, tuple[str, str, bool]]) -> dict:
    """Settings of the search, second and sample enzymes that a file names by number. Without residues (cut everywhere) a
    search enzyme is none; a number that the table lacks is an error."""
    out: dict = {}
    rule = {}
    for name in ("search_enzyme_number", "search_enzyme2_number", "sample_enzyme_number"):
        if name in params:
            number = int(params[name])
            if number not in table:
                raise ValueError(f"{name}: no enzyme {number} in the table")
            rule[name] = table[number]
    if "search_enzyme_number" in rule:
        residues, blocked, before = rule["search_enzyme_number"]
        out |= {"enzyme": bool(residues), "cut_after": "" if before else residues, "no_cut_before": "" if before else blocked, "cut_before": residues if before else "", "no_cut_after": blocked if before else ""}
    if rule.get("search_enzyme2_number", ("",))[0]:
        out["second"] = rule["search_enzyme2_number"]
    sample = rule.get("sample_enzyme_number") or rule.get("search_enzyme_number")
    if sample:
        out["sample"] = sample
    return out


#: on/off parameters and masses added to every end, by their names in a parameter file.
SWITCHES = {"clip_nterm_methionine": "clip_met", "equal_I_and_L": "equal_il", "use_NL_ions": "use_nl_ions", "correct_mass": "correct_mass", "explicit_deltacn": "explicit_delta_cn", "scale_fragmentNL": "scale_fragment_loss"}
ENDS = ("add_Nterm_peptide", "add_Cterm_peptide", "add_Nterm_protein", "add_Cterm_protein")


#: Switches of the ion series, and parameters that a session here has no use for (threads, output files,
#: batches, formats and folders are arguments of the sinks, masses of averages aren't used).
SERIES = {"use_A_ions": "a", "use_B_ions": "b", "use_C_ions": "c", "use_X_ions": "x", "use_Y_ions": "y", "use_Z_ions": "z"}
UNUSED = frozenset(
    "database_name num_threads spectrum_batch_size output_suffix text_file_extension output_sqtstream output_sqtfile output_txtfile output_pepxmlfile output_mzidentmlfile output_percolatorfile "
    "print_expect_score print_ascorepro_score export_additional_pepxml_scores resolve_fullpaths pinfile_protein_delimiter peff_verbose_output old_mods_encoding max_index_runtime create_fragment_index "
    "create_peptide_index index_search_type fragindex_skipreadprecursors mass_type_parent mass_type_fragment scan_range ms_level search_enzyme_number search_enzyme2_number sample_enzyme_number "
    "protein_modslist_file compoundmods_file peff_obo peff_format spectral_library_name require_variable_mod nucleotide_reading_frame mango_search".split()
)


def config_from_params(params: dict[str, str], enzymes: dict[int, tuple[str, str, bool]] | None = None, unknown: list[str] | None = None) -> Config:
    """The settings of a parameter file. ``enzymes``: its table, needed where it names enzymes. Names that have no field
    here and aren't known to have none are appended to ``unknown``, or an error without it."""
    pair = lambda v, t: tuple(t(x) for x in v.split())[:2]
    missing: list[str] = []
    out: dict = {}
    units = {"0": "amu", "1": "mmu", "2": "ppm"}
    plain = {
        "peptide_mass_tolerance": ("tolerance", float), "isotope_error": ("isotope_error", int), "allowed_missed_cleavage": ("missed_cleavages", int), "num_results": ("num_results", int),
        "num_output_lines": ("num_output", int), "fragment_bin_tol": ("bin_width", float), "fragment_bin_offset": ("bin_offset", float), "max_fragment_charge": ("max_fragment_charge", int),
        "minimum_peaks": ("min_peaks", int), "minimum_intensity": ("min_intensity", float), "decoy_search": ("decoys", int), "decoy_prefix": ("decoy_prefix", str), "num_enzyme_termini": ("termini", int),
        "max_variable_mods_in_peptide": ("max_mods", int), "remove_precursor_peak": ("remove_precursor", int), "remove_precursor_tolerance": ("remove_tolerance", float), "max_duplicate_proteins": ("max_proteins", int), "activation_method": ("activation", str), "override_charge": ("override_charge", int),
        "fragindex_min_ions_score": ("index_min_ions", int), "fragindex_min_ions_report": ("index_min_reported", int), "fragindex_num_spectrumpeaks": ("index_peaks", int), "percentage_base_peak": ("min_intensity_share", float),
    }
    if enzymes is not None:
        out |= enzymes_of(params, enzymes)
    elif params.get("search_enzyme_number", "1") != "1":
        raise ValueError("search_enzyme_number needs the file's enzyme table")
    if SERIES.keys() & params.keys():
        series = {"use_B_ions": "1", "use_Y_ions": "1"} | params
        out["ion_series"] = "".join(s for name, s in SERIES.items() if series.get(name, "0") == "1")
    for name, value in params.items():
        if name in plain:
            out[plain[name][0]] = plain[name][1](value)
        elif name == "peptide_mass_units":
            out["tolerance_unit"] = units[value]
        elif name in ("digest_mass_range", "clear_mz_range"):
            out["digest_mass" if name[0] == "d" else "clear_range"] = pair(value, float)
        elif name in ("peptide_length_range", "precursor_charge"):
            out["length" if "length" in name else name] = pair(value, int)
        elif name in SWITCHES:
            out[SWITCHES[name]] = value == "1"
        elif name in ENDS:
            ends = list(out.get("static_ends", (0.0,) * 4))
            ends[ENDS.index(name)] = float(value)
            out["static_ends"] = tuple(ends)
        elif name == "mass_offsets":
            out["mass_offsets"] = tuple(float(x) for x in value.split()) or (0.0,)
        elif name == "theoretical_fragment_ions":
            out["flanking"] = value == "0"
        elif name == "precursor_tolerance_type":
            out["tolerance_on_mz"] = value == "1"
        elif name == "precursor_NL_ions":
            out["precursor_losses"] = tuple(float(x) for x in value.split())
        elif name.startswith("add_") and len(name) > 5 and name[5] == "_":
            if float(value):
                out.setdefault("static_mods", {})[name[4]] = float(value)
        elif name.startswith("variable_mod") and name[12:].isdigit():
            part = value.split()
            if float(part[0].split(",")[0]):
                counts, loss = part[3].split(","), [*(float(x) for x in part[7].split(",")), 0.0] if len(part) > 7 else [0.0, 0.0]
                mod = Mod(float(part[0]), part[1].replace("X", ""), int(counts[-1]), int(part[2]), len(part) > 6 and part[6] == "1", loss[0], loss[1], int(counts[0]) if len(counts) > 1 else 0, int(part[4]) if len(part) > 4 else -1, int(part[5]) if len(part) > 5 else 0, len(part) > 6 and part[6] == "-1")
                out["variable_mods"] = (*out.get("variable_mods", ()), mod)
        elif name not in SERIES and name not in UNUSED:
            missing.append(name)
    if missing and unknown is None:
        raise ValueError(f"unknown parameters: {', '.join(missing)}")
    (unknown if unknown is not None else []).extend(missing)
    return Config(**out)
