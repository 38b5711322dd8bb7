"""Files of loop energies: a first line, then sections of numbers, each under a header line."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import SparkSession

from ribolens.kernels.loops import LONGEST, NEVER, LoopModel, default_model

#: Section, table, and the part of the table that its numbers fill in order; the first pair kind and residue are left out
#: where the format does so.
SHAPES = {
    "stack_energies": ("stack", np.s_[1:, 1:]),
    "hairpin": ("hairpin", np.s_[:]),
    "bulge": ("bulge", np.s_[:]),
    "internal_loop": ("internal", np.s_[:]),
    "mismatch_hairpin": ("mismatch_hairpin", np.s_[1:]),
    "mismatch_interior": ("mismatch_interior", np.s_[1:]),
    "dangle5": ("dangle5", np.s_[:]),
    "dangle3": ("dangle3", np.s_[:]),
    "int11_energies": ("int11", np.s_[1:, 1:]),
    "int21_energies": ("int21", np.s_[1:, 1:]),
    "int22_energies": ("int22", np.s_[1:, 1:, 1:, 1:, 1:, 1:]),
}
WORDS = {"INF": NEVER, "DEF": -50, "NST": 0}
# Fixed value: the first line of the public format.
HEADER = "## RNAfold parameter file"


def _filled(table: np.ndarray, at: tuple, values: list[str], extrapolate: float, section: str) -> np.ndarray:
    """table with a section's numbers: ``*`` keeps what is there, ``x`` extrapolates a loop from the last number."""
    new = table.copy()
    part = new[at].copy()
    flat = part.reshape(-1)
    if len(values) != len(flat):
        raise ValueError(f"{section}: {len(values)} numbers instead of {len(flat)}")
    last = None
    for n, word in enumerate(values):
        if word.startswith("*"):
            continue
        if word.startswith("x"):
            if not last:
                raise ValueError(f"{section}: nothing to extrapolate from")
            flat[n] = flat[last] + round(extrapolate * float(np.log(n / last)))
            continue
        flat[n] = WORDS[word] if word in WORDS else int(word)
        last = n
    new[at] = flat.reshape(part.shape)
    if section.startswith("dangle"):  # no neighbour costs nothing, and no dangling end costs anything
        new = np.minimum(new, 0)
    return new


def parse_energies(text: str, base: LoopModel | None = None) -> LoopModel:
    """The model of a parameter file's text; sections that it lacks are those of ``base``, and so are enthalpies, since
    energies hold at 37 degrees. A text without the header, or a section of another size, is a ValueError."""
    model = base or default_model()
    if not text.lstrip().startswith(HEADER):
        raise ValueError("no parameter file")
    changed: dict = {}
    for part in re.split(r"^#(?!#)\s*", re.sub(r"/\*.*?\*/", " ", text), flags=re.M)[1:]:
        name, _, body = part.partition("\n")
        section, words = name.split()[0] if name.split() else "", body.split()
        if section in SHAPES:
            table, at = SHAPES[section]
            changed[table] = _filled(changed.get(table, getattr(model, table)), at, words, model.extrapolate, section)
        elif section == "ML_params":
            changed |= dict(zip(("ml_base", "ml_closing", "ml_intern", "terminal_au"), map(int, words), strict=True))
        elif section == "NINIO":
            changed |= dict(zip(("ninio", "most_ninio"), map(int, words), strict=True))
        elif section in ("Tetraloops", "Triloops"):
            changed[section.lower()] = {loop: int(e) for loop, e in zip(words[::2], words[1::2], strict=True)}
    return model.with_tables(**changed)


def energies_text(model: LoopModel) -> str:
    """The file of a model, which parse_energies reads back."""
    line = lambda x: " ".join("INF" if v >= NEVER else str(int(v)) for v in np.atleast_1d(x))
    out = [HEADER]
    for section, (table, at) in SHAPES.items():
        part = getattr(model, table)[at]
        out += ["", f"# {section}", *(line(x) for x in part.reshape(-1, part.shape[-1]))]
    out += ["", "# ML_params", line([model.ml_base, model.ml_closing, model.ml_intern, model.terminal_au]), "", "# NINIO", line([model.ninio, model.most_ninio])]
    for section, loops in (("Tetraloops", model.tetraloops), ("Triloops", model.triloops)):
        out += ["", f"# {section}", *(f"{loop} {e}" for loop, e in loops.items())]
    return "\n".join(out) + "\n"


def read_energies(spark: SparkSession, path: str, base: LoopModel | None = None) -> LoopModel:
    """The model of a parameter file, one file of some hundred kilobytes that every executor then gets with its tasks."""
    (row,) = spark.read.text(path, wholetext=True).limit(2).collect()
    return parse_energies(row["value"], base)


assert LONGEST == 30  # loops of 0 to 30 residues, as the format has them
