"""Column functions on nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base pairs that count as canonical, and the residue codes (other symbols are 0).
CANONICAL = ("AU", "UA", "CG", "GC", "GU", "UG")
CODES = {"A": 1, "C": 2, "G": 3, "U": 4, "T": 4}

# The standard genetic code; "*" ends.
GENETIC_CODE = {
    "F": "UUU UUC", "L": "UUA UUG CUU CUC CUA CUG", "I": "AUU AUC AUA", "M": "AUG", "V": "GUU GUC GUA GUG",
    "S": "UCU UCC UCA UCG AGU AGC", "P": "CCU CCC CCA CCG", "T": "ACU ACC ACA ACG", "A": "GCU GCC GCA GCG",
    "Y": "UAU UAC", "H": "CAU CAC", "Q": "CAA CAG", "N": "AAU AAC", "K": "AAA AAG", "D": "GAU GAC", "E": "GAA GAG",
    "C": "UGU UGC", "W": "UGG", "R": "CGU CGC CGA CGG AGA AGG", "G": "GGU GGC GGA GGG", "*": "UAA UAG UGA",
}


def residues(text: Column) -> Column:
    """Only nucleotides, upper case, T as U."""
    return F.translate(F.upper(F.regexp_replace(text, "[^ACGTUacgtu]", "")), "T", "U")


def aligned(text: Column, width: int) -> Column:
    """The first ``width`` characters, with a gap for each that is no nucleotide."""
    return gapped(F.substring(text, 1, width))


def gapped(text: Column) -> Column:
    """The nucleotides, upper case, T as U, with a gap for each character that is none."""
    return F.translate(F.upper(F.regexp_replace(text, "[^ACGTUacgtu]", "-")), "T", "U")


def ungapped(seq: Column) -> Column:
    return F.translate(seq, ".-", "")


def count_of(seq: Column, symbols: str) -> Column:
    """How many characters of seq are among ``symbols``."""
    return F.length(seq) - F.length(F.translate(seq, symbols, ""))


def gc_share(seq: Column) -> Column:
    return count_of(seq, "GC") / F.nullif(F.length(seq), F.lit(0))


def reverse_complement(seq: Column) -> Column:
    """Also of IUPAC symbols; U and T give A, and A gives U."""
    return F.reverse(F.translate(seq, "ACGUTRYMKSWHBVDN", "UGCAAYRKMSWDVBHN"))


def base_code(base: Column) -> Column:
    code = F.lit(0)
    for symbol, n in CODES.items():
        code = F.when(F.upper(base) == symbol, n).otherwise(code)
    return code


def is_canonical(left: Column, right: Column) -> Column:
    return F.concat(left, right).isin(*CANONICAL)


def translated(seq: Column, frame: int) -> Column:
    """Amino acids from the given frame (0 to 2) on; codons with other symbols give X."""
    codes = F.create_map(*[F.lit(x) for aa, codons in GENETIC_CODE.items() for c in codons.split() for x in (c, aa)])
    count = F.floor((F.length(seq) - frame) / 3).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda n: F.coalesce(F.element_at(codes, F.substr(seq, n * 3 + frame + 1, F.lit(3))), F.lit("X"))), "")


def species_id(hit: Column) -> Column:
    """Project of an accession of four letters and a digit, else what comes before the slash."""
    return F.when(hit.rlike("^[A-Za-z]{4}[0-9]"), F.substring(hit, 1, 4)).otherwise(F.split(hit, "/")[0])


def hit_part(hit: Column, n: int) -> Column:
    """Part n (1: name, 2: start, 3: end) of name/start-end."""
    return F.regexp_extract(hit, r"^(\S+)/(\d+)-(\d+)$", n)


def trimmed(seq: Column, bad: str = "^[^ACGU]+|[^ACGU]+$") -> Column:
    """seq without its degenerate ends."""
    return F.regexp_replace(seq, bad, "")


def masked(seq: Column, start: Column, stop: Column) -> Column:
    """N in place of the residues start to stop (from 1, both included)."""
    return F.overlay(seq, F.repeat(F.lit("N"), F.greatest(stop - start + 1, F.lit(0))), start)
