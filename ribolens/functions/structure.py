"""Column functions on structure strings, names and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The residues of each IUPAC symbol.
IUPAC = {"R": "AG", "Y": "CU", "M": "AC", "K": "GU", "S": "CG", "W": "AU", "H": "ACU", "B": "CGU", "V": "ACG", "D": "AGU", "N": "ACGU"}


def hairpins(structure: Column) -> Column:
    """How many loops are closed by a pair with only unpaired places inside."""
    return F.size(F.regexp_extract_all(structure, F.lit(r"(\(\.*\))"), F.lit(1)))


def without_pseudoknots(wuss: Column) -> Column:
    return F.regexp_replace(wuss, "[A-Za-z]", ".")


def plain_brackets(wuss: Column) -> Column:
    """All nested brackets as < and >, everything else unpaired."""
    return F.regexp_replace(F.translate(wuss, "([{)]}", "<<<>>>"), "[^<>]", ".")


def iupac_pattern(motif: str) -> str:
    """A regular expression for a motif with IUPAC symbols."""
    return "".join(f"[{IUPAC[c]}]" if c in IUPAC else c for c in motif.upper().replace("T", "U"))


def common_prefix(one: Column, two: Column, mark: str = ".") -> Column:
    """The leading parts between marks that both names share."""
    a, b = F.split(one, f"\\{mark}"), F.split(two, f"\\{mark}")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.array_join(F.slice(a, 1, F.when(first == 0, F.size(a)).otherwise((first - 1).cast("int"))), mark)


def share(part: Column, whole: Column, kinds: int) -> Column:
    """part / whole, and 1 / kinds for 0 / 0."""
    return F.when((whole == 0) & (part == 0), F.lit(1.0 / kinds)).otherwise(part / F.nullif(whole, F.lit(0)))


def log_sum_exp(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, log_sum): ln of the sum of e to the values, held against the largest so that it can't overflow."""
    top = rows.groupBy(key).agg(F.max(value).alias("top"))
    return rows.join(top, key).groupBy(key).agg((F.first("top") + F.log(F.sum(F.exp(F.col(value) - F.col("top"))))).alias("log_sum"))
