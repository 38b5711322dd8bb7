"""Summary statistics of alignments: one row each, as the ranking of motifs takes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ribolens.operators import alignment as al
from ribolens.operators.streamed import small_summaries


def summary(rows: DataFrame, pairs: Sequence[tuple[int, int]], width: int) -> DataFrame:
    """One row for each alignment of rows(msa_id, seq_id, aseq, weight) with the paired columns pairs (i, j): size, weight,
    length, GC, entropy, conserved columns, mutual information of the pairs, and weighted identity."""
    sums = small_summaries(rows, pairs, width, 10, al.LARGE_BLOCK)
    return al.totals(rows).join(al.with_large_identities(sums, rows, width), "msa_id", "left").select("msa_id", "num", "total_weight", "mean_len", "mean_gc", "entropy", "conserved", "mi", "mean_identity")
