"""Columns are dropped from rows, not from rows of single cells."""

from ribolens.catalog import alignments


def test_gappy_columns_are_cut_from_whole_rows(spark):
    rows = spark.createDataFrame([("a", 1, "AC--", 1.0), ("a", 2, "-CG-", 1.0), ("b", 3, "----", 1.0)], "msa_id string, seq_id long, aseq string, weight double")
    kept = alignments._kept_columns(rows)
    assert {(r.msa_id, r.seq_id, r.aseq) for r in kept.collect()} == {("a", 1, "AC-"), ("a", 2, "-CG")}
