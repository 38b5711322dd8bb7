"""Kept columns as masks against the consensus by cells."""

import random

from ribolens.operators import alignment as al


def test_masks_equal_consensus_without_cells(spark):
    rng = random.Random(5)
    rows = [(f"m{k % 7}", k, "".join(rng.choice("ACGU" + "-" * (c % 9)) if c % 11 else "-" for c in range(64)), rng.choice([0.5, 1.0])) for k in range(200)]
    rows += [("none", 1, "-" * 64, 1.0), ("light", 1, "A" * 64, 0.0), ("light", 2, "-" * 64, 0.0)]
    at = spark.createDataFrame(rows, "msa_id string, seq_id long, aseq string, weight double")
    kept = {}
    for r in al.consensus_columns(al.cells(at)).where("rf <> '.'").collect():
        kept.setdefault(r.msa_id, set()).add(r.col)
    for limit in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
        masks = al.column_masks(at, 64)
        got = {(r.msa_id, r.seq_id): (r.kept, r.filled) for r in al.masked_columns(at.join(masks, "msa_id"), 64, ("kept", "filled")).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for msa, seq_id, aseq, _ in rows:
            filled = {c for m, _, text, _ in rows if m == msa for c, x in enumerate(text, 1) if x in "ACGU"}
            assert got[msa, seq_id] == tuple("".join(x for c, x in enumerate(aseq, 1) if c in some) for some in (kept.get(msa, set()), filled))
    assert "Generate" not in masks._jdf.queryExecution().toString()
