"""Blocks of whole texts against slices, for characters of all kinds."""

from ribolens.catalog import structures
from ribolens.catalog import views as v


def test_texts_are_cleaned_before_they_are_cut(spark, tmp_path):
    texts = ["acgt\r\nU.- \U0001f600G" * 20, "A" * 60, "c" * 61, "\n", "", None, "é" * 119 + "t", "ßTu" * 41]
    spark.createDataFrame([(k, t, "en", "web") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = lambda t: "".join(c.upper().replace("T", "U") if c in "ACGTUacgtu" else "-" for c in t)
    expected = {(f"en:web:{n // 60}", k): clean(t[n : n + 60]).ljust(60, "-") for k, t in enumerate(texts) for n in range(0, len(t or ""), 60)}
    assert {(r.msa_id, r.seq_id): r.aseq for r in v.alignment_rows(spark, str(tmp_path)).collect()} == expected
    raw = structures.raw_folds(spark, str(tmp_path)).select("seq_id", "seq")
    assert {r.seq_id: r.seq for r in raw.collect()} == {k * 100_000 + int(m.split(":")[-1]): s for (m, k), x in expected.items() if (s := x.replace("-", ""))}
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1  # once for a text, not for each block
