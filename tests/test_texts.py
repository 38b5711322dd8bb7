"""What a Stockholm text's lines share is worked out once."""

from ribolens.sources import stockholm


def test_longest_name_is_not_sought_for_each_line(spark):
    kind = "msa_id string, ordinal int, seq_id string, weight double, start int, stop int, score double, aseq string, ss string"
    rows = spark.createDataFrame([("m", 1, "a", 1.0, None, None, None, "AC", None), ("m", 2, "long", 1.0, None, None, None, "GU", "<>"), ("n", 1, "b", 1.0, None, None, None, "A", None)], kind)
    columns = spark.createDataFrame([("m", "a_very_long_tag", "..")], "msa_id string, tag string, value string")
    text = stockholm.stockholm_text(rows, columns)
    assert "array_max" not in text._jdf.queryExecution().optimizedPlan().toString()
    got = {r.msa_id: r.value.split("\n\n")[-1] for r in text.collect()}
    names = ["a", "long", "#=GR long SS", "#=GC a_very_long_tag"]
    assert got == {"m": "\n".join(f"{n:<21}{x}" for n, x in zip(names, ["AC", "GU", "<>", ".."], strict=True)) + "\n//", "n": "b A\n//"}
