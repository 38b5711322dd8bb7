"""Line dedup by a tree of line templates.

A line's path in the tree is its number of tokens, then its first LEAD tokens, with every token that holds a digit
replaced by a wildcard. In a leaf, lines belong to one template if their tokens agree once wildcards are in place; also
if all but one of the three thirds of the tokens after the first LEAD agree (the third that differs is a variable field:
with three tokens or fewer, one token) in lines of FIELD_TOKENS at least, and so do chains of such lines. Templates that occur in several documents are
dropped but for their first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribolens.llm.shared import sized, unused, written
from ribolens.operators.clustering import components

LEAD = 3
WILD = "<*>"
#: Lines of fewer tokens have no variable field but tokens with digits: in short lines one other word is another sentence.
FIELD_TOKENS = 6


def line_rows(docs: DataFrame, key: str, text: str, lead: int) -> DataFrame:
    """(doc, version, line, form, k0, k1, k2): form is the masked line's digest, k0 to k2 128-bit keys of the leaf with one
    third left out, null where that third has no tokens. Blank lines are no rows.

    Tokens are parted by white space; those with a digit are wildcards, but not where no token would be left: such lines
    (numbers, links, rows of figures) are alike only if they are equal. Parts are hashed once, keys combine their hashes.
    """
    rows = docs.select(docs[key].alias("doc"), F.xxhash64(docs[text]).alias("version"), F.posexplode(F.split(docs[text], "\n")).alias("line", "value"))
    place = ["doc", "version", "line"]
    has_digit = lambda t: t.rlike("[0-9]")
    rows = rows.select(*place, has_digit(F.col("value")).alias("digits"), F.array_remove(F.split("value", r"\s+"), "").alias("plain")).where(F.size("plain") > 0)
    masked = F.transform("plain", lambda t: F.when(has_digit(t), F.lit(WILD)).otherwise(t))
    masked = F.when(F.col("digits") & F.exists("plain", lambda t: ~has_digit(t)), masked).otherwise(F.col("plain"))
    rows = rows.select(*place, masked.alias("t"), F.size("plain").alias("n"))
    rest = F.greatest(F.col("n") - lead, F.lit(0))
    cuts = [F.ceil(rest * m / 3).cast("int") for m in range(4)]
    parts = [F.slice("t", 1, lead), *[F.slice("t", lead + 1 + low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)]]
    hashes = [F.xxhash64(F.lit(seed), part).alias(f"p{m}_{seed}") for m, part in enumerate(parts) for seed in (0, 1)]
    rows = rows.select(*place, "n", F.unhex(F.md5(F.concat_ws(" ", "t"))).alias("form"), *hashes)

    def leaf(out: int) -> Column:
        kept = [m for m in range(4) if m != out + 1]
        return F.when((cuts[out + 1] > cuts[out]) & (F.col("n") >= FIELD_TOKENS), F.struct(*[F.xxhash64(F.lit(out), "n", *[f"p{m}_{seed}" for m in kept]).alias(f"h{seed}") for seed in (0, 1)]))

    return rows.select(*place, "form", *[leaf(m).alias(f"k{m}") for m in range(3)])


def recurring(rows: DataFrame) -> DataFrame:
    """(form, first): the forms whose template occurs in two documents or more, and the template's first line."""
    place, doc = F.struct("doc", "version", "line"), F.struct("doc", "version")
    forms = rows.groupBy("form").agg(F.min(place).alias("first"), F.min(doc).alias("low"), F.max(doc).alias("high"), *[F.first(f"k{n}").alias(f"k{n}") for n in range(3)])
    forms = written(forms, "line-forms")
    keyed = forms.select("form", F.explode(F.array("k0", "k1", "k2")).alias("k")).where("k IS NOT NULL")
    shared = keyed.groupBy("k").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least <> most").drop("most")
    roots = components(keyed.join(shared, "k").where("form <> least").select(F.col("form").alias("a"), F.col("least").alias("b")))
    roots = written(roots.select(F.col("node").alias("form"), "root"), "line-templates")
    spread = forms.join(roots, "form", "left").withColumn("root", F.coalesce("root", "form"))
    templates = spread.groupBy("root").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    templates = templates.where("NOT (low <=> high)").select("root", "first")
    return spread.select("form", "root").join(templates, "root").select("form", "first")


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", lead: int = LEAD, total: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """docs without the lines whose template an earlier line has in another document, and n_lines, n_dropped of each.

    Lines are parts between "\\n"; blank ones stay. The first line of a template, by (key, text digest, line number),
    stays, also if its own document repeats it; further lines of a recurring template go wherever they are. Templates
    that occur in one document alone are kept. Null texts stay null and empty ones empty, with 0 dropped lines. Equal rows
    act as one document. Null keys come first. The two new columns replace columns of docs of the same names.
    """
    rows = written(line_rows(docs, key, text, lead), "lines")
    again = rows.select("doc", "version", "line", "form").join(sized(written(recurring(rows), "recurring")), "form")
    gone = again.where(~F.struct("doc", "version", "line").eqNullSafe(F.col("first"))).groupBy("doc", "version").agg(F.collect_set("line").alias("gone"))
    doc, version, lines = (unused(docs, c) for c in ("doc", "version", "gone"))
    gone = gone.withColumnsRenamed({"doc": doc, "version": version, "gone": lines})
    met = docs.join(gone, docs[key].eqNullSafe(gone[doc]) & (F.xxhash64(docs[text]) == gone[version]), "left")
    split = F.split(docs[text], "\n")
    mark = lambda places, keep: F.transform(places, lambda n: F.struct(n.alias("n"), F.lit(keep).alias("keep")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lines))
    marked = F.arrays_zip(split.alias("value"), F.sort_array(F.concat(mark(kept, True), mark(F.col(lines), False))).alias("mark"))
    held = F.array_join(F.transform(F.filter(marked, lambda z: z["mark"]["keep"]), lambda z: z["value"]), "\n")
    counts = {total: F.greatest(F.coalesce(F.size(split), F.lit(0)), F.lit(0)), dropped: F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0))}
    new = met.withColumns({text: F.when(F.col(lines).isNull(), docs[text]).otherwise(held), **counts})
    return new.drop(doc, version, lines)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with their recurring lines dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


OP2_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line, unnest(ls) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, line, list_filter(string_split_regex(value, '\s+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, line, CASE WHEN len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9]'))) = 0 THEN w
  ELSE list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) END AS t FROM w),
n AS (SELECT doc_id, line, t, len(t) AS n, (len(t) - 1) // 3 AS m1, (2 * len(t) - 4) // 3 AS m2, array_to_string(t, ' ') AS form FROM k WHERE len(t) > 0),
f AS (SELECT form, any_value(t) AS t, any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2 FROM n GROUP BY form),
g AS (SELECT form, t[1:3] AS head, n, t[4 : 3 + m1] AS a, t[4 + m1 : 3 + m2] AS b, t[4 + m2 :] AS c FROM f WHERE n >= 6),
ks AS (SELECT form, 0 AS o, n, array_to_string(head, ' ') AS h, array_to_string(b, ' ') AS x, array_to_string(c, ' ') AS y FROM g
  UNION ALL SELECT form, 1, n, array_to_string(head, ' '), array_to_string(a, ' '), array_to_string(c, ' ') FROM g WHERE len(b) > 0
  UNION ALL SELECT form, 2, n, array_to_string(head, ' '), array_to_string(a, ' '), array_to_string(b, ' ') FROM g WHERE len(c) > 0),
e AS (SELECT form AS a, low AS b FROM (SELECT form, min(form) OVER (PARTITION BY o, n, h, x, y) AS low FROM ks) WHERE form <> low),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON r.node = s.a),
roots AS (SELECT node, min(root) AS root FROM r GROUP BY node),
p AS (SELECT doc_id, line, coalesce(root, form) AS root FROM n LEFT JOIN roots ON form = node),
q AS (SELECT root, min((doc_id, line)) AS first FROM p GROUP BY root HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT doc_id, line FROM p JOIN q USING (root) WHERE (doc_id, line) <> first)
SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(len(z), 0) AS n_dropped,
  array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(coalesce(z, []), i - 1)), chr(10)) AS text
FROM documents d LEFT JOIN (SELECT doc_id, list(line) AS z FROM gone GROUP BY doc_id) USING (doc_id)
"""
