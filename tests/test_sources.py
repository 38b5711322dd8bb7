"""Round trips of the formats."""

from ribolens.sources import fasta, stockholm
from ribolens.streaming.hits import sequence_stream, windowed_hits

STO = """# STOCKHOLM 1.0

#=GS s1 WT 0.75
#=GS s2 WT 1.25
#=GS s1 DE 3..14\t7.500000

s1          ACGU-ACG
#=GR s1 SS  (((..)))
s2          ACGUUACG
#=GC SS_cons <<<..>>>

s1          UUAA
s2          UU-A
#=GC SS_cons ....
//
# STOCKHOLM 1.0

x           AC
//
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first seq\nACG\nTTA\n>two\nGG\n>three only head\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(map(tuple, rows.collect())) == [("one", "first seq", "ACGTTA"), ("three", "only head", ""), ("two", "", "GG")]
    fasta.write_fasta(rows, str(tmp_path / "out"), 4)
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "out")).collect())) == [("one", "first seq", "ACGTTA"), ("two", "", "GG")]


def test_stockholm(spark, tmp_path):
    (tmp_path / "a.sto").write_text(STO)
    rows, columns = stockholm.read_stockholm(spark, str(tmp_path / "a.sto"))
    got = {r.seq_id: r for r in rows.collect()}
    assert got["s1"].aseq == "ACGU-ACGUUAA" and got["s2"].aseq == "ACGUUACGUU-A" and got["x"].aseq == "AC"
    assert (got["s1"].weight, got["s1"].start, got["s1"].stop, got["s1"].score, got["s1"].ss) == (0.75, 3, 14, 7.5, "(((..)))")
    assert (got["s2"].ordinal, got["x"].weight, got["x"].start) == (2, 1.0, None)
    assert [(c.tag, c.value) for c in columns.collect()] == [("SS_cons", "<<<..>>>....")]
    stockholm.write_stockholm(rows, columns, str(tmp_path / "out"))
    again, notes = stockholm.read_stockholm(spark, str(tmp_path / "out"))
    drop = lambda frame: sorted(tuple(r)[1:] for r in frame.collect())
    assert str(drop(again)) == str(drop(rows)) and drop(notes) == drop(columns)
    assert any(r.value.startswith("2 12\ns1        ACGU-ACGUUAA\n") for r in stockholm.phylip_text(rows).collect())


def test_stats_and_newick(spark, tmp_path):
    (tmp_path / "s").write_text("Num=4\t Len=12.5  x\nScore=-1e3\n")
    assert sorted((r.key, r.value) for r in stockholm.stats_lines(spark, str(tmp_path / "s")).collect()) == [("Len", "12.5"), ("Num", "4"), ("Score", "-1e3")]
    tree = spark.createDataFrame([(1, "((a:1,b:2)ab:0.5,c:3)r;"), (2, "x;")], "tree_id long, newick string")
    edges = {(r.tree_id, r.name): r for r in stockholm.newick_edges(tree).collect()}
    assert edges[1, "a"].parent == edges[1, "b"].parent == edges[1, "ab"].node and edges[1, "ab"].parent == edges[1, "c"].parent == edges[1, "r"].node
    assert edges[1, "r"].parent is None and edges[1, "b"].length == 2 and edges[2, "x"].parent is None


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">one x\nACGT\n>two\nGG\n")
    query = sequence_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seqs").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.acc, r.seq, r.gc) for r in spark.table("seqs").collect()) == [("one", "ACGU", 0.5), ("two", "GG", 1.0)]
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:00:00", "a", 2.0)], "ts string, event_type string, value double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value")
    assert sorted((r.n, r.best) for r in windowed_hits(rows).collect()) == [(1, 2.0), (2, 3.0)]


def test_candidate_files(spark, tmp_path):
    """Records of both kinds of files read back; broken ones are marked, not lost."""
    from ribolens.sources.candidatefiles import read_candidates, write_candidates

    rows = [(3, 0, 5, 9, -1.25, "GAAAC", "(...)"), (-1, 2, 1, 2, 0.0, "AC", ".."), (10, 1, 7, 7, 12.5, "A", ".")]
    frame = spark.createDataFrame([*rows, (4, 1, None, 3, 0.0, "A", ".")], "seq_id long, cand_id long, start long, stop long, energy double, seq string, ss string")
    write_candidates(frame.coalesce(1), f"{tmp_path}/good")
    got = read_candidates(spark, f"{tmp_path}/good")
    assert sorted(tuple(r) for r in got.collect()) == sorted((*r, True) for r in rows)
    (tmp_path / "bad").write_text(">1_2_3_4 -1.5\nACG\n(.)\n>1_2_3 -1.5\nACG\n...\n>5_0_1_2 x\nAC\n..\n>6_0_1_2 1\nAC\n.\n>7_0_1_1 1\n")
    got = {r.seq: tuple(r) for r in read_candidates(spark, str(tmp_path / "bad")).where("seq_id IS NOT NULL").collect()}
    assert got == {"ACG": (1, 2, 3, 4, -1.5, "ACG", "(.)", True), "AC": (6, 0, 1, 2, 1.0, "AC", ".", False), None: (7, 0, 1, 1, 1.0, None, None, False)}
    assert read_candidates(spark, str(tmp_path / "bad")).count() == 5
