import gzip

import pytest
from pyspark.errors import AnalysisException

from weft.operators.edges import top_edges
from weft.queries import GRAPH, MERGES
from weft.sources import edges as E


def test_round_trip_of_mixed_files(spark, tmp_path):
    rows = [f"{j}\t{i}  {d!r}" for i, j, d in GRAPH]
    (tmp_path / "a.txt").write_text("\n".join(rows[:7]) + "\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("\n".join(rows[7:]) + "\n")
    edges = E.read_edges(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt.gz")])
    assert sorted(map(tuple, edges.collect())) == sorted(GRAPH)
    assert E.max_singleton(edges) == 23 and E.max_singleton(edges.limit(0)) == 0
    assert top_edges(edges, 1).collect()[0].dist == 1e-100
    E.write_edges(edges, str(tmp_path / "out"), compression="none")
    assert sorted(map(tuple, E.read_edges(spark, str(tmp_path / "out")).collect())) == sorted(GRAPH)  # every digit
    assert not any("E" in r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    E.write_split(edges, str(tmp_path / "split"), 3)
    assert spark.read.parquet(str(tmp_path / "split")).count() == len(GRAPH)
    with pytest.raises(AnalysisException):
        E.read_edges(spark, str(tmp_path / "missing")).count()


def test_forest_sizes_and_weights(spark, tmp_path):
    forest = spark.createDataFrame([(*m, k) for k, m in enumerate(MERGES, 1)], "c1 long, c2 long, height double, merged long, merge_no long")
    for part in ("merge_no <= 4", "merge_no > 4"):  # appended round by round
        E.write_forest(forest.where(part), str(tmp_path / "tree"))
    back = E.read_forest(spark, str(tmp_path / "tree"))
    assert sorted(map(tuple, back.collect())) == sorted(MERGES)
    (tmp_path / "sizes").write_text("24 2\n25 3\n")
    assert sorted(map(tuple, E.read_sizes(spark, str(tmp_path / "sizes")).collect())) == [(24, 2), (25, 3)]
    E.write_weighted(spark.createDataFrame([(1, 2, 6.0, 3)], "i long, j long, sum_d double, w long"), str(tmp_path / "w"))
    (row,) = E.read_weighted_edges(spark, str(tmp_path / "w")).collect()
    assert tuple(row) == (1, 2, 6.0, 3)
    (tmp_path / "bad").write_text("1 2 3\n2 1 4\nx\n")
    assert [(r.line, r.problem) for r in E.check_lines(spark, str(tmp_path / "bad")).orderBy("line").collect()] == [(2, "duplicate"), (3, "format")]
    assert E.as_intervals(spark.createDataFrame([(1, 2, 0.5)], "i long, j long, dist double")).collect()[0].ub == 0.5


def test_plain_numbers(spark):
    from pyspark.sql import functions as F

    values = [0.0, 1.0, -2.5, 1e-100, 4.94e-324, 1.7976931348623157e308, 12345678.9, 1.5e7, 1.23456789012345e10, 1e21, -3.25e-7, 0.1 + 0.2]
    got = spark.createDataFrame([(x,) for x in values], "v double").select("v", E.plain(F.col("v")).alias("s")).collect()
    assert all(float(r.s) == r.v and not set(r.s) & set("eE") for r in got), got


def test_line_numbers_of_split_files(spark, tmp_path):
    rows = [f"{k} {k + 1} 0.5" for k in range(1, 400)]
    rows[29], rows[350] = "x", "2 1 0.25"
    (tmp_path / "a.txt").write_text("\n".join(rows) + "\n")
    (tmp_path / "b.txt").write_text("7 7 1\n1 3 1\n2 3 1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("500b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            found = E.check_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).orderBy("line").collect()
            assert [(r.line, r.problem) for r in found] == [(30, "format"), (351, "duplicate"), (400, "self edge"), (402, "duplicate")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_forests_with_merges_below_their_parts(spark, tmp_path):
    (tmp_path / "f").write_text("1 2 0.5 24\n24 3 0.6 20\n")
    with pytest.raises(Exception, match="not above its parts"):
        E.read_forest(spark, str(tmp_path / "f")).collect()


def test_distances_above_psi_are_named(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.5)], "i long, j long, dist double")
    with pytest.warns(UserWarning, match="1 edges are above"):
        assert E.checked(edges, 1.0).count() == 1
    with pytest.raises(ValueError, match="illegal edge"):
        E.checked(edges.union(edges.selectExpr("j", "j", "dist")), 1.0)


def test_vector_and_split_text(spark, tmp_path):
    E.write_vector(spark.createDataFrame([(1, 0.5), (2, 1.5)], "index long, value double"), str(tmp_path / "v"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "v")).collect()) == ["1\t0.5", "2\t1.5"]
    rows = spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long")
    E.write_split(rows, str(tmp_path / "s"), 4, text=True)
    assert len(list((tmp_path / "s").glob("*.gz"))) == 4 and spark.read.text(str(tmp_path / "s")).count() == 100
