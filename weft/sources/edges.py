"""Reading and writing edges, merge forests and cluster sizes as text or Parquet.

Text is tab-separated without a header; gzip is recognised by its extension,
and plain and compressed files may be mixed in one list of paths.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EDGE, WEIGHTED = "i long, j long, dist double", "i long, j long, dist double, w long"
FOREST, SIZES = "c1 long, c2 long, height double, merged long", "id long, size long"
LINE = r"^\s*\d+\s+\d+\s+[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def read_table(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """White-space separated fields of all files; a missing path raises."""
    names = [x.strip().split(" ") for x in schema.split(",")]
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(paths).where(F.trim("value") != "")
    return lines.select(parts.alias("p")).select(*[F.get("p", F.lit(k)).cast(kind).alias(name) for k, (name, kind) in enumerate(names)])


def canonical(edges: DataFrame) -> DataFrame:
    """Ends in order, i < j."""
    rest = [c for c in edges.columns if c not in ("i", "j")]
    return edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *rest)


def read_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return canonical(read_table(spark, paths, EDGE))


def read_weighted_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(i, j, sum_d, w): the stored mean times its count."""
    df = canonical(read_table(spark, paths, WEIGHTED))
    return df.select("i", "j", (F.col("dist") * F.col("w")).alias("sum_d"), "w")


def as_intervals(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", F.col("dist").alias("lb"), F.col("dist").alias("ub"))


def read_forest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(c1, c2, height, merged); reading fails at a merge whose id isn't above those of its parts."""
    forest = read_table(spark, paths, FOREST)
    bad = F.assert_true((F.col("merged") > F.col("c1")) & (F.col("merged") > F.col("c2")), F.concat(F.lit("not above its parts: "), F.coalesce(F.col("merged").cast("string"), F.lit("no id"))))
    return forest.where(bad.isNull())


def read_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_table(spark, paths, SIZES)


def max_singleton(edges: DataFrame) -> int:
    """The largest id of the edges, 0 without any."""
    return edges.agg(F.max(F.greatest("i", "j"))).first()[0] or 0


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, content): the lines of all files, files in order of their paths, counted from 1.

    A large file is read in splits; each split's lines are counted, and the
    running total over the splits (one row each) is where its numbers begin.
    """
    lines = spark.read.text(paths).select(F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1))
    begin = splits.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(begin, ["file", "start"]).select((F.col("at") + F.col("shift") + 1).alias("line"), F.col("value").alias("content"))


def check_lines(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """(line, content, problem) of text lines that are no legal edge.

    Problems: format, zero id, self edge, and duplicate (after ordering the
    ends; every occurrence but the first). Lines are numbered as by
    numbered_lines; a DataFrame of (line, content) can be given instead.
    """
    lines = paths.select("line", "content") if isinstance(paths, DataFrame) else numbered_lines(spark, paths)
    f = F.split(F.trim(F.regexp_replace("content", r"\s+", " ")), " ")
    ok = F.col("content").rlike(LINE)
    num = lambda k: F.when(ok, F.get(f, F.lit(k)).cast("long"))
    parsed = lines.select("line", "content", ok.alias("ok"), num(0).alias("a"), num(1).alias("b"))
    pairs = parsed.select("*", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    first = pairs.where("ok").groupBy("i", "j").agg(F.min("line").alias("first"))
    problem = (
        F.when(~F.col("ok"), "format").when((F.col("a") == 0) | (F.col("b") == 0), "zero id").when(F.col("a") == F.col("b"), "self edge").when(F.col("line") > F.col("first"), "duplicate")
    )
    return pairs.join(first, ["i", "j"], "left").select("line", "content", problem.alias("problem")).where("problem is not null")


def checked(edges: DataFrame, psi: float) -> DataFrame:
    """Legal edges with dist at most psi, with a warning about those above it.

    ValueError for self edges, ids below 1 or a distance that is no number.
    """
    bad = F.col("i").isNull() | F.col("j").isNull() | (F.col("i") == F.col("j")) | (F.least("i", "j") < 1) | F.col("dist").isNull() | F.isnan("dist")
    found = edges.agg(F.min(F.when(bad, F.struct("i", "j", "dist"))).alias("bad"), F.count_if(F.col("dist") > psi).alias("above")).first()
    if found.bad is not None:
        raise ValueError(f"illegal edge {tuple(found.bad)}")
    if found.above:
        warnings.warn(f"{found.above} edges are above psi = {psi} and count as absent", stacklevel=3)
    return canonical(edges).where(F.col("dist") <= psi)


def plain(number: Column) -> Column:
    """A double with all its digits, without an exponent."""
    text = F.abs(number).cast("string")
    digits, power = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.", ""), F.split_part(text, F.lit("E"), F.lit(2)).cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.rpad(digits, power + 1, "0")
    rest = F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substr(digits, power + 2))).otherwise("")
    shown = F.when(~text.contains("E"), text).when(power < 0, small).otherwise(F.concat(F.substr(large, F.lit(1), power + 1), rest))
    return F.concat(F.when(number < 0, "-").otherwise(""), shown)


def write_edges(edges: DataFrame, path: str, compression: str = "gzip", columns: list[Column] | None = None) -> None:
    """Tab-separated lines without header or quotes; numbers in plain notation, with all their digits."""
    cells = columns or [F.col("i").cast("string"), F.col("j").cast("string"), plain(F.col("dist"))]
    edges.select(F.concat_ws("\t", *cells).alias("value")).write.option("compression", compression).text(path)


def scientific(edges: DataFrame) -> DataFrame:
    """(line): ends in 8 columns and the distance in scientific notation with 6 decimals."""
    return edges.select(F.format_string("%8d\t%8d\t%.6e", "i", "j", "dist").alias("line"))


def write_weighted(edges: DataFrame, path: str, compression: str = "gzip", in_order: bool = False) -> None:
    """(i, j, mean, count) of edges (i, j, sum_d, w); in_order: by mean, then ends, over all files."""
    rows = edges.select("i", "j", (F.col("sum_d") / F.col("w")).alias("mean"), "w")
    rows = rows.orderBy("mean", "i", "j") if in_order else rows
    rows.select(F.concat_ws("\t", "i", "j", "mean", "w").alias("value")).write.option("compression", compression).text(path)


def write_sizes(sizes: DataFrame, path: str, compression: str = "none") -> None:
    """Cluster ids and sizes."""
    sizes.select(F.concat_ws("\t", "id", "size").alias("value")).write.option("compression", compression).text(path)


def write_vector(values: DataFrame, path: str, compression: str = "none") -> None:
    """(index, value) lines of a vector."""
    values.select(F.concat_ws("\t", "index", "value").alias("value")).write.option("compression", compression).text(path)


def write_forest(forest: DataFrame, path: str, mode: str = "append", compression: str = "none") -> None:
    """Merges as text; appended to what earlier rounds wrote."""
    forest.select(F.concat_ws("\t", "c1", "c2", "height", "merged").alias("value")).write.mode(mode).option("compression", compression).text(path)


def write_split(df: DataFrame, path: str, k: int, text: bool = False, compression: str = "gzip") -> None:
    """k files of about the same number of rows, as Parquet or as tab-separated text."""
    if text:
        df.repartition(k).select(F.concat_ws("\t", *df.columns).alias("value")).write.option("compression", compression).text(path)
    else:
        df.repartition(k).write.parquet(path)
