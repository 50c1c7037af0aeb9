"""Sample-by-feature matrices in long form.

The canonical form is (sample_id BIGINT, feature_id BIGINT, value DOUBLE) with
names in a dimension table (feature_id, name); never thousands of columns. The
vector form (feature_id, vec ARRAY<DOUBLE>) holds a feature's values in order
of sample_id, for kernels over samples that fit an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: As many features as the matrix may have.
MAX_FEATURES = 5_000_000


def validate(df: DataFrame) -> DataFrame:
    """df itself if it is a non-empty long matrix; ValueError otherwise."""
    kinds = dict(df.dtypes)
    for name, allowed in (("sample_id", {"bigint", "int"}), ("feature_id", {"bigint", "int"}), ("value", {"double"})):
        if kinds.get(name) not in allowed:
            raise ValueError(f"a matrix needs {name} as {sorted(allowed)}, not {kinds.get(name)}")
    row = df.agg(F.count("*").alias("n"), F.approx_count_distinct("feature_id", 0.01).alias("p")).first()
    if not row.n:
        raise ValueError("the matrix must have samples and features")
    if row.p > MAX_FEATURES * 1.05 or (row.p > MAX_FEATURES * 0.95 and df.select("feature_id").distinct().count() > MAX_FEATURES):
        raise ValueError(f"more than {MAX_FEATURES} features")
    return df


def from_wide(df: DataFrame, id_col: str, features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(long matrix, feature_dim) of numeric columns; features count from 1 in column order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = features or [c for c in df.columns if c != id_col and isinstance(kinds[c], T.NumericType)]
    for c in names:
        if not isinstance(kinds.get(c), T.NumericType):
            raise ValueError(f"{c} is not a numeric column")
    if not names:
        raise ValueError("no feature columns")
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("feature_id"), F.col(f"`{c}`").cast("double").alias("value")) for k, c in enumerate(names, 1)])
    long = df.select(F.col(f"`{id_col}`").cast("long").alias("sample_id"), F.explode(cells).alias("cell")).select("sample_id", "cell.feature_id", "cell.value")
    return long, df.sparkSession.createDataFrame(list(enumerate(names, 1)), "feature_id long, name string")


def from_arrays(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Long matrix of an array column; a feature is a position, from 1."""
    return df.select(F.col(id_col).cast("long").alias("sample_id"), F.posexplode(array_col).alias("p", "v")).select(
        "sample_id", (F.col("p") + 1).cast("long").alias("feature_id"), F.col("v").cast("double").alias("value")
    )


def transposed(long: DataFrame) -> DataFrame:
    return long.select(F.col("feature_id").alias("sample_id"), F.col("sample_id").alias("feature_id"), "value")


def to_wide(long: DataFrame, names: list[tuple[int, str]]) -> DataFrame:
    """One column a feature, on demand; names lists (feature_id, column)."""
    wide = long.groupBy("sample_id").pivot("feature_id", [i for i, _ in names]).agg(F.first("value"))
    return wide.select("sample_id", *[F.col(f"`{i}`").alias(c) for i, c in names])


def to_vectors(long: DataFrame, *by: str) -> DataFrame:
    """(feature_id, vec), values in order of sample_id; by further columns too, if named."""
    pairs = F.sort_array(F.collect_list(F.struct("sample_id", "value")))
    return long.groupBy("feature_id", *by).agg(pairs.alias("p")).select("feature_id", *by, F.col("p.value").alias("vec"))


def subset(long: DataFrame, features: DataFrame) -> DataFrame:
    """Only features of a table with feature_id; their order is a column, not a layout."""
    return long.join(features.select("feature_id").distinct(), "feature_id", "left_semi")


def sample_features(feature_dim: DataFrame, most: int = 10_000, seed: int = 1) -> DataFrame:
    """At most so many features, the same for the same seed whatever the partitioning."""
    return feature_dim.orderBy(F.xxhash64(F.lit(seed), "feature_id"), "feature_id").limit(most)


def same_names(a: DataFrame, b: DataFrame) -> bool:
    """Whether two dimension tables have the same names, as multisets."""
    x, y = a.select("name"), b.select("name")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
