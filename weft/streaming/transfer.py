"""Transfer of a fitted model to a stream of samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def loadings(rotation: DataFrame, p: int) -> DataFrame:
    """(module, pc, weights): a component's loadings as an array over features 1..p; one row a component."""
    pairs = F.map_from_entries(F.collect_list(F.struct("feature_id", "loading")))
    dense = F.expr(f"transform(sequence(1L, {p}L), k -> coalesce(try_element_at(m, k), 0D))")
    return rotation.groupBy("module", "pc").agg(pairs.alias("m")).select("module", "pc", dense.alias("weights"))


def project_stream(samples: DataFrame, rotation: DataFrame, p: int, id_col: str = "sample_id", vec_col: str = "vec") -> DataFrame:
    """(id_col, module, pc, value) of a stream of (id, values of features 1..p).

    Stateless: each sample meets the static table of components, so nothing
    waits for a watermark and a late sample is as good as any.
    """
    static = loadings(rotation, p).agg(F.collect_list(F.struct("module", "pc", "weights")).alias("cs")).withColumn("one", F.lit(1))
    met = samples.withColumn("one", F.lit(1)).join(F.broadcast(static), "one")
    value = F.expr(f"aggregate(zip_with(c.weights, {vec_col}, (w, v) -> w * v), 0D, (a, x) -> a + x)")
    return met.select(id_col, vec_col, F.explode("cs").alias("c")).select(id_col, "c.module", "c.pc", value.alias("value"))


def start(samples: DataFrame, rotation: DataFrame, p: int, sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """A running query that hands each batch of projections to ``sink`` (foreachBatch)."""
    writer = project_stream(samples, rotation, p, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(sink).start()
