"""Running totals that survive one key holding most of the rows.

A window partitioned by the key runs a key's rows in one task. Here the rows are
range-partitioned by key and order, so a large key spans many partitions; each
partition runs its own totals, and the few keys that cross a partition border get
the totals of the partitions before them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sealgrade.session import stage


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add, per key in ``order``, the running sum of each value in ``sums``
    (current row included). ``order`` must be unique within a key.

    The partitioned rows are staged, since range borders are sampled and two
    readings must see the same ones.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    ranged = stage(
        df.withColumns(values)
        .repartitionByRange(n, *keys, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    per_part = ranged.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    # rows of keys that span partitions: at most two per partition border
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_part.withColumns({f"_o{v}": F.sum(f"_t{v}").over(before) for v in values})
        .where(F.col("_o_v0").isNotNull())
        .select(*keys, "_part", *[f"_o{v}" for v in values])
    )
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = ranged.withColumns({f"_r{v}": F.sum(v).over(own) for v in values})
    # fewer rows than range partitions, so broadcasting is bounded by ``n``
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] + [
        F.col("l._part") == F.col("o._part")
    ]
    joined = local.alias("l").join(F.broadcast(offsets).alias("o"), on, "left")
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns],
        *[
            (F.col(f"l._r{v}") + F.coalesce(F.col(f"o._o{v}"), F.lit(0))).alias(name)
            for name, v in zip(sums, values)
        ],
    )
