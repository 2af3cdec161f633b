"""Consistent hashing: keys go to the partition of the first ring point at or after their hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VNODES = 150
HASH_BITS = 60
_BUCKET_BITS = 12


def place(text: Column) -> Column:
    """A text's place on the ring: the first 60 bits of its md5, which any engine can give. Null hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def ring(spark: SparkSession, partitions: int, vnodes: int = VNODES) -> DataFrame:
    """(h, partition) of all points; of equal hashes the last partition holds."""
    n = spark.range(partitions * vnodes)
    points = n.select((F.col("id") / vnodes).cast("int").alias("partition"), (F.col("id") % vnodes).alias("v"))
    key = F.concat(F.lit("partition-"), F.col("partition").cast("string"), F.lit("-vnode-"), F.col("v").cast("string"))
    return points.select(place(key).alias("h"), "partition").groupBy("h").agg(F.max("partition").alias("partition"))


def assigned(keys: DataFrame, partitions: int, vnodes: int = VNODES, key: str = "key") -> DataFrame:
    """Keys with ``partition``; with no partitions all go to 0. A null key is placed as an empty one.

    The ring's points are at most partitions * vnodes and known before. They are cut into 4,096 buckets of the hash
    space, each with its own points and the next one after it, so a key looks at a handful of points only.
    """
    spark = keys.sparkSession
    if partitions <= 0:
        return keys.withColumn("partition", F.lit(0))
    points = sorted((r.h, r.partition) for r in ring(spark, partitions, vnodes).collect())
    shift = HASH_BITS - _BUCKET_BITS
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(1 << _BUCKET_BITS)]
    for h, p in points:
        buckets[h >> shift].append((h, p))
    after = (1 << 63) - 1, points[0][1]  # beyond the last point the ring begins again
    for own in reversed(buckets):
        first = own[0] if own else None
        own.append(after)
        after = first or after
    table = spark.createDataFrame(list(enumerate(buckets)), "bucket int, points array<struct<h:bigint,p:int>>")
    hashed = keys.withColumn("__h", place(F.col(f"`{key}`")))
    bucket = F.shiftright(F.col("__h"), shift).cast("int")
    joined = hashed.withColumn("bucket", bucket).join(F.broadcast(table), "bucket")
    first = F.element_at(F.filter("points", lambda p: p["h"] >= F.col("__h")), 1)["p"]
    return joined.select(*[F.col(f"`{c}`") for c in keys.columns], first.alias("partition"))


def distribution(points: DataFrame) -> DataFrame:
    """(partition, n) of a ring's points."""
    return points.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


def stats(points: DataFrame, partitions: int, vnodes: int = VNODES) -> DataFrame:
    """One row: partitions, vnodes, ring entries, population variance and standard deviation of the points a partition has."""
    per = points.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition")).join(distribution(points), "partition", "left")
    n = F.coalesce("n", F.lit(0))
    return per.agg(F.lit(partitions).alias("num_partitions"), F.lit(vnodes).alias("virtual_nodes"), F.sum(n).alias("total_ring_entries"),
                   F.var_pop(n).alias("variance"), F.stddev_pop(n).alias("std_dev"))
