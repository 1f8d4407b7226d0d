"""What several corpus operators share: filters of fixed size, joins with hot keys and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.sources.written import discard, fresh_path, materialise, shared_root  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that a worker holds what it makes of those alone."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def fingerprint(*cols) -> list:
    """Two 64-bit hashes with different seeds, named k1 and k2; equal inputs only, but for odds of 2**-128 a pair."""
    return [F.xxhash64(F.lit(seed), *cols).alias(name) for seed, name in ((11, "k1"), (29, "k2"))]


#: Bits of the filter that among() and apart() send to the workers: 2 MB however many keys there are.
FILTER_BITS = 24


def may_have(rows: DataFrame, keys: DataFrame, key: str = "k1") -> DataFrame:
    """rows(key, ...) with a column `may`: true where the key is in keys(key), and for a few others; false only where it is not.

    The filter is a table of 2**(FILTER_BITS - 6) words at most, whatever the number of keys, and may therefore be broadcast.
    """
    slot = F.shiftrightunsigned(key, 64 - FILTER_BITS)
    words = keys.select(slot.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    bit = F.expr(f"(shiftrightunsigned(bits, cast(shiftrightunsigned({key}, {64 - FILTER_BITS}) & 63 as int)) & 1) = 1")
    return rows.withColumn("w", F.shiftright(slot, 6)).join(F.broadcast(words), "w", "left").withColumn("may", F.coalesce(bit, F.lit(False))).drop("w", "bits")


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose k1 may be in keys(k1): all that have it there, and few others. A join with keys then shuffles those alone."""
    return may_have(rows, keys).where("may").drop("may")


def apart(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The other rows, none of which has its k1 in keys(k1)."""
    return may_have(rows, keys).where("not may").drop("may")


#: A key of more than HOT rows is dealt over WAYS tasks by join_spread().
HOT, WAYS = 1000, 32


def join_spread(rows: DataFrame, keys: DataFrame, on: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """rows joined with keys on one column, in which keys has few rows for each value and rows may have very many.

    Rows of a hot value are dealt over WAYS tasks by all their columns, and the rows of keys with that value go to each. A filter
    of fixed size tells both sides which values are hot; that it also names a few others changes no result. hot: those values,
    where they have been counted.
    """
    if hot is None:
        hot = rows.groupBy(on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    # one key that is always there keeps the plan the same, be there hot values or none
    hot = hot.select(F.xxhash64(on).alias("_key")).unionByName(rows.sparkSession.range(1).select(F.col("id").alias("_key")))
    flagged = lambda df: may_have(df.withColumn("_key", F.xxhash64(on)), hot, "_key").drop("_key")
    dealt = flagged(rows).withColumn("_way", F.when(F.col("may"), F.pmod(F.xxhash64(*rows.columns), F.lit(WAYS)).cast("int")).otherwise(0))
    every = flagged(keys).withColumn("_way", F.explode(F.when(F.col("may"), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("may").join(every.drop("may"), [on, "_way"], how).drop("_way")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): rows (id, component), component the smallest id reachable.

    Edges go from the larger id to the smaller. A round hangs the larger neighbours of every node on the least id in its
    neighbourhood (large star), then the smaller neighbours and the node itself (small star). Either keeps what is connected and
    makes no more edges than there are; rounds grow as the square of the logarithm of the nodes at most, and go on until stars
    are left. Edges are written to the shared folder each round; at most one row comes to the driver. The edges of a node with
    many neighbours are dealt over many tasks. Ids without an edge don't appear. Rows with a null end are left out.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        edges = materialise(edges, "edges")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        large = join_spread(edges, least.select(F.col("a").alias("b"), "m"), "b").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        large = materialise(large.groupBy("a", "b").agg(F.max("moved").alias("moved")), "stars")
        discard(edges, *([before] if before else []))
        # no edge moved and one for each node: nothing is left to do
        if large.groupBy("a").agg(F.max("moved").alias("moved"), F.count(F.lit(1)).alias("n")).where("moved or n > 1").isEmpty():
            break
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_spread(large.select("a", "b"), least, "a", "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, before = small.unionByName(least.withColumnRenamed("m", "b")).distinct(), large
    stars = large.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
    out.written_to = large.written_to
    return out


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, with underscores before it until no name in taken is the same, whatever its case."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted
