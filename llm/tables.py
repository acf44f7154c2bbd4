"""Reading tables and cutting lineage, for every operator of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; only where it is unset (tests, local mode), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps no longer recompute what leads to it, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """As `materialise`, with the rows in n buckets by some columns: what is grouped or joined by them later is not shuffled again. df has to be in n partitions by these columns."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *columns).option("path", f"{shared_dir(spark)}/tables/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


def renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns, so that further columns of the caller can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, in any case."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


#: Groups with more than this share of the rows are broadcast; there are fewer of them than 1 / HOT.
HOT = 1 / 500


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: list[str], hot: float = HOT) -> DataFrame:
    """Left join of rows with groups on keys, each group with the number of its rows in `size`, of `total` rows.

    Rows of large groups, with more than the share `hot` of all rows (so that there are fewer than 1 / hot of them), get theirs by broadcast; in the shuffle for the other ones they are dealt out by the columns `spread`.
    """
    mine = lambda table, prefix: table.select(*[F.col(c).alias(f"{prefix}{c}") for c in table.columns])
    large = F.broadcast(mine(groups.where(F.col(size) > hot * total), "_hot_"))
    other = mine(groups.where(F.col(size) <= hot * total), "_cold_")
    same = lambda left, prefix: [left[k].eqNullSafe(F.col(prefix + k)) for k in keys]
    both = rows.join(large, same(rows, "_hot_"), "left")
    both = both.withColumn("_deal", F.when(F.col(f"_hot_{size}").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(*spread)))
    other = other.withColumn("_cold_deal", F.xxhash64(*[f"_cold_{k}" for k in keys]))
    met = both.join(other, [both["_deal"] == other["_cold_deal"], *[both[k] == other[f"_cold_{k}"] for k in keys]], "left")
    return met.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in groups.columns if c not in keys])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an undirected edge table reaches.

    Alternating large-star and small-star steps; a star of any size is one aggregation with
    map-side combining, and the driver sees one count a round. Nodes without an edge are absent.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialise(linked.union(small).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == before or now[0] == 0:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
