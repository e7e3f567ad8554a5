"""Helpers that several corpus operators share: staged tables, sized
broadcasts, distributed numbering and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructType
from pyspark.sql.window import Window

from ..operators.lineage import shared_dir

#: Rows that one numbering bucket holds on average.
BUCKET_ROWS = 4_096

#: A set of 64-bit ids is broadcast up to this many entries (32 MB); beyond it
#: the same join runs as a shuffle.
BROADCAST_IDS = 4_000_000

#: Edges of a graph that one task joins up (4 MB, a second); more are contracted
#: by rounds over all executors until they are as few.
TASK_EDGES = 1 << 18


class Stage:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor, and rereading it gives
    Catalyst its true size.  `drop` frees tables that later steps don't read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._staged_at)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is computed meanwhile: operators
    on long texts hold a batch several times, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """`df` (a staged or otherwise cheap table of ids) with a broadcast hint if
    it has at most `limit` rows, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def number_rows(df: DataFrame, groups: list[str], order: list[str], rows: int, out: str) -> DataFrame:
    """Adds `out`: gapless numbers from 0 within `groups`, without gathering a group.

    Rows are dealt by hash into buckets of about BUCKET_ROWS; each bucket is
    numbered alone and starts where the counts of its predecessors end.  The
    order inside a group is by bucket, then by `order`; rows equal in `order`
    are interchangeable.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inner = Window.partitionBy(*keys).orderBy(*order)
    starts = starts.select(*[F.col(k).alias(f"_start_{k}") for k in keys], "_start")
    numbered = dealt.join(starts, [F.col(k).eqNullSafe(F.col(f"_start_{k}")) for k in keys]).select(*dealt.columns, "_start")
    return numbered.withColumn(out, F.col("_start") + F.row_number().over(inner) - 1).drop("_bucket", "_start")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def unused(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores before it as make it no column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def with_fields(schema: StructType, *fields: tuple[str, DataType]) -> StructType:
    out = StructType(list(schema.fields))
    for name, kind in fields:
        out = out.add(name, kind)
    return out


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """Connected components of undirected `edges` (a, b: long).

    Returns (node, root), root being the smallest node of the component, for
    every node that has an edge.  Each round hooks every node to its smallest
    neighbour, jumps pointers once and contracts the edges; a node's edges are
    only aggregated by min, so a hub of any degree is pre-aggregated before its
    shuffle.  Edges at least halve in nodes each round.  What is left of them, or
    all, if they are no more than TASK_EDGES, is joined up in one task: a round is
    a dozen plans, of each of which the driver keeps something.
    """
    live = stage.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while True:
        last = live.limit(TASK_EDGES + 1).count() <= TASK_EDGES
        old, step = labels, stage.write(_joined_up(live)) if last else _hooked(live, stage)
        if old is None:
            labels = step
        else:
            moved = old.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            labels = stage.write(moved.select("node", F.coalesce("to", "root").alias("root")))
        if last:
            stage.drop(live, *([] if old is None else [old, step]))
            return labels
        roots = step.select("node", "root")
        a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        contracted = (
            live.join(a, "a").join(b, "b").filter("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        )
        then = stage.write(contracted)
        stage.drop(live, *([] if old is None else [old, step]))
        live = then


def _joined_up(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded table of edges, by union-find in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if not parts:
            return
        pairs = np.concatenate([np.concatenate(side) for side in zip(*parts, strict=True)])
        nodes, at = np.unique(pairs, return_inverse=True)  # ascending, so the least place is the least node
        up = list(range(len(nodes)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in at.reshape(2, -1).T.tolist():
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[top(x) for x in range(len(nodes))]])], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def _hooked(live: DataFrame, stage: Stage) -> DataFrame:
    """(node, root): every node of `live` with the end of its smallest neighbours."""
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    # A node hooks downwards only: its target is smaller, so there is no cycle.
    return _jumped(stage.write(hooks.select("node", F.least("node", "near").alias("root"))), stage)


def _jumped(step: DataFrame, stage: Stage) -> DataFrame:
    """Pointers that each lead to a smaller node, followed to their ends."""
    while True:
        far = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        doubled = step.join(far, "root", "left").select(
            "node", F.coalesce("far", "root").alias("root"), (F.coalesce("far", "root") != F.col("root")).alias("moved")
        )
        then = stage.write(doubled)
        stage.drop(step)
        if then.filter("moved").isEmpty():
            out = then.select("node", "root")
            out._staged_at = then._staged_at
            return out
        step = then.select("node", "root")
        step._staged_at = then._staged_at
