"""Shared helpers of the training-data operators: durable intermediate tables and graph components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls from tab to carriage return.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (local tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ragloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scoped(df: DataFrame, *names: str) -> DataFrame:
    """Only the input columns an operator needs, so that extra columns can't clash with those it makes."""
    return df.select(*[df[n] for n in names])


def _local_forest(batches):
    """Union-find over one partition's links: yields (node, root) once for each node that isn't its root."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        pairs = [(x, r) for x in part if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node with a link: ``(a long, b long) -> (node long, component long)``.

    Each partition first shrinks its links to a spanning forest; alternating large-star and small-star rounds then
    turn the graph into stars. A round is two grouped minima with joins; links and minima are written to the shared
    folder, so that Spark can split the join of a node that holds many links. Nodes without links aren't returned;
    self-links and repeated links are ignored.
    """
    e = edges.toDF("a", "b").where("a is not null and b is not null and a <> b")
    e = materialize(e.mapInArrow(_local_forest, "u long, v long"), "forest")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-stars")
        # links now point from larger to smaller node
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = materialize(small, "stars")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def spans_of(flags: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge.reshape(-1, 2)
