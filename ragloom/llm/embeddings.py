"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors are compared when labels are equal and not null. Equal vectors of a label form one class. Each class vector is
scaled to unit length and quantised to int8; the length of its rounding error is kept. For two unit vectors u, v with
quantised forms a, b and errors e, f the cosine differs from a.b by at most e|b| + f|a| + ef. Classes of a label are
dealt into blocks by hash; each pair of blocks is a tile, one task's work. A tile multiplies the int8 matrices (exactly,
in float arithmetic), and only pairs that the bound leaves possible are computed again in double precision.

A tile returns, for each vector with links, how many vectors it links to and the root of its part of the tile's graph,
so its output is bounded by its input however many links there are.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those without label, link
with nothing and are their own component; vectors of different length don't link; repeated rows link with each other
(equal vec_ids share results); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, scoped

THRESHOLD, BLOCK = 0.93, 2048
_SLACK = 1e-9


def quantise(v: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Int8 form, its scale, and an upper bound of the rounding error's length, of a unit vector."""
    scale = float(np.abs(v).max()) / 127
    q = np.rint(v / scale).astype(np.int8)
    return q, scale, float(np.linalg.norm(v - scale * q)) + _SLACK


def _quantised(batches):
    for b in batches:
        rows = []
        for rep, n, label, vec in zip(*(c.to_pylist() for c in b.columns)):
            v = np.array(vec, np.float64)
            v = v / np.abs(v).max()  # else squares of very large or small components overflow or vanish
            u = v / np.linalg.norm(v)
            q, scale, err = quantise(u)
            rows.append((rep, n, label, len(v), q.tobytes(), scale, err, u.tobytes()))
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["rep", "n", "label", "dim", "q", "scale", "err", "unit"])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def tile_links(q: np.ndarray, scale: np.ndarray, err: np.ndarray, unit: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, strip: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of ``left``, j of ``right``) with cosine at or over the threshold."""
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers in this range stay exact
    size = scale * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    other = q[right].astype(exact).T
    out_a, out_b = [], []
    for lo in range(0, len(left), strip):
        rows = left[lo : lo + strip]
        about = (q[rows].astype(exact) @ other) * (scale[rows][:, None] * scale[right][None, :])
        about += err[rows][:, None] * (size[right] + err[right])[None, :] + size[rows][:, None] * err[right][None, :]
        i, j = np.nonzero(about >= threshold - _SLACK)
        i, j = rows[i], right[j]
        for at in range(0, len(i), 65536):
            a, b = i[at : at + 65536], j[at : at + 65536]
            hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            out_a.append(a[hit])
            out_b.append(b[hit])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_a or none), np.concatenate(out_b or none)


def _tile(threshold):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        q = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(-1, dim)
        unit = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(-1, dim)
        scale, err, block, n, rep = (pdf[c].to_numpy() for c in ("scale", "err", "block", "n", "rep"))
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = tile_links(q, scale, err, unit, left, right, threshold)
        if i == j:
            a, b = a[a < b], b[a < b]
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        order = np.argsort(rep, kind="stable")  # roots are the smallest reps
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root = rep[order[roots(len(rep), place[a], place[b])]][place]
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``embeddings (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept)``, one row for each input row."""
    v = scoped(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("long"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    v = v.withColumn("usable", usable)
    classes = v.where("usable").groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes, "classes")
    coded = classes.select("rep", "n", "label", "e").mapInArrow(_quantised, "rep long, n long, label long, dim int, q binary, scale double, err double, unit binary")
    blocks = materialize(classes.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")  # so that Spark can split a label's join
    coded = coded.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = coded.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    found = materialize(dealt.groupBy("label", "dim", "i", "j").applyInPandas(_tile(threshold), "rep long, links long, root long"), "links")
    comp = connected_components(found.where("rep <> root").select("rep", "root"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = v.where("usable").join(named, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
