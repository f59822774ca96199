"""Connected components of a graph whose edges stay on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, Written, map_batches


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what edges (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], least)
        np.minimum.at(new, low[j], least)
        new = new[new]
        while True:
            next_ = new[new]
            if (next_ == new).all():
                break
            new = next_
        new = new[low]
        if (new == low).all():
            break
        low = new
    off = low != np.arange(len(nodes))
    return nodes[off], nodes[low[off]]


def _forests(batches: Batches) -> Batches:
    for b in batches:
        u, v = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (two long columns): the smallest node reachable.

    Null ends and loops are left out; no edges give no rows. Large-star and small-star rounds:
    each joins every edge with the least neighbour of its end, an aggregate that is combined
    before it is shuffled, so a node with many edges only makes its own edges long, which a
    skewed join splits. Each round is written to the shared folder.
    """
    a, b = edges.columns
    plain = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = Written(map_batches(plain, _forests, "u long, v long").distinct())
    before: tuple | None = None
    while True:
        state = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.df.select("v", "v").distinct())
        before = tuple(state)
        both = now.df.union(now.df.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        step = Written(large)
        now.drop()
        least = step.df.groupBy("u").agg(F.min("v").alias("m"))
        small = step.df.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = Written(small.union(least.select("u", "m")).distinct())
        step.drop()
