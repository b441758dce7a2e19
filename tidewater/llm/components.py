"""Connected components by DataFrame operations, or in one task while edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import hot_join, python_ready, python_task, remove, save, saved

#: Edges between numbers up to which one task solves all: 16 bytes each, some 100 MB of a worker's memory with what it makes of them.
FEW_EDGES = 1 << 20


def _to_smallest(edges: DataFrame, keep: str, total: int) -> DataFrame:
    """For each u, its smallest neighbour or itself as m, joined back to the neighbours v for which `keep` holds."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_degree"))
    return hot_join(edges, least, ["u"], "_degree", total, F.col("v")).filter(keep).select("u", "v", "m")


def _least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes in order, and for each the smallest that edges reach, by joining roots and halving paths."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = a[apart], b[apart]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            parts = [[np.asarray(c) for c in batch.columns] for batch in batches]
            if parts:
                nodes, least = _least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])

    python_ready(edges)
    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 50, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component: its smallest node.

    Alternates the large-star and small-star steps until the edges form stars. Each step is one aggregation and one
    join on u; nodes of high degree are spread. Every round is written to the shared folder, which cuts the lineage.
    Up to few_edges edges between numbers, which is counted, one task on an executor does it all instead, with the
    same result; 0 keeps to DataFrame operations. Empty edges give no rows; edges with a null end are ignored; loops and repeated edges change nothing, except
    that a node with only a loop is a component of its own.
    """
    edges = edges.select("u", "v").filter("u is not null and v is not null")
    with saved(edges.sparkSession) as keep:
        if few_edges and dict(edges.dtypes)["u"] == "bigint":
            edges = keep(edges, "cc-given", keep=True)
            if edges.count() <= few_edges:
                return keep(_in_one_task(edges), "cc-components", keep=True)
        nodes = keep(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct(), "cc-nodes")
        now, path = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
        for _ in range(max_rounds):
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            n = now.count()
            if not n:
                break
            large = _to_smallest(both, "v > u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            mid, mid_path = save(large, "cc-large")
            # small star: the edges of mid point from the larger end u to the smaller v already
            star = _to_smallest(mid, "true", max(mid.count(), 1))
            small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
            new, new_path = save(small, "cc-small")
            same = new.count() == n and new.join(now, ["u", "v"], "left_anti").isEmpty()
            remove(now.sparkSession, path)
            remove(now.sparkSession, mid_path)
            now, path = new, new_path
            if same:
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        found = nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        found = keep(found, "cc-components", keep=True)
    remove(edges.sparkSession, path)
    return found
