"""Connected components and reachability as DataFrame loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.storage import apart, dropped, stored

#: Rounds after which the tables of what was reached are put together.
TOGETHER = 16
#: Nodes of a frontier that may be broadcast.
FEW = 100_000
#: Edges that a task joins up at once; more in a partition go in several lots.
LOT = 1 << 21


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): the nodes of edges and the least node of each one's component, by hooking and halving paths."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (nearer := root[root]).tobytes() != root.tobytes():
            root = nearer
    return nodes, nodes[root]


def _lots(batches):
    """(u, v) by batches to (node, root) of each lot's components."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])
    held, size = [], 0

    def close():
        table = pa.Table.from_batches(held)
        nodes, roots = joined_up(table.column(0).to_numpy(), table.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], schema=schema)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LOT:
            yield close()
            held, size = [], 0
    if held:
        yield close()


def _written(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """df stored, with a row that changes when its edges (u, v) do, taken from the write itself."""
    seen = Observation()
    out = stored(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, root) for the nodes of distinct edges (u, v), u > v, by alternating large and small stars.

    Each step hangs a node's neighbours below the smallest of them, by a grouped minimum (combined before the shuffle) and a join.
    Rounds grow with the logarithm of the longest path. One side of each join has a row per node, so a hub's rows are one key of
    the other: adaptive execution splits such a partition. Each round is written to the shared folder, and the one before it goes.
    """
    now, state = _written(edges, "cc-edges")
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, before = now, state
        now, state = _written(small, "cc-edges")
        dropped(old)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, near: Column | None = None) -> DataFrame:
    """(node, component) for every node of an edge, component being the component's smallest node.

    In two levels. Edges are dealt by ranges of their smaller node, or of near, an expression over edges that is alike for edges
    that lie together; every task joins up its edges in memory, lot by lot, and hands on a row per node. Nodes that several lots
    have found join these lots' roots, and only those few edges between roots go through rounds of joins (_stars). All is written to the
    shared folder on the way. Null ends drop the edge; self loops name their node alone; repeated edges count once; no edges
    give no rows.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"), (F.least(src, dst) if near is None else near).alias("near")).where("u is not null and v is not null")
    kind = edges.schema[src].dataType
    parts = stored(pairs.repartitionByRange(n, "near").select("u", "v").mapInArrow(_lots, "node long, root long"), "cc-parts")
    between = parts.withColumn("least", F.min("root").over(Window.partitionBy("node"))).where("root <> least")
    links = between.select(F.col("root").alias("u"), F.col("least").alias("v")).distinct()
    roots = _stars(links, max_rounds).withColumnRenamed("node", "from").withColumnRenamed("root", "to")
    found = parts.join(apart(roots), F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("component"))
    found = found.groupBy("node").agg(F.min("component").alias("component"))
    return found.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def reachable(seeds: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", max_rounds: int = 100_000) -> DataFrame:
    """(node) for every node that directed paths of edges lead to from a seed, seeds included.

    Nodes joined by edges that lead both ways are reached together, so such parts are made one node each first, by
    connected_components. What is left is gone through in a frontier loop: each round joins only what the last one found, so there
    are as many rounds as the longest shortest path has steps that lead one way only; more than max_rounds are an error.
    Frontiers are written to the shared folder, and put together every so many rounds.
    """
    links = stored(edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).where("node <> to").distinct(), "reach-edges")
    back = links.select(F.col("to").alias("node"), F.col("node").alias("to"))
    parts = stored(connected_components(links.join(apart(back), ["node", "to"], "left_semi"), "node", "to"), "reach-parts")
    part = lambda df, column, name: df.join(apart(parts.select(F.col("node").alias(column), F.col("component").alias("_part"))), column, "left").withColumn(name, F.coalesce("_part", column)).drop("_part")
    begun = part(seeds.select(F.col(node).alias("node")).where("node is not null").distinct(), "node", "part")
    ways = part(part(links, "node", "a"), "to", "b").where("a <> b").select(F.col("a").alias("part"), F.col("b").alias("onto")).distinct()
    ways, seen = stored(ways, "reach-ways"), stored(begun.select("part").distinct(), "reach-seen")
    front, many = seen, seen.count()
    for k in range(1, max_rounds + 1):
        new = (front if many <= FEW else apart(front)).join(ways, "part").select(F.col("onto").alias("part")).distinct().join(apart(seen), "part", "left_anti")
        front = stored(new, "reach-front")
        if not (many := front.count()):
            break
        seen = seen.unionByName(front)
        if k % TOGETHER == 0:
            seen = stored(seen, "reach-seen")
    else:
        raise RuntimeError(f"nodes were still being reached after {max_rounds} rounds")
    whole = parts.join(apart(seen), F.col("component") == F.col("part"), "left_semi").select("node")
    return whole.unionByName(seen.select(F.col("part").alias("node"))).distinct()
