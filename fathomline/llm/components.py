"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014), all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import discard, written

#: Edges that a task draws together at a time.
CHUNK = 1 << 19


def drawn_together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges and the smallest node that they lead to, but for the smallest nodes themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (label[u], label[v], u, v):  # the smaller label goes to both ends and to what they stood for
            np.minimum.at(new, end, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), u > v, that say the same as a task's own, part by part."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        u, v = drawn_together(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)))
            size += batch.num_rows
        if size >= CHUNK:
            yield out()
            size = 0
    if held:
        yield out()


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v, after each node's neighbours were linked to the smallest of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node keeps its own link to the smallest neighbour.
        out = out.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def _settled(state: DataFrame) -> bool:
    """Whether every node but the smallest ones has one edge, which leads to a smallest one."""
    ends = state.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(state.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, *, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node with an edge in ``edges`` (columns a, b of one integer type).

    A component is named by its smallest node. Loops and nulls are ignored, directions and repeats don't matter;
    no edges give no rows. Tasks first draw their own edges together, chunk by chunk, which keeps what they connect;
    stars then connect the rest. Every round is written to the shared folder; the driver sees whether one is left.
    """
    plain = edges.where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    state = written(plain.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(state):
            break
        before, state = state, written(_starred(_starred(state, True), False), "edges")
        discard(before)
    else:
        raise RuntimeError("components didn't settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
