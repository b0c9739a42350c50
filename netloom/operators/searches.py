"""Searches from all vertices: a task holds the edges of one component and searches from a share of its vertices.

As many pairs as vertices squared can't be carried from round to round, so no table holds them: only edges are
shuffled, a component's to each of its parts, and only results leave a task. A component whose pairs can be counted at
all (10^12 for a million vertices) has edges that fit into a task; graphs of many components may be of any size.

A search from 64 vertices at once keeps one word for each vertex, a bit for each source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.model import Graph
from netloom.plans.skew import hot_keys, spread_join

#: Sources that make a part of their own, parts of a component for each core, bits of a word.
FEW_SOURCES, PARTS_A_CORE, WORD = 256, 4, 64
#: Half-edges looked at together; (vertex, source) cells with numbers of their own; vertices whose bits are listed together.
BLOCK, CELLS, LISTED = 1 << 20, 1 << 23, 1 << 13


class Component:
    """Sorted ids, and the neighbours of index v in near[starts[v]:starts[v + 1]]."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, larger: np.ndarray):
        """``larger``: the neighbours that follow a vertex in id order, ``lengths`` of them for each of ``ids``."""
        self.ids = np.sort(ids)
        a, b = np.repeat(np.searchsorted(self.ids, ids), lengths), np.searchsorted(self.ids, larger)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        self.near = dst[np.argsort(src, kind="stable")].astype(np.int32)
        self.degree = np.bincount(src, minlength=len(ids))
        self.starts = np.concatenate([[0], np.cumsum(self.degree)])
        self.blocks = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.near), BLOCK)), len(ids)))

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in ``rows`` and neighbour, for every half-edge of these vertices."""
        d = self.degree[rows]
        owner = np.repeat(np.arange(len(rows)), d)
        return owner, self.near[np.arange(len(owner)) + np.repeat(self.starts[rows] - np.cumsum(d) + d, d)]

    def levels(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """depth, vertices, bits: which of the sources first..last-1 (at most 64) have a vertex at this depth."""
        rows, bits = np.arange(first, last), np.uint64(1) << np.arange(last - first, dtype=np.uint64)
        seen = np.zeros(len(self.ids), np.uint64)
        seen[rows] = bits
        depth = 0
        while len(rows):
            yield depth, rows, bits
            depth += 1
            touched = self.degree[rows].sum()
            if not touched:
                return
            if 4 * touched < len(self.near):
                owner, to = self.expand(rows)
                order = np.argsort(to, kind="stable")
                to = to[order]
                heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                rows = to[heads]
                got = np.bitwise_or.reduceat(bits[owner[order]], heads) & ~seen[rows]
                rows, bits = rows[got != 0], got[got != 0]
                seen[rows] |= bits
            else:
                # every vertex has a neighbour here, so no segment is empty
                newest, got = np.zeros_like(seen), np.zeros_like(seen)
                newest[rows] = bits
                for lo, hi in zip(self.blocks[:-1], self.blocks[1:], strict=True):
                    at = self.starts[lo : hi + 1]
                    got[lo:hi] = np.bitwise_or.reduceat(newest[self.near[at[0] : at[-1]]], at[:-1] - at[0])
                got &= ~seen
                seen |= got
                rows = np.flatnonzero(got)
                bits = got[rows]


def _members(rows: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vertex, number of the source) of each bit."""
    for k in range(0, len(rows), LISTED):
        r, s = np.nonzero(_unpacked(bits[k : k + LISTED]))
        yield rows[k : k + LISTED][r], s


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, WORD)


def _words(lo: int, hi: int, size: int = WORD) -> Iterator[tuple[int, int]]:
    for first in range(lo, hi, size):
        yield first, min(first + size, hi)


def by_parts(graph: Graph, schema: str, f: Callable[[Component, int, int], Iterator[list[np.ndarray]]], found: DataFrame | None = None) -> DataFrame:
    """graph_id and ``schema``: the columns that ``f(component, first, last)`` yields, for sources first..last-1 of each part of each component.

    found: graph_id, id, label, if components are known.
    """
    from netloom.operators.measures import labels

    spark = graph.vertices.sparkSession
    most = PARTS_A_CORE * spark.sparkContext.defaultParallelism
    found = (labels(graph) if found is None else found).select(F.struct("graph_id", "label").alias("of"), "graph_id", "id")
    sizes = found.groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    parts = F.least(F.ceil(F.col("n") / FEW_SOURCES), F.lit(most)).cast("long")
    split = spread_join(found, sizes.select("of", parts.alias("parts")), "of", hot_keys(sizes, "of"), "id")
    larger = graph.canonical.groupBy("graph_id", F.col("src").alias("id")).agg(F.collect_list("dst").alias("larger"))
    rows = split.join(larger, ["graph_id", "id"], "left").select("graph_id", "of.label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts", "id", "larger")
    out = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in f"graph_id long, {schema}".split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        of, part, of_parts = (t.column(c)[0].as_py() for c in ("graph_id", "part", "parts"))
        lists = t.column("larger").combine_chunks()
        whole = Component(t.column("id").to_numpy(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy())
        n = len(whole.ids)
        for columns in f(whole, part * n // of_parts, (part + 1) * n // of_parts):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), of), pa.int64()), *(pa.array(c, k.type) for c, k in zip(columns, list(out)[1:], strict=True))], schema=out)

    # as many partitions as asked for: tasks are long for the little that they read
    keys = ["graph_id", "label", "part"]
    dealt = rows.repartition(max(most, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    return dealt.groupBy(*keys).applyInArrow(run, f"graph_id long, {schema}")


def pairs(graph: Graph) -> DataFrame:
    """graph_id, source, id, depth of every pair of a component."""

    def f(c: Component, lo: int, hi: int):
        for first, last in _words(lo, hi):
            for depth, rows, bits in c.levels(first, last):
                for v, s in _members(rows, bits):
                    yield [c.ids[first + s], c.ids[v], np.full(len(v), depth)]

    return by_parts(graph, "source long, id long, depth long", f)


def distance_sums(graph: Graph) -> DataFrame:
    """graph_id, id, s: the sum of the distances to all vertices of the component."""

    def f(c: Component, lo: int, hi: int):
        for first, last in _words(lo, hi):
            total = np.zeros(WORD, np.int64)
            for depth, _, bits in c.levels(first, last):
                for k in range(0, len(bits), LISTED):
                    total += depth * _unpacked(bits[k : k + LISTED]).sum(axis=0, dtype=np.int64)
            yield [c.ids[first:last], total[: last - first]]

    return by_parts(graph, "id long, s long", f)


def deepest(graph: Graph, found: DataFrame | None = None) -> DataFrame:
    """graph_id, depth: the greatest distance from the sources of each part."""

    def f(c: Component, lo: int, hi: int):
        yield [np.array([max(depth for first, last in _words(lo, hi) for depth, _, _ in c.levels(first, last))])]

    return by_parts(graph, "depth long", f, found)


def loads(graph: Graph, include_endpoints: bool) -> DataFrame:
    """graph_id, id, load: what the sources of each part send over each vertex.

    From the deepest level upwards, a vertex shares one and what it got equally among its neighbours one level nearer.
    """

    def f(c: Component, lo: int, hi: int):
        n = len(c.ids)
        load = np.zeros(n)
        for first, last in _words(lo, hi, max(1, min(WORD, CELLS // n))):
            size = last - first
            far, got, levels = np.full(n * size, -1, np.int32), np.zeros(n * size), []
            for depth, rows, bits in c.levels(first, last):
                cells = np.concatenate([v.astype(np.int64) * size + s for v, s in _members(rows, bits)])
                far[cells] = depth
                levels.append(cells)
            for depth in range(len(levels) - 1, 0, -1):
                cells = levels[depth]
                ends = np.cumsum(c.degree[cells // size])
                cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], BLOCK)), len(cells)))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = cells[a:b]
                    owner, to = c.expand(part // size)
                    to = to.astype(np.int64) * size + (part % size)[owner]
                    nearer = far[to] == depth - 1
                    owner, to = owner[nearer], to[nearer]
                    share = 1.0 / np.bincount(owner, minlength=len(part))
                    np.add.at(got, to, ((1.0 + got[part]) * share)[owner])
            got[np.arange(first, last) * size + np.arange(size)] = 0.0
            load += got.reshape(n, size).sum(axis=1)
            if include_endpoints:
                load += (far > 0).reshape(n, size).sum(axis=1)
        yield [c.ids, load]

    return by_parts(graph, "id long, load double", f)
