"""Random graph ensembles.

Models whose edges are independent, or a rank, are one relational plan over
all samples, with chance from the counter-based generator keyed by sample and
pair. Models that are sequential within a graph run as one task for each sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.rng import uniform, uniform_py
from netloom.model import Graph, GraphError, symmetric
from netloom.operators import access, kernels
from netloom.plans.ordering import with_rank
from netloom.session import materialize


def sample_vertices(spark: SparkSession, n: int, samples: int = 1) -> DataFrame:
    """n vertices for each of ``samples`` graphs, numbered by one range (no join)."""
    return spark.range(n * samples).select(F.floor(F.col("id") / n).alias("graph_id"), (F.col("id") % n).alias("id"))


def all_pairs(vertices: DataFrame, n: int) -> DataFrame:
    """(graph_id, src, dst) with src < dst, generated by each vertex itself; the longest list is n/2.

    Vertex i lists the n//2 vertices after it on a circle, so every task gets equal work.
    """
    half = (n - 1) // 2
    steps = F.explode(F.sequence(F.lit(1), F.lit(half))) if half >= 1 else F.explode(F.array().cast("array<int>"))
    near = vertices.select("graph_id", F.col("id").alias("a"), steps.alias("k")).select("graph_id", "a", ((F.col("a") + F.col("k")) % n).alias("b"))
    if n % 2 == 0:
        far = vertices.where(F.col("id") < n // 2).select("graph_id", F.col("id").alias("a"), (F.col("id") + n // 2).alias("b"))
        near = near.unionByName(far)
    return near.select("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def _graph(vertices: DataFrame, canonical: DataFrame) -> Graph:
    return Graph(vertices.withColumn("payload", F.struct(F.col("id").alias("index"))), symmetric(canonical.select("graph_id", "src", "dst")))


def er_c(spark: SparkSession, n: int, c: float, seed: int, samples: int = 1) -> Graph:
    """Each pair with probability p = c/(n-1), in time proportional to the edges.

    Vertex i skips from one of its partners above i to the next: the gaps are
    geometric, the k-th one from the random number of (sample, i, k) (Batagelj
    and Brandes 2005). No pair without an edge is ever looked at.
    """
    if n < 2:
        raise GraphError("at least two vertices")
    v, p = sample_vertices(spark, n, samples), c / (n - 1)

    def partners(g: int, i: int):
        if p >= 1:
            yield from range(i + 1, n)
        elif p > 0:
            at, k = i, 1
            while (at := at + 1 + int(math.log(1 - uniform_py(seed, "er_c", g, i, k)) / math.log(1 - p))) < n:
                yield at
                k += 1

    def run(batches):
        for b in batches:
            src, dst, gid = [], [], []
            for g, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = list(partners(g, i))
                dst += new
                src += [i] * len(new)
                gid += [g] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (gid, src, dst)], names=["graph_id", "src", "dst"])

    return _graph(v, v.mapInArrow(run, "graph_id long, src long, dst long"))


def er_m(spark: SparkSession, n: int, m: int, seed: int, samples: int = 1) -> Graph:
    """Exactly m pairs, all sets of m equally likely, in time proportional to m.

    Up to half of all pairs: pairs are drawn one after the other and the first m
    different ones count; should the draws not give m, more are made. Beyond
    that the graph has most pairs anyway, and those of the m smallest random numbers are taken.
    """
    pairs = n * (n - 1) // 2
    if m > pairs:
        raise GraphError("more edges than pairs")
    v = sample_vertices(spark, n, samples)
    if 2 * m > pairs:
        ranked = with_rank(all_pairs(v, n).withColumn("u", uniform(seed, "er_m", "graph_id", "src", "dst")), "u", "src", "dst")
        return _graph(v, ranked.where(F.col("rank") < m))
    draws = 2 * m + 64
    while True:
        drawn = spark.range(samples * draws).select(F.floor(F.col("id") / draws).alias("graph_id"), (F.col("id") % draws).alias("k"))
        a = F.floor(uniform(seed, "er_m_a", "graph_id", "k") * n)
        b = F.floor(uniform(seed, "er_m_b", "graph_id", "k") * (n - 1))
        both = drawn.select("graph_id", "k", a.alias("a"), b.alias("b")).withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("long"))
        first = both.groupBy("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("k").alias("k"))
        kept = materialize(with_rank(first, "k").where(F.col("rank") < m))
        if kept.count() == samples * m:
            return _graph(v, kept)
        draws *= 2


def positions(spark: SparkSession, n: int, seed: int, samples: int = 1) -> DataFrame:
    """Uniform points of the unit square."""
    v = sample_vertices(spark, n, samples)
    return v.withColumns({"x": uniform(seed, "x", "graph_id", "id"), "y": uniform(seed, "y", "graph_id", "id")})


def _with_positions(pairs: DataFrame, at: DataFrame) -> DataFrame:
    a = at.select("graph_id", F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = at.select("graph_id", F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return pairs.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])


def distance() -> Column:
    return F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))


def spatial_distance(at: DataFrame, pairs: DataFrame) -> DataFrame:
    """Euclidean distance of each pair; pairs out of range have no row."""
    return _with_positions(pairs, at).select("graph_id", "src", "dst", distance().alias("distance"))


def spatial_edge_probability(at: DataFrame, pairs: DataFrame, n: int, f: float, alpha: float) -> DataFrame:
    """The edge probability clamped to 0..1."""
    p = _spatial_p(n, f, alpha)
    return _with_positions(pairs, at).select("graph_id", "src", "dst", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("probability"))


def _spatial_p(n: int, f: float, alpha: float, d: Column | None = None) -> Column:
    return F.lit(f) * F.pow(1 + F.lit(math.sqrt(n * math.pi)) * (distance() if d is None else d) / F.lit(alpha), F.lit(-alpha))


#: Vertices that a cell of the finest grid holds on average.
CELL = 8


def _interleaved(x: Column, y: Column, bits: int) -> Column:
    """Morton code: the bits of two cell numbers by turns, so that a block of cells of any level is one stretch of codes."""
    code = F.lit(0).cast("long")
    for k in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(x, k).bitwiseAND(1), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(y, k).bitwiseAND(1), 2 * k + 1))
    return code


def _apart(code: Column, bits: int, first: int) -> Column:
    """One of the two cell numbers of a Morton code."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 2 * k + first).bitwiseAND(1), k))
    return out


def distance_edges(at: DataFrame, n: int, p: Callable[[Column], Column], seed: int, stream: str) -> DataFrame:
    """(graph_id, src, dst) with src < dst: each pair of points (graph_id, id, x, y in the unit square) with probability p(distance).

    ``p`` must fall with the distance. Cells of a grid with about ``CELL`` points
    each are blocks, and so are the cells of coarser grids. Two blocks of one
    level that aren't neighbours, but whose parents are, or that are neighbours
    on the finest level, stand for all pairs of their points; every pair lies in
    exactly one such pair of blocks. Its points are far enough apart for p at
    the blocks' least distance to be a good bound: candidates are drawn by
    geometric gaps with the bound, and each stays with probability p over the
    bound. Time grows with the vertices and the edges, not with the pairs.
    """
    finest = max(0, round(math.log(max(1.0, n / CELL), 4)))
    side = lambda level: F.pow(F.lit(2.0), -level)
    cell = lambda c: F.least(F.floor(F.col(c) * 2**finest), F.lit(2**finest - 1)).cast("long")
    placed = materialize(with_rank(at.withColumn("z", _interleaved(cell("x"), cell("y"), finest)), "z", "id", out="pos"))
    levels = F.explode(F.array(*(F.lit(k) for k in sorted({*range(2, finest + 1), finest}))))
    blocks = placed.select("graph_id", "pos", "z", levels.alias("level")).withColumn("code", F.expr(f"shiftright(z, 2 * ({finest} - level))"))
    blocks = materialize(blocks.groupBy("graph_id", "level", "code").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("size")))

    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-3, 4) for dy in range(-3, 4)))
    around = blocks.select("*", _apart(F.col("code"), finest, 0).alias("cx"), _apart(F.col("code"), finest, 1).alias("cy"), F.explode(steps).alias("step")).select("*", "step.dx", "step.dy")
    bx, by, width = F.col("cx") + F.col("dx"), F.col("cy") + F.col("dy"), F.expr("shiftleft(1L, level)")
    parents = F.greatest(F.abs(F.shiftright(bx, 1) - F.shiftright("cx", 1)), F.abs(F.shiftright(by, 1) - F.shiftright("cy", 1))) <= 1
    near = F.greatest(F.abs("dx"), F.abs("dy")) <= 1
    inside = (bx >= 0) & (by >= 0) & (bx < width) & (by < width)
    wanted = around.where(inside & F.when(near, F.col("level") == finest).otherwise(parents)).withColumn("other", _interleaved(bx, by, finest)).where("other >= code")
    gap = lambda c: F.greatest(F.abs(c) - 1, F.lit(0)).cast("double")
    bound = F.least(F.lit(1.0), p(F.sqrt(gap("dx") * gap("dx") + gap("dy") * gap("dy")) * side(F.col("level"))))
    others = blocks.select("graph_id", "level", F.col("code").alias("other"), F.col("start").alias("other_start"), F.col("size").alias("other_size"))
    met = wanted.select("graph_id", "level", "code", "other", "start", "size", bound.alias("bound")).join(others, ["graph_id", "level", "other"])

    def drawn(r: dict):
        total, k, t = r["size"] * r["other_size"], 0, -1
        keys = (seed, f"{stream}_gap", r["graph_id"], r["level"], r["code"], r["other"])
        scale = math.log1p(-r["bound"]) if r["bound"] < 1 else None
        while True:
            k += 1
            t += 1 if scale is None else 1 + int(math.log(1 - uniform_py(*keys, k)) / scale) if scale else total
            if t >= total:
                return
            a, b = r["start"] + t // r["other_size"], r["other_start"] + t % r["other_size"]
            if a < b:  # within one block each pair turns up twice
                yield a, b

    def run(batches):
        for batch in batches:
            gid, a, b, bounds = [], [], [], []
            for r in batch.to_pylist():
                new = list(drawn(r))
                gid += [r["graph_id"]] * len(new)
                a += [x for x, _ in new]
                b += [y for _, y in new]
                bounds += [r["bound"]] * len(new)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (gid, a, b)), pa.array(bounds, pa.float64())], names=["graph_id", "a", "b", "bound"])

    candidates = met.repartition("graph_id", "level", "code").mapInArrow(run, "graph_id long, a long, b long, bound double")
    end = lambda c, k: placed.select("graph_id", F.col("pos").alias(c), F.col("id").alias(f"id{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    both = candidates.join(end("a", 1), ["graph_id", "a"]).join(end("b", 2), ["graph_id", "b"]).withColumns({"src": F.least("id1", "id2"), "dst": F.greatest("id1", "id2")})
    return both.where(uniform(seed, stream, "graph_id", "src", "dst") * F.col("bound") <= p(distance())).select("graph_id", "src", "dst")


def spatial(spark: SparkSession, n: int, f: float, alpha: float, seed: int, samples: int = 1) -> Graph:
    """Each pair with probability f (1 + sqrt(n pi) d / alpha)^-alpha, in time proportional to vertices and edges."""
    at = positions(spark, n, seed, samples)
    return Graph(at, symmetric(distance_edges(at, n, lambda d: _spatial_p(n, f, alpha, d), seed, "spatial")))


def latin_hypercube_2d(spark: SparkSession, n: int, seed: int, samples: int = 1) -> DataFrame:
    """graph_id, id, x, y: each coordinate a random permutation of 0..n-1."""
    v = sample_vertices(spark, n, samples)
    for c in ("x", "y"):
        v = with_rank(v, uniform(seed, f"lhs_{c}", "graph_id", "id"), "id", out=c)
    return v


def dog_base(spark: SparkSession, n: int, kappa: float, seed: int, samples: int = 1) -> Graph:
    """The distance-dependent edges: probability 1 - (1 - exp(-kappa d))^2, on Latin-hypercube points scaled to the unit square."""
    at = latin_hypercube_2d(spark, n, seed, samples).withColumns({"x": F.col("x") / F.lit(float(n)), "y": F.col("y") / F.lit(float(n))})
    return Graph(at, symmetric(distance_edges(at, n, lambda d: 1 - F.pow(F.expm1(-d * F.lit(kappa)), F.lit(2.0)), seed, "dog")))


def degree_vec_is_valid(degrees: DataFrame) -> DataFrame:
    """graph_id, valid: more than one vertex, every degree under V-1, an even sum (rows graph_id, degree)."""
    return degrees.groupBy("graph_id").agg(((F.count(F.lit(1)) > 1) & (F.max("degree") < F.count(F.lit(1)) - 1) & (F.sum("degree") % 2 == 0)).alias("valid"))


# ---------------------------------------------------------------- one task for each sample


def samples_frame(spark: SparkSession, model: str, params: dict, seed: int, count: int, start: int = 0) -> DataFrame:
    """graph_id, model, seed, params (JSON): one row for each sample, its own seed, dealt evenly to tasks."""
    rows = spark.range(start, start + count).select(F.col("id").alias("graph_id"), F.lit(model).alias("model"), F.concat_ws(".", F.lit(str(seed)), F.col("id")).alias("seed"), F.lit(json.dumps(params)).alias("params"))
    return rows.repartition(max(1, min(count, 4 * spark.sparkContext.defaultParallelism)))


def _each(batches):
    for b in batches:
        for r in b.to_pylist():
            yield r["graph_id"], kernels.build(r["model"], r["seed"], json.loads(r["params"]))


def generate(samples: DataFrame) -> DataFrame:
    """(graph_id, src, dst) with src < dst of every sample."""

    def run(batches):
        for graph_id, model in _each(batches):
            e = model.g.edges()
            yield pa.RecordBatch.from_arrays([pa.array([graph_id] * len(e), pa.int64()), pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64())], names=["graph_id", "src", "dst"])

    return samples.mapInArrow(run, "graph_id long, src long, dst long")


def ensemble(spark: SparkSession, model: str, params: dict, seed: int, samples: int = 1) -> Graph:
    """A Graph of ``samples`` draws of a sequential model."""
    n = int(params.get("n", len(params.get("degrees", ()))))
    return _graph(sample_vertices(spark, n, samples), generate(samples_frame(spark, model, params, seed, samples)))


def config_from_degrees(degrees: DataFrame, seed: int, samples: int = 1) -> Graph:
    """A Graph of ``samples`` draws of the configuration model with the degrees of all rows (id, degree).

    The rows go to the samples' tasks as a table: none is collected by the driver or left out.
    """
    rows = degrees.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("graph_id"), "id", "degree")

    def run(key, t):
        t = t.sort_by("id")
        ids = t.column("id").to_pylist()
        model = kernels.build("config", f"{seed}.{key[0].as_py()}", {"degrees": t.column("degree").to_pylist()})
        e = [sorted((ids[x], ids[y])) for x, y in model.g.edges()]
        return pa.table({"graph_id": pa.array([key[0].as_py()] * len(e), pa.int64()), "src": pa.array([x for x, _ in e], pa.int64()), "dst": pa.array([y for _, y in e], pa.int64())})

    return _graph(rows.select("graph_id", "id"), rows.groupBy("graph_id").applyInArrow(run, "graph_id long, src long, dst long"))


#: A measure: a name of kernels.MEASURES, or a function of a kernels.Adjacency that returns a number or None.
Measure = str | Callable[[kernels.Adjacency], float | None]


def measure(m: Measure) -> Callable[[kernels.Adjacency], float | None]:
    """The function behind a name, or a function itself."""
    if callable(m):
        return m
    if m not in kernels.MEASURES:
        raise ValueError(f"unknown measure: {m!r}")
    return kernels.MEASURES[m]


def measures_of(measures: list[str] | dict[str, Measure]) -> dict[str, Callable]:
    """Column name -> function: from a list of names, or from names that the caller gives to functions or named measures."""
    return {name: measure(m) for name, m in (measures if isinstance(measures, dict) else {m: m for m in measures}).items()}


def _figure(x) -> float | None:
    return None if x is None else float(x)


def simple_sample(samples: DataFrame, measures: list[str] | dict[str, Measure]) -> DataFrame:
    """graph_id and one double column for each measure, taken where the sample is drawn."""
    chosen = measures_of(measures)

    def run(batches):
        for graph_id, model in _each(batches):
            cols = [pa.array([_figure(f(model.g))], pa.float64()) for f in chosen.values()]
            yield pa.RecordBatch.from_arrays([pa.array([graph_id], pa.int64()), *cols], names=["graph_id", *chosen])

    return samples.mapInArrow(run, ", ".join(["graph_id long", *(f"`{m}` double" for m in chosen)]))


def step_log(samples: DataFrame, steps: int) -> DataFrame:
    """graph_id, step_no, kind, a, b, c, d: the record of ``steps`` Markov steps of each sample."""

    def run(batches):
        for graph_id, model in _each(batches):
            made = [(s[0], *s[1:], *[None] * (5 - len(s))) for s in model.m_steps(steps)]
            cols = [pa.array([graph_id] * len(made), pa.int64()), pa.array(range(1, len(made) + 1), pa.int64()), pa.array([s[0] for s in made], pa.string())]
            cols += [pa.array([s[k] for s in made], pa.int64()) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays(cols, names=["graph_id", "step_no", "kind", "a", "b", "c", "d"])

    return samples.mapInArrow(run, "graph_id long, step_no long, kind string, a long, b long, c long, d long")


def steps_and_undo(samples: DataFrame, steps: int) -> DataFrame:
    """(graph_id, src, dst, stage): edges before the steps, after them, and after undoing them."""

    def run(batches):
        for graph_id, model in _each(batches):
            stages = {"before": model.g.edges()}
            made = model.m_steps(steps)
            stages["after"] = model.g.edges()
            model.undo_steps(made)
            stages["undone"] = model.g.edges()
            for stage, e in stages.items():
                yield pa.RecordBatch.from_arrays([pa.array([graph_id] * len(e), pa.int64()), pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64()), pa.array([stage] * len(e), pa.string())], names=["graph_id", "src", "dst", "stage"])

    return samples.mapInArrow(run, "graph_id long, src long, dst long, stage string")


def metropolis(
    samples: DataFrame,
    steps: int,
    step_size: int,
    temperature: float,
    energy: Measure,
    connected: bool = False,
    stop: Callable[[int, float | None], bool] | None = None,
    observe: dict[str, Measure] | None = None,
) -> DataFrame:
    """graph_id, counter, energy, accepted of one chain for each sample, and a double column for each measure in ``observe``.

    A null energy refuses the proposal. With ``connected`` the start is redrawn
    until the graph is connected. A chain ends after ``steps`` proposals, or
    behind the first for which ``stop(counter, energy)`` is true.
    """
    f, seen = measure(energy), measures_of(observe or {})

    def run(batches):
        for graph_id, model in _each(batches):
            while connected and not kernels.connected(model.g):
                model.randomize()
            rows = [(*r, *(_figure(o(model.g)) for o in seen.values())) for r in kernels.metropolis(model, steps, step_size, temperature, f, stop=stop)]
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([_figure(r[1]) for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())]
            cols += [pa.array([r[3 + k] for r in rows], pa.float64()) for k in range(len(seen))]
            yield pa.RecordBatch.from_arrays([pa.array([graph_id] * len(rows), pa.int64()), *cols], names=["graph_id", "counter", "energy", "accepted", *seen])

    return samples.mapInArrow(run, ", ".join(["graph_id long", "counter long", "energy double", "accepted boolean", *(f"`{k}` double" for k in seen)]))


def reject_chain(samples: DataFrame, steps: int, value: Measure, least: float) -> DataFrame:
    """graph_id, stayed, and the measure at the end, of chains that refuse graphs whose measure is under ``least``."""
    f = measure(value)

    def run(batches):
        for graph_id, model in _each(batches):
            stayed = kernels.reject_chain(model, steps, lambda g: (f(g) or 0.0) >= least)
            yield pa.RecordBatch.from_arrays([pa.array([graph_id], pa.int64()), pa.array([stayed], pa.int64()), pa.array([_figure(f(model.g))], pa.float64())], names=["graph_id", "stayed", "value"])

    return samples.mapInArrow(run, "graph_id long, stayed long, value double")


def _into_window(model: kernels.Model, f: Callable, lo: int, hi: int) -> None:
    """Redraw until the value lies inside lo..hi; ValueError if 1000 draws don't."""
    for _ in range(1000):
        if lo <= int(f(model.g)) <= hi:
            return
        model.randomize()
    raise ValueError(f"no draw lies inside {lo}..{hi}")


def wang_landau(samples: DataFrame, lo: int, hi: int, value: Measure, sweeps: int) -> DataFrame:
    """graph_id, value, log_density: an estimate for each sample, whose chain starts inside lo..hi."""
    f = measure(value)

    def run(batches):
        for graph_id, model in _each(batches):
            _into_window(model, f, lo, hi)
            out = kernels.wang_landau(model, lo, hi, lambda g: int(f(g)), sweeps)
            yield pa.RecordBatch.from_arrays([pa.array([graph_id] * len(out), pa.int64()), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.float64())], names=["graph_id", "value", "log_density"])

    return samples.mapInArrow(run, "graph_id long, value long, log_density double")


def entropic(samples: DataFrame, lo: int, hi: int, value: Measure, sweeps: int, steps: int) -> DataFrame:
    """graph_id, value, hits, log_density: Wang and Landau's estimate, refined by ``steps`` steps of entropic sampling with it."""
    f = measure(value)

    def run(batches):
        for graph_id, model in _each(batches):
            _into_window(model, f, lo, hi)
            first = kernels.wang_landau(model, lo, hi, lambda g: int(f(g)), sweeps)
            hits, out = kernels.entropic(model, first, lambda g: int(f(g)), steps)
            cols = [pa.array([graph_id] * len(out), pa.int64()), pa.array(list(out), pa.int64()), pa.array(list(hits.values()), pa.int64()), pa.array(list(out.values()), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["graph_id", "value", "hits", "log_density"])

    return samples.mapInArrow(run, "graph_id long, value long, hits long, log_density double")


def states(samples: DataFrame, steps: int = 0) -> DataFrame:
    """graph_id, state: the whole state of each ensemble, generator included, as JSON, after ``steps`` Markov steps."""

    def run(batches):
        for graph_id, model in _each(batches):
            model.m_steps(steps)
            yield pa.RecordBatch.from_arrays([pa.array([graph_id], pa.int64()), pa.array([json.dumps(model.state())])], names=["graph_id", "state"])

    return samples.mapInArrow(run, "graph_id long, state string")


def states_of(graph: Graph, seed: int, c: float) -> DataFrame:
    """graph_id, state: each graph as the state of an ensemble whose pairs are edges with probability c/(n-1), to go on from with ``resume``."""

    def run(key, t):
        t = t.sort_by("id")
        n, adj = t.num_rows, t.column("adj").to_pylist()
        if t.column("id").to_pylist() != list(range(n)):
            raise GraphError("ids must be dense")
        state = {"model": "ErC", "rng": [f"{seed}.{key[0].as_py()}", "er_c", 0], "adj": adj, "own": {"n": n, "c": c}}
        return pa.table({"graph_id": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([json.dumps(state)])})

    return access.containers(graph).select("graph_id", "id", "adj").groupBy("graph_id").applyInArrow(run, "graph_id long, state string")


def resume(saved: DataFrame, steps: int, measures: list[str] | dict[str, Measure] = ()) -> DataFrame:
    """graph_id, state and measures after ``steps`` more steps from saved states: the same as if the chain had not stopped."""
    chosen = measures_of(measures if isinstance(measures, dict) else list(measures))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                model = kernels.resume(json.loads(r["state"]))
                model.m_steps(steps)
                cols = [pa.array([_figure(f(model.g))], pa.float64()) for f in chosen.values()]
                yield pa.RecordBatch.from_arrays([pa.array([r["graph_id"]], pa.int64()), pa.array([json.dumps(model.state())]), *cols], names=["graph_id", "state", *chosen])

    return saved.select("graph_id", "state").mapInArrow(run, ", ".join(["graph_id long", "state string", *(f"`{m}` double" for m in chosen)]))


def measure_grouped(graph: Graph, measures: list[str] | dict[str, Measure]) -> DataFrame:
    """Measures of every graph of a Graph, one group for each graph: for many small graphs."""
    chosen = measures_of(measures)
    sizes = graph.vertices.groupBy("graph_id").agg((F.max("id") + 1).alias("n"))
    lists = graph.topology().where("src < dst").join(sizes, "graph_id", "right").select("graph_id", "n", "src", "dst")

    def run(key, t):
        g = kernels.Adjacency.of_edges(t.column("n")[0].as_py(), [(a, b) for a, b in zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True) if a is not None])
        return pa.table({"graph_id": pa.array([key[0].as_py()], pa.int64()), **{m: pa.array([_figure(f(g))], pa.float64()) for m, f in chosen.items()}})

    return lists.groupBy("graph_id").applyInArrow(run, ", ".join(["graph_id long", *(f"`{m}` double" for m in chosen)]))
