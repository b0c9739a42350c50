"""Sequential algorithms on one graph in memory, for use inside grouped or mapped tasks.

Anything here is bounded by one graph; many graphs run in parallel.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import deque

from netloom.functions.rng import Rng


class Adjacency:
    """Neighbour sets with insertion order, one dict a vertex."""

    def __init__(self, n: int):
        self.n = n
        self.adj: list[dict[int, None]] = [{} for _ in range(n)]
        self.m = 0

    @staticmethod
    def of(n: int, lists) -> Adjacency:
        g = Adjacency(n)
        for i, js in lists:
            for j in js or ():
                g.adj[i][j] = None
        g.m = sum(map(len, g.adj)) // 2
        return g

    @staticmethod
    def of_edges(n: int, edges) -> Adjacency:
        g = Adjacency(n)
        for i, j in edges:
            g.add(i, j)
        return g

    def add(self, i: int, j: int) -> bool:
        if i == j or j in self.adj[i]:
            return False
        self.adj[i][j] = self.adj[j][i] = None
        self.m += 1
        return True

    def remove(self, i: int, j: int) -> bool:
        if j not in self.adj[i]:
            return False
        del self.adj[i][j], self.adj[j][i]
        self.m -= 1
        return True

    def has(self, i: int, j: int) -> bool:
        return j in self.adj[i]

    def degree(self, i: int) -> int:
        return len(self.adj[i])

    def edges(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.n) for j in sorted(self.adj[i]) if i < j]

    def copy(self) -> Adjacency:
        g = Adjacency(self.n)
        g.adj, g.m = [dict(a) for a in self.adj], self.m
        return g


def dfs_order(g: Adjacency, start: int) -> list[int]:
    """Stack order; a vertex is marked when it is pushed."""
    if not 0 <= start < g.n:
        return []
    seen, stack, out = {start}, [start], []
    while stack:
        v = stack.pop()
        out.append(v)
        for w in g.adj[v]:
            if w not in seen:
                seen.add(w)
                stack.append(w)
    return out


def distances(g: Adjacency, start: int) -> dict[int, int]:
    out, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in g.adj[v]:
            if w not in out:
                out[w] = out[v] + 1
                queue.append(w)
    return out


def component_sizes(g: Adjacency) -> list[int]:
    seen: set[int] = set()
    out = []
    for v in range(g.n):
        if v not in seen:
            part = distances(g, v).keys()
            seen |= part
            out.append(len(part))
    return sorted(out, reverse=True)


def connected(g: Adjacency) -> bool | None:
    return None if not g.n else len(distances(g, 0)) == g.n


def diameter(g: Adjacency) -> int | None:
    if not connected(g):
        return None
    return max(max(distances(g, v).values()) for v in range(g.n))


def q_core(g: Adjacency, q: int) -> int | None:
    """Size of the largest component of the q-core."""
    if q < 2 or not g.n:
        return None
    degree = [g.degree(v) for v in range(g.n)]
    gone = {v for v in range(g.n) if degree[v] < q}
    queue = deque(gone)
    while queue:
        for w in g.adj[queue.popleft()]:
            degree[w] -= 1
            if w not in gone and degree[w] < q:
                gone.add(w)
                queue.append(w)
    core = Adjacency(g.n)
    for v in range(g.n):
        if v not in gone:
            core.adj[v] = {w: None for w in g.adj[v] if w not in gone}
    left, best = set(range(g.n)) - gone, 0
    while left:
        part = distances(core, next(iter(left))).keys()
        best = max(best, len(part))
        left -= part
    return best


def transitivity(g: Adjacency) -> float:
    paths = sum(g.degree(v) * (g.degree(v) - 1) for v in range(g.n))
    closed = sum(1 for v in range(g.n) for w in g.adj[v] for x in g.adj[w] if x != v and x in g.adj[v])
    return closed / paths if paths else math.nan


def vertex_load(g: Adjacency, include_endpoints: bool) -> list[float]:
    load = [0.0] * g.n
    for s in range(g.n):
        far = distances(g, s)
        amount = dict.fromkeys(far, 1.0)
        for v in sorted(far, key=far.get, reverse=True):
            if v == s:
                continue
            load[v] += amount[v] - (0.0 if include_endpoints else 1.0)
            before = [w for w in g.adj[v] if far[w] == far[v] - 1]
            for w in before:
                amount[w] += amount[v] / len(before)
    return load


def biconnected_sizes(edges) -> list[int]:
    """Vertices of each biconnected component, by an iterative lowpoint search with an edge stack."""
    adj: dict[int, list[int]] = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    sizes: list[int] = []
    for root in sorted(adj):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        path, pending = [(root, None, iter(adj[root]))], []
        while path:
            v, parent, rest = path[-1]
            for w in rest:
                if w not in number:
                    pending.append((v, w))
                    number[w] = low[w] = len(number)
                    path.append((w, v, iter(adj[w])))
                    break
                if w != parent and number[w] < number[v]:
                    pending.append((v, w))
                    low[v] = min(low[v], number[w])
            else:
                path.pop()
                if path:
                    u = path[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= number[u]:
                        block: set[int] = set()
                        while True:
                            e = pending.pop()
                            block.update(e)
                            if e == (u, v):
                                break
                        sizes.append(len(block))
    return sorted(sizes, reverse=True)


MEASURES = {
    "edges": lambda g: float(g.m),
    "leaves": lambda g: float(sum(g.degree(v) == 1 for v in range(g.n))),
    "min_degree": lambda g: float(min((g.degree(v) for v in range(g.n)), default=0)),
    "components": lambda g: float(len(component_sizes(g))),
    "largest": lambda g: float(max(component_sizes(g), default=0)),
    "connected": lambda g: float(bool(connected(g))),
    "diameter": lambda g: None if (d := diameter(g)) is None else float(d),
    "q_core_3": lambda g: None if (c := q_core(g, 3)) is None else float(c),
    "q_core_4": lambda g: None if (c := q_core(g, 4)) is None else float(c),
    "transitivity": transitivity,
    "max_load": lambda g: max(vertex_load(g, True), default=0.0),
    "biconnected": lambda g: float(len(biconnected_sizes(g.edges()))),
}


# ---------------------------------------------------------------- models


class StepError(ValueError):
    """A step that can't be undone: the graph is not the one that the step left."""


class DegreeError(ValueError):
    """No simple graph has these degrees."""


class RingError(ValueError):
    """A ring of this distance, or a probability, that the model can't have."""


class Model:
    """A random graph with reversible Markov steps; ``rng`` is its only source of chance."""

    #: Parameters that ``set_params`` may change; steps and draws from then on follow the new values.
    PARAMS: tuple[str, ...] = ()

    def set_params(self, **params: float) -> None:
        unknown = set(params) - set(self.PARAMS)
        if unknown:
            raise ValueError(f"no such parameters: {sorted(unknown)}")
        for k, v in params.items():
            setattr(self, k, v)

    def state(self) -> dict:
        """Everything, generator and order of adjacency included, as values of JSON; ``resume`` goes on from it."""
        own = {k: [[*e, x] for e, x in v.items()] if k == "at_origin" else v for k, v in self.__dict__.items() if k not in ("rng", "g")}
        return {"model": type(self).__name__, "rng": [self.rng.seed, self.rng.stream, self.rng.counter], "adj": [list(a) for a in self.g.adj], "own": own}

    def __init__(self, rng: Rng, n: int):
        self.rng, self.n = rng, n
        self.g = Adjacency(n)

    def randomize(self) -> None:
        raise NotImplementedError

    def m_step(self) -> tuple:
        raise NotImplementedError

    def undo(self, step: tuple) -> None:
        raise NotImplementedError

    def m_steps(self, k: int) -> list[tuple]:
        return [self.m_step() for _ in range(k)]

    def undo_steps(self, steps: list[tuple]) -> None:
        for s in reversed(steps):
            self.undo(s)

    def _undo_pair(self, step: tuple) -> None:
        kind, i, j = step[:3]
        if kind == "add":
            if not self.g.remove(i, j):
                raise StepError(f"step can't be undone: {step}")
        elif kind == "remove" and not self.g.add(i, j):
            raise StepError(f"step can't be undone: {step}")


class ErC(Model):
    """Each pair is an edge with probability c/(n-1)."""

    PARAMS = ("c",)

    def __init__(self, rng, n, c):
        if n < 2:
            raise ValueError("at least two vertices")
        super().__init__(rng, n)
        self.c = c
        self.randomize()

    @property
    def p(self) -> float:
        return self.c / (self.n - 1)

    def chance(self, i: int, j: int) -> float:
        return self.p

    def randomize(self):
        self.g = Adjacency(self.n)
        for i in range(self.n):
            for j in range(i + 1, self.n):
                if self.rng.random() <= self.chance(i, j):
                    self.g.add(i, j)

    def m_step(self):
        i, j = self.rng.pair(self.n)
        if self.rng.random() <= self.chance(i, j):
            return ("add", i, j) if self.g.add(i, j) else ("nothing", i, j)
        return ("remove", i, j) if self.g.remove(i, j) else ("nothing", i, j)

    undo = Model._undo_pair

    def make_connected(self) -> None:
        """Chain the least vertices of the components."""
        seen: set[int] = set()
        firsts = []
        for v in range(self.n):
            if v not in seen:
                firsts.append(v)
                seen |= distances(self.g, v).keys()
        for a, b in zip(firsts, firsts[1:], strict=False):
            self.g.add(a, b)


class ErM(Model):
    """Exactly m of all pairs; a step swaps a present edge for an absent one."""

    def __init__(self, rng, n, m):
        if m > n * (n - 1) // 2:
            raise ValueError("more edges than pairs")
        super().__init__(rng, n)
        self.m = m
        self.pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        self.randomize()

    def randomize(self):
        self.rng.shuffle(self.pairs)
        self.g = Adjacency.of_edges(self.n, self.pairs[: self.m])

    def m_step(self):
        if not 0 < self.m < len(self.pairs):
            raise ValueError("no edge can be swapped")
        a = self.rng.below(self.m)
        b = self.m + self.rng.below(len(self.pairs) - self.m)
        return self._swap(a, b)

    def _swap(self, a: int, b: int):
        gone, new = self.pairs[a], self.pairs[b]
        self.g.remove(*gone)
        self.g.add(*new)
        self.pairs[a], self.pairs[b] = new, gone
        return ("swap", a, b)

    def undo(self, step):
        self._swap(step[1], step[2])


class Sw(Model):
    """Small world with root edges: every vertex owns d edges that a rewiring moves and a reset brings back."""

    PARAMS = ("r",)

    def __init__(self, rng, n, r, distance=2):
        if n < 2 * distance + 1:
            raise RingError("the ring needs more vertices")
        super().__init__(rng, n)
        self.r, self.d = r, distance
        self.g = Adjacency.of_edges(n, [(i, (i + k) % n) for i in range(n) for k in range(1, distance + 1)])
        self.root = [[(i + k) % n for k in range(1, distance + 1)] for i in range(n)]
        self.randomize()

    def origin(self, i: int, k: int) -> int:
        return (i + k + 1) % self.n

    def _move(self, i: int, k: int, to: int):
        old = self.root[i][k]
        if to == old:
            return ("nothing", i, k, old, to)
        if to == i or self.g.has(i, to):
            return ("blocked", i, k, old, to)
        self.g.remove(i, old)
        self.g.add(i, to)
        self.root[i][k] = to
        return ("changed", i, k, old, to)

    def draw_edge(self) -> tuple[int, int]:
        """A root edge at random: (vertex, which of its own edges)."""
        return self.rng.below(self.n), self.rng.below(self.d)

    def _draw(self, i: int, k: int):
        if self.rng.random() <= self.r:
            to = self.rng.below(self.n - 1)
            return self._move(i, k, to + (to >= i))
        return self._move(i, k, self.origin(i, k))

    def randomize(self):
        for i in range(self.n):
            for k in range(self.d):
                self._draw(i, k)

    def m_step(self):
        return self._draw(*self.draw_edge())

    def undo(self, step):
        if step[0] == "changed" and self._move(step[1], step[2], step[3])[0] != "changed":
            raise StepError(f"step can't be undone: {step}")

    def long_ranging(self) -> int:
        return sum(self.root[i][k] != self.origin(i, k) for i in range(self.n) for k in range(self.d))

    def make_connected(self) -> None:
        """Bring back ring edges that bridge two components, until one is left."""
        while True:
            part = distances(self.g, 0)
            if len(part) == self.n:
                return
            moved = False
            for i in range(self.n):
                for k in range(self.d):
                    o = self.origin(i, k)
                    if self.root[i][k] != o and (i in part) != (o in part):
                        moved |= self._move(i, k, o)[0] == "changed"
                        break
                if moved:
                    break
            if not moved:
                return


class Ws(Model):
    """Watts-Strogatz variant: an edge at its origin moves to a uniformly drawn pair without edge."""

    PARAMS = ("p",)

    def __init__(self, rng, n, distance, p, single_pass=False):
        if n < 2 * distance + 1 or distance < 1 or not 0 <= p <= 1:
            raise RingError("ring distance or probability out of range")
        super().__init__(rng, n)
        self.d, self.p, self.single_pass = distance, p, single_pass
        self.randomize()

    def randomize(self):
        n = self.n
        ring = [(i, (i + k) % n) for i in range(n) for k in range(1, self.d + 1)]
        self.g = Adjacency.of_edges(n, ring)
        self.at_origin = dict.fromkeys(((min(e), max(e)) for e in ring), True)
        if self.g.m >= n * (n - 1) // 2:
            return
        # every vertex visits its edges, so one that stays at its first end is asked again at the other
        for v in range(n):
            for w in list(self.g.adj[v]):
                e = (min(v, w), max(v, w))
                if not self.at_origin.get(e) or (self.single_pass and v > w):
                    continue
                if self.rng.random() <= self.p:
                    while True:
                        a, b = self.rng.pair(n)
                        if not self.g.has(a, b):
                            break
                    self.g.remove(*e)
                    self.g.add(a, b)
                    self.at_origin.pop(e)
                    self.at_origin[min(a, b), max(a, b)] = False


class Ba(Model):
    """Preferential attachment to a seed graph; weights are frozen while one vertex attaches."""

    def __init__(self, rng, n, m, seed_edges=None, seed_n=None):
        self.seed_edges = seed_edges if seed_edges is not None else [(0, 1)]
        self.seed_n = seed_n if seed_n is not None else 2
        if m > self.seed_n or n < self.seed_n or not self.seed_edges:
            raise ValueError("m is more than the seed's vertices, or the seed is empty")
        super().__init__(rng, n)
        self.m = m
        self.randomize()

    def randomize(self):
        self.g = Adjacency.of_edges(self.n, self.seed_edges)
        order = list(range(self.seed_n, self.n))
        self.rng.shuffle(order)
        ends = [v for e in self.seed_edges for v in e]  # a vertex once for each edge end
        for v in order:
            frozen = len(ends)
            while self.g.degree(v) < self.m:
                w = ends[self.rng.below(frozen)]
                if self.g.add(v, w):
                    ends += (v, w)


class Config(Model):
    """A simple graph with an exact degree vector: a graph that has it, then random swaps of edge pairs.

    The start connects the vertex of most missing partners to those that miss
    most after it (Havel and Hakimi), which always succeeds for a valid vector.
    ``MIXING`` swaps for each edge forget the start (each keeps all degrees,
    and any graph can be reached), so a draw takes time linear in the edges
    whatever the degrees.
    """

    MIXING = 10

    def __init__(self, rng, degrees):
        self.degrees = list(degrees)
        if not valid_degrees(self.degrees):
            raise DegreeError("no simple graph has these degrees")
        super().__init__(rng, len(self.degrees))
        self.randomize()

    def randomize(self):
        g = Adjacency(self.n)
        heap = [(-d, v) for v, d in enumerate(self.degrees) if d]
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            for e, w in [heapq.heappop(heap) for _ in range(-d)]:
                g.add(v, w)
                if e < -1:
                    heapq.heappush(heap, (e + 1, w))
        self.g = g
        edges = g.edges()
        for _ in range(self.MIXING * len(edges)):
            a, b = self.rng.below(len(edges)), self.rng.below(len(edges))
            (i, j), (k, x) = edges[a], edges[b]
            if self.rng.random() < 0.5:
                k, x = x, k
            if self._swap(i, j, k, x)[0] == "swap":
                edges[a], edges[b] = (i, k), (j, x)

    def m_step(self):
        """(n, j), (k, l) become (n, k), (j, l)."""
        ends = [v for v in range(self.n) for _ in range(self.g.degree(v))]
        if not ends:
            return ("error",)
        a, b = ends[self.rng.below(len(ends))], ends[self.rng.below(len(ends))]
        j = list(self.g.adj[a])[self.rng.below(self.g.degree(a))]
        x = list(self.g.adj[b])[self.rng.below(self.g.degree(b))]
        return self._swap(a, j, b, x)

    def _swap(self, a, j, k, x):
        if len({a, j, k, x}) < 4 or self.g.has(a, k) or self.g.has(j, x):
            return ("error",)
        self.g.remove(a, j)
        self.g.remove(k, x)
        self.g.add(a, k)
        self.g.add(j, x)
        return ("swap", a, j, k, x)

    def undo(self, step):
        if step[0] == "swap" and self._swap(step[1], step[3], step[2], step[4])[0] != "swap":
            raise StepError(f"step can't be undone: {step}")


class Spatial(ErC):
    """Points in the unit square; the chance of an edge falls with the distance."""

    PARAMS = ("f", "alpha")

    def __init__(self, rng, n, f, alpha):
        self.f, self.alpha = f, alpha
        self.xy = [(rng.random(), rng.random()) for _ in range(n)]
        super().__init__(rng, n, 0.0)

    def chance(self, i, j):
        d = math.dist(self.xy[i], self.xy[j])
        return self.f * (1 + math.sqrt(self.n * math.pi) * d / self.alpha) ** -self.alpha


class Dog(Model):
    """Latin-hypercube points with distance-dependent edges, then extra degree-weighted edges of some vertices."""

    def __init__(self, rng, n, kappa, tau, lam):
        if lam <= 0:
            raise ValueError("lambda must be positive")
        super().__init__(rng, n)
        self.kappa, self.tau, self.lam = kappa, tau, lam
        xs, ys = list(range(n)), list(range(n))
        rng.shuffle(xs)
        rng.shuffle(ys)
        self.xy = [(x / n, y / n) for x, y in zip(xs, ys, strict=True)]
        self.randomize()

    def _poisson(self) -> int:
        limit, k, p = math.exp(-self.lam), 0, 1.0
        while True:
            p *= self.rng.random()
            if p <= limit:
                return k
            k += 1

    def randomize(self):
        self.g = Adjacency(self.n)
        for i in range(self.n):
            for j in range(i):
                if self.rng.random() < 1 - math.expm1(-math.dist(self.xy[i], self.xy[j]) * self.kappa) ** 2:
                    self.g.add(i, j)
        order = list(range(self.n))
        self.rng.shuffle(order)
        for v in order[: round((1 - self.tau) * self.n)]:
            for _ in range(self._poisson()):
                if self.g.degree(v) >= self.n - 1 or not any(self.g.degree(w) for w in range(self.n) if w != v and not self.g.has(v, w)):
                    break  # nothing left that could be drawn
                total = 2 * self.g.m
                while True:
                    w = self.rng.below(self.n)
                    if w != v and self.rng.random() < self.g.degree(w) / total and self.g.add(v, w):
                        break


def valid_degrees(degrees: list[int]) -> bool:
    """More than one vertex, all degrees under n-1, an even sum, and the Erdos-Gallai inequalities."""
    n = len(degrees)
    if n < 2 or any(d < 0 or d >= n - 1 for d in degrees) or sum(degrees) % 2:
        return False
    d = sorted(degrees, reverse=True)
    first = [0, *itertools.accumulate(d)]
    over = n  # how many degrees are k or more
    for k in range(1, n + 1):
        while over and d[over - 1] < k:
            over -= 1
        wide = max(over, k)
        if first[k] > k * (k - 1) + k * (wide - k) + first[n] - first[wide]:
            return False
    return True


def build(model: str, seed: int, params: dict) -> Model:
    """A model by name; the stream is the model's name, so that (seed, counter) resumes a run."""
    rng = Rng(seed, model)
    p = params
    makers = {
        "er_c": lambda: ErC(rng, int(p["n"]), p["c"]),
        "er_m": lambda: ErM(rng, int(p["n"]), int(p["m"])),
        "sw": lambda: Sw(rng, int(p["n"]), p["r"], int(p.get("distance", 2))),
        "ws": lambda: Ws(rng, int(p["n"]), int(p["distance"]), p["p"]),
        "ba": lambda: Ba(rng, int(p["n"]), int(p["m"]), p.get("seed_edges"), p.get("seed_n")),
        "config": lambda: Config(rng, p["degrees"]),
        "spatial": lambda: Spatial(rng, int(p["n"]), p["f"], p["alpha"]),
        "dog": lambda: Dog(rng, int(p["n"]), p["kappa"], p["tau"], p["lam"]),
    }
    if model not in makers:
        raise ValueError(f"unknown model {model!r}")
    return makers[model]()


def resume(state: dict) -> Model:
    """The model that ``Model.state`` described."""
    kind = {c.__name__: c for c in (ErC, ErM, Sw, Ws, Ba, Config, Spatial, Dog)}[state["model"]]
    model = kind.__new__(kind)
    own = dict(state["own"])
    if "at_origin" in own:
        own["at_origin"] = {(a, b): x for a, b, x in own["at_origin"]}
    model.__dict__.update(own)
    model.rng = Rng(*state["rng"])
    model.g = Adjacency.of(model.n, enumerate(state["adj"]))
    return model


def metropolis(model: Model, steps: int, step_size: int, temperature: float, energy, counter: int = 0, start: float | None = None, stop=None):
    """Yield (counter, energy, accepted) for each of ``steps`` proposals of ``step_size`` Markov steps, up to the first that ``stop(counter, energy)`` ends with."""
    e = energy(model.g) if start is None else start
    for k in range(counter + 1, counter + steps + 1):
        made = model.m_steps(step_size)
        new = energy(model.g)
        ok = new is not None and (e is None or model.rng.random() <= math.exp(min(0.0, -(new - e) / temperature)))
        if ok:
            e = new
        else:
            model.undo_steps(made)
        yield k, e, ok
        if stop is not None and stop(k, e):
            return


def reject_chain(model: Model, steps: int, keep) -> int:
    """Single steps, each undone if the graph is then refused; returns how many stayed."""
    stayed = 0
    for _ in range(steps):
        s = model.m_step()
        if keep(model.g):
            stayed += 1
        else:
            model.undo(s)
    return stayed


def wang_landau(model: Model, lo: int, hi: int, value, sweeps: int, step_size: int = 1, log_f: float = 1.0, least_log_f: float = 1e-3, flat: float = 0.7) -> dict[int, float]:
    """Log density of an integer value in lo..hi (Wang and Landau 2001); the modification factor halves when the histogram is flat."""
    log_g, hits = dict.fromkeys(range(lo, hi + 1), 0.0), dict.fromkeys(range(lo, hi + 1), 0)
    now = value(model.g)
    if not lo <= now <= hi:
        raise ValueError("the start lies outside the window")
    for k in range(sweeps):
        made = model.m_steps(step_size)
        new = value(model.g)
        if lo <= new <= hi and math.log(max(model.rng.random(), 1e-300)) <= log_g[now] - log_g[new]:
            now = new
        else:
            model.undo_steps(made)
        log_g[now] += log_f
        hits[now] += 1
        if k % 200 == 199 and (seen := [h for h in hits.values() if h]) and min(seen) >= flat * sum(seen) / len(seen):
            log_f, hits = log_f / 2, dict.fromkeys(hits, 0)
            if log_f < least_log_f:
                break
    return {v: g - min(log_g.values()) for v, g in log_g.items()}


def entropic(model: Model, log_density: dict[int, float], value, steps: int, step_size: int = 1) -> tuple[dict[int, int], dict[int, float]]:
    """Entropic sampling (Lee 1993): a chain whose weights are the inverse of an estimated density visits all values about equally.

    Returns how often each value was visited, and the estimate corrected by
    that: log density plus log visits, for the values visited.
    """
    hits = dict.fromkeys(log_density, 0)
    now = value(model.g)
    if now not in hits:
        raise ValueError("the start lies outside the window")
    for _ in range(steps):
        made = model.m_steps(step_size)
        new = value(model.g)
        if new in hits and math.log(max(model.rng.random(), 1e-300)) <= log_density[now] - log_density[new]:
            now = new
        else:
            model.undo_steps(made)
        hits[now] += 1
    seen = {v: log_density[v] + math.log(h) for v, h in hits.items() if h}
    least = min(seen.values(), default=0.0)
    return hits, {v: seen[v] - least if v in seen else None for v in hits}
