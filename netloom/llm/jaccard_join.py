"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of 5-word shingles (lower case, letters and digits) and two
of them are linked when the Jaccard similarity of their sets is at least 0.8.
The join runs in these steps.

1. One pass over the texts gives each document a digest of its shingle set and
   a MinHash sketch (one permutation, 165 bins, empty bins filled from a
   random other bin). Documents with equal sets form a class, so that copies
   never meet each other in a join.
2. The sketches of the classes are cut into 33 bands of 5 values; a pair at
   exactly 0.8 shares no band with probability 2e-6. Buckets of up to ``LIGHT``
   members give pairs by an equi-join, each pair once.
3. Pruning compares sketches 33 bins at a time. A bin that is filled in either
   set is evidence, and matches with a probability equal to the similarity;
   bins that are empty in both tell nothing and don't count, so that one rule
   holds for sets of every size. With a uniform prior the posterior of the
   similarity is a Beta distribution; a pair is dropped as soon as the
   posterior probability of 0.8 or more is under ``TOLERANCE``.
4. What is left is verified exactly on the shingle sets, in whole numbers.
5. In a larger bucket every member is first compared with one pivot, the
   member that shares most large buckets. Members at 0.9 or more to a pivot
   form its family. Jaccard distance is a metric, so all of a family are
   linked to each other: counted by the family's size, never compared.
   Only pairs across families and outside them are left; the bucket is cut
   into blocks, a large family has blocks of its own, blocks of one family
   don't meet, and each other pair of blocks is one task group. No pair leaves
   a group, only link counts and a spanning forest. A pair counts in its first
   large bucket, and not there if a small bucket already has it.
6. Groups are the connected components of the links: labels spread to
   neighbours with pointer jumping, over tables in the shared folder.

Joins on keys that may hold a large share of all rows (classes of copies, large
buckets, hubs, labels) deal the rows of hot keys to many tasks.

Defined cases: null and empty texts, and texts without any word, have the
empty set; they are equal to each other and to nothing else. Texts of fewer
than five words have one shingle, all their words. Rows, not ids, are joined:
a null or repeated doc_id is a document like any other, ids only name classes
and groups (null if all ids of one are null). Texts of any length are read
whole. Extra columns, whatever their names, don't matter to ``join`` and are
kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import re
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import fresh, slices, small_batches
from netloom.plans.skew import hot_keys, spread_join
from netloom.session import discard, materialize

WORDS = 5
#: Similarity from which documents are linked, and that of a family's members to its pivot, in whole numbers.
LINKED, TIGHT = (4, 5), (9, 10)
THRESHOLD = LINKED[0] / LINKED[1]
BANDS, ROWS = 33, 5
BINS = BANDS * ROWS
STEP = 33
TOLERANCE = 1e-6
#: Buckets of more members than this are joined block by block, inside tasks.
LIGHT = 24
#: Members and bytes of shingles of a block, at most; small buckets are cut into up to 8 blocks of a few members at least.
BLOCK, BLOCK_BYTES, FEW = 2048, 16 << 20, 192
CACHE_WORDS = 150_000
#: Rows that a worker holds as Python lists at once.
SLICE = 512
#: Pairs compared at once inside a task.
PAIRS = 1 << 14

_FOLD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_MARKS = re.compile(r"[^\w\x00-\x7f]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_RANK = np.argsort(np.random.default_rng(168).random((BINS, BINS)), axis=1).astype(np.int32)
_EDGES = np.array([((i << 64) // BINS) for i in range(BINS)], dtype=np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, cache: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words."""
    cache = _WordHash() if cache is None else cache
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, np.uint64(min(len(w), WORDS)), np.uint64)
    for k in range(min(WORDS, len(w))):
        h = (h ^ w[k : k + n]) * _P
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled): the least hash of each bin, an empty bin's from the filled bin it ranks first; which bins are filled."""
    out, filled = np.zeros(BINS, np.uint32), np.zeros(BINS, bool)
    if len(s):
        first = np.searchsorted(s, _EDGES)
        filled = first < np.append(first[1:], len(s))
        out[filled] = (s[first[filled]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        if not filled.all():
            donors, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
            out[empty] = out[donors[_RANK[empty][:, donors].argmin(1)]]
    return out, filled


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of bins with evidence, the least matches with which a pair stays.

    With a uniform prior, m matches of n make the similarity Beta(m+1, n-m+1),
    and P(S >= t) is the probability of at most m successes in n+1 draws at t.
    """
    out = np.zeros(BINS + 1, np.int32)
    for n in range(1, BINS + 1):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


_LEAST = least_matches()


def survivors(a: np.ndarray, fill_a: np.ndarray, b: np.ndarray, fill_b: np.ndarray) -> np.ndarray:
    """Which rows of two aligned sketch matrices (values, filled) outlast the pruning."""
    live = np.arange(len(a))
    seen, same = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
    for n in range(0, BINS, STEP):
        cols = slice(n, n + STEP)
        fa, fb = fill_a[live, cols], fill_b[live, cols]
        seen[live] += (fa | fb).sum(1, dtype=np.int32)
        same[live] += (fa & fb & (a[live, cols] == b[live, cols])).sum(1, dtype=np.int32)
        live = live[same[live] >= _LEAST[seen[live]]]
    return live


def _row_key():
    """A hash that names a row by id and text; what it selects is checked again by the set's digest."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketches(docs: DataFrame) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), "text")

    def run(batches):
        cache = _WordHash()
        for b in slices(batches, SLICE):
            sets = [shingles(t, cache) for t in b.column(2).to_pylist()]
            made = [sketch(s) for s in sets]
            cols = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
            cols += [pa.array([v.tobytes() for v, _ in made], pa.binary()), pa.array([np.packbits(f).tobytes() for _, f in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "row_key", "set_key", "n", "sketch", "filled"])

    return small_batches(source).mapInArrow(run, "doc_id long, row_key long, set_key binary, n int, sketch binary, filled binary")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, shingles) of the classes in ``wanted`` (cid, row_key, set_key); the other texts are dropped before they are read again."""
    source = docs.select(_row_key().alias("row_key"), "text").join(wanted.select("row_key").distinct(), "row_key", "left_semi")

    def run(batches):
        cache = _WordHash()
        for b in slices(batches, SLICE):
            sets = [shingles(t, cache) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"])

    found = small_batches(source).mapInArrow(run, "set_key binary, shingles binary").dropDuplicates(["set_key"])
    return found.join(wanted.select("cid", "set_key"), "set_key").select("cid", "shingles")


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _filled(column) -> np.ndarray:
    return np.unpackbits(_matrix(column, np.uint8, -(-BINS // 8)), axis=1)[:, :BINS].astype(bool)


def _prune(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of the pairs (sketch_a, filled_a, sketch_b, filled_b) that outlast the pruning."""

    def run(batches):
        for b in slices(batches, 4096):
            if b.num_rows:
                col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                live = pa.array(survivors(*(x for s in "ab" for x in (_matrix(col[f"sketch_{s}"], np.uint32, BINS), _filled(col[f"filled_{s}"])))))
                yield pa.RecordBatch.from_arrays([col[c].take(live) for c in keep], names=keep)

    return pairs.mapInArrow(run, pairs.select(*keep).schema)


def _shared(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the intersection and the union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both, len(x) + len(y) - both


def _verify(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """The pairs (set_a, set_b) that are linked, and whether they are tight."""

    def run(batches):
        for b in slices(batches, SLICE):
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            sizes = np.array([_shared(x, y) for x, y in zip(col["set_a"].to_pylist(), col["set_b"].to_pylist(), strict=True)], np.int64).reshape(-1, 2)
            tight = TIGHT[1] * sizes[:, 0] >= TIGHT[0] * sizes[:, 1]
            out = pa.RecordBatch.from_arrays([*(col[c] for c in keep), pa.array(tight)], names=[*keep, "tight"])
            yield out.filter(pa.array(LINKED[1] * sizes[:, 0] >= LINKED[0] * sizes[:, 1]))

    return pairs.mapInArrow(run, ", ".join([*(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep), "tight boolean"]))


def _dense_overlap(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two blocks, as a product of 0/1 matrices in slices of columns."""
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    sides = []
    for sets, flat in ((sets_a, flat_a), (sets_b, flat_b)):
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(both, flat)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == flat[ok]
        sides.append((row[ok], at[ok]))
    for lo in range(0, len(both), 2048):
        m = []
        for (row, at), sets in zip(sides, (sets_a, sets_b), strict=True):
            x = np.zeros((len(sets), 2048), np.float32)
            inside = (at >= lo) & (at < lo + 2048)
            x[row[inside], at[inside] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


class Block:
    """One side of a task group: columns of its members as arrays."""

    def __init__(self, t: pa.Table):
        self.cid, self.family, self.heavy = (t.column(c).to_numpy() for c in ("cid", "family", "heavy"))
        self.sketch, self.filled = _matrix(t.column("sketch"), np.uint32, BINS), _filled(t.column("filled"))
        self.sets = [np.frombuffer(v, np.uint64) for v in t.column("shingles").to_pylist()]
        self.size = np.array([len(s) for s in self.sets], np.int64)


def block_links(band: int, a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of one large bucket: (index in a, index in b) arrays.

    A pair counts here if it is of no common family, shares no small bucket,
    and this is the first large bucket that it shares. ``heavy``: bit j says
    that band j's bucket is large. A family is -1 if there is none.
    """
    na, nb = len(a.cid), len(b.cid)
    found = []
    rows = max(1, PAIRS // nb)
    for lo in range(0, na, rows):
        i, j = (x.ravel() for x in np.indices((min(rows, na - lo), nb)))
        i = i + lo
        keep = (a.family[i] != b.family[j]) | (a.family[i] < 0)
        if same:
            keep &= i < j
        i, j = i[keep], j[keep]
        keep = LINKED[1] * np.minimum(a.size[i], b.size[j]) >= LINKED[0] * np.maximum(a.size[i], b.size[j])
        i, j = i[keep], j[keep]
        live = survivors(a.sketch[i], a.filled[i], b.sketch[j], b.filled[j])
        i, j = i[live], j[live]
        for k in range(BANDS):  # other shared buckets
            if k == band or not len(i):
                continue
            shared = (a.sketch[i, k * ROWS : (k + 1) * ROWS] == b.sketch[j, k * ROWS : (k + 1) * ROWS]).all(1)
            drop = shared & ((a.heavy[i] >> k & 1 == 0) | (k < band))
            i, j = i[~drop], j[~drop]
        found.append(np.stack((i, j)))
    i, j = np.concatenate(found, 1)
    if len(i):
        rows, cols = np.unique(i), np.unique(j)
        both = _dense_overlap([a.sets[r] for r in rows], [b.sets[c] for c in cols])[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)
        keep = LINKED[1] * both >= LINKED[0] * (a.size[i] + b.size[j] - both)
        i, j = i[keep], j[keep]
    return i, j


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of these links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in root if find(x) != x]


def _heavy_links(dealt: DataFrame) -> DataFrame:
    """(cid, links) rows with links > 0, and (cid, other) rows of the forest, from pairs of blocks (bucket, x, y)."""

    def run(key, t):
        _, x, y = (k.as_py() for k in key[:3])
        band = t.column("band")[0].as_py()
        t = t.sort_by("cid")
        block = t.column("block").to_numpy()
        sides = [Block(t.filter(pa.array(block == v))) for v in ((x, y) if x != y else (x,))]
        out_cid, out_links, out_other = [], [], []
        if all(len(s.cid) for s in sides):
            a, b = sides[0], sides[-1]
            i, j = block_links(band, a, b, x == y)
            for side, at in ((a, i), (b, j)):
                which, count = np.unique(at, return_counts=True)
                out_cid += side.cid[which].tolist()
                out_links += count.tolist()
                out_other += [None] * len(which)
            for p, q in _forest(a.cid[i], b.cid[j]):
                out_cid.append(p)
                out_links.append(0)
                out_other.append(q)
        return pa.table({"cid": pa.array(out_cid, pa.int64()), "links": pa.array(out_links, pa.int64()), "other": pa.array(out_other, pa.int64())})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(run, "cid long, links long, other long")


def _count_blocks(members, shingles):
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles * 8 / BLOCK_BYTES), F.least(F.lit(8), F.ceil(members / FEW))).cast("long")


def _blocks(heavy: DataFrame, hot: dict[int, list[int]]) -> tuple[DataFrame, DataFrame]:
    """The blocks of each large bucket, and which of them meet.

    heavy: bucket, cid, family (-1: none), n; hot: the buckets to deal. Returns (bucket, cid,
    block) of every member, and (bucket, block, pairs): an array of the (x, y) that a
    block takes part in, as long as the bucket has other blocks. A family large
    enough for blocks of its own is a part of the bucket; all others are one part.
    """
    of = heavy.withColumn("of", F.struct("bucket", "family"))
    count = of.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles"))
    large = (F.col("of.family") >= 0) & (F.col("n") >= FEW)
    own = materialize(count.where(large).withColumn("own_blocks", _count_blocks(F.col("n"), F.col("shingles"))))
    rest = count.where(~large).groupBy(F.col("of.bucket").alias("bucket")).agg(_count_blocks(F.sum("n"), F.sum("shingles")).alias("rest_blocks"))
    rest = materialize(rest)
    placed = spread_join(spread_join(of, own.select("of", "own_blocks"), "of", hot_keys(own.select("of", "n"), "of"), "cid", "left"), rest, "bucket", hot, "cid", "left")
    part, blocks = F.when(F.col("own_blocks").isNotNull(), F.col("family")).otherwise(F.lit(-1)), F.coalesce("own_blocks", "rest_blocks")
    placed = placed.select("bucket", "cid", F.xxhash64(part, F.pmod(F.xxhash64("cid"), blocks)).alias("block"))

    parts = own.select("of.bucket", F.col("of.family").alias("part"), F.col("own_blocks").alias("blocks")).unionByName(rest.select("bucket", F.lit(-1).cast("long").alias("part"), F.col("rest_blocks").alias("blocks")))
    each = parts.select("bucket", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")).select("bucket", F.struct("part", F.xxhash64("part", "k").alias("block")).alias("me"))
    mates = each.groupBy("bucket").agg(F.collect_list("me").alias("all"))
    met = F.filter("all", lambda o: (o["part"] != F.col("me.part")) | (o["part"] == -1))
    pairs = F.transform(met, lambda o: F.struct(F.least(o["block"], F.col("me.block")).alias("x"), F.greatest(o["block"], F.col("me.block")).alias("y")))
    return placed, each.join(mates, "bucket").select("bucket", F.col("me.block").alias("block"), pairs.alias("pairs")).where(F.size("pairs") > 0)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the least id reachable.

    Each round every id takes the least label among its own, its neighbours'
    and its label's label (pointer jumping). Tables between rounds lie in the
    shared folder; only a count reaches the driver. Hubs and labels that many
    ids share are dealt to many tasks.
    """
    both = materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).where("id <> to").distinct())
    hubs = hot_keys(both.groupBy("to").agg(F.count(F.lit(1)).alias("n")), "to")
    labels = materialize(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("label")))
    for _ in range(max_rounds):
        near = spread_join(both, labels.select(F.col("id").alias("to"), "label"), "to", hubs, "id").select("id", "label")
        # the label's own label, once for each label in use
        used = hot_keys(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
        jump = spread_join(labels, labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", used, "id").select("id", F.col("next").alias("label"))
        after = near.unionByName(jump).unionByName(labels.select("id", "label")).groupBy("id").agg(F.min("label").alias("new"))
        nxt = materialize(labels.join(after, "id").select("id", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("changed")))
        changed = nxt.where("changed").limit(1).count()
        discard(labels)
        labels = nxt
        if not changed:
            discard(both)
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError("labels still change after the last round")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, classes, counts, edges).

    rows: doc_id, row_key, set_key of every document.
    classes: cid, set_key, first_id (smallest doc_id), copies.
    counts: cid, n_links (classes linked to it), if any.
    edges: a, b (cids) whose components are those of all links.
    """
    base = materialize(_sketches(docs))
    classes = base.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first(F.struct("sketch", "filled")).alias("s"))
    classes = materialize(classes.select("*", "s.*", F.monotonically_increasing_id().alias("cid")).drop("s"))

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sketch", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    banded = classes.where("n > 0").select("cid", "n", F.posexplode(bands).alias("band", "bucket"))
    sizes = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = hot_keys(sizes, "bucket")
    shared = materialize(spread_join(banded, sizes.select("bucket", F.col("n").alias("size")), "bucket", hot, "cid"))

    light = shared.where(F.col("size") <= LIGHT).select("bucket", "cid")
    pairs = light.select("bucket", F.col("cid").alias("a")).join(light.select("bucket", F.col("cid").alias("b")), "bucket").where("a < b")
    pairs = pairs.select("a", "b", F.lit(True).alias("light"), F.lit(False).alias("led_by_a"), F.lit(False).alias("led_by_b"))

    heavy = shared.where(F.col("size") > LIGHT)
    marks = materialize(heavy.groupBy("cid").agg(F.sum(F.expr("shiftleft(1L, band)")).alias("heavy"), F.count(F.lit(1)).alias("buckets")))
    pivots = heavy.join(marks, "cid").groupBy("bucket").agg(F.max(F.struct("buckets", "cid"))["cid"].alias("pivot"))
    led = spread_join(heavy.select("bucket", "cid"), pivots, "bucket", hot, "cid").where("cid <> pivot")
    led = led.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"), F.lit(False).alias("light"), (F.col("pivot") < F.col("cid")).alias("led_by_a"), (F.col("pivot") > F.col("cid")).alias("led_by_b"))

    flags = ["light", "led_by_a", "led_by_b"]
    pairs = pairs.unionByName(led).groupBy("a", "b").agg(*(F.max(c).alias(c) for c in flags))
    sk = classes.select("cid", "n", "sketch", "filled")
    for side in ("a", "b"):
        pairs = pairs.join(sk.select(F.col("cid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch", "filled"))), side)
    pairs = pairs.where(f"{LINKED[1]} * least(n_a, n_b) >= {LINKED[0]} * greatest(n_a, n_b)")
    likely = materialize(_prune(pairs, ["a", "b", *flags]))

    needed = likely.select(F.col("a").alias("cid")).unionByName(likely.select(F.col("b").alias("cid"))).unionByName(marks.select("cid")).distinct()
    sets = materialize(_shingle_sets(docs, classes.select("cid", "row_key", "set_key").join(needed, "cid", "left_semi")))
    found = likely
    for side in ("a", "b"):
        found = found.join(sets.select(F.col("cid").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    verified = materialize(_verify(found, ["a", "b", *flags]))

    # Each class joins the family of the pivot of smallest cid that it is tight to; a pivot is tight to itself.
    tight = verified.where("tight")
    tied = tight.where("led_by_a").select(F.col("b").alias("cid"), F.col("a").alias("pivot")).unionByName(tight.where("led_by_b").select(F.col("a").alias("cid"), F.col("b").alias("pivot")))
    tied = tied.unionByName(tied.select(F.col("pivot").alias("cid"), "pivot").distinct())
    family = materialize(tied.groupBy("cid").agg(F.min("pivot").alias("family")))
    of_family = family.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    inside = spread_join(family, of_family.select("family", F.col("n").alias("size")), "family", hot_keys(of_family, "family"), "cid").where("size > 1").select("cid", (F.col("size") - 1).alias("links"))
    apart = verified.where("light")
    for side in ("a", "b"):
        apart = apart.join(family.select(F.col("cid").alias(side), F.col("family").alias(f"family_{side}")), side, "left")
    apart = apart.where("family_a is null or family_b is null or family_a <> family_b")

    # Each member is completed once; only then is it copied to its pairs of blocks.
    placed, meet = _blocks(heavy.select("bucket", "cid", "n").join(family, "cid", "left").withColumn("family", F.coalesce("family", F.lit(-1))), hot)
    per_block = placed.groupBy(F.struct("bucket", "block").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    meeting = spread_join(placed.withColumn("at", F.struct("bucket", "block")), meet.select(F.struct("bucket", "block").alias("at"), "pairs"), "at", hot_keys(per_block, "at"), "cid")
    whole = marks.select("cid", "heavy").join(sk.drop("n"), "cid").join(sets, "cid").join(family, "cid", "left").withColumn("family", F.coalesce("family", F.lit(-1)))
    bands_of = heavy.groupBy("bucket").agg(F.first("band").alias("band"))
    complete = spread_join(meeting.select("bucket", "cid", "block", "pairs"), bands_of, "bucket", hot, "cid").join(whole, "cid")
    dealt = complete.select("*", F.explode("pairs").alias("pair")).select("*", "pair.x", "pair.y").drop("pairs", "pair")
    dense = materialize(_heavy_links(dealt))
    edges = verified.select("a", "b").unionByName(dense.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    counts = (
        apart.select(F.explode(F.array("a", "b")).alias("cid"), F.lit(1).cast("long").alias("links"))
        .unionByName(inside)
        .unionByName(dense.where("links > 0").select("cid", "links"))
        .groupBy("cid")
        .agg(F.sum("links").alias("n_links"))
    )
    return base.select("doc_id", "row_key", "set_key"), classes.select("cid", "set_key", "first_id", "copies"), counts, edges


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, first_id, copies, n_links and group (a cid) of every row."""
    rows, classes, counts, edges = links(docs)
    groups = components(edges)
    per_class = classes.join(counts, "cid", "left").join(groups.withColumnRenamed("id", "cid"), "cid", "left").withColumn("group", F.coalesce("component", "cid"))
    return spread_join(rows, per_class, "set_key", hot_keys(classes.select("set_key", F.col("copies").alias("n")), "set_key"), "row_key")


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id with an equal shingle set), copies
    (documents in that class), n_links (other classes at 0.8 or more), group_id (smallest doc_id of
    the connected group)."""
    found = materialize(_grouped(docs))
    groups = found.groupBy("group").agg(F.min("first_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    named = spread_join(found, groups.drop("n"), "group", hot_keys(groups.select("group", "n"), "group"), "row_key")
    return named.select("doc_id", F.col("first_id").alias("class_id"), F.col("copies").cast("long").alias("copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one of smallest doc_id (a null id only if no other is there;
    of several texts under that id the one of smallest hash; of equal rows any)."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key"))
    first = _grouped(docs).groupBy("group").agg(best.alias("first")).select(F.col("first.row_key").alias("key"))
    key = fresh(docs, "row_key")[0]
    return docs.withColumn(key, _row_key()).join(first.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key]).select(docs.columns)
