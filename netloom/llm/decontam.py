"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, letters and digits only, single
spaces). An item of n characters may occur with up to k = floor(n * ERRORS)
edits. Split into k + 1 pieces, at least one piece must occur unchanged in any
such occurrence. One Aho-Corasick automaton finds the pieces of all items in a
pass over the whole text; a hit fixes where the item would lie, and Myers'
bit-parallel algorithm measures the edit distance of the item to the best
substring of that window. Hits of one item on overlapping windows are verified
once. Items under ``MIN_CHARS`` characters are too short to tell from prose
with edits in them: they must occur exactly (k = 0) and as whole words, except
in scripts without spaces, where any place will do.

The items travel in task closures, at most ``MAX_ITEM_CHARS`` at a time. A
larger set runs block by block: the driver reads one block, its search ends
and its hits lie in the shared folder before the next block is read, so that
neither the driver nor a task ever holds more than one block. Documents are
never shuffled; a worker builds the automaton of a block once.

Defined cases: null and empty texts match nothing; items without a letter or
digit match nothing; equal items are reported each under its own id; a null
item_id is reported as null, a null item text is left out; documents with a
null or repeated doc_id are searched like all others, row by row, and equal
rows give equal results; texts of any length are searched whole; an empty
table on either side gives no hit; ``remove`` keeps all columns, whatever
their names; of several best windows the first is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import slices, small_batches
from netloom.session import materialize

#: Edits allowed for each character of an item.
ERRORS = 0.08
MIN_CHARS = 40
#: Normalised characters of items in one automaton.
MAX_ITEM_CHARS = 4_000_000
#: Rows that a worker holds as Python strings at once.
ROWS = 512

_FOLD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_MARKS = re.compile(r"[^\w\x00-\x7f]+")
#: Scripts that are written without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana and Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str | None) -> str:
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()).decode()


def _whole_words(text: str, lo: int, hi: int) -> bool:
    """Whether text[lo:hi] starts and ends at the border of a word, or in a script without spaces."""
    return (lo == 0 or text[lo - 1] == " " or bool(_UNSPACED.match(text[lo]))) and (hi == len(text) or text[hi] == " " or bool(_UNSPACED.match(text[hi - 1])))


def best_match(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the first best approximate occurrence within ``limit`` edits (Myers 1999)."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, limit + 1, -1
    get = peq.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = (mh << 1 | ~(xv | ph)) & mask
        mv = ph & xv & mask
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return (best, end) if best <= limit else None


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], errors: float = ERRORS, min_chars: int = MIN_CHARS):
        self.min_chars = min_chars
        self.items = [(i, n, int(len(n) * errors) if len(n) >= min_chars else 0) for i, t in items if (n := normalise(t))]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for which, (_, text, k) in enumerate(self.items):
            for p in range(k + 1):
                lo, hi = p * len(text) // (k + 1), (p + 1) * len(text) // (k + 1)
                pieces.setdefault(text[lo:hi], []).append((which, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if len(self.automaton):
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item the merged windows in which it may lie."""
        out: dict[int, list[list[int]]] = {}
        if not len(self.automaton):
            return out
        for last, (size, places) in self.automaton.iter(text):
            start = last + 1 - size
            for which, offset in places:
                _, item, k = self.items[which]
                if len(item) < self.min_chars and not _whole_words(text, start, last + 1):
                    continue
                lo, hi = max(0, start - offset - k), min(len(text), start - offset + len(item) + k)
                spans = out.setdefault(which, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(lo, spans[-1][0]), max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        return out

    def search(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, edits, end, windows checked) for each item found, best window first."""
        text = normalise(text)
        for which, spans in sorted(self.windows(text).items()):
            item_id, item, k = self.items[which]
            best = None
            for lo, hi in spans:
                if hi - lo >= len(item) - k and (m := best_match(item, text[lo:hi], k)) and (best is None or m[0] < best[0]):
                    best = m[0], lo + m[1]
            if best:
                yield item_id, best[0], best[1], len(item)


#: The matcher of this worker process, by its items.
_matchers: dict[bytes, Matcher] = {}


def _matcher(key: bytes, block: list[tuple[int | None, str]]) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(block)
    return _matchers[key]


def _blocks(items: DataFrame) -> Iterator[tuple[bytes, list[tuple[int | None, str]]]]:
    """(digest, items) of at most MAX_ITEM_CHARS each, or of one longer item; none is empty but the only one."""
    block, size, made = [], 0, 0
    for r in items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        if block and size + len(r["text"]) > MAX_ITEM_CHARS:
            yield hashlib.sha256(repr(block).encode("utf-8", "replace")).digest(), block
            block, size, made = [], 0, made + 1
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block or not made:
        yield hashlib.sha256(repr(block).encode("utf-8", "replace")).digest(), block


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, item_chars, end_char (in the normalised text) of each item that a document contains."""
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(key, block) -> DataFrame:
        def run(batches):
            matcher = _matcher(key, block)
            for b in slices(batches, ROWS):
                rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in matcher.search(t)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[k], pa.int64()) for k in (0, 1, 2, 4, 3)], names=["doc_id", "item_id", "edits", "item_chars", "end_char"])

        return source.mapInArrow(run, "doc_id long, item_id long, edits long, item_chars long, end_char long")

    out, waiting = None, None
    for block in _blocks(items):  # a block is searched when the next one turns up; the last one, often the only one, is left to the caller
        if waiting is not None:
            done = materialize(waiting)
            out = done if out is None else out.unionByName(done)
        waiting = search(*block)
    return waiting if out is None else out.unionByName(waiting)


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains an item. Each row is judged by itself, whatever its id."""
    at = small_batches(docs).columns.index("text")

    def keep(key, block):
        def run(batches):
            matcher = _matcher(key, block)
            for b in slices(batches, ROWS):
                yield b.filter(pa.array([next(matcher.search(t), None) is None for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    waiting = None
    for block in _blocks(items):
        if waiting is not None:
            docs = materialize(docs.mapInArrow(waiting, docs.schema))
        waiting = keep(*block)
    return docs.mapInArrow(waiting, docs.schema)
