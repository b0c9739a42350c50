"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents dropped, homoglyphs of other
scripts and full-width forms mapped to Latin letters, digit and symbol
substitutions undone (one class for i, l, 1, ! and |). One automaton then finds
every lexicon stem that begins a word, or lies anywhere in a script without
spaces, and every short word that stands alone; hits inside an exception phrase
do not count. The weights of the hits are summed, normalised by the number of
words, and a logistic link turns both figures into a probability.

The lexicon is learnt: word beginnings, and whole words of two or three
letters, that stand out in far more toxic training documents than others, by a
binomial tail that allows for the number of beginnings tried. Some words are
toxic wherever they occur; beginnings that ordinary words share have a usual
rate, learnt from the documents that have them and are not toxic, and count
only in a text in which they are clearly more frequent than that.
Exception phrases are learnt from
the same rows: neighbour pairs with a stem that occur in several documents
that are not toxic and in no toxic one. Fitting uses a bounded sample
(``per_class`` rows of each label); scoring is a map over whole texts without
a shuffle.

Defined cases: a null or empty text has no hits and gets the score of a text
without hits; without labels of both classes every score is 0 (nothing was
learnt); texts of any length are read whole; repeated rows, and rows of equal
text, get equal scores whatever their id; extra columns are kept, and an output
column that the table already has is replaced only where the caller names it.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import held_out, sample_texts, slices, small_batches, with_fields

#: Rows of each label, at most, that the lexicon is learnt from.
POSITIVE_ROWS, NEGATIVE_ROWS = 1500, 4500
#: Lengths of the word beginnings that may become stems.
STEMS = range(4, 11)
#: How often a stem occurs in a document, at least, to be looked at closely.
OFTEN = (1, 2, 3)
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l"}
# Digits and symbols written in place of letters.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"


def _table() -> dict[int, str]:
    table = {ord(a): b for a, b in HOMOGLYPHS.items()}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        if code not in table and base.isascii() and base != chr(code):
            table[code] = base.lower()
    table |= dict.fromkeys(map(ord, INVISIBLE), "") | {c: "" for c in range(0x300, 0x370)}
    for code, base in list(table.items()):
        table[code] = "".join(SUBSTITUTIONS.get(c, c) for c in base)
    return table | {ord(a): b for a, b in SUBSTITUTIONS.items()}


FOLD = _table()
FOLD_BYTES = bytes(ord(FOLD.get(c, chr(c).lower()) if c < 128 else "?") for c in range(256))
WORD = re.compile(r"[^\W_]+")
#: Scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
#: A symbol is a substitution only inside a word; at its end it is punctuation.
EDGE = re.compile(r"[!|$@]+(?![^\W_])")


def fold(text: str) -> str:
    """The folded form that stems, phrases and texts are compared in."""
    if "!" in text or "$" in text or "|" in text or "@" in text:
        text = EDGE.sub(" ", text)
    if text.isascii():
        return text.encode().translate(FOLD_BYTES).decode()
    return text.lower().translate(FOLD)


def _tail(k: int, n: int, p: float) -> float:
    """log10 of the Chernoff bound on P(Binomial(n, p) >= k)."""
    q = k / n
    if q <= p:
        return 0.0
    d = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return -n * d / math.log(10)


def _copy_keys(text: str) -> set[tuple[int, int]]:
    """Three MinHash values of the text's runs of four words; near copies share one almost surely."""
    words = text.split()
    h = np.array([zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))], np.uint64)
    return {(k, int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))}


def _beginnings(folded: str) -> Counter:
    """How often each stem that a text offers begins a word: beginnings of words, and short words followed by a space."""
    found = Counter()
    for w, k in Counter(WORD.findall(folded)).items():
        for n in STEMS:
            if len(w) < n:
                break
            found[w[:n]] += k
        if 2 <= len(w) < STEMS.start:
            found[w + " "] += k
    return found


def _words(folded: str) -> int:
    return folded.count(" ") + folded.count("\n") + 1


def stands_out(count: int, words: int, rate: float) -> bool:
    """Whether a stem occurs more often than chance lets it in ``words`` words at its rate in texts that are not toxic."""
    usual = rate * words
    return count > 0 and count >= usual + 2 * math.sqrt(usual)


def _odds(a: int, b: int, n: list[int]) -> float:
    return math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))


def learn_lexicon(rows: list[tuple[str, int]]) -> dict[str, tuple[float, float]]:
    """Stem -> (weight, rate): log odds of the documents in which it stands out, and its usual rate.

    A first pass finds stems that tell by occurring once, twice or three times;
    a second one takes for each its rate in the documents that have it and are
    not toxic, and counts the documents in which it stands out from that.
    """
    n, seen, texts = [0, 0], set(), []
    df = {(y, least): Counter() for y in (0, 1) for least in OFTEN}
    for text, y in rows:
        keys = _copy_keys(text)
        if not seen.isdisjoint(keys):
            continue  # copies would count one author's words many times
        seen.update(keys)
        n[y] += 1
        texts.append((text, y))
        found = _beginnings(fold(text))
        for least in OFTEN:
            df[y, least].update([s for s, k in found.items() if k >= least])
    if not n[0] or not n[1]:
        return {}
    share, tried = n[1] / (n[0] + n[1]), [(s, least) for least in OFTEN for s, a in df[1, least].items() if a + df[0, least][s] >= 3]
    needed = math.log10(0.01 / max(1, len(tried)))
    likely = {s for s, least in tried if _tail(a := df[1, least][s], a + df[0, least][s], share) <= needed}

    counts, rate = [], dict.fromkeys(likely, (0, 0))
    for text, y in texts:
        folded = fold(text)
        found, words = {s: k for s, k in _beginnings(folded).items() if s in likely}, _words(folded)
        counts.append((y, words, found))
        if not y:
            for s, k in found.items():
                rate[s] = (rate[s][0] + k, rate[s][1] + words)
    rate = {s: k / w if w else 0.0 for s, (k, w) in rate.items()}
    out = [Counter(), Counter()]
    for y, words, found in counts:
        out[y].update([s for s, k in found.items() if stands_out(k, words, rate[s])])
    odds, count = {}, {}
    for s in likely:
        a, b = out[1][s], out[0][s]
        if a and (w := _odds(a, b, n)) >= 2.5 and _tail(a, a + b, share) <= needed:
            odds[s], count[s] = w, a
    # Of nested stems the shorter goes where one longer is as frequent, and the longer where the shorter is as telling.
    for s in sorted(odds, key=len):
        if any(count.get(x, 0) >= 0.95 * count[s] for x in odds if len(x) > len(s) and x.startswith(s)):
            count[s] = 0
    odds = {s: w for s, w in odds.items() if count[s]}
    return {s: (w, rate[s]) for s, w in odds.items() if not any(odds.get(s[:k], -9) >= w - 1 for k in range(STEMS.start, len(s)))}


class Matcher:
    """One automaton over stems (stem -> weight and usual rate) and exception phrases."""

    def __init__(self, lexicon: dict[str, tuple[float, float]], exceptions: list[str] = ()):
        self.stems = list(lexicon.values())
        self.automaton = ahocorasick.Automaton()
        for k, s in enumerate(lexicon):
            self.automaton.add_word(s, (len(s), k))
        for p in exceptions:
            if p and p not in lexicon:
                self.automaton.add_word(p, (len(p), -1))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, int]]:
        """(start, end, number of the stem), without those that an exception phrase covers."""
        if not len(self.automaton):
            return []
        found, spared = [], []
        for last, (size, k) in self.automaton.iter(folded + " "):
            start = last + 1 - size
            if start and folded[start - 1].isalnum() and not UNSPACED.match(folded[start]):
                continue
            (spared if k < 0 else found).append((start, last + 1, k))
        if spared:
            spared.sort()
            starts, ends = [a for a, _, _ in spared], list(accumulate((b for _, b, _ in spared), max))
            found = [h for h in found if not (k := bisect_right(starts, h[0])) or ends[k - 1] < h[1]]
        return found

    def figures(self, text: str) -> tuple[float, int, int]:
        """Sum of weights and number of the hits whose stem stands out, number of words."""
        folded = fold(text)
        words = _words(folded)
        counts = {s: k for s, k in Counter(k for _, _, k in self.hits(folded)).items() if stands_out(k, words, self.stems[s][1])}
        return sum(k * self.stems[s][0] for s, k in counts.items()), sum(counts.values()), words


def features(weight: float, hits: int, words: int) -> list[float]:
    return [1.0, math.log1p(weight), math.log1p(100 * weight / words), float(hits > 0)]


def _learn_exceptions(rows: list[tuple[str, int]], matcher: Matcher) -> list[str]:
    seen = [Counter(), Counter()]
    for text, y in rows:
        folded, pairs = fold(text), set()
        for start, end, _ in matcher.hits(folded):
            before = re.search(r"([^\W_]+)\W+$", folded[max(0, start - 40) : start])
            after = re.match(r"[^\W_]*(?:[^\S\n]|-)([^\W_]+)", folded[end : end + 60])
            word = re.match(r"[^\W_]*", folded[start : start + 60])[0]
            if before:
                pairs.add(f"{folded[max(0, start - 40) : start][before.start():]}{word}")
            if after:
                pairs.add(folded[start:end] + after[0])
        seen[y].update(pairs)
    return sorted(p for p, k in seen[0].items() if k >= 5 and not seen[1][p])


class Model:
    """Lexicon, exceptions and link; small enough to travel with the tasks."""

    def __init__(self, lexicon: dict[str, tuple[float, float]], exceptions: list[str], link: list[float]):
        self.lexicon, self.exceptions, self.link = lexicon, exceptions, link

    def matcher(self) -> Matcher:
        return Matcher(self.lexicon, self.exceptions)

    def probability(self, weight: float, hits: int, words: int) -> float:
        if not self.lexicon:
            return 0.0
        z = sum(a * b for a, b in zip(self.link, features(weight, hits, words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[str, int]], prior: float | None = None, exceptions: list[str] = ()) -> Model:
    """Learn from (text, 0/1) rows; ``prior`` is the share of 1 among all labels, if the rows are not in proportion."""
    lexicon = learn_lexicon(rows)
    if not lexicon:
        return Model({}, list(exceptions), [0.0] * 4)
    phrases = sorted({fold(p) for p in exceptions} | set(_learn_exceptions(rows, Matcher(lexicon))))
    m = Matcher(lexicon, phrases)
    x, y = np.array([features(*m.figures(t)) for t, _ in rows]), np.array([v for _, v in rows], float)
    share = y.mean()
    prior = share if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    b = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.1 * b
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(len(b)), grad)
        b -= step
        if abs(step).max() < 1e-6:
            break
    return Model(lexicon, phrases, b.tolist())


def fit_tables(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE_ROWS, negatives: int = NEGATIVE_ROWS) -> Model:
    """Fit on at most ``positives`` toxic and ``negatives`` other labelled rows of the training fold."""
    train = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    ids = None
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    for y, limit in ((1, positives), (0, negatives)):
        part = train.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        ids = part if ids is None else ids.unionByName(part)
    picked = sample_texts(docs).join(F.broadcast(ids), "doc_id")
    rows = [(r["text"], r["y"]) for r in picked.dropDuplicates(["doc_id", "text"]).limit(positives + negatives).collect()]
    rows.sort()
    total = sum(counts.values())
    return fit(rows, counts.get(1, 0) / total if total else None)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity", hits: str | None = "toxic_hits", weight: str | None = "toxic_weight") -> DataFrame:
    """``df`` with columns for the score, the number of hits and the sum of their weights (None: left out)."""
    new = [(c, t, k) for c, t, k in ((out, "double", 0), (hits, "long", 1), (weight, "double", 2)) if c]
    rest = df.drop(*(c for c, _, _ in new))
    at = rest.columns.index(text)
    schema = with_fields(rest, **{c: t for c, t, _ in new})
    kinds = {"double": pa.float64(), "long": pa.int64()}

    def run(batches):
        matcher = model.matcher()
        for b in slices(batches, 512):
            figures = [matcher.figures(t or "") for t in b.column(at).to_pylist()]
            made = ([model.probability(*f) for f in figures], [f[1] for f in figures], [f[0] for f in figures])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(made[k], kinds[t]) for _, t, k in new)], names=[*b.schema.names, *(c for c, _, _ in new)])

    return small_batches(rest).mapInArrow(run, schema)
