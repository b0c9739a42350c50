"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. The emission score of a line comes from
its own features (case, symbols, digits, word statistics, repetition) and from
those of its neighbours; transitions tie consecutive lines. Forward-backward
gives the marginal of each line, the marginals are averaged with the lines'
lengths as weights, and a logistic link calibrates the average to the document
label.

Line labels are not given, so fitting is in two rounds: first each line takes
its document's label, then the lines of bad documents that look good under the
first model are relabelled (the worst line stays bad) and the field is fitted
again. Fitting uses a bounded sample (``LABELLED_SAMPLE`` rows of the training
fold) on the driver; scoring is a map over whole texts without a shuffle.

Defined cases: a null or blank text has no line and gets the share of good
labels; without labels of both classes every score is that share (0.5 if there
are none); texts of any length are scored over all lines; repeated rows, and
rows of equal text, get equal scores whatever their id, also a null one; extra
columns are kept, except one of the output's name, which the caller chooses.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netloom.llm.common import slices, small_batches, training_rows, with_fields

THRESHOLD = 0.3
SEQUENCE = 64

_CLASS = bytearray(b"o" * 256)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = ord("u" if _s.isupper() else "l" if _s.islower() else "d" if _s.isdigit() else "s" if _s.isspace() else "p" if _s in ".,;:'\"-?()" else "x" if _c < 128 else "o")
_CLASS = bytes(_CLASS)

OWN = ("bias", "log_length", "upper", "digit", "mark", "symbol", "other", "word_length", "distinct", "repeated", "ends", "capital", "few_words", "one_letter", "long_word")
NEAR = ("upper", "symbol", "repeated", "distinct", "few_words")
_NEAR = [OWN.index(k) for k in NEAR]
WIDTH = len(OWN) + 2 * len(NEAR)


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()]


def line_features(lines: list[str]) -> np.ndarray:
    """One row a line: its own features, then those of the previous and of the next line."""
    own, seen = [], {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    for x in lines:
        classes = x.encode("latin-1", "replace").translate(_CLASS)
        n = len(classes)
        words = x.split()
        k = len(words)
        letters = classes.count(b"u") + classes.count(b"l")
        own.append((
            1.0, math.log1p(n) / 5, classes.count(b"u") / max(1, letters), classes.count(b"d") / n, classes.count(b"p") / n * 5, classes.count(b"x") / n * 5, classes.count(b"o") / n,
            n / k / 8, len(set(words)) / k, float(seen[x] > 1), float(x[-1] in ".!?:;\"'"), float(x[0].isupper()), float(k < 4), sum(len(w) == 1 for w in words) / k, float(max(map(len, words)) > 30),
        ))
    a = np.array(own, np.float64).reshape(-1, len(OWN))
    out = np.zeros((len(a), WIDTH))
    out[:, : len(OWN)] = a
    m = len(NEAR)
    out[1:, len(OWN) : len(OWN) + m] = a[:-1, _NEAR]
    out[:-1, len(OWN) + m :] = a[1:, _NEAR]
    return out


def marginals(z: list[float], stay: tuple[float, float, float, float]) -> list[float]:
    """P(good) of each line from the log odds of its emission and the transition weights (gg, gb, bg, bb)."""
    gg, gb, bg, bb = stay
    n = len(z)
    e = [math.exp(max(-30.0, min(30.0, v))) for v in z]
    fore = [0.0] * n
    g = 0.5
    for i in range(n):
        if i:
            up, down = (g * gg + (1 - g) * bg) * e[i], g * gb + (1 - g) * bb
        else:
            up, down = e[0], 1.0
        g = fore[i] = up / (up + down)
    out = [0.0] * n
    hg, hb = 1.0, 1.0  # messages from the right
    for i in range(n - 1, -1, -1):
        up, down = fore[i] * hg, (1 - fore[i]) * hb
        out[i] = up / (up + down)
        up, down = e[i] * hg, hb
        hg, hb = gg * up + gb * down, bg * up + bb * down
        s = hg + hb
        hg, hb = hg / s, hb / s
    return out


class Model:
    def __init__(self, weights: list[float], stay: tuple[float, float, float, float], link: tuple[float, float], prior: float):
        self.weights, self.stay, self.link, self.prior = np.array(weights), stay, link, prior

    def share(self, text: str | None) -> float | None:
        """Length-weighted mean of the lines' marginals."""
        lines = lines_of(text)
        if not lines:
            return None
        p = marginals((line_features(lines) @ self.weights).tolist(), self.stay)
        size = [len(x) for x in lines]
        return sum(a * b for a, b in zip(p, size, strict=True)) / sum(size)

    def probability(self, text: str | None) -> float:
        if not len(self.weights) or (s := self.share(text)) is None:
            return self.prior
        return _link(s, self.link)


def _link(share: float, link: tuple[float, float]) -> float:
    s = min(max(share, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, link[0] * math.log(s / (1 - s)) + link[1]))))


def _padded(seqs: list[tuple[np.ndarray, np.ndarray, float]]):
    n = len(seqs)
    x, y, m = np.zeros((n, SEQUENCE, WIDTH), np.float32), np.zeros((n, SEQUENCE), np.float32), np.zeros((n, SEQUENCE), np.float32)
    for i, (f, lab, w) in enumerate(seqs):
        x[i, : len(f)], y[i, : len(f)], m[i, : len(f)] = f, lab, w
    return x, y, m


def _fit_field(seqs, rounds: int = 120, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the labelled sequences by Adam; (emission weights, 2 x 2 log transitions)."""
    x, y, m = _padded(seqs)
    live = m > 0
    w, t = np.zeros(WIDTH), np.zeros((2, 2))
    state = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    pair = live[:, 1:]
    lab = y.astype(int)
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = (m[:, 1:] * pair * (lab[:, :-1] == a) * (lab[:, 1:] == b)).sum()
    total = m.sum()
    n, length = y.shape
    for k in range(1, rounds + 1):
        e = np.exp(np.clip(np.einsum("nld,d->nl", x, w), -30, 30))
        em = np.stack((np.ones_like(e), e), 2)  # state 0 bad, 1 good
        tr = np.exp(t)
        al, be = np.zeros((n, length, 2)), np.ones((n, length, 2))
        al[:, 0] = em[:, 0] / em[:, 0].sum(1, keepdims=True)
        for i in range(1, length):
            v = (al[:, i - 1] @ tr) * em[:, i]
            al[:, i] = np.where(live[:, i : i + 1], v / v.sum(1, keepdims=True), al[:, i - 1])
        for i in range(length - 2, -1, -1):
            v = (em[:, i + 1] * be[:, i + 1]) @ tr.T
            be[:, i] = np.where(live[:, i + 1 : i + 2], v / v.sum(1, keepdims=True), 1.0)
        p = al * be
        p /= p.sum(2, keepdims=True)
        gw = np.einsum("nld,nl->d", x, (p[:, :, 1] - y) * m) / total + 1e-4 * w
        xi = al[:, :-1, :, None] * tr[None, None] * (em[:, 1:] * be[:, 1:])[:, :, None, :]
        xi /= xi.sum((2, 3), keepdims=True)
        gt = ((xi * (m[:, 1:] * pair)[:, :, None, None]).sum((0, 1)) - seen) / total + 1e-4 * t
        g = np.concatenate((gw, gt.ravel()))
        state[0], state[1] = 0.9 * state[0] + 0.1 * g, 0.99 * state[1] + 0.01 * g * g
        step = rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        w, t = w - step[:WIDTH], t - step[WIDTH:].reshape(2, 2)
    return w, t


def fit(rows: list[tuple[str, int]]) -> Model:
    labels = [y for _, y in rows]
    prior = sum(labels) / len(labels) if labels else 0.5
    if not labels or not 0 < prior < 1:
        return Model([], (1, 1, 1, 1), (1.0, 0.0), prior)
    made = [(line_features(ls), y, [len(x) for x in ls]) for t, y in rows if (ls := lines_of(t))]
    balance = (0.5 / prior, 0.5 / (1 - prior))

    def sequences(target):
        return [(f[i : i + SEQUENCE], lab[i : i + SEQUENCE], balance[0] if y else balance[1]) for (f, y, _), lab in zip(made, target, strict=True) for i in range(0, len(f), SEQUENCE)]

    target = [np.full(len(f), float(y)) for f, y, _ in made]
    for round_ in range(2):
        w, t = _fit_field(sequences(target))
        tr = np.exp(t)
        stay = (float(tr[1, 1]), float(tr[1, 0]), float(tr[0, 1]), float(tr[0, 0]))
        if round_ == 0:
            for k, (f, y, _) in enumerate(made):
                if not y:
                    p = np.array(marginals((f @ w).tolist(), stay))
                    target[k] = (p > 0.6).astype(float)
                    target[k][p.argmin()] = 0.0
    shares = np.array([sum(a * b for a, b in zip(marginals((f @ w).tolist(), stay), size, strict=True)) / sum(size) for f, _, size in made])
    s = np.clip(shares, 1e-4, 1 - 1e-4)
    x, y = np.stack((np.log(s / (1 - s)), np.ones(len(s))), 1), np.array([v for _, v, _ in made], float)
    b = np.array([0.5, 0.0])
    for _ in range(60):  # calibration by Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b - np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(2), x.T @ (p - y) + 0.05 * b)
    return Model(w.tolist(), stay, (max(0.05, float(b[0])), float(b[1])), prior)


def fit_tables(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(training_rows(docs, labels, "quality"))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``df`` with the probability that its label is 1."""
    rest = df.drop(out)
    at = rest.columns.index(text)

    def run(batches):
        for b in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.probability(t) for t in b.column(at).to_pylist()], pa.float64())], names=[*b.schema.names, out])

    return small_batches(rest).mapInArrow(run, with_fields(rest, **{out: "double"}))
