"""Personal data and secrets: candidate spans scored by gradient-boosted trees.

Base rules find e-mail addresses, IPv4 addresses, payment cards and
international phone numbers; their spans always stay. High-recall generators
propose further, possibly overlapping spans (addresses that are spelled out, in
any case of letters, or have a single label, IPv6 addresses in full or with a
``::``, national phone numbers, card-like digit groups, and tokens and assigned
values that may be secrets). Boosted trees score every proposal from features
of its format and of the text around it; the score is calibrated, and proposals
at or above their kind's threshold that overlap no base span and no better
proposal are added; of such proposals of one kind, one that lies inside another
is a part of it.

All work on documents is DataFrame expressions inside one projection: no
shuffle, no Python on executors. The trees are fitted on the driver from
``TRAINING_TEXTS`` texts of a seeded grammar (a fixed bound, independent of the
data) in which the places of true spans are known: the generators and features
that run on documents run on these texts, so a training row is a proposal as it
turns up, with its overlaps, and its label says whether it is exactly a true
span. The trees become CASE expressions over the features that they use.

Matches are located without searching: the text split at a pattern and the
pattern's matches alternate, so positions are running sums of lengths, taken
chunk by chunk. The patterns are the given ones with possessive repeats and a
test that a match does not start inside a run, which keeps the matches and
makes long runs take linear time. Positions are code points, ends exclusive.
Proposals are matches of a lookahead at every place where one can start, so
none hides another; of digit groups, each beginning that ends with a group is a
proposal too. What is added is settled in one sweep over base spans and
proposals in the order of their starts.

Defined cases: null and empty texts have no spans; texts of any length are
read whole; equal rows get equal results, rows with null or repeated ids are
rows like all others; extra columns are kept, whatever their names, except
where the caller names an output column that is there already.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import fresh, let

#: Kinds of the base rules, and what proposals can be besides.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
TRAINING_TEXTS = 2000
PRECISION = 0.97

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: " At " behind a full stop begins a sentence, so that form is proposed in lower case only.
_HEX = "[0-9A-Fa-f]{1,4}"
_SHORT_IP = "|".join([rf"::{_HEX}(?::{_HEX}){{0,6}}", *(rf"(?:{_HEX}:){{{i}}}:(?:{_HEX}(?::{_HEX}){{0,{6 - i}}})?" for i in range(1, 7)), rf"(?:{_HEX}:){{7}}:"])
_ASSIGNED = r"(?i:key|token|secret|passwd|password|passphrase|pwd|bearer|auth)[\"'\x20]{0,2}[:=]{0,2}[>\x20]{0,2}[\"'`]{0,1}"
GENERATORS = {
    "email": rf"{_LOCAL}++(?:@|(?i:\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?)|\x20at\x20|(?<!\.)(?i:\x20at\x20))[A-Za-z0-9-]++(?:(?:\.|(?i:\x20?(?:\(dot\)|\[dot\]|\{{dot\}})\x20?|\x20dot\x20))[A-Za-z0-9-]++)*+",
    "ip": rf"(?:(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Fa-f:])|(?<![0-9A-Za-z])(?:{_SHORT_IP})(?![0-9A-Za-z:]))",
    "card": r"[0-9](?:[\x20./-]{0,3}[0-9]){11,22}+",
    "secret": rf"(?:(?<={_ASSIGNED})[^\s\"'`,;<>]{{6,200}}+|(?=[A-Za-z+/_-]{{0,60}}[0-9])[A-Za-z0-9+/_-]{{20,200}}+={{0,2}}(?![A-Za-z0-9+/_-]))",
    "phone": r"(?:00[1-9]|\(?[0-9]{2,5}\)?[\x20./-]{1,2})[0-9][0-9\x20()./-]{4,16}[0-9](?![0-9A-Za-z])",
}
#: What must hold where a proposal starts; proposals start at all such places, whether or not they overlap.
STARTS = {"email": rf"(?<!{_LOCAL})", "ip": r"(?<![0-9A-Fa-f:])", "card": r"(?<![0-9])", "phone": r"(?<![0-9A-Za-z+])", "secret": r"(?<![A-Za-z0-9+/_=-])"}
#: Where proposals of digit groups may also end: a phone number before a space only, a card, which has a check digit, before any separator.
GROUPED = {"card": r"(?<=[0-9])(?=[^0-9])", "phone": r"(?<=[0-9])(?=\x20)"}
#: Cheap test that a text can hold a match at all.
NEEDS = {"email": r"@|(?i)\bat\b|\(at\)|\[at\]|\{at\}", "ip": r":[0-9A-Fa-f]{0,4}:", "card": r"[0-9]", "phone": r"[0-9]", "secret": r"[A-Za-z0-9+/_-]{20}|(?i)key|token|secret|passw|passph|pwd|bearer|auth"}
CUES = {
    "email": r"(?i)(mail|contact|write|reach)",
    "ip": r"(?i)(\bip\b|host|server|addr|login)",
    "card": r"(?i)(card|visa|master|credit|pay|iban|account)",
    "secret": r"(?i)(key|token|secret|passw|pwd|bearer|credential|auth)",
    "phone": r"(?i)(tel|phone|call|fax|mobil|cell|whatsapp|dial|ring)",
}
AGAINST = r"(?i)(order|invoice|isbn|issn|version|serial|ref|no\.|item|id|part|page|ticket|date|commit|sha[0-9]*|hash|build|digest|checksum)\W{0,4}$"
CONTEXT = 24
#: Pieces of text before a proposal that its context is taken from.
PIECES = 6

FEATURES = ("digits", "length", "separators", "distinct", "luhn", "cue", "against", "spelled", "parens", "year", "dots", "labels", "upper", "lower", "hex", "assigned", "known", "digit_before", "digit_after", "colons", "first_zero", "space_at")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _base_ok(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    return F.length(_digits(m)).between(10, 15)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def running(a: Column) -> Column:
    """Prefix sums of an array of integers: chunks of about the root of its size are summed, then continued from the sums before them."""

    def whole(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        chunks = let(width, lambda w: F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / w).cast("int")), lambda k: F.slice(a, k * w + 1, w)))

        def inside(chunks: Column, totals: Column) -> Column:
            heads = F.transform(totals, lambda _, k: _sum(F.slice(totals, F.lit(1), k)))
            return F.flatten(F.zip_with(chunks, heads, lambda c, h: F.transform(c, lambda _, j: h + _sum(F.slice(c, F.lit(1), j + 1)))))

        return let(chunks, lambda c: let(F.transform(c, _sum), lambda t: inside(c, t)))

    return let(a, lambda a: F.when(F.size(a) == 0, a).otherwise(whole(a)))


def _located(text: Column, pattern: str, made, keep) -> Column:
    """Array of ``made(start, end)`` for the matches that ``keep(match)`` lets stay."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(arrays: Column) -> Column:
        ends = running(F.transform(arrays["m"], lambda m, i: F.length(arrays["p"][i]) + F.length(m)))
        rows = F.filter(F.zip_with(arrays["m"], ends, lambda m, e: F.struct(m.alias("m"), e.alias("e"))), lambda r: keep(r["m"]))
        return F.transform(rows, lambda r: made(r["e"] - F.length(r["m"]), r["e"]))

    return let(F.struct(matches.alias("m"), pieces.alias("p")), placed)


def _proposed(text: Column, kind: str, scored, keep=None) -> Column:
    """Array of ``scored(start, end, before, match, after)`` that ``keep`` lets stay, of all proposals, overlapping or not.

    A lookahead matches nothing by itself, so a match starts wherever one can. The
    text is split behind a line feed, since a split at its very start leaves no piece.
    """
    pattern = rf"{STARTS[kind]}(?=({GENERATORS[kind]})((?s:.{{0,{CONTEXT}}})))"
    matches, afters = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pieces = F.split(F.concat(F.lit("\n"), text), pattern, -1)

    def ends(m: Column) -> Column:
        if kind not in GROUPED:
            return F.array(m)
        parts = F.split(m, GROUPED[kind], -1)
        shorter = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ""))
        return F.filter(shorter, lambda s: (s == m) | s.rlike(rf"\A(?:{GENERATORS[kind]})\z"))

    def placed(arrays: Column) -> Column:
        starts = running(F.transform(arrays["m"], lambda _, i: F.length(arrays["p"][i])))
        return let(starts, lambda begins: all_of(arrays, begins))

    def all_of(arrays: Column, starts: Column) -> Column:
        def at(m: Column, i: Column) -> Column:
            first = F.greatest(i - PIECES, F.lit(0))
            before = F.right(F.array_join(F.slice(arrays["p"], first + 1, i - first + 1), ""), F.lit(CONTEXT))

            def one(e: Column, x: Column) -> Column:
                after = F.left(F.concat(F.substring(m, F.length(e) + 1, F.length(m)), arrays["a"][i]), F.lit(CONTEXT))
                return scored(x["s"], x["s"] + F.length(e), x["b"], e, after)

            return let(F.struct((starts[i] - 1).alias("s"), before.alias("b")), lambda x: F.transform(ends(m), lambda e: one(e, x)))

        made = F.flatten(F.transform(arrays["m"], at))
        return F.filter(made, keep) if keep else made

    return let(F.struct(matches.alias("m"), afters.alias("a"), pieces.alias("p")), placed)


def _span(rank: int, start: Column, end: Column, score: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), score.alias("score"))


def _no_spans() -> Column:
    return F.filter(F.array(_span(0, F.lit(0), F.lit(0), F.lit(1.0))), lambda _: F.lit(False))


def base_spans(text: Column) -> Column:
    """Sorted array<struct<start, rank, end, score>> of the base rules' matches in a text that is not null."""
    parts = []
    for rank, kind in enumerate(BASE_KINDS):
        found = _located(text, BASE[kind], lambda s, e, rank=rank: _span(rank, s, e, F.lit(1.0)), lambda m, kind=kind: _base_ok(kind, m))
        parts.append(F.when(text.rlike(BASE[kind]), found).otherwise(_no_spans()))
    return F.array_sort(F.concat(*parts))


def features(kind: str, before: Column, m: Column, after: Column) -> dict[str, Column]:
    """The columns of FEATURES as doubles."""
    d = _digits(m)
    near = F.concat_ws(" ", before, after)
    count = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
    made = {
        "digits": F.length(d),
        "length": F.length(m),
        "separators": count(r"\x20./-"),
        "distinct": F.size(F.array_distinct(F.split(d, ""))),
        "luhn": F.when(F.length(d).between(12, 23), luhn(d)).otherwise(False).cast("int"),
        "cue": near.rlike(CUES[kind]).cast("int"),
        "against": before.rlike(AGAINST).cast("int"),
        "spelled": m.rlike(r"(?i)[(\[{]|\x20(at|dot)\x20").cast("int"),
        "parens": m.rlike(r"\([0-9]{2,5}\)").cast("int"),
        "year": m.rlike(r"(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)").cast("int"),
        "dots": count(".") + F.when(m.rlike(r"(?i)[(\[{]dot[)\]}]|\x20dot\x20"), 1).otherwise(0),
        "labels": F.size(F.split(m, r"[\x20./-]+")),
        "upper": count("A-Z"),
        "lower": count("a-z"),
        "hex": m.rlike(r"\A[0-9A-Fa-f]+\z").cast("int"),
        "assigned": before.rlike(rf"(?i:key|token|secret|passwd|password|passphrase|pwd|bearer|auth)[\"'\x20]{{0,2}}[:=][>\x20]{{0,2}}[\"'`]?\z").cast("int"),
        "known": m.rlike(r"\A(AKIA|ASIA|ghp_|gho_|sk-|sk_live|pk_live|xox[abp]-|eyJ|AIza|glpat-)").cast("int"),
        "digit_before": before.rlike(r"[0-9][\x20()./-]{0,2}\z").cast("int"),
        "digit_after": after.rlike(r"\A[\x20()./-]{0,2}[0-9]").cast("int"),
        "colons": count(":"),
        "first_zero": m.rlike(r"\A\(?0").cast("int"),
        "space_at": m.rlike(r"(?i)[^)\]}]\x20at\x20").cast("int"),
    }
    return {k: v.cast("double") for k, v in made.items()}


class Trees:
    """Logistic gradient boosting with small trees, and a calibrated threshold."""

    def __init__(self, rounds: int = 24, rate: float = 0.3, depth: int = 3):
        self.rounds, self.rate, self.depth = rounds, rate, depth

    def _grow(self, x, g, h, rows, depth):
        value = -g[rows].sum() / (h[rows].sum() + 1.0) * self.rate
        if depth == 0 or len(rows) < 20:
            return float(value)
        best = (1e-6, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            col = x[rows, f]
            for cut in np.unique(np.quantile(col, np.linspace(0.05, 0.95, 13))):
                left = col <= cut
                if left.any() and not left.all():
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total
                    if gain > best[0]:
                        best = (gain, (f, float(cut), left))
        if best[1] is None:
            return float(value)
        f, cut, left = best[1]
        return f, cut, self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1)

    def _value(self, node, x):
        if isinstance(node, float):
            return np.full(len(x), node)
        f, cut, a, b = node
        return np.where(x[:, f] <= cut, self._value(a, x), self._value(b, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._value(t, x) for t in self.trees)

    def fit(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Trees:
        fold = np.arange(len(x)) % 4 == 0
        tx, ty = x[~fold], y[~fold]
        p0 = min(max(ty.mean(), 1e-3), 1 - 1e-3)
        self.bias, self.trees = float(np.log(p0 / (1 - p0))), []
        f = np.full(len(tx), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(tx, p - ty, p * (1 - p), np.arange(len(tx)), self.depth)
            self.trees.append(tree)
            f = f + self._value(tree, tx)
        m, v = self.margin(x[fold]), y[fold]
        a, b = 1.0, 0.0  # Platt's scaling on the held-out fold
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * m + b)))
            a, b = a - 0.05 * ((p - v) * m).mean(), b - 0.05 * (p - v).mean()
        self.scale, self.shift = float(a), float(b)
        p = 1 / (1 + np.exp(-(a * m + b)))
        order = np.argsort(-p)
        right = np.cumsum(v[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        self.threshold = float(max(0.5, p[order[good[-1]]])) if len(good) else 1.1
        return self

    @property
    def used(self) -> list[str]:
        """The features that some tree asks for."""

        def asked(node) -> set[int]:
            return set() if isinstance(node, float) else {node[0]} | asked(node[2]) | asked(node[3])

        return [FEATURES[k] for k in sorted(set().union(*map(asked, self.trees)))] or [FEATURES[0]]

    def column(self, x: dict[str, Column]) -> Column:
        cols = [x.get(k) for k in FEATURES]

        def node(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(cols[t[0]] <= t[1], node(t[2])).otherwise(node(t[3]))

        total = F.lit(self.bias)
        for t in self.trees:
            total = total + node(t)
        return 1 / (1 + F.exp(-(total * self.scale + self.shift)))


def training_texts(n: int = TRAINING_TEXTS, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, true spans as (kind, start, end)) from a seeded grammar: forms that people write, and look-alikes, between words."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[r.integers(len(xs))]
    num = lambda k: "".join(str(v) for v in r.integers(0, 10, k))
    word = lambda lo=2, hi=9: "".join(pick(*"abcdefghiklmnoprstuvwz") for _ in range(r.integers(lo, hi)))
    case = lambda x: pick(x, x, x.upper(), x.capitalize())
    hexes = lambda k: "".join(pick(*"0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(pick(*"ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k))
    chance = lambda p: r.random() < p

    def card(ok: bool) -> str:
        d = [int(c) for c in pick("4", "5", "37", "60") + num(14)][:15]
        s = sum((c * 2 - 9 * (c > 4)) if i % 2 == 0 else c for i, c in enumerate(reversed(d)))
        return "".join(map(str, d)) + str((-s + (0 if ok else r.integers(1, 10))) % 10)

    def in_fours(d: str, sep: str) -> str:
        return sep.join((d[:4], d[4:8], d[8:12], d[12:]))

    def email() -> tuple[str, str]:
        user = f"{word()}{pick('', '.' + word(), num(2), '_' + word())}"
        at, dot = pick(" (at) ", "(at)", " [at] ", "[at]", " {at} ", " at "), pick(" (dot) ", "[dot]", "(dot)", " dot ", ".")
        end = pick("com", "org", "net", "de", "fr", "es", "edu", word(2, 4))
        if at == " at " and dot == ".":
            return f"{pick('mail', 'email', 'contact', 'write to', 'reach', 'e-mail:')} ", f"{user} at {word(4)}.{end}"
        if chance(0.1):
            return f"{pick('mail', 'email', 'contact', 'login')} ", f"{user}@{pick('localhost', word(4))}"
        body = f"{user}{case(at)}{word(3)}{case(dot)}{end}"
        return (f"{pick('mail', 'e-mail:', 'contact', 'reach me at', 'write to')} " if chance(0.6) else ""), body

    def not_email() -> tuple[str, str]:
        fore = pick("", "", "", "", "mail ", "write ", "contact ", "reach ")
        a, b, c = word(2, 16), word(2, 16), word(2, 16)
        return fore, pick(f"{a} at {b}", f"{a} at {b}", f"{a} at {b}. ", f"{a}at at {b}", f"{a} {c} at {b} {word()}", f"{a} at {b}. {c.capitalize()}", f"{a} looked at {b} at {c}", f"@{b}", f"{a} @ {b}", f"{a} at {num(2)}.{num(2)}", f"At {b}", f"{a.capitalize()} At {b}", f"{a} dot {b}")

    def ip() -> tuple[str, str]:
        groups = [f"{v:x}" for v in r.integers(0, 65536, 8)]
        head = ":".join(groups[: r.integers(1, 5)])
        m = pick(":".join(groups), f"{pick('2001', 'fe80', '2a02', groups[0])}:{head}::{':'.join(groups[5 : r.integers(6, 9)])}", f"{pick('fe80', '2001:db8', groups[0])}::{r.integers(1, 256):x}")
        return (f"{pick('ip', 'host', 'server', 'addr', 'address:', 'from')} " if chance(0.6) else ""), m

    def not_ip() -> tuple[str, str]:
        only = "".join(pick(*"abcdef") for _ in range(r.integers(1, 5)))
        return "", pick(f"{only}::{word(1, 4)}", f"{word()}::{word()}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(2)}::{num(2)}", f"std::{word()}", f"::{num(1)}", ":".join(num(2) for _ in range(8)), f"{only}::", f"{only}::{only}")

    def a_card() -> tuple[str, str]:
        return (f"{pick('card', 'visa', 'credit card', 'pay with', 'card no.')} " if chance(0.7) else ""), in_fours(card(True), pick(".", "/", "  ", ". ", " - "))

    def not_card() -> tuple[str, str]:
        m = pick(card(False), num(13), num(20), in_fours(card(False), "."), in_fours(card(False), " "), "-".join(("978", num(1), num(4), num(4), num(1))))
        return (f"{pick('order', 'invoice', 'isbn', 'serial no.', 'account')} " if chance(0.5) else ""), m

    def phone() -> tuple[str, str]:
        sep = pick(" ", "-", ".", "/")
        m = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(3)}{pick(' ', '-', '/')}{num(7)}", f"00{pick('1', '44', '49', '33')} {num(3)} {num(7)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"({pick('0', '')}{num(3)}) {num(6)}", f"{num(3)} {num(3)} {num(3)}")
        sure = m.startswith(("(", "00"))
        return (f"{pick('call', 'phone', 'tel.', 'tel:', 'mobile', 'fax', 'whatsapp', 'ring', 'phone number')} " if not sure or chance(0.6) else ""), m

    def not_phone() -> tuple[str, str]:
        year = pick("19", "20") + num(2)
        m = pick(f"{year}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{year}", f"{num(3)} {num(3)} {num(3)}", f"{num(4)}-{num(4)}", f"{num(3)}-{num(10)}", f"{num(2)}/{num(2)}/{year}", f"{num(3)}.{num(3)}.{num(3)}.{num(3)}", f"{num(2)} {num(3)} {num(3)}", f"{year}-{year}", f"{num(2)}.{num(3)}.{num(3)}", f"pp. {num(3)}-{num(3)} {num(4)}")
        return (f"{pick('order', 'invoice', 'version', 'ref', 'date', 'about', 'population')} " if chance(0.4) else ""), m

    def secret() -> tuple[str, str]:
        name = pick("token", "api_key", "apikey", "secret", "password", "SECRET_KEY", "access_token", "passwd", "pwd", "auth_token", "TOKEN", "key", "client_secret", "API_KEY")
        value = pick(hexes(32), hexes(40), hexes(64), hexes(40).upper(), mixed(24), mixed(40), mixed(32) + "==", f"{word(4)}{num(3)}!", f"{mixed(10)}", f"{mixed(8)}-{mixed(8)}-{mixed(8)}")
        if chance(0.2):
            return pick("", "use ", f"{name}: "), pick("AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "sk-" + mixed(40), "sk_live_" + mixed(24), "xoxb-" + num(11) + "-" + mixed(24), "eyJ" + mixed(40), "AIza" + mixed(35))
        quote = pick("", '"', "'")
        return f"{name}{pick(' = ', '=', ': ', ':', ' => ')}{quote}", value + "\0" + quote

    def not_secret() -> tuple[str, str]:
        return pick("commit ", "sha256:", "build ", "", "hash ", "checksum ", "the key ", "token ", "a password "), pick(hexes(40), hexes(64), hexes(32), word(20, 30) + num(1), f"{word()}/{num(4)}/{num(2)}/{word(6)}-{word(6)}-{word(6)}", "-".join(word(5) for _ in range(5)) + f"-{num(4)}", num(24), word(7, 10), word(7, 10), f"is {word(7)}")

    makers = {"email": (email, not_email), "ip": (ip, not_ip), "card": (a_card, not_card), "phone": (phone, not_phone), "secret": (secret, not_secret)}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.integers(1, 7)):
            kind = pick(*KINDS)
            true = chance(0.5)
            fore, body = makers[kind][0 if true else 1]()
            text += " ".join(word() for _ in range(r.integers(1, 6))) + pick(" ", " ", ", ", ": ", "\n", ". ")
            text += fore
            body, _, rest = body.partition("\0")
            if true:
                spans.append((kind, len(text), len(text) + len(body)))
            text += body + rest + pick(" ", " ", ", ", ". ", "\n", "; ")
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=1)
def models() -> dict[str, Trees]:
    """The trees of each kind, fitted on what the generators propose in the grammar's texts."""
    spark = SparkSession.active()
    made = training_texts()
    true = [set(spans) for _, spans in made]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i int, text string").repartition(8)

    def row(kind):
        return lambda s, e, before, m, after: F.struct(s.alias("s"), e.alias("e"), *(v.alias(k) for k, v in features(kind, before, m, after).items()))

    rows = df.select("i", base_spans(F.col("text")).alias("base"), *(_proposed(F.col("text"), k, row(k)).alias(k) for k in KINDS)).collect()
    out = {}
    for kind in KINDS:
        x, y = [], []
        for r in sorted(rows, key=lambda r: r["i"]):
            for c in r[kind]:
                if not any(b["start"] < c["e"] and c["s"] < b["end"] for b in r["base"]):
                    x.append([c[k] for k in FEATURES])
                    y.append(float((kind, c["s"], c["e"]) in true[r["i"]]))
        out[kind] = Trees().fit(np.array(x), np.array(y))
    return out


def _at_least(threshold: float):
    return lambda c: c["score"] >= threshold


def _of_rank(rank: int):
    return lambda c: c["rank"] == rank


def _settled(base: Column, proposals: Column) -> Column:
    """The proposals that are added, in order, by one sweep over base spans and proposals.

    ``last`` is the newest proposal that may still give way, ``spare`` the one
    that ``last`` displaced, which comes back if ``last`` is itself displaced by
    something it doesn't meet; ``wall`` is the furthest end of the base spans so far.
    """
    none = F.filter(proposals, lambda _: F.lit(False))
    entry = lambda c, given: F.struct(c["start"].alias("start"), F.lit(0 if given else 1).alias("after"), (-c["end"]).alias("back"), c.alias("span"))
    all_ = F.array_sort(F.concat(F.transform(base, lambda c: entry(c, True)), F.transform(proposals, lambda c: entry(c, False))))
    zero = F.struct(none.alias("kept"), none.alias("last"), none.alias("spare"), F.lit(0).alias("wall"))

    def state(kept, last, spare, wall) -> Column:
        return F.struct(kept.alias("kept"), last.alias("last"), spare.alias("spare"), wall.alias("wall"))

    def step(acc: Column, x: Column) -> Column:
        c, kept, last, spare, wall = x["span"], acc["kept"], acc["last"], acc["spare"], acc["wall"]
        me, top = F.array(c), last[0]
        free = F.size(last) == 0
        clear = free | (top["end"] <= c["start"])
        back = F.when((F.size(spare) > 0) & (spare[0]["end"] <= c["start"]), spare).otherwise(none)
        given = F.when(clear, state(kept, last, spare, F.greatest(wall, c["end"]))).otherwise(state(kept, back, none, F.greatest(wall, c["end"])))
        proposed = (
            F.when(c["start"] < wall, acc)
            .when(clear, state(F.concat(kept, last), me, none, wall))
            .when((top["rank"] == c["rank"]) & (c["end"] <= top["end"]), acc)
            .when(c["score"] > top["score"], state(F.concat(kept, back), me, last, wall))
            .otherwise(acc)
        )
        return F.when(x["after"] == 0, given).otherwise(proposed)

    return F.aggregate(all_, zero, step, lambda acc: F.concat(acc["kept"], acc["last"]))


def added_spans(text: Column, base: Column) -> Column:
    """Sorted spans of the proposals that the trees accept; none overlaps a base span or a better proposal."""
    parts = []
    for rank, kind in enumerate(KINDS):
        model = models()[kind]

        def made(s, e, before, m, after, rank=rank, kind=kind, model=model):
            x = features(kind, before, m, after)
            bound = let(F.struct(*(x[k].alias(k) for k in model.used)), lambda row: model.column({k: row[k] for k in model.used}))
            return _span(rank, s, e, bound)

        found = _proposed(text, kind, made, _at_least(model.threshold))
        parts.append(F.when(text.rlike(NEEDS[kind]) & text.rlike(STARTS[kind] + GENERATORS[kind]), found).otherwise(_no_spans()))
    return let(F.concat(*parts), lambda p: F.when(F.size(p) == 0, p).otherwise(_settled(base, p)))


def _listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["rank"]], s["start"], s["end"])), ",")


def find(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``df`` with two arrays of (start, rank in KINDS, end, score), both sorted: the base spans, and all spans."""
    whole = F.coalesce(F.col(text), F.lit(""))
    both = let(whole, lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, added_spans(t, b))).alias("spans"))))
    rest = df.drop(base, spans)
    pii = fresh(rest, "pii")[0]
    return rest.withColumn(pii, both).withColumns({base: F.col(f"{pii}.base"), spans: F.col(f"{pii}.spans")}).drop(pii)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind and digests of the base spans, the list of all spans, and how many they are."""
    found = find(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    counts = {f"n_{k}": F.size(F.filter("base_spans", _of_rank(r))).cast("long") for r, k in enumerate(BASE_KINDS)}
    return found.select("doc_id", *(v.alias(k) for k, v in counts.items()), F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each span of the text replaced by its kind in brackets; overlapping spans become one, of the first one's kind."""
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def merged(spans: Column) -> Column:
        """(gaps, wall): for each run of overlapping spans the gap before it and its first kind; where the last run ends."""
        none = F.filter(F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("rank"))), lambda _: F.lit(False))

        def step(acc: Column, s: Column) -> Column:
            gap = F.array(F.struct(acc["wall"].alias("lo"), s["start"].alias("hi"), s["rank"].alias("rank")))
            begins = (s["start"] >= acc["wall"]) | (F.size(acc["gaps"]) == 0)
            return F.struct(F.when(begins, F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"), F.greatest(acc["wall"], s["end"]).alias("wall"))

        return F.aggregate(spans, F.struct(none.alias("gaps"), F.lit(0).alias("wall")), step)

    def spliced(t: Column, runs: Column) -> Column:
        parts = F.transform(runs["gaps"], lambda g: F.concat(F.substring(t, g["lo"] + 1, g["hi"] - g["lo"]), label[g["rank"]]))
        return F.concat(F.array_join(parts, ""), F.substring(t, runs["wall"] + 1, F.length(t)))

    base, spans = fresh(df, "base_spans", "spans")
    found = find(df, text, base, spans)
    out = F.when(F.size(spans) == 0, F.col(text)).otherwise(let(merged(F.col(spans)), lambda runs: spliced(F.col(text), runs)))
    return found.withColumn(text, out).drop(base, spans).select(df.columns)
