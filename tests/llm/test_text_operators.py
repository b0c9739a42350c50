"""Operators 3, 4, 8, 9 and 10 against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken

from netloom.llm import bpe, decontam, jaccard_join, quality, toxicity
from netloom.plans import skew

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, tokenizers.PATTERN)


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})


def test_bpe_equals_the_library(codec, own):
    r = random.Random(1)
    for _ in range(600):
        t = "".join(r.choice("aab '\"s\n\t  \x1c\x85 é½²一٣🙂ñЖ'll123.,​́") for _ in range(r.randint(0, 40)))
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t) and codec.decode(ids) == t.encode()
    long = "ab" * 10_000 + " " * 1000 + "word " * 220_000
    assert codec.encode(long) == own.encode_ordinary(long)
    assert codec.encode(None) == codec.encode("") == []


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot_key) == list(range(5000)) and all(keys[h.find(k)] == k for k in keys)
    assert bpe.PerfectHash([b"x"]).find(b"x") == 0


def test_bpe_tables(spark, own):
    df = spark.createDataFrame([(1, "Hello  world"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(df, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).orderBy("doc_id").collect()
    assert rows[0]["token_ids"] == own.encode_ordinary("Hello  world") and rows[0]["decoded"] == "Hello  world"
    assert rows[1]["token_ids"] == [] and rows[1]["n_tokens"] == 0 and len(rows) == 4


def test_bpe_query_equals_the_library(spark, own):
    """The whole query, digests included; one text spans several blocks."""
    texts = ["Hello  world", None, "", "", "é" * 3000 + "\n\n" + "word 12,345 " * 100_000, "x" * 5000, "🙂 ñandú\r\n  "]
    rows = [*enumerate(texts), (None, "no id"), (3, "again")]
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    got = bpe.round_trip(df, path, tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert bpe.round_trip(df.limit(0), path, tokenizers.PATTERN).count() == 0
    assert bpe.encode(df, path, tokenizers.PATTERN, count="k").columns == ["doc_id", "text", "n_tokens", "token_ids", "k"]


def _semi_global(a, b):
    prev = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        cur = [i]
        for j, d in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(300):
        a, b, k = "".join(r.choice("ab ") for _ in range(r.randint(1, 70))), "".join(r.choice("ab ") for _ in range(r.randint(1, 90))), r.randint(0, 30)
        d, m = _semi_global(a, b), decontam.best_match(a, b, k)
        assert (m[0] if m else None) == (d if d <= k else None)


def test_pigeonhole_loses_no_occurrence():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(15))) for i in range(6)]
    m = decontam.Matcher(items)
    for _ in range(40):
        i, text = items[r.randrange(6)]
        n = decontam.normalise(text)
        chars = list(n)
        for _ in range(r.randint(0, int(len(n) * decontam.ERRORS) + 3)):
            chars[r.randrange(len(chars))] = r.choice("abcxyz")
        doc = " ".join(word() for _ in range(30)) + " " + "".join(chars) + " " + " ".join(word() for _ in range(30))
        want = {(k, d) for k, t in items if (d := _semi_global(decontam.normalise(t), decontam.normalise(doc))) <= int(len(decontam.normalise(t)) * decontam.ERRORS)}
        assert {x[:2] for x in m.search(doc)} == want


def test_decontamination_tables(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away from the angry bear"
    long = "clean words here " * 60_000
    rows = [(1, f"Intro. {item.upper()}! End"), (2, "clean text"), (3, None), (4, ""), (None, item), (5, item.replace("lazy", "lasy")), (2, item), (6, "as short as this"), (7, "shortest, shor t"), (8, "天気がいい日です"), (9, long), (10, long + item.replace(" ", "\u2019 ")), (2, "clean text")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (8, "Short!"), (12, "がいい"), (None, item), (9, None), (10, "...")], "item_id long, text string")
    want = {(1, 7, 0), (1, None, 0), (None, 7, 0), (None, None, 0), (5, 7, 1), (5, None, 1), (2, 7, 0), (2, None, 0), (6, 8, 0), (8, 12, 0), (10, 7, 0), (10, None, 0)}
    for limit in (4_000_000, 50):  # one block of items, and one block for each
        monkeypatch.setattr(decontam, "MAX_ITEM_CHARS", limit)
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find(docs, items).collect()} == want
        kept = decontam.remove(docs, items)
        assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.where("text is not null").collect()) == sorted([(2, "clean text"), (2, "clean text"), (4, ""), (7, rows[8][1]), (9, long)])
    assert decontam.find(docs, items.limit(0)).count() == 0 and decontam.find(docs.limit(0), items).count() == 0 and decontam.remove(docs, items.limit(0)).count() == len(rows)


def _labelled(spark, label, sf=SF):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", label).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    return docs, labels, {r["doc_id"]: r[label] for r in rows if held(r["doc_id"])}


def _recall_precision(held, flagged):
    both = sum(y and flagged[i] for i, y in held.items())
    return both / max(1, sum(held.values())), both / max(1, sum(flagged[i] for i in held))


def test_quality_held_out(spark):
    docs, labels, held = _labelled(spark, "quality")
    model = quality.fit_tables(docs, labels)
    p = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).select("doc_id", "quality_score").collect()}
    recall, precision = _recall_precision(held, {i: p[i] >= quality.THRESHOLD for i in held})
    bad, clean = _recall_precision({i: 1 - y for i, y in held.items()}, {i: p[i] < quality.THRESHOLD for i in held})
    assert recall > 0.95 and precision > 0.95 and bad > 0.9 and clean > 0.9


def test_toxicity_held_out(spark):
    docs, labels, held = _labelled(spark, "toxic", "/root/testdata/sf0.1")
    model = toxicity.fit_tables(docs, labels)
    p = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).select("doc_id", "toxicity").collect()}
    recall, precision = _recall_precision(held, {i: p[i] >= toxicity.THRESHOLD for i in held})
    assert recall >= 0.9 and precision >= 0.95


def test_models_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["quality_score"] for r in quality.score(docs, quality.fit_tables(docs, empty)).collect()} == {0.5}
    assert {r["toxicity"] for r in toxicity.score(docs, toxicity.fit_tables(docs, empty)).collect()} == {0.0}


def test_folding_and_exceptions():
    assert toxicity.fold("ІDІ0Т") == toxicity.fold("idiot") == toxicity.fold("1d10t")
    m = toxicity.Matcher({toxicity.fold("clown"): (3.0, 0.0)}, [toxicity.fold("clown fish")])
    assert m.figures("A Cl0wn!")[1] == 1 and m.figures("a clown fish")[1] == 0 and m.figures("aclown")[1] == 0 and m.figures("")[1] == 0


def _awkward(spark):
    rows = [(None, None), (1, ""), (1, "A good line of words, as people write them.\nAnother one follows here."), (1, "A good line of words, as people write them.\nAnother one follows here."), (2, "x !!! ## 11\n" * 20_000), (None, "you idiot, you moron"), (3, "\n \n")]
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, quality_score string, toxic_hits int")


def test_scores_of_awkward_rows(spark):
    """Nulls, repeated rows, very long texts, clashing names and empty tables, for both classifiers."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    df = _awkward(spark)
    good = quality.score(df, quality.fit_tables(docs, labels), out="score")
    toxic = toxicity.score(df, toxicity.fit_tables(docs, labels), out="score", hits=None, weight="w")
    assert good.columns == [*df.columns, "score"] and toxic.columns == [*df.columns, "score", "w"]
    for out in (good, toxic):
        rows = out.collect()
        assert len(rows) == 7 and all(0 <= r["score"] <= 1 and r["quality_score"] == "mine" and r["toxic_hits"] == 7 for r in rows)
        by_text = {}
        for r in rows:
            by_text.setdefault(r["text"], set()).add(r["score"])
        assert all(len(v) == 1 for v in by_text.values())
    score = {r["text"]: r["score"] for r in toxic.collect()}
    assert score["you idiot, you moron"] > 0.5 > score[""] == score[None]
    assert quality.score(df.limit(0), quality.fit([]), out="s").count() == 0 and toxicity.score(df.limit(0), toxicity.fit([]), out="s").count() == 0


def test_quality_equals_enumeration():
    """The whole score of a text against the sum over all labellings of its lines."""
    from itertools import product
    from math import exp

    docs = ["Good line here.\nAnd another good line.\nThird line of it.", "x!!\n##\n12 34\nq", "One line.", "a b c\n\n!!! ???\nSome words that follow each other."]
    model = quality.fit([(d, k % 2) for k, d in enumerate(docs * 4)])
    gg, gb, bg, bb = model.stay
    step = {(1, 1): gg, (1, 0): gb, (0, 1): bg, (0, 0): bb}
    for d in docs:
        lines = quality.lines_of(d)
        e = [exp(max(-30, min(30, v))) for v in (quality.line_features(lines) @ model.weights).tolist()]
        total = good = 0.0
        for s in product((0, 1), repeat=len(lines)):
            w = 1.0
            for i, v in enumerate(s):
                w *= (e[i] if v else 1.0) * (step[s[i - 1], v] if i else 1.0)
            total += w
            good += w * sum(len(x) for x, v in zip(lines, s, strict=True) if v)
        assert model.share(d) == pytest.approx(good / total / sum(map(len, lines)))


def test_toxicity_figures_equal_a_plain_search():
    """Random texts against a search that looks at every position for every stem."""
    r = random.Random(8)
    lexicon = {"abc": (2.0, 0.0), "abcd": (3.0, 0.1), "ba": (1.5, 0.05), "ab ": (4.0, 0.0), "天気": (2.5, 0.0)}
    exceptions = ["abc ca", "ba ba"]
    m = toxicity.Matcher(lexicon, exceptions)
    for _ in range(400):
        text = " ".join(r.choice(["ab", "abc", "abcd", "abcde", "ba", "bab", "ca", "c", "い天気", "x"]) for _ in range(r.randint(0, 40)))
        folded = toxicity.fold(text)
        at = lambda w: [i for i in range(len(folded) + 1) if (folded + " ").startswith(w, i) and (not i or not folded[i - 1].isalnum() or "\u3400" <= w[0] <= "\u9fff")]  # noqa: E731, B023
        spared = [(i, i + len(p)) for p in exceptions for i in at(p)]
        weight = hits = 0
        words = folded.count(" ") + folded.count("\n") + 1
        for s, (w, rate) in lexicon.items():
            k = sum(not any(a <= i and i + len(s) <= b for a, b in spared) for i in at(s))
            if toxicity.stands_out(k, words, rate):
                weight, hits = weight + k * w, hits + k
        got = m.figures(text)
        assert (got[1], got[2]) == (hits, words) and got[0] == pytest.approx(weight)


def test_marginals_equal_enumeration():
    from itertools import product
    from math import exp

    z, stay = [0.5, -1.0, 2.0, 0.1], (3.0, 0.4, 0.6, 2.0)
    tr = {(1, 1): stay[0], (1, 0): stay[1], (0, 1): stay[2], (0, 0): stay[3]}
    weight = {}
    for s in product((0, 1), repeat=4):
        w = 1.0
        for i, v in enumerate(s):
            w *= exp(z[i]) if v else 1.0
            w *= tr[s[i - 1], v] if i else 1.0
        weight[s] = w
    for i, p in enumerate(quality.marginals(z, stay)):
        assert p == pytest.approx(sum(w for s, w in weight.items() if s[i]) / sum(weight.values()))


def _brute(texts):
    sets = {i: frozenset(jaccard_join.shingles(t).tolist()) for i, t in texts.items()}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    reps = sorted(rep.values())
    links = {r: set() for r in reps}
    for k, a in enumerate(reps):
        for b in reps[:k]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) / len(x | y) >= jaccard_join.THRESHOLD:
                links[a].add(b)
                links[b].add(a)
    group = {}
    for r in reps:
        if r not in group:
            stack = [r]
            while stack:
                v = stack.pop()
                if v not in group:
                    group[v] = r
                    stack += links[v]
    return {i: (rep[s], len(links[rep[s]]), group[rep[s]]) for i, s in sets.items()}


@pytest.mark.parametrize("light,few,hot", [(24, 192, 256), (3, 4, 2)])
def test_jaccard_join(spark, monkeypatch, light, few, hot):
    """Also with limits so low that most buckets are large, span several blocks and have families, and keys are dealt."""
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(skew, "FEW_ROWS", hot)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = {0: None, 1: "", 2: "a b", 3: "A, b!", 4: "a b c", 5: " ".join(base)}
    for i in range(6, 70):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    for i in range(200, 240):
        w = list(base)
        w[r.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    for i in range(70, 100):
        texts[i] = " ".join(word() for _ in range(r.randint(1, 300)))
    texts[100] = texts[99]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, rep string").repartition(5)
    got = {x["doc_id"]: (x["class_id"], x["n_links"], x["group_id"]) for x in jaccard_join.join(df).collect()}
    assert got == _brute(texts)
    assert {x["doc_id"] for x in jaccard_join.deduplicate(df).collect()} == {g[2] for g in got.values()}


def test_jaccard_join_of_awkward_rows(spark):
    """Null and repeated ids, equal rows, very long texts, clashing columns."""
    long = " ".join(f"w{i}" for i in range(120_000))
    same, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(None, same), (4, same), (4, other), (4, other), (None, long), (9, long + " end"), (7, None), (None, ""), (None, "only here"), (None, "only here")]
    df = spark.createDataFrame([(*r, 1, "y", "z") for r in rows], "doc_id long, text string, _keep int, row_key string, cid string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["copies"], r["n_links"], str(r["group_id"])) for r in jaccard_join.join(df).collect())
    want = [("None", "4", 2, 0, "4"), ("4", "4", 2, 0, "4"), ("4", "4", 2, 0, "4"), ("4", "4", 2, 0, "4"), ("None", "None", 1, 1, "9"), ("9", "9", 1, 1, "9"), ("7", "7", 2, 0, "7"), ("None", "7", 2, 0, "7"), ("None", "None", 2, 0, "None"), ("None", "None", 2, 0, "None")]
    assert got == sorted(want)
    kept = jaccard_join.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.where("text is not null").collect()) == sorted([("4", same), ("4", other), ("9", long + " end"), ("None", "only here")])
    assert kept.where("text is null").count() == 1


def test_jaccard_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(df).count() == 0 and jaccard_join.deduplicate(df).count() == 0


def test_posterior_table():
    least = jaccard_join.least_matches()
    assert least[0] == 0 and least[33] < 0.8 * 33 and (least[1:] >= least[:-1]).all() and (least <= 0.8 * np.arange(len(least))).all()


def test_pruning_keeps_links_of_sets_of_all_sizes():
    """One rule: pairs at 0.8 or just above stay, pairs without anything in common go."""
    r = np.random.default_rng(1)
    for n in (6, 12, 30, 60, 200, 2000):
        tried = 0
        for _ in range(300):
            union = np.unique(r.integers(0, 2**64, n, np.uint64))
            spare = r.permutation(n)[: n // 5]
            a, b = np.delete(union, spare[::2]), np.delete(union, spare[1::2])
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * n:
                continue
            tried += 1
            (va, fa), (vb, fb), (vc, fc) = map(jaccard_join.sketch, (a, b, np.unique(r.integers(0, 2**64, n, np.uint64))))
            assert len(jaccard_join.survivors(va[None], fa[None], vb[None], fb[None]))
            assert n < 30 or not len(jaccard_join.survivors(va[None], fa[None], vc[None], fc[None]))
        assert tried > 200



@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """A folder of tables whose documents have every awkward row and columns of clashing names."""
    folder = str(tmp_path_factory.mktemp("tiny"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    item = "the quick brown fox jumps over the lazy dog and runs away from the angry bear"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").write.parquet(f"{folder}/labelled.parquet")
    texts = [None, "", "you stupid pathetic idiot, you worthless moron, disgusting scum and trash", f"Intro {item} end", "mail bob@example.com now please and thank you", "mail bob@example.com now please and thank you", "word " * 210_000, "plain words that nobody minds at all"]
    rows = [(k if k % 2 else None, t) for k, t in enumerate(texts)] + [(1, "another text under the same id as one before"), (1, "another text under the same id as one before"), (None, "plain words that nobody minds at all")]
    names = ["spans", "base_spans", "toxic_hits", "toxicity", "_keep", "_decoded", "rep", "token_ids", "n_tokens", "decodes", "pii", "row_key"]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *names) for r in rows], ", ".join(["doc_id long, text string, n_chars long", *(f"{n} string" for n in names)]))
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_pipeline_stages_on_awkward_rows(spark, tiny):
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    every, columns = _rows(docs), docs.columns
    toxic = stages["toxicity"](spark, docs.unionByName(spark.read.parquet(f"{tiny}/labelled.parquet"), allowMissingColumns=True), tiny)
    assert toxic.columns == columns
    assert _rows(toxic.where("spans is not null")) == [r for r in every if "stupid" not in r[1]]
    clean = stages["decontamination"](spark, docs, tiny)
    assert clean.columns == columns and _rows(clean) == [r for r in every if "quick brown" not in r[1]]
    single = stages["near_duplicates"](spark, docs, tiny)
    assert single.columns == columns and sorted(r["text"] or "" for r in single.collect()) == sorted({r["text"] or "" for r in docs.collect()})
    redacted = stages["pii"](spark, docs, tiny)
    assert redacted.columns == columns and sorted(r["text"] or "" for r in redacted.collect()) == sorted((r["text"] or "").replace("bob@example.com", "[EMAIL]") for r in docs.collect())
    assert all(r["n_chars"] == len(r["text"] or "") and r["spans"] == "spans" and r["toxic_hits"] == "toxic_hits" for r in redacted.collect())
    ids = stages["byte_bpe"](spark, docs, tiny)
    assert ids.columns == [*columns, "token_ids_", "n_tokens_", "decodes_"] and all(r["decodes_"] and r["decodes"] == "decodes" for r in ids.collect()) and ids.count() == len(every)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), tiny).count() == 0, name


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = {r["doc_id"]: r for r in pipeline.run(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = _brute({i: docs[i] for i in docs})
    assert len({kept[i][2] for i in rows}) == len(rows)  # one of each group
    assert all(r["decodes"] and r["n_tokens"] == len(r["token_ids"]) for r in rows.values())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(t in docs[i] for i in rows for t in items)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"] or "") for r in rows.values())
