"""Ranked search, language ID and the filter audit: brute force over fixtures with nulls, long texts, ties, repeats and clashing names."""

import math
import random
import re
import unicodedata
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftcube.llm import byte_words, filter_audit, language_id, lexical, queries

DOCS = "doc_id long, text string, lang string, source string, term string, n long, part string, A boolean, score double, digest string"
EXTRA = ("t", 1, "p", True, 0.5, "d")


def prose(draw, n, of="alpha beta Gamma, delta. épsilon ZETA zeta_eta 7th".split()):
    return " ".join(draw.choice(of) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    texts = [None, "", " \t\n", "word", "ALPHA alpha", "$ money", prose(draw, 3000), "épsilon épsilon", "x" * 9000]
    texts += [prose(draw, draw.randint(3, 90)) for _ in range(40)] + ["same text of many copies " * 3] * 20
    out = [(i, t, "en", draw.choice(["s1", "s2", None, ""]), *EXTRA) for i, t in enumerate(texts)]
    return [*out, out[12], out[12], (None, texts[12], "en", "s1", *EXTRA), (None, "same text of many copies " * 3, "en", "s9", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_words_come_whole_from_pieces(monkeypatch):
    table = byte_words.separators("abcdefghijklmnopqrstuvwxyzABC", lower=True)
    text = "Aab, c d\x00é-éé Abc" * 50
    want = text.translate(str.maketrans("ABC", "abc")).replace(",", " ").replace("\x00", " ").replace("-", " ").encode().split()
    for piece in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(byte_words, "PIECE", piece)
        assert [w for part in byte_words.words(text.encode(), table) for w in part] == want


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) rows by hand."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scores += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


ITEMS = [(1, "alpha zeta ALPHA"), (2, None), (3, ""), (4, "same text"), (4, "same text"), (5, "unknown"), (None, "épsilon 7TH gamma"), (6, "many many copies x")]


def by_item(rows):
    return Counter((repr(r[0]), r[1], repr(r[2]), r[3]) for r in rows)


@pytest.mark.parametrize("entries", [lexical.ENTRIES, 3])
def test_search(spark, docs, rows, entries):
    items = spark.createDataFrame([(*x, 1, "n") for x in ITEMS], "item_id long, text string, rank int, doc_id string")
    got = lexical.search(docs, items, entries=entries, most_docs=7, most_postings=50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_item(got.collect()) == by_item(ranked([(r[0], r[1]) for r in rows], ITEMS))


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 == lexical.search(docs, items.limit(0)).count()


def test_impacts_beyond_a_long():
    args = np.array([3]), np.array([2]), np.array([2**40])
    docs, length = 2**30, 2**60
    m = 25 + 75 * 2**40 * docs // length
    assert lexical._impacts(*args, docs, length).tolist() == [3 * (2 * 10**9 // (2000 + 8 * m))]


def verdict(texts, i, doc_id):
    text, words = texts[i] or "", re.findall("[^\x20\x09-\x0d]+", texts[i] or "")
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None,
    }


def test_audit(spark, docs, rows):
    labels = spark.createDataFrame([(i, q, t) for i, q, t in [(3, 1, 0), (4, 0, 1), (12, 1, 1), (12, 0, None), (20, None, 1), (None, 1, 1), (9999, 1, 1), *((i, 1, 0) for i in range(30, 60))]], "doc_id long, quality int, toxic int")
    good, toxic = {3, 12, *range(30, 60)}, {4, 12, 20}
    texts, held = [r[1] for r in rows], []
    for i, r in enumerate(rows):
        fails = verdict(texts, i, r[0])
        fails["E"] = r[0] is not None and any(q[0] is not None and q[0] < r[0] and (q[1] or "") == (r[1] or "") for q in rows)
        held.append((r[3] or "", {f for f in fails if fails[f]}, r[0] in good, r[0] in toxic))
    want = {}
    for part in {h[0] for h in held}:
        own = [h for h in held if h[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                alive = [h for h in own if not h[1] & before]
                gone = [h for h in alive if f in h[1]]
                shapley[f] += len(gone)
                want[part, "".join(order), step] = [
                    len(alive) - len(gone), len(gone), sum(f in h[1] for h in own) - len(gone), sum(h[1] == {f} for h in own), sum(h[2] for h in gone), sum(h[3] for h in gone), f,
                ]
        for key in want:
            if key[0] == part:
                want[key][-1] = shapley[want[key][-1]]
    for most in (filter_audit.BROADCAST_ROWS, 0):  # by broadcast, and by shuffles with hot keys apart
        verdicts = filter_audit.verdicts(docs, labels, most)
        assert verdicts.columns == ["part", *"ABCDE", "good", "toxic"] and verdicts.count() == len(rows)
        got = filter_audit.audit(verdicts)
        names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
        assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got.collect()} == want
    assert len(want) == 600 * len({h[0] for h in held})
    assert filter_audit.audit(filter_audit.verdicts(docs.limit(0), labels)).count() == 0
    assert filter_audit.verdicts(docs, labels.limit(0)).where("good or toxic").count() == 0


def test_audit_shares_prefixes(spark):
    rows = spark.createDataFrame([("p", True, False, True), ("p", False, False, False)], "part string, X1 boolean, Y boolean, m boolean")
    found = filter_audit.states(rows, ["X1", "Y"])
    assert {k: v.count() for k, v in found.items()} == {frozenset(): 2, frozenset(["X1"]): 1, frozenset(["Y"]): 2}
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["m_lost"], r["shapley"]) for r in filter_audit.audit(rows, ["X1", "Y"], marks=["m"]).collect()}
    assert got == {("X1Y", 1): (1, 1, 1, 2), ("X1Y", 2): (1, 0, 0, 0), ("YX1", 1): (2, 0, 0, 0), ("YX1", 2): (1, 1, 1, 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(rows, [])


# Language ID: dictionaries and plain loops


def grams(text):
    plain = "".join(c.lower()[0] if c.isalpha() else c if ord(c) > 127 and unicodedata.category(c)[0] == "M" else " " for c in text)
    middle, plain = f" {text} ", f" {plain} "
    return Counter(plain[i - 1 : i + 2] for i in range(1, len(plain) - 1) if middle[i].isalpha())


def learned(texts):
    counts = {}
    for text, lang in texts:
        if lang is not None and text:
            counts.setdefault(lang, Counter()).update(grams(text))
    counts = {x: c for x, c in sorted(counts.items()) if c}
    shares = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    every = {g: sum(s.get(g, 0) for s in shares.values()) / len(shares) for s in shares.values() for g in s}
    table = {g: [0.95 * shares[x].get(g, 0) + 0.05 * mean for x in shares] for g, mean in every.items()}
    return list(counts), table


def em(seen, start):
    share, total = start, sum(n for _, n in seen)
    for _ in range(40):
        new = [0.0] * len(share)
        for p, n in seen:
            mixed = sum(a * b for a, b in zip(p, share))
            new = [x + n * a * b / mixed for x, a, b in zip(new, p, share)]
        new = [x / total for x in new]
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < 1e-4:
            break
    return share, sum(n * math.log(sum(a * b for a, b in zip(p, share))) for p, n in seen)


def inferred(text, languages, table):
    found = grams(text or "")
    if not found or not languages:
        return "und", 0.0
    seen = [(table[g], n) for g, n in found.items() if g in table]
    if not seen:
        return None, 1 / len(languages)
    full, _ = em(seen, [1 / len(languages)] * len(languages))
    order = sorted(range(len(full)), key=lambda i: (-full[i], i))
    price, best = 3 * math.log(1 + sum(n for _, n in seen)), None
    for k in range(1, len(full) + 1):
        start = [max(full[i], 1e-6) if i in order[:k] else 0.0 for i in range(len(full))]
        share, value = em(seen, [x / sum(start) for x in start])
        value -= price * (k - 1)
        if best is None or value > best[0]:
            best = value, share
    top = max(range(len(full)), key=lambda i: (best[1][i], -i))
    return languages[top], best[1][top]


WORDS = {"de": "und der die nicht über weiß", "en": "and the with which that of", "fr": "être les où que dans très", "it": "che gli perché della più", None: "xyz"}


@pytest.fixture(scope="module")
def spoken(spark):
    draw = random.Random(3)
    texts = [(prose(draw, draw.randint(2, 60), WORDS[x].split()), x) for x in draw.choices(list(WORDS), k=60)]
    texts += [(None, "en"), ("", "de"), ("123 $", "fr"), ("Ωμέγα", None), ("the " * 3000 + "über die " * 2000, None), ("THE AND", None), texts[3], texts[3]]
    texts += [(prose(draw, 40, WORDS["en"].split()) + " " + prose(draw, 40, WORDS["fr"].split()), None) for _ in range(5)]
    return texts


def test_language_mixture(spark, spoken, monkeypatch):
    docs = spark.createDataFrame([(None if i == 9 else i, t, x, 7, "s") for i, (t, x) in enumerate(spoken)], "doc_id long, text string, lang string, score int, chunk string").repartition(3)
    languages, table = learned(spoken)
    model = language_id.fit(docs)
    assert (model.languages, model.rows) == (languages, len(table))
    results = []
    for cells in (language_id.CELLS, 0):  # by broadcast, and by chunks that meet the table in a join
        got = language_id.identify(docs, model, cells=cells)
        assert got.columns == ["doc_id", "lang", "chunk", "lang_pred", "score", "proportions"]
        results.append(sorted(map(repr, got.collect())))
        rows = {r["doc_id"]: r for r in got.collect()}
        assert len(rows) == len(spoken)
        for i, (text, _) in enumerate(spoken):
            want, score = inferred(text, languages, table)
            r = rows[None if i == 9 else i]
            assert r["lang_pred"] == (want or languages[model.usual]) and r["score"] == pytest.approx(score, abs=2e-6) and r["chunk"] == "s"
        mixed = rows[len(spoken) - 1]["proportions"]
        assert {x.split(":")[0] for x in mixed.split(",")} == {"en", "fr"}
    assert results[0] == results[1]
    assert language_id.identify(docs.limit(0), model).count() == 0
    nothing = language_id.fit(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs, nothing).collect()} == {("und", 0.0)}
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs)


def test_trigrams_of_pieces(monkeypatch):
    from driftcube.llm import char_model

    texts = ["", "Ab, cd", "é" * 50, "x1y zz " * 9]
    total = lambda: Counter({(int(o), int(g)): int(n) for o, g, n in zip(*map(np.concatenate, zip(*language_id._merged(list(language_id.trigrams(texts))))))})
    want = total()
    for piece in (1, 3, 10):
        monkeypatch.setattr(char_model, "PIECE", piece)
        assert total() == want
    assert sum(n for (i, _), n in want.items() if i == 2) == 50


FOLDER = "/root/testdata/sf0.001"


def test_op12(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("held", F.expr("pmod(crc32(string(doc_id)), 4) = 2")).collect()}
    got = {r["doc_id"]: r for r in queries.queries()["op12_language_mixture"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    languages, table = learned([(r["text"], r["lang"]) for r in docs.values() if not r["held"]])
    right = [r["lang_pred"] == docs[i]["lang"] for i, r in got.items() if docs[i]["held"]]
    assert np.mean(right) > 0.95  # accuracy where nothing was learned from
    for i in sorted(docs)[::5]:
        want, score = inferred(docs[i]["text"], languages, table)
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (want, docs[i]["held"]) and got[i]["score"] == pytest.approx(score, abs=2e-5)
