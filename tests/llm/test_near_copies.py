"""The near_dedup stage of the pipeline against brute force over all pairs."""

import random
from itertools import combinations
from math import comb

import corpus_pipeline
import numpy as np
from driftcube.llm import near_copies
from driftcube.llm.common import text_key
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest


def test_near_copies_against_brute_force(spark):
    draw = random.Random(4)
    texts = [None, "", " ", "three short words", "Three short WORDS"]
    for _ in range(25):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(4, 300))] + "the same closing words stand below all of them".split()
        texts.append(" ".join(words))
        for _ in range(draw.randint(0, 4)):  # near copies: words changed one by one
            for _ in range(draw.randint(1, 4)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(3000)}"
            texts.append(" ".join(words))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            linked += sets[a] != sets[b]
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert linked > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = corpus_pipeline.near_dedup(spark, df, "")  # two bits of a 3-word SimHash leave most of these
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert near_copies.near_copies(df.limit(0)).collect() == []


def test_prefix_holds_the_bound():
    draw = np.random.default_rng(5)
    for _ in range(300):
        n = int(draw.integers(1, 60))
        a = np.unique(draw.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate((draw.choice(a, max(1, len(a) - len(a) // 8), replace=False), draw.integers(-(2**63), 2**63 - 1, len(a) // 9))))
        common = len(np.intersect1d(a, b))
        if 5 * common >= 4 * len(np.union1d(a, b)):
            frequent = np.sort(draw.choice(a, len(a) // 2, replace=False))
            ranks = draw.permutation(len(frequent))
            (x, p), (y, q) = near_copies.prefix(a, frequent, ranks), near_copies.prefix(b, frequent, ranks)
            assert len(np.intersect1d(x, y)) and (np.diff(p) >= 0).all() and len(p) == len(x)
            end = min(p[-1], q[-1])  # the bound of the narrowing step
            assert 9 * (len(np.intersect1d(p, q)) + min(len(a) - (p < end).sum(), len(b) - (q < end).sum())) >= 4 * (len(a) + len(b))


def test_stage_on_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert kept == set(found.values())
    assert {1, 6} <= kept and not {177, 145} & kept  # Jaccard 0.83, 11 and 7 bits apart


def test_places_that_collide_lose_no_link(spark):
    """Two sets of 36 with 32 common, 0.8 exactly, of which two pairs share a place each."""
    sets = [list(range(1, 33)) + [101, 102, 103, 104], list(range(1, 33)) + [201, 202, 203, 204]]
    for places in ([*range(1, 9)], [1, 1, 2, 2, 5, 6, 7, 8]):
        prints = spark.createDataFrame([(i, len(s), places) for i, s in enumerate(sets)], "row long, n long, places array<int>")
        pairs = spark.createDataFrame([(0, 1)], "a long, b long")
        assert near_copies._narrowed(pairs, prints).count() == 1


def simhash_by_hand(text):
    words = text.split()
    hashes = {xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))}
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_links_by_simhash_alone(spark):
    """Pairs of near copies whose prefixes are not posted: fingerprints that share three bytes link them, and only where the sets do."""
    draw = random.Random(9)
    texts = []
    for _ in range(30):
        words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        other = words[:]
        for at in draw.sample(range(200), 2):
            other[at] = f"x{draw.randrange(10**6)}"
        texts += [" ".join(words), " ".join(other)]
    texts += [texts[0] + " " + " ".join(f"y{i}" for i in range(48)), texts[0] + " " + " ".join(f"z{i}" for i in range(52))]  # Jaccard 196 of 244 and of 248: above and below
    prints = [simhash_by_hand(t) for t in texts]
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    shares = lambda a, b: sum(not (prints[a] ^ prints[b]) >> 8 * i & 255 for i in range(8))
    bits = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    none = np.empty(0, np.int64)
    rows = []
    for i, t in enumerate(texts):
        hashes = near_copies.shingles(t)
        rows.append((i, len(hashes), 1, signed(prints[i]), [], near_copies.prefix(hashes, none, none)[1].tolist(), t))
    df = spark.createDataFrame(rows, "row long, n long, copies long, simhash long, prefix array<long>, places array<int>, text string")
    df = df.withColumns({"text_key": text_key(), "text_sum": F.crc32(F.col("text").cast("binary"))})
    got = {(r["a"], r["b"]): (r["postings"], r["bits"]) for r in near_copies.met(df.where("row < 60")).collect()}
    want = {(a, a + 1): (comb(shares(a, a + 1), 3), bits(a, a + 1)) for a in range(0, 60, 2) if shares(a, a + 1) >= 3}
    assert {p: v for p, v in got.items() if p in want} == want and len(want) > 10
    found = {(r["a"], r["b"]) for r in near_copies.links(df.select("text"), df.drop("text")).collect()}
    alike = {p for p in combinations(range(len(texts)), 2) if 5 * len(sets[p[0]] & sets[p[1]]) >= 4 * len(sets[p[0]] | sets[p[1]])}
    assert found <= alike
    assert {p for p, v in want.items() if p[0] and (v[0] >= 4 or v[1] <= 14)} <= found


def test_made_fingerprints_are_those_of_the_sets():
    for text in ("one", "A b c d E", " ".join(f"w{i % 90}" for i in range(400))):
        assert near_copies.majority(near_copies.shingles(text)) & (2**64 - 1) == simhash_by_hand(text.lower())
    assert near_copies.majority(near_copies.shingles(None)) == 0


def test_simhash_index_meets_in_one_text(spark):
    """A posting of 3,000 fingerprints makes a pair a row, empty sets and unequal lengths none."""
    rows = [(i, 50, 2 if i == 7 else 1, 1 << i % 8) for i in range(3000)] + [(3000, 0, 1, 0), (3001, 400, 1, 0)]
    df = spark.createDataFrame(rows, "row long, n long, copies long, simhash long")
    got = near_copies.met(df).collect()
    assert len(got) < 4 * 3000 and not {3000, 3001} & {x for r in got for x in (r["a"], r["b"])}
    assert {r["a"] + r["b"] - 7 for r in got if 7 in (r["a"], r["b"])} == set(range(3000)) - {7}
