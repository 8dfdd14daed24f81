"""The registered queries that have no SQL, over the smallest tables, column by column."""

import hashlib
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from by_hand import alike
from tokenizers import Tokenizer

from driftcube.llm import kneser_ney, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def result(spark, name, columns):
    got = queries.queries()[name](spark, FOLDER)
    assert set(columns.split(", ")) <= {f"{n} {t}" for n, t in got.dtypes}
    rows = got.collect()
    return {r["doc_id"]: r for r in rows}, len(rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2(spark, docs):
    got, n = result(spark, "op2_winnowing", "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    assert n == len(docs) == len(got)
    order = sorted(docs)
    for i, doc_id in enumerate(order):
        text, following, r = docs[doc_id]["text"] or "", docs[order[(i + 1) % len(order)]]["text"] or "", got[doc_id]
        half = len(text) // 2
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(text[: len(text) - half] + following[:half]))
        following_row, edited_chars = got[order[(i + 1) % len(order)]], len(text[: len(text) - half] + following[:half])
        assert r["near_edited"] == pytest.approx(alike(r["fingerprint"], len(text), r["edited_fingerprint"], edited_chars))
        assert r["near_next"] == pytest.approx(alike(r["fingerprint"], len(text), following_row["fingerprint"], following_row["n_chars"]))


def test_op4(spark, docs):
    got, n = result(spark, "op4_bpe_automaton", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert n == len(docs) == len(got)
    for doc_id, r in got.items():
        ids = library.encode(docs[doc_id]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op5(spark, docs):
    got, n = result(spark, "op5_simhash_near_dedup", "doc_id bigint, fingerprint string, component_id bigint")
    assert n == len(docs) == len(got)

    def by_hand(text):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))

    prints = {i: by_hand(r["text"]) for i, r in docs.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    smallest = {i: i for i in docs}

    def find(x):
        while smallest[x] != x:
            x = smallest[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            low, high = sorted((find(a), find(b)))
            smallest[high] = low
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in docs}


def test_op9(spark, docs):
    got, n = result(spark, "op9_kneser_ney_quality", "doc_id bigint, lang string, length bigint, perplexity double, lowest double, highest double, keep boolean")
    assert n == len(docs) == len(got)
    good = {r["doc_id"] for r in kneser_ney.trusted(spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    for i, r in got.items():
        assert r["length"] == len(docs[i]["text"]) and np.isfinite(r["perplexity"]) and r["keep"] == (r["lowest"] <= r["perplexity"] <= r["highest"])
    assert all(got[i]["keep"] for i in good)  # within 1.2 of their own quantile


def test_op10(spark, docs):
    got, n = result(spark, "op10_token_counts", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert n == len(docs) == len(got)
    for doc_id, r in got.items():
        text = docs[doc_id]["text"] or ""
        tokens = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), tokens, tokens > 4096)
    assert any(r["over_limit"] for r in got.values())
