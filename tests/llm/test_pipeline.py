"""The pipeline's stages, each against what it must do by brute force, written apart from the operators."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from driftcube.llm.common import stage

FOLDER = "/root/testdata/sf0.001"
PATTERNS = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: m[2] if len(m[2]) >= 6 else None),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: m[0] if len(m[0]) >= 20 else None),
    (re.compile("[0-9a-f]+"), lambda m: m[0] if len(m[0]) >= 24 else None),
    (re.compile("[A-Za-z0-9+/_-]{24,}={0,2}"), lambda m: m[0] if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]")) else None),
]


def near_groups(texts):
    """Smallest index of each text's group of 5-word Jaccard 0.8 or more."""

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return [find(i) for i in range(len(texts))]


def masked(docs):
    """Texts with the values that fewer than three owners or repositories hold cut out; copies of a text count once."""
    spans, holders = [], {}
    for d in docs:
        own = [(m.start(), m.end(), v) for p, value in PATTERNS for m in p.finditer(d["text"] or "") if (v := value(m))]
        spans.append(own)
        for _, _, v in own:
            key = v, d["text"]
            holders[key] = min(holders.get(key, (d["source"], d["lang"])), (d["source"], d["lang"]))
    spread = {}
    for (v, _), (source, lang) in holders.items():
        spread.setdefault(v, (set(), set()))[0].add(source)
        spread[v][1].add((source, lang))
    out = []
    for d, own in zip(docs, spans):
        text, at = "", 0
        for start, end, _ in sorted(s for s in own if min(map(len, spread[s[2]])) < 3):
            if start >= at:
                text += d["text"][at:start] + "[credential]"
            at = max(at, end)
        out.append(d["text"] if at == 0 else text + d["text"][at:])
    return out


def mixed(docs):
    """doc_id -> copies, by rounds of resharing and a walk through each source's documents in the order of their seeded hash."""
    size = {d["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", d["text"] or "")) for d in docs}
    sources = sorted({d["source"] for d in docs})
    total = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    target |= share
    copies = {}
    for s in sources:
        own = sorted((d["doc_id"] for d in docs if d["source"] == s), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest())
        whole, room = (int(target[s] // total[s]), int(target[s] - target[s] // total[s] * total[s])) if total[s] else (0, 0)
        for i in own:
            taken = min(size[i], room)
            room -= taken
            copies[i] = whole + (size[i] > 0 and 2 * taken >= size[i])
    return Counter({i: n for i, n in copies.items() if n})


def test_secret_stage_on_more_texts(spark):
    """The same table with secrets that one source holds, that several hold, and in copies."""
    docs = spark.createDataFrame(
        [(i, f'text {i % 40} with password = "{v}" and more', lang, source, 1) for i, (v, lang, source) in enumerate((f"Secret{i % 13}abc", "en" if i % 2 else None, f"s{i % (2 if i % 13 < 6 else 5)}") for i in range(200))],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    held = docs.orderBy("doc_id").collect()
    got = corpus_pipeline.secret_scan(spark, docs, "").orderBy("doc_id").collect()
    key = lambda d: {"text": d["text"], "source": d["source"] or "", "lang": d["lang"] or ""}
    assert [r["text"] for r in got] == masked([key(d) for d in held])
    assert len({"[credential]" in r["text"] for r in got}) == 2


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secret_scan", "mix", "encode"]
    held = {"": docs.orderBy("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, FOLDER), name)
        held[name] = docs.orderBy("doc_id").collect()
        if name != "encode":
            assert docs.columns == before.columns and docs.schema.simpleString() == before.schema.simpleString()
    # quality: by the labels; test_char_model holds perplexities and thresholds against brute force
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [i for i, v in labels.items() if v == (1, 0)]
    kept = {r["doc_id"] for r in held["quality"]}
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert sum(i in kept for i, v in labels.items() if v[0] == 0) <= 0.4 * sum(v[0] == 0 for v in labels.values())
    assert held["quality"] == [r for r in held[""] if r["doc_id"] in kept]
    groups = near_groups([r["text"] for r in held["quality"]])
    assert held["near_dedup"] == [r for i, r in enumerate(held["quality"]) if groups[i] == i]
    texts = masked(held["near_dedup"])
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in held["secret_scan"]] == [(r["doc_id"], t, len(t)) for r, t in zip(held["near_dedup"], texts)]
    assert Counter(r["doc_id"] for r in held["mix"]) == mixed(held["secret_scan"])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in held["mix"]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], r["source"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert Counter(tuple(r[c] for c in ("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")) for r in held["encode"]) == Counter(want)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, spans string, size long, ids string, row_no long"


def hard_rows():
    text = "the river runs over old stones and under trees"
    rows = [(i, f"{text} number {i} {'abc' * (i % 7)}", "en", "s1", 5) for i in range(60)]
    rows += [(None, None, None, None, None), (None, "lost", "en", None, 1), (100, None, "en", "s2", None), (101, "", None, "s2", 0), (102, text * 2000, "en", None, 9), rows[3], rows[3], (103, rows[4][1], "de", "s3", 4)]
    return [(*r, False, "x", 7, "y", 1) for r in rows]


def test_stages_with_nulls_and_repeats(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, None, None), (41, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (hard_rows(), []):
        docs = spark.createDataFrame(rows, DOCS)
        for name, step in corpus_pipeline.STAGES:
            before, docs = docs, stage(step(spark, docs, str(tmp_path)), name)
            if name != "encode":
                assert docs.columns == before.columns
        found = docs.collect()
        assert bool(found) == bool(rows)
        if rows:
            assert 103 not in {r["doc_id"] for r in found}  # a copy of document 4


def test_quality_keeps_columns_of_its_names(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"the river runs over old stones and under trees number {i}", "en", -i, "mine", 0.5, "fold") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, length int, keep string, perplexity double, __fold string")
    got = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert got.schema == docs.schema
    kept = got.collect()
    assert len(kept) >= 40 and set(map(tuple, kept)) <= set(rows)
