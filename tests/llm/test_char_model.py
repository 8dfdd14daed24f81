"""The classifier's character models against the textbook's recursion, and its thresholds against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from driftcube.llm import char_model, kneser_ney


def by_hand(texts):
    counts = {4: Counter(tuple(("   " + t)[i : i + 4]) for t in texts for i in range(len(t)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k in counts:
        m = [sum(c == i for c in counts[k].values()) for i in range(1, 5)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] else 0.5
        cut[k] = [min(max(i - (i + 1) * y * m[i] / m[i - 1] if m[i - 1] else 0.5 * i, char_model.LEAST_CUT), i) for i in (1, 2, 3)]
    followers = {k: {} for k in counts}
    for k, of in counts.items():
        for g, c in of.items():
            followers[k].setdefault(g[:-1], {})[g] = c

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 0x110000
        seen = followers[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        d = lambda c: cut[k][min(c, 3) - 1]
        total, c = sum(seen.values()), seen.get(gram, 0)
        return ((c - d(c)) if c else 0.0) / total + sum(map(d, seen.values())) / total * p(gram[1:])

    return p


def test_pieces_hold_all_grams():
    """However texts are cut, every character keeps the three before it."""
    texts = ["abracadabra", "", "x", "привет мир", "12345678"]
    number, ctx, c = char_model.grams(texts)
    want = list(zip(ctx[number].tolist(), c[number].tolist()))
    for most in (1, 2, 3, 7, 1000):
        got = []
        for group in char_model.pieces(texts, most):
            assert 0 < sum(len(p) for _, _, p in group) <= most
            number, ctx, c = char_model.grams([p for _, _, p in group], [b for _, b, _ in group])
            got += zip(ctx[number].tolist(), c[number].tolist())
        assert got == want


@pytest.mark.parametrize("most", [0, char_model.BROADCAST_GRAMS])
def test_against_recursion(spark, most):
    texts = ["abra cadabra, abra.", "Barbara ran!", None, "", "aaaa ббб", "Привет, мир", "привет 你好 \U0001f600", "12 AB 21"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, surprise string").repartition(3)
    folds = {r[0]: r[1] for r in df.select("doc_id", char_model.fold("doc_id")).collect()}
    assert len(set(folds.values())) > 1
    model = char_model.tables(char_model.counts(df, "text", char_model.fold("doc_id")))
    scored = char_model.with_surprise(df, "text", "doc_id", model, most)
    assert scored.columns == ["doc_id", "text", "surprise", "length"]
    got = {r["doc_id"]: r for r in scored.collect()}
    for i, t in enumerate(texts):
        assert got[i]["text"] == t and got[i]["length"] == len(t or "")
        if not t:
            assert got[i]["surprise"] is None
            continue
        p = by_hand([x for j, x in enumerate(texts) if x and folds[j] != folds[i]])
        want = -np.mean([np.log(p(tuple(("   " + t)[k : k + 4]))) for k in range(len(t))])
        assert got[i]["surprise"] == pytest.approx(want, rel=1e-5)
    assert char_model.with_surprise(df.limit(0), "text", "doc_id", model, most).collect() == []


def test_thresholds_against_brute_force(spark):
    """Perplexity, both thresholds and the decision, recomputed for rows of three scripts; the two ways of scoring agree."""
    draw = random.Random(8)
    words = {"en": ["the", "river", "runs", "over", "stones"], "ru": ["съешь", "ещё", "этих", "булок"], "zh": ["你好", "世界", "今天", "天气"]}
    rows = [(i, " ".join(draw.choice(words[lang]) for _ in range(draw.randint(5, 40))), lang) for i, lang in enumerate(draw.choices(list(words), k=90))]
    rows += [(200, "цфщъ жэыю гшхч " * 20, "ru"), (201, "鬱鬱鬱" * 60, "zh"), (202, "#@!%^&*" * 40, "xx"), (203, "stones " * 300, "en"), (204, None, "en"), (205, "", None), (None, rows[0][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    folds = {r[0]: r[1] for r in df.select("doc_id", char_model.fold("doc_id")).collect()}
    good = [r for r in rows if r[0] is not None and r[0] < 60]
    models = [by_hand([t for i, t, _ in good if folds[i] != f]) for f in range(char_model.FOLDS)]
    surprise = {i: -np.mean([np.log(models[folds[i]](tuple(("   " + t)[k : k + 4]))) for k in range(len(t))]) for i, t, _ in rows if t}
    limits = {}
    for lang in (*words, None):
        own = [(surprise[i], len(t)) for i, t, x in good if lang in (x, None)]
        middle = sorted(s for s, _ in own)[-(-len(own) // 2) - 1]
        far = sorted(abs(s - middle) * len_**0.5 for s, len_ in own)
        limits[lang] = middle, far[int(np.ceil(0.999 * len(far))) - 1] * 1.2
    both = [kneser_ney.Classifier(spark, df, labels, most_grams=most).judged(df, pooled=True).collect() for most in (0, 4_000_000)]
    listed = lambda found: sorted(map(repr, found))
    assert listed(both[0]) == listed(both[1])
    kept = {}
    for r in both[0]:
        kept[r["doc_id"]] = r["keep"]
        if not r["text"]:
            assert r["keep"] and r["perplexity"] is None
            continue
        middle, limit = limits.get(r["lang"], limits[None])
        off = limit / len(r["text"]) ** 0.5
        assert np.isfinite(r["perplexity"]) and r["perplexity"] == pytest.approx(np.exp(surprise[r["doc_id"]]), rel=1e-5)
        assert (r["lowest"], r["highest"]) == pytest.approx((np.exp(middle - off), np.exp(middle + off)), rel=1e-4)
        assert r["keep"] == (abs(surprise[r["doc_id"]] - middle) <= off)
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in (200, 201, 202, 203))
