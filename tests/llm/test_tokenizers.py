"""The automaton's encoder and counter against the libraries that own the vocabularies."""

import random

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from driftcube.llm import bpe, token_counts
from driftcube.llm.automaton import Gadgets, MergeAutomaton

ODD = "abcde <|>/s\n▁éñüß漢字😀01239ing the's're \t　 \xa0\r،ہा̈①²ⅷ٣\x00"
FIXED = ["", " ", "  ", " a", "a ", "a  b", "a\n \nb", "a \n b", "\n ", "x\n\n y", "<|endoftext|>a b<|endoftext|><|endoftext|>", " <|endoftext|> ", "</s><s> <unk>", "▁", "a▁b ▁ c", "a" * 3000, "é" * 500 + " " * 40]


def texts(n=1500):
    draw = random.Random(11)
    small = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 40))) for _ in range(n)]
    any_char = lambda: chr(draw.choice([draw.randrange(32, 0xD800), draw.randrange(0xE000, 0x20000)]))
    wide = ["".join(any_char() if draw.random() < 0.7 else " " for _ in range(20)) for _ in range(n)]
    return FIXED + small + wide


@pytest.fixture(scope="module")
def byte_bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.ByteBpe(open(path, "rb").read(), max_states=500), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return open(path, "rb").read(), sentencepiece.SentencePieceProcessor(model_file=path)


def test_bpe_equals_library(byte_bpe):
    own, library = byte_bpe
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), text


@pytest.mark.parametrize("chunk", [1, 7, 16_384])
def test_counts_equal_library(pieces, chunk):
    model, library = pieces
    counter = token_counts.PieceCounter(model, chunk=chunk, max_states=500)
    for text in texts():
        assert counter.count(text) == len(library.encode(text)), text


def test_chunk_maps_compose(pieces):
    draw = random.Random(3)
    for text in ("the quick brown fox\njumps over the lazy dogs again and again", "".join(draw.choice("abcdeghinorst") for _ in range(400)), "▁▁a  b" * 30):
        counter = token_counts.PieceCounter(pieces[0], chunk=5)
        marked = token_counts.SPACE + text.replace(" ", token_counts.SPACE)
        maps, start = counter.maps(marked), counter.automaton.start
        a, b, c = maps[:3]
        for state in (start, counter.automaton.read("▁th", start)[0], counter.automaton.read("▁ab", start)[0]):
            assert token_counts.compose(token_counts.compose(a, b), c)(state) == token_counts.compose(a, token_counts.compose(b, c))(state)
        whole = counter.automaton.read(marked, start)[1]
        assert token_counts.scan(maps)[-1](start)[1] == whole
        prefixes, at, total = token_counts.scan(maps), start, 0
        for m, prefix in zip(maps, prefixes):
            at, n = m(at)
            total += n
            assert prefix(start)[1] == total


def test_maps_from_any_entry(pieces):
    """A chunk that begins inside a word sends each entry state where reading it from there leads."""
    counter = token_counts.PieceCounter(pieces[0], chunk=50)
    draw = random.Random(12)
    text = "▁" + "".join(draw.choice("abcdeghinorst") for _ in range(300))
    maps = counter.maps(text)
    assert len(maps) == 7 and [m.constant for m in maps] == [True] + [False] * 6
    for before in ("▁", "▁the", "▁inter", "xyz", text[:50]):
        state = counter.automaton.read(before, counter.automaton.start)[0]
        assert maps[1](state) == counter.automaton.read(text[50:100], state)


def test_a_million_characters_without_spaces(pieces):
    model, library = pieces
    draw = random.Random(6)
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789+/漢字") for _ in range(1_000_000))
    counter = token_counts.PieceCounter(model)
    maps = counter.maps(token_counts.SPACE + text)
    assert len(maps) == 62 and not any(m.constant for m in maps[1:])
    assert counter.count(text) == len(library.encode(text))


def test_memory_bound_changes_nothing(pieces):
    small, large = token_counts.PieceCounter(pieces[0], max_states=1), token_counts.PieceCounter(pieces[0])
    small.MEMO = 3
    words = ["theaores", "ingtionation", "xq9z", "ééé"] * 3
    assert [small.count(w) for w in words] == [large.count(w) for w in words]
    assert len(small.words) <= 3 and len(small.automaton.states) == 1


def test_arcs_against_rerun_of_merges():
    draw = random.Random(5)
    for _ in range(40):
        ranks, tokens = {}, list("abc")
        for r in range(12):
            pair = draw.choice(tokens), draw.choice(tokens)
            if pair not in ranks and "".join(pair) not in tokens:
                ranks[pair] = r
                tokens.append("".join(pair))

        def merged(word):
            parts = list(word)
            while found := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]:
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return parts

        automaton = MergeAutomaton(Gadgets(lambda a, b: ranks.get((a, b)), tokens), "abc")
        for _ in range(60):
            word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 14)))
            assert automaton.count(word) == len(merged(word)), (ranks, word)


def test_columns_of_the_operators(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "hello <|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode_texts(df, public_tokenizers.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [r["ids"] for r in coded[:3]] == [[], [], []] and coded[3]["ids"][-1] == 50256 and coded[3]["decoded"] == rows[3][1]
    counted = token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in counted[:3]] == [0, 0, 0] and counted[3]["ids"] is None
    assert bpe.encode_texts(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
