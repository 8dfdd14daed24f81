"""BPE encoding and decoding with a tokenization automaton.

The merges of a byte-level vocabulary are compiled into the automaton of
:mod:`automaton` by successive merge gadgets.  Pre-split words are encoded by
table-driven transitions: every byte's arc carries the token that ends there,
and walking back from the last one gives the word's tokens.  Decoding emits the
arc labels, the bytes of the tokens.
"""

from __future__ import annotations

import json
import re
from itertools import chain
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from driftcube.llm.automaton import Gadgets, MergeAutomaton
from driftcube.llm.common import prepare, with_columns_mapped

#: The split pattern, and the bytes that stand for themselves in byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Marks that the split pattern takes from letters as words of their own.
MARKS = frozenset(".,;:!?")
#: Below this character no two Unicode versions class characters otherwise.
OLD = "\u0220"


def byte_alphabet() -> dict[str, str]:
    """Character of a vocabulary file -> the byte it stands for, as a Latin-1 character."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {**{chr(b): chr(b) for b in PRINTABLE}, **{chr(256 + i): chr(b) for i, b in enumerate(others)}}


class ByteBpe:
    """Encoder and decoder of one vocabulary file of the ``tokenizers`` library (byte-level BPE)."""

    #: Words kept with their ids.  A full table takes no more until so many times as many words were missed, then starts anew.
    MEMO, PATIENCE = 300_000, 40

    def __init__(self, vocabulary: bytes, max_states: int = 320_000):
        spec = json.loads(vocabulary)
        self.alphabet = alphabet = str.maketrans(byte_alphabet())
        ranks: dict[tuple[str, str], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks[left.translate(alphabet), right.translate(alphabet)] = rank
        self.ids = {token.translate(alphabet): i for token, i in spec["model"]["vocab"].items()}
        self.automaton = MergeAutomaton(
            Gadgets(lambda a, b: ranks.get((a, b)), [a + b for a, b in ranks]),
            [t for t in self.ids if len(t) == 1],
            counts=False,
            max_states=max_states,
        )
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.labels = {i: token.encode("latin-1") for token, i in self.ids.items()} | {i: t.encode() for t, i in added.items()}
        #: Only splits, by the library's own character classes; its words come in the file's alphabet.
        self.split_any = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.split_latin = regex.compile(SPLIT).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.spaced: dict[str, tuple[int, ...]] = {}
        self.missed = 0

    def _split(self, text: str) -> list[str]:
        """Pre-split words of ``text`` as bytes, each a Latin-1 character."""
        if text.isascii():
            return self.split_latin(text)
        if max(text) < OLD:
            return [w.encode().decode("latin-1") for w in self.split_latin(text)]
        return [w.translate(self.alphabet) for w, _ in self.split_any(text)]

    def _keep(self, table: dict, key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        self.missed += 1
        if self.missed > self.MEMO * self.PATIENCE:
            self.missed = 0
            self.words.clear()
            self.spaced.clear()
        if len(table) < self.MEMO:
            table[key] = ids
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-split word, read backwards along the arcs' tokens."""
        found = self.words.get(word)
        if found is None:
            ending, ids = self.automaton.ending(word), self.ids
            out, at = [], len(ending)
            while at:
                token = ending[at - 1]
                out.append(ids[token])
                at -= len(token)
            out.reverse()
            found = self._keep(self.words, word, tuple(out))
        return found

    def _whole(self, text: str) -> list[int]:
        return list(chain.from_iterable([self._word(w) for w in self._split(text)]))

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of a part behind a space.  Letters alone are one word, and so is the punctuation mark behind them."""
        core, mark = part, ""
        if part[-1] in MARKS:
            core, mark = part[:-1], part[-1]
        if not core.isalpha() or not (core.isascii() or max(core) < OLD):
            return tuple(self._whole(" " + part))
        word = " " + core
        ids = self._word(word if core.isascii() else word.encode().decode("latin-1"))
        return ids + self._word(mark) if mark else ids

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        The split pattern never joins what stands on both sides of a space
        that follows a non-space, so spaces cut the text into parts that are
        looked up; where a part begins with white space or is empty, spaces
        may group otherwise and the whole text is split by the pattern.
        """
        first, *parts = text.split(" ")
        get, out = self.spaced.get, self._whole(first)
        for part in parts:
            ids = get(part)
            if ids is None:
                if not part or part[0].isspace():
                    return self._whole(text)
                ids = self._keep(self.spaced, part, self._part(part))
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[int, ByteBpe] = {}


def encode_texts(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``decoded`` (string) of column ``text``.

    A null text counts as empty: no ids, an empty decoded text.  Long texts are
    encoded whole.  Special strings of the vocabulary inside a text become
    their ids, as the library does by default.  Columns of ``df`` named ids or
    decoded are replaced; all others stay, repeated rows too; an empty table
    gives an empty result.  A Python worker holds one automaton and one memory
    of words, some 500 MB at most, so an executor needs that for each core.
    """
    spark = prepare(df.sparkSession)
    sent = spark.sparkContext.broadcast(Path(vocabulary_path).read_bytes())  # a file of fixed size
    key = hash(sent.value)

    def rows():
        codec = _loaded.get(key) or _loaded.setdefault(key, ByteBpe(sent.value))

        def batch(texts):
            ids = [codec.encode(t) if t else [] for t in texts]
            return ids, [codec.decode(x) for x in ids]

        return batch

    return with_columns_mapped(
        df,
        [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())],
        rows,
        text,
    )


def digests() -> list[Column]:
    """n_tokens, and the SHA-256 of the ids in decimal, comma-joined, and of the decoded text."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
