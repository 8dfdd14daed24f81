"""Token counts by a compiled finite-state tokenizer.

The pieces of a sentencepiece BPE model become the deterministic transducer of
:mod:`automaton`, whose arcs are annotated with the change of the token count.
A text is cut into chunks.  A chunk's map sends each entry state to the exit
state and the tokens emitted in between; maps compose associatively, and a
parallel prefix scan over the maps of a text gives the count behind every chunk.

No piece joins a character with a space after it, so at such a space every
state moves to the same one.  Chunks begin at such spaces where there are any,
and then their maps are constant, one pair for all entry states.  In a text
without spaces chunks begin anywhere; their maps are tabled at the entry states
that occur, the first of which is told by reading a little of what stands
before the chunk, since states soon forget what was read long ago.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftcube.llm.automaton import Gadgets, MergeAutomaton
from driftcube.llm.common import prepare, with_columns_mapped

#: Fixed value: the character that stands for a space in the pieces.
SPACE = "▁"
#: A cut: before a space behind what is none.  A word: its spaces and what follows.
CUT, WORD = re.compile(f"[^{SPACE}](?={SPACE})"), re.compile(f"{SPACE}+[^{SPACE}]*")


class ChunkMap:
    """Entry state -> (exit state, tokens emitted), tabled as far as asked for; ``run`` computes an entry that is not.

    A constant map has one pair for all entry states.
    """

    def __init__(self, run: Callable[[dict], tuple[dict, int]], constant: bool = False):
        self.run, self.constant, self.table = run, constant, {}

    def __call__(self, state: dict) -> tuple[dict, int]:
        key = None if self.constant else state[None]
        found = self.table.get(key)
        if found is None:
            found = self.table[key] = self.run(state)
        return found


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of two chunks that follow each other."""

    def run(state: dict) -> tuple[dict, int]:
        between, first = a(state)
        after, second = b(between)
        return after, first + second

    return ChunkMap(run, a.constant)


def scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """All prefixes' maps, in log2(len(maps)) rounds of composing neighbours at doubling distance."""
    step = 1
    while step < len(maps):
        maps = [compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


class PieceCounter:
    """Counts the tokens of texts under one sentencepiece BPE model."""

    #: Words kept with their counts.  A full table takes no more until so many times as many words were missed, then starts anew.
    MEMO, PATIENCE = 250_000, 40
    #: Characters from which on a word is read and not kept, and characters read before a chunk to tell its entry state.
    LONG, LOOK_BACK = 64, 96

    def __init__(self, model: bytes, chunk: int = 16_384, max_states: int = 120_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece spans a space: words cannot be cut there")
        order = {s: r for r, s in enumerate(sorted(set(plain.values()), reverse=True))}
        rank = {p: order[s] for p, s in plain.items()}
        self.chunk = chunk
        self.automaton = MergeAutomaton(
            Gadgets(lambda a, b: rank.get(a + b), rank),
            [p for p in rank if len(p) == 1],
            outside=lambda c: len(c.encode()),  # byte fallback
            max_states=max_states,
        )
        self.words: dict[str, int] = {}
        self.missed = 0

    def _word(self, word: str) -> int:
        """Tokens of a word: spaces, at least one, and what follows up to the next space."""
        found = self.words.get(word)
        if found is None:
            found = self.automaton.count(word)
            self.missed += 1
            if self.missed > self.MEMO * self.PATIENCE:
                self.missed = 0
                self.words.clear()
            if len(self.words) < self.MEMO and len(word) < self.LONG:
                self.words[word] = found
        return found

    def maps(self, text: str) -> list[ChunkMap]:
        """Maps of the chunks of a text, in which spaces are SPACE and one stands in front."""
        at, out, start = 0, [], self.automaton.start
        while at < len(text):
            end = at + self.chunk
            cut = self._cut(text, end)
            fresh = self._is_cut(text, at)
            part = text[at : cut if cut is not None else end]
            if fresh:
                last = None if cut is not None else part.rfind(SPACE)  # the exit state matters only where no cut follows
                out.append(ChunkMap(lambda state, part=part, last=last: self._words(part, last), constant=True))
            else:
                entry, _ = self.automaton.read(text[max(0, at - self.LOOK_BACK) : at], start)
                out.append(ChunkMap(lambda state, part=part: self.automaton.read(part, state)))
                out[-1](entry)
            at += len(part)
        return out

    def _is_cut(self, text: str, at: int) -> bool:
        return at == 0 or (text[at] == SPACE and text[at - 1] != SPACE)

    def _cut(self, text: str, at: int) -> int | None:
        """The next place at which every state moves to the same one, if there is one within a chunk's length; the end is one."""
        if at >= len(text):
            return len(text)
        found = CUT.search(text, at, min(len(text), at + self.chunk))
        return found.start() + 1 if found else None

    def _words(self, part: str, last: int | None) -> tuple[dict, int]:
        """Exit state and tokens of a chunk that begins at a cut, by whole words; ``last`` is where its open last word may begin."""
        get, total, state = self.words.get, 0, self.automaton.start
        if last is not None:
            while last > 0 and part[last - 1] == SPACE:
                last -= 1
            state, total = self.automaton.read(part[last:], state)
            part = part[:last]
        for word in WORD.findall(part):
            total += get(word) or self._word(word)
        return state, total

    def count(self, text: str) -> int:
        """Tokens of ``text`` without begin and end tokens; 0 for an empty one."""
        if not text:
            return 0
        return scan(self.maps(SPACE + text.replace(" ", SPACE)))[-1](self.automaton.start)[1]


_loaded: dict[int, PieceCounter] = {}


def count_tokens(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` (long) of column ``text``; a null or empty text has 0 tokens.

    Texts are read whole, whatever their length, with spaces or without.  A
    column of ``df`` named n_tokens is replaced; all others stay, repeated rows
    too; an empty table gives an empty result.
    """
    spark = prepare(df.sparkSession)
    sent = spark.sparkContext.broadcast(Path(model_path).read_bytes())  # a file of fixed size
    key = hash(sent.value)

    def rows():
        counter = _loaded.get(key) or _loaded.setdefault(key, PieceCounter(sent.value))
        return lambda texts: ([counter.count(t) if t else 0 for t in texts],)

    return with_columns_mapped(df, [T.StructField("n_tokens", T.LongType())], rows, text)
