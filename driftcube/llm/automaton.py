"""Byte-pair merges compiled into a deterministic automaton.

Merges are applied as gadgets, one after another.  The gadget of merge number
``r`` (left, right -> product) does three things to the automaton that accepts
the tokenizations under the merges before it: the state behind ``left`` is
copied without its ``right`` arc, ``left`` arcs lead to that copy, and every
state with a ``left`` arc gets a ``product`` arc to where ``right`` led.  All
arcs of one token lead to one state, so a state is named by the token read
last, and a whole automaton is the log of its gadgets: :meth:`Gadgets.arc`
resolves an arc by replaying the gadgets that touch it, latest first.  Nothing
of the size states x tokens is ever held.

:class:`MergeAutomaton` turns that token automaton into a deterministic
transducer over symbols (bytes or characters).  A symbol state holds, for each
start position at which a vocabulary token may still be open, the trie node
reached, the token that ended there, and how many tokens fewer the prefix up to
there has.  Its arcs carry the token that ends at the symbol and the change of
the token count; they are compiled on first use and then only looked up.  Once
``max_states`` states are tabled, arcs into further states are built each time
and not kept, so memory is bounded while results never depend on what has been
compiled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

_NEVER = 1 << 60


class Gadgets:
    """The log of merge gadgets over single symbols.

    ``pair_rank(a, b)`` is the rank of merging tokens a and b, or None.
    ``tokens`` are the products; those that the merges do not produce from
    their own symbols can end no tokenization and are left out of
    ``reachable``.
    """

    def __init__(self, pair_rank: Callable[[str, str], int | None], tokens: Iterable[str]):
        self.pair_rank = pair_rank
        self.rank: dict[str, int] = {}
        self.split: dict[str, tuple[str, str]] = {}
        for token in tokens:
            if len(token) > 1 and (last := self._last_merge(token)):
                self.rank[token], self.split[token] = last
        self.reachable = frozenset(self.split)

    def _last_merge(self, token: str) -> tuple[int, tuple[str, str]] | None:
        """Rank and sides of the merge that completes ``token``; None if none does."""
        parts = list(token)
        while len(parts) > 1:
            ranks = [self.pair_rank(a, b) for a, b in zip(parts, parts[1:])]
            found = [(r, i) for i, r in enumerate(ranks) if r is not None]
            if not found:
                return None
            r, i = min(found)
            if len(parts) == 2:
                return r, (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return None

    def arc(self, left: str, right: str) -> bool:
        """Whether the state behind ``left`` has a ``right`` arc after all gadgets."""
        before, rank, split = _NEVER, self.rank, self.split
        while True:
            r = self.pair_rank(left, right)
            if r is not None and r < before:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if b >= a:  # the right token's gadget is the later one; ties go to the left pair
                before, right = b + 1, split[right][0]
            else:
                before, left = a, split[left][1]


class MergeAutomaton:
    """Deterministic transducer over symbols; see the module's text.

    An arc is ``(next state, token, change of the count)``.  A symbol outside
    the vocabulary has token None: it closes what is open and adds
    ``outside(symbol)`` to the count.  Without ``counts`` the changes are left
    out of the states, which are fewer then, and mean nothing.
    """

    def __init__(self, gadgets: Gadgets, singles: Iterable[str], outside: Callable[[str], int] = lambda symbol: 1, counts: bool = True, max_states: int = 60_000):
        self.gadgets, self.outside, self.counts, self.max_states = gadgets, outside, counts, max_states
        self.trie: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for token in {*singles, *gadgets.reachable}:
            node = 0
            for symbol in token:
                if symbol not in self.trie[node]:
                    self.trie[node][symbol] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                node = self.trie[node][symbol]
            self.ends[node] = token
        #: Symbols that stand side by side in some token; no merge crosses any other two.
        self.beside = {pair for token in gadgets.reachable for pair in zip(token, token[1:])}
        self.allowed: dict[tuple[str, str], bool] = {}
        self.start: dict = {None: ((0, None, 0),)}
        self.states = {self.start[None]: self.start}

    def _resolve(self, last: str, token: str) -> bool:
        if len(self.allowed) >= 8 * self.max_states:
            self.allowed.clear()
        found = self.allowed[last, token] = self.gadgets.arc(last, token)
        return found

    def compile_arc(self, state: dict, symbol: str) -> tuple[dict, str | None, int]:
        """Build and return the arc of ``state`` for ``symbol``; table it while there is room."""
        trie, ends, allowed = self.trie, self.ends, self.allowed
        opened, ended, change = [], None, 0
        for node, last, behind in state[None]:
            child = trie[node].get(symbol)
            if child is None:
                continue
            if last is not None and node == 0 and (last[-1], symbol) not in self.beside:
                last = None
            if ended is None and (token := ends[child]) is not None:
                fits = last is None or allowed.get((last, token))
                if fits is None:
                    fits = self._resolve(last, token)
                if fits:
                    ended, change = token, behind + 1
            if trie[child]:
                opened.append((child, last, behind))
        if ended is None:
            window, change = ((0, None, 0),), self.outside(symbol)
        else:
            if self.counts:
                opened = [(n, last, b - change) for n, last, b in opened]
            opened.append((0, ended, 0))
            window = tuple(opened)
        target = self.states.get(window)
        if target is None:
            target = {None: window}
            if len(self.states) >= self.max_states:
                return target, ended, change
            self.states[window] = target
        arc = state[symbol] = (target, ended, change)
        return arc

    def ending(self, word: str) -> list[str | None]:
        """For every prefix of ``word``, the last token of its tokenization."""
        state, out, arc_of = self.start, [], self.compile_arc
        for symbol in word:
            state, token, _ = state.get(symbol) or arc_of(state, symbol)
            out.append(token)
        return out

    def read(self, text: str, state: dict) -> tuple[dict, int]:
        """The state behind ``text``, read from ``state``, and the sum of its arcs' changes of the token count."""
        total, arc_of = 0, self.compile_arc
        for symbol in text:
            state, _, change = state.get(symbol) or arc_of(state, symbol)
            total += change
        return state, total

    def count(self, word: str) -> int:
        """Number of tokens of ``word``."""
        return self.read(word, self.start)[1]
