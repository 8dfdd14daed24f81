"""Filter interaction audit: every order of a few filters, run as a trie whose equal prefixes are one state.

What a prefix of filters leaves does not depend on their order, so the trie of
all orders has one state for each set of filters.  States are visited depth
first; each is the table of the rows that survived, written to shared storage
once, from the survivors of the state that it was first reached from, and held
under its unordered set.  Every edge (state, next filter) counts what that
filter removes from the survivors in fact.  Orders, steps and Shapley sums are
put together from the edges, part by part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftcube.llm.byte_words import separators, words
from driftcube.llm.common import prepare, stage, text_of, with_columns_mapped

#: Production parameters of the filters, by letter: least words; least distinct words in 100; most capitals in 100 code points; banned characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, BANNED = 50, 65, 5, "#$%&*|"
FILTERS = ("A", "B", "C", "D", "E")
#: Most filters of an audit: it writes a table for each of their sets.
MOST_FILTERS = 8
#: Rows up to which a side of a join is broadcast, counted before; and the share of all rows from which on a key is joined apart.
BROADCAST_ROWS, HOT = 500_000, 1000

_BLANK = separators("".join(chr(c) for c in range(128) if not (c == 32 or 9 <= c <= 13)))
_CAPITALS, _BANNED = bytes(range(65, 91)), BANNED.encode()
_INNER = bytes(range(0x80, 0xC0))  # bytes within a character, none of its own


def _verdict(text: bytes) -> tuple[bool, bool, bool, bool, bytes]:
    """Whether a text fails A, B, C, D, and a digest by which equal texts meet."""
    n, distinct = 0, set()
    for piece in words(text, _BLANK):
        n += len(piece)
        distinct.update(piece)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    banned = len(text.translate(None, _BANNED)) < len(text)
    return n < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, banned, hashlib.blake2b(text, digest_size=16).digest()


def join_unique(rows: DataFrame, side: DataFrame, key: str, most: int = BROADCAST_ROWS, hot: int = HOT) -> DataFrame:
    """``rows`` left-joined with ``side``, which has one row a key; both are staged tables.

    A side of at most ``most`` rows is broadcast.  Beyond it keys that hold
    more than 1/``hot`` of all rows, so at most ``hot`` of them, meet a
    broadcast part of the side, the others are shuffled, and rows without a
    key, which match nothing, stay where they are.
    """
    if side.count() <= most:
        return rows.join(F.broadcast(side), key, "left")
    known = rows.where(F.col(key).isNotNull())
    large = known.groupBy(key).count().where(F.col("count") > rows.count() / hot).select(key)
    large = F.broadcast(stage(large, "hot-keys"))  # at most ``hot`` rows
    apart = known.join(large, key, "left_semi").join(F.broadcast(side.join(large, key, "left_semi")), key, "left")
    others = known.join(large, key, "left_anti").join(side, key, "left")
    return others.unionByName(apart).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def verdicts(docs: DataFrame, labels: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every document: which filters it fails, and its labels.

    A: too few words; B: too few distinct ones; C: too many capitals; D: a
    banned character; E: the text of a smaller doc_id, anywhere in the table.
    A null text is empty, a null source the part ''.  Rows without an id fail E
    never and have no label; rows that repeat an id are rows of their own, and
    none is the other's copy by E.  A document is good or toxic if any of its
    labels says so; one without labels is neither.  Texts are read whole, a
    bounded piece at a time.  Other columns are left out; an empty table gives
    an empty one.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    fields = [*(T.StructField(c, T.BooleanType()) for c in FILTERS[:4]), T.StructField("digest", T.BinaryType())]
    rows = stage(with_columns_mapped(rows, fields, lambda: lambda texts: tuple(zip(*map(_verdict, texts))) or ([],) * 5, "text", drop=["text"]), "verdicts")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = join_unique(rows, stage(copies, "copies"), "digest", most)
    rows = rows.select("part", "doc_id", *FILTERS[:4], F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("E"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = join_unique(stage(rows, "unlabelled"), stage(known, "labels"), "doc_id", most)
    return rows.select("part", *FILTERS, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def states(rows: DataFrame, filters: Sequence[str]) -> dict[frozenset, DataFrame]:
    """The survivors of each set of filters that has a filter after it, by depth first; each is written once."""
    found = {frozenset(): stage(rows, "survivors")}

    def descend(passed: frozenset) -> None:
        for step in filters:
            reached = passed | {step}
            if reached != passed and reached not in found and len(reached) < len(filters):
                found[reached] = stage(found[passed].where(~F.col(step)), "survivors")
                descend(reached)

    descend(frozenset())
    return found


def audit(rows: DataFrame, filters: Sequence[str] = FILTERS, part: str = "part", marks: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, lost by mark, shapley) of every order of ``filters``.

    ``rows`` has a part, a column for each filter that says whether a row fails
    it, and boolean ``marks``; none of them null.  ``redundant`` rows fail the
    step's filter, but were removed before it; ``unique_fails`` fail only it;
    ``shapley`` sums what the filter removes over all orders.  Parts are those
    of ``rows``: an empty table gives no row, a part whose rows are all removed
    gets zeros.  A part of most rows is counted by task first.  Filter names
    must not hold ``|`` or ``>``.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    tables = states(rows.select(part, *filters, *marks), filters)
    survivors = None
    for passed, table in tables.items():
        own = table.select(F.lit("|".join(sorted(passed))).alias("state"), F.array(*map(F.lit, sorted(set(filters) - passed))).alias("ahead"), *table.columns)
        survivors = own if survivors is None else survivors.unionByName(own)
    counts = lambda f: F.struct(F.count("*").alias("n"), F.count_if(F.col(f)).alias("removed"), *(F.count_if(F.col(f) & F.col(m)).alias(m) for m in marks))
    entry = lambda f: F.struct(F.concat("state", F.lit(f">{f}")).alias("edge"), F.col(f"counts>{f}").alias("counts"))
    counted = survivors.groupBy("state", "ahead", part).agg(*(counts(f).alias(f"counts>{f}") for f in filters))
    edges = stage(counted.select(part, F.explode(F.filter(F.array(*map(entry, filters)), lambda e: F.array_contains("ahead", F.substring_index(e["edge"], ">", -1)))).alias("e")), "edges")
    by_part = edges.groupBy(part).agg(F.map_from_entries(F.collect_list("e")).alias("edges"))  # an entry for each edge that has rows
    orders = F.array(*(F.array(*map(F.lit, order)) for order in permutations(filters)))
    out = by_part.withColumn("order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    out = out.withColumn("filter", F.element_at("order", F.col("step")))
    key = lambda passed: F.concat(F.array_join(F.array_sort(passed), "|"), F.lit(">"), F.col("filter"))
    at = {"here": key(F.slice("order", 1, F.col("step") - 1)), "first": key(F.array().cast("array<string>")), "last": key(F.array_except("order", F.array("filter")))}
    out = out.withColumns({name: F.try_element_at("edges", k) for name, k in at.items()})
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed: Column = n("here.removed")
    out = out.select(
        part, F.array_join("order", "").alias("filter_order"), "step", "filter", (n("here.n") - removed).alias("kept"), removed.alias("removed"),
        (n("first.removed") - removed).alias("redundant"), n("last.removed").alias("unique_fails"), *(n(f"here.{m}").alias(f"{m}_lost") for m in marks),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy(part, "filter")))  # rows of a part: orders times filters
