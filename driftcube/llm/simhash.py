"""Near-duplicates by SimHash with a byte-position inverted index.

Fingerprints of 64 bits that differ in at most 2 bits share at least 6 of
their 8 positional bytes.  A posting of one byte alone would hold 1/256 of all
fingerprints at any size, so the inverted index posts four bytes at a time: of
the four byte pairs 2 differing bits leave two intact, hence 6 postings a
fingerprint find every link.  The postings in which a pair meets are counted:
1, 3 or 6 of them for 2, 3 or 4 shared byte pairs, which tallies 4, 6 or 8
shared bytes; to that come the bytes shared within the other byte pairs.  Pairs
that reach the guaranteed 6 bytes are verified bit by bit, each once.

A posting of more than ``CAP`` fingerprints emits no pairs.  Its members meet
at midpoints instead: two fingerprints are within 2 bits exactly if some
fingerprint is within 1 bit of both, and at most 65 are within 1 bit of any.
So nothing is dropped and no group's pairs are enumerated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from driftcube.llm.common import prepare, stage, text_key, with_columns_mapped
from driftcube.operators.components import components

#: Words of a shingle, seed of its hash, most differing bits of a link.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a posting that emits pairs; larger ones go by midpoints.
CAP = 32
#: Shared positional bytes that a link guarantees.
LEAST_SHARED = 8 - RADIUS


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes, as a signed long: a bit is 1 if it is set in over half of them; 0 without hashes."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):  # in blocks: a long text must not need 64 bytes a shingle at once
        block = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    """SimHash over the XXH64 of all 3-word shingles, as a signed long; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    return majority(np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def with_simhash(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``simhash`` (long) of column ``text``; a null text counts as empty. A column of that name is replaced."""
    prepare(df.sparkSession)
    return with_columns_mapped(
        df, [T.StructField("simhash", T.LongType())], lambda: lambda texts: ([fingerprint(t) for t in texts],), text
    )


def _postings(prints: DataFrame) -> DataFrame:
    """(slot, bytes, simhash): each fingerprint under its six choices of two byte pairs."""
    pair = [F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [
        F.struct(F.lit(slot).cast("byte").alias("slot"), (F.shiftleft(pair[i], 16) + pair[j]).alias("bytes"))
        for slot, (i, j) in enumerate(combinations(range(4), 2))
    ]
    return prints.select("simhash", F.explode(F.array(*keys)).alias("key")).select("key.slot", "key.bytes", "simhash")


def _tallied(pairs: DataFrame) -> DataFrame:
    """(a, b, shared): each of ``pairs``, which has a row a posting, once with its number of shared positional bytes.

    Whole byte pairs come from the count of postings.  A byte pair that no
    posting vouches for still shares a byte if one of its two is the same.
    """
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("postings"))
    whole = F.when(F.col("postings") >= 6, 4).when(F.col("postings") >= 3, 3).otherwise(2)
    byte = lambda i: F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), 8 * i).bitwiseAND(0xFF) == 0
    half = sum(((byte(2 * i) != byte(2 * i + 1)).cast("int") for i in range(4)), F.lit(0))
    return met.select("a", "b", (2 * whole + half).alias("shared"))


def links(prints: DataFrame, cap: int = CAP) -> DataFrame:
    """(a, b): pairs of distinct ``simhash`` values that connect all that differ in at most 2 bits.

    Small postings give every such pair; of large ones each midpoint's members
    are linked to the smallest, which connects the same fingerprints.  A pair
    that meets in large postings too is counted in its small ones only, so its
    tally may stay below the guarantee; the midpoints link it.
    """
    postings = _postings(prints)
    sizes = postings.groupBy("slot", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(postings.join(sizes, ["slot", "bytes"]), "postings")
    small = shared.where(F.col("n") <= cap).groupBy("slot", "bytes").agg(F.sort_array(F.collect_list("simhash")).alias("members"))
    pairs = small.select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b")).where("a < b")
    near = _tallied(pairs).where(F.col("shared") >= LEAST_SHARED)
    near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")

    crowded = shared.where(F.col("n") > cap).select("simhash").distinct()
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    meeting = crowded.select("simhash", F.explode(masks).alias("mask"))
    meeting = meeting.groupBy(F.col("simhash").bitwiseXOR(F.col("mask")).alias("z")).agg(F.sort_array(F.collect_list("simhash")).alias("members"))
    stars = meeting.where(F.size("members") > 1).select(F.col("members")[0].alias("a"), F.explode("members").alias("b")).where("a <> b")
    return near.union(stars)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", cap: int = CAP) -> DataFrame:
    """(doc_id, text_key, simhash, root, component_id) of every row of ``df``.

    component_id is the smallest doc_id that links reach, its own included, and
    root the smallest fingerprint.  Null texts count as empty; texts without
    words have fingerprint 0 and are linked like any other; long texts are read
    whole.  Rows with a null id keep it and get the smallest id of their
    component, or null.  Repeated rows stay; other columns are left out; an
    empty table gives an empty result.
    """
    own = with_simhash(df.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text")), "text")
    rows = stage(own.select("doc_id", "text_key", "simhash"), "simhash")
    prints = rows.groupBy("simhash").agg(F.min("doc_id").alias("first_id"))
    roots = stage(components(links(prints.select("simhash"), cap)), "roots")
    named = prints.join(roots, prints["simhash"] == roots["node"], "left").select("simhash", "first_id", F.coalesce("root", "simhash").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.select("simhash", "root").join(smallest, "root").select("simhash", "root", "component_id")
    return rows.join(labels, "simhash", "left").select("doc_id", "text_key", "simhash", "root", "component_id")


#: Documents that go or have copies of their own row, up to which their list is broadcast; beyond it it is joined by a shuffle.
BROADCAST_LISTED = 1_000_000


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` that stay: one of each component, that of the smallest doc_id; rows without an id come last.

    ``found`` (doc_id, text_key, root) are the components, by default those of
    :func:`near_duplicates`.  Of different texts under the smallest id one
    stays, by the hash of its text, and of rows that repeat id and text one,
    that whose columns are the smallest.  Null texts count as empty.  All
    columns stay; an empty table gives an empty result.

    What goes is listed by id and text, and only rows that repeat id and text
    are gathered; all others stay where they are.
    """
    found = stage(near_duplicates(df, doc_id, text) if found is None else found.select("doc_id", "text_key", "root"), "found")
    place = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_key")
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    placed = found.join(first, "root").groupBy("doc_id", "text_key").agg(F.max(place == F.col("first")).alias("stays"), F.count("*").alias("n"))
    listed = placed.where("not stays or n > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("stays").alias("__again"))
    listed = stage(listed, "listed")
    listed = F.broadcast(listed) if listed.count() <= BROADCAST_LISTED else listed
    own_id, own_key = F.col(doc_id).cast("long"), text_key(text)
    on = own_id.eqNullSafe(F.col("__id")) & (own_key == F.col("__key"))
    alone = df.join(listed, on, "left_anti")
    again = df.join(listed.where("__again"), on).groupBy("__id", "__key").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("row"))
    return alone.union(again.select(*(F.col(f"row.`{c}`") for c in df.columns)))
