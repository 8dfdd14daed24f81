"""Near copies by SimHash with a byte-position inverted index, and by an exact similarity join what it leaves apart.

Two texts are linked if the Jaccard index of their sets of 5-word shingles is
0.8 or more; a text of fewer words has one shingle, all of it.  Links are
sought by the SimHash of these sets first.  Its index posts three of the eight
positional bytes at a time, 56 postings a fingerprint, so fingerprints that
differ in at most 5 bits always meet.  A posting's members are held against one
of them, the text with most copies.  The postings in which a pair meets are
counted: 1, 4, 10, 20, 35 or 56 of them tally 3 to 8 shared bytes.  Pairs that
share no more than the three of their one posting meet by chance as a rule and
must be within 14 bits.  What is left is verified on the whole sets, and
components of the links label the texts.

Fingerprints don't hold the bound of 0.8: linked pairs of sf0.1 differ in 4 to 14
of 64 bits, and an index of so many is quadratic.  So texts of different labels
are sought by a prefix filter as well, which is exact: under
any order of all shingles, two sets of that likeness share one of their first
n - ceil(0.8 n) + 1, at places behind which enough of both sets is left.
Frequent shingles, as a sample shows them, come last in the order, so postings
stay short and what only one text has comes first.

Its postings emit no pairs within a group of copies either.  Members of
different labels are held against one text first; linked ones then have one
label, and only members of labels that still differ are held against each
other.  The links found connect exactly the texts that all links connect.
Every pair is held against the whole prefixes first, which tell what else the
two cannot share, and then verified on the whole sets; no posting is cut.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from driftcube.llm.common import prepare, release, stage, text_key, text_of, with_columns_mapped
from driftcube.llm.simhash import majority
from driftcube.operators.components import components

#: Words of a shingle, seed of its hash, least Jaccard index of a link as a fraction.
SHINGLE, SEED, PART, WHOLE = 5, 42, 4, 5
#: Positional bytes of a posting of the SimHash index, and most differing bits of a pair that shares no more bytes than these.
HELD, NEAR = 3, 14
#: One text in so many is in the sample that tells frequent shingles, texts of it that a frequent one is in at least, and most of these.
#: They only order the shingles; links don't depend on them. The sample grows with the input, so what is frequent doesn't.
SHARE, LEAST, FREQUENT = 4, 4, 1_000_000
#: Shingles that several texts share in their prefixes, and texts to be verified, up to which their lists are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SHARED, BROADCAST_LISTED = 2_000_000, 1_000_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, as signed longs."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # as of the SimHash
    if not words:
        return np.empty(0, np.int64)
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)], np.uint64).view(np.int64))


def _digest(hashes: np.ndarray) -> bytes:
    """128 bits by which equal sets meet: 64 would call some different ones copies among a billion."""
    return xxh3_128_digest(hashes.tobytes(), SEED) if len(hashes) else b""


def _text_sum() -> Column:
    """Bits of a text beside those of its key, so that different texts of one key stay apart."""
    return F.crc32(text_of().cast("binary"))


def prefix(hashes: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(0.8 n) + 1 hashes, those not in ``frequent`` (sorted) ascending, then the others by rank; and their places in that order of all shingles, to 31 bits."""
    n, places = len(hashes), (hashes >> 33).astype(np.int32)
    if n and len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        known = frequent[at] == hashes
        last = np.argsort(ranks[at[known]])
        hashes = np.concatenate((hashes[~known], hashes[known][last]))
        places = np.concatenate((places[~known], (1 << 30) + ranks[at[known]][last])).astype(np.int32)
    size = n + PART * n // -WHOLE + 1 if n else 0
    return hashes[:size], places[:size]


def _sets(texts: DataFrame) -> DataFrame:
    """``texts`` (column text, others stay) with the sorted ``hashes`` of each text in the place of the text."""
    field = T.StructField("hashes", T.ArrayType(T.LongType()))
    return with_columns_mapped(texts, [field], lambda: lambda values: ([shingles(t) for t in values],), "text", drop=["text"])


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles frequent in a sample of distinct texts, and their ranks by frequency."""
    sample = texts.where(F.pmod(text_key(), F.lit(SHARE)) == 0).distinct()
    counts = _sets(sample).select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    top = counts.orderBy(F.col("n").desc(), "hash").limit(FREQUENT).toArrow()  # at most FREQUENT rows
    hashes, n = top["hash"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(hashes)
    ranks = np.empty(len(hashes), np.int64)
    ranks[np.lexsort((hashes, n))] = np.arange(len(hashes))
    return hashes[order], ranks[order]


def _listed(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _possible(a: str, b: str) -> Column:
    """Whether lengths and places of a shared shingle leave room for a link between the sides named so."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    rest = F.least(n_a - F.col(f"at_{a}"), n_b - F.col(f"at_{b}"))
    return (WHOLE * F.least(n_a, n_b) >= PART * F.greatest(n_a, n_b)) & ((PART + WHOLE) * rest >= PART * (n_a + n_b))


def _side(postings: DataFrame, s: str, *more: str) -> DataFrame:
    return postings.select("hash", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "n", "at", *more)))


def _narrowed(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose prefixes leave room for a link.

    Up to the earlier end of two prefixes all that both sets hold is known: what
    they share there, and what is left of each behind it, bound all they share.
    Places are rounded, so those equal to the end's count as left, and hashes
    of one set that share a place count as shared, though the intersection
    holds their place once.
    """
    sides = [prints.select(F.col("row").alias(s), F.col("n").alias(f"n_{s}"), F.col("places").alias(f"p_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    end = F.least(F.element_at("p_a", -1), F.element_at("p_b", -1))
    shared = F.size(F.array_intersect("p_a", "p_b")) + F.size("p_a") - F.size(F.array_distinct("p_a"))
    rows = both.select("a", "b", "n_a", "n_b", "p_a", "p_b", end.alias("end"), shared.alias("shared"))
    left = [F.col(f"n_{s}") - F.size(F.filter(f"p_{s}", lambda p: p < F.col("end"))) for s in "ab"]
    return rows.where((PART + WHOLE) * (F.col("shared") + F.least(*left)) >= PART * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b) of the ``pairs`` whose whole sets are alike; ``prints`` leads to the texts."""
    pairs = stage(pairs, "candidates")
    near = stage(_narrowed(pairs, prints), "pairs")
    asked = near.select(F.col("a").alias("row")).union(near.select("b")).distinct()
    asked = prints.select("row", "text_key", "text_sum").join(asked, "row", "left_semi")
    asked = stage(asked.select("row", F.col("text_key").alias("__key"), F.col("text_sum").alias("__sum")), "asked")
    listed = _listed(asked, BROADCAST_LISTED)
    keys = ["__key", "__sum"]
    one = texts.select(text_key().alias("__key"), _text_sum().alias("__sum"), "text").join(listed.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("text").alias("text"))  # of copies one
    sets = stage(_sets(one.join(listed, keys).select("row", "text")), "sets")
    both = near.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = stage(both.where(WHOLE * common >= PART * (F.size("x") + F.size("y") - common)).select("a", "b"), "verified")
    release(pairs, near, asked, sets)
    return out


def met(prints: DataFrame) -> DataFrame:
    """(a, b, postings, bits): pairs of rows that meet in the SimHash index of ``prints`` (row, n, copies, simhash), in how many postings, and their differing bits.

    Sets of lengths that leave no room for a link don't meet, nor do empty
    ones.  A row meets the one of most copies in each of its postings, so pairs
    grow with the rows, whatever a posting holds.
    """
    masks = [sum(0xFF << 8 * i for i in held) for held in combinations(range(8), HELD)]
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks))
    postings = prints.where("n > 0").select("row", "n", "copies", "simhash", F.explode(masks).alias("mask"))
    postings = postings.withColumn("bytes", F.col("simhash").bitwiseAND(F.col("mask")))
    crowd = stage(postings.groupBy("mask", "bytes").agg(F.count("*").alias("m")).where("m > 1").select("mask", "bytes"), "crowded-bytes")
    shared = stage(postings.join(_listed(crowd, BROADCAST_SHARED), ["mask", "bytes"]), "shared-bytes")
    centre = shared.groupBy("mask", "bytes").agg(F.max(F.struct("copies", "row", "n", "simhash")).alias("c"))
    pairs = shared.join(centre, ["mask", "bytes"]).where((F.col("row") != F.col("c.row")) & (WHOLE * F.least("n", "c.n") >= PART * F.greatest("n", "c.n")))
    pairs = pairs.select(F.least("row", "c.row").alias("a"), F.greatest("row", "c.row").alias("b"), F.bit_count(F.col("simhash").bitwiseXOR(F.col("c.simhash"))).alias("bits"))
    out = stage(pairs.groupBy("a", "b").agg(F.count("*").alias("postings"), F.first("bits").alias("bits")), "met")
    release(crowd, shared)
    return out


def _apart(shared: DataFrame, near: DataFrame) -> DataFrame:
    """The ``shared`` postings that hold several labels, with the label ``root`` of each row: the smallest that links ``near`` lead to."""
    label = stage(components(near), "labels")
    labelled = shared.join(label.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    mixed = labelled.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("hash")
    out = stage(labelled.join(mixed, "hash"), "labelled-shingles")
    release(label)
    return out


def _star(rest: DataFrame) -> DataFrame:
    """(a, b): each row of the postings ``rest`` with that of most copies, where labels differ."""
    centre = rest.groupBy("hash").agg(F.max(F.struct("copies", "row", "n", "at", "root")).alias("c"))
    centre = centre.select("hash", *(F.col(f"c.{x}").alias(f"{x}_b") for x in ("row", "n", "at", "root")))
    star = _side(rest, "a", "root").join(centre, "hash").where((F.col("root_a") != F.col("root_b")) & _possible("a", "b"))
    return star.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def _cross(rest: DataFrame) -> DataFrame:
    """(a, b): all pairs of rows of the postings ``rest`` whose labels differ."""
    largest = rest.groupBy("hash", "root").agg(F.count("*").alias("m")).groupBy("hash").agg(F.max(F.struct("m", "root"))["root"].alias("largest"))
    others = rest.join(largest, "hash").where("root != largest")
    cross = _side(others, "a", "root").join(_side(rest, "b", "root"), "hash").where((F.col("root_a") != F.col("root_b")) & _possible("a", "b"))
    return cross.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b): rows of pairs of sets alike that connect all such pairs, from ``prints`` (row, n, simhash, prefix, places, text_key, text_sum, copies), a row a set, of ``texts``."""
    tallied = met(prints)
    near = _verified(tallied.where((F.col("postings") >= comb(HELD + 1, HELD)) | (F.col("bits") <= NEAR)).select("a", "b"), texts, prints)
    postings = prints.select("row", "n", "copies", F.posexplode("prefix").alias("at", "hash"))
    crowd = stage(postings.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1").select("hash"), "crowd")
    shared = stage(postings.join(_listed(crowd, BROADCAST_SHARED), "hash"), "shared-shingles")
    for pairs in (_star, _cross):  # what the fingerprints leave apart, exactly
        rest = _apart(shared, near)
        near = near.union(_verified(pairs(rest), texts, prints))
        release(rest)
    release(tallied, crowd, shared)
    return near


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, root, component_id) of every row of ``df``; component_id is the smallest doc_id that links reach, its own included.

    Null texts count as empty; texts without words are linked with each other
    only; long texts are read whole.  Rows with a null id keep it and get the
    smallest id of their component, or null.  Repeated rows stay; other columns
    are left out; an empty table gives an empty result.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = spark.sparkContext.broadcast(_frequent(rows.select("text")))

    def first():
        frequent, ranks = sent.value

        def batch(values):
            found = [shingles(t) for t in values]
            heads = [prefix(h, frequent, ranks) for h in found]
            return [_digest(h) for h in found], [len(h) for h in found], [majority(h) for h in found], [h for h, _ in heads], [p for _, p in heads]

        return batch

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("simhash", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))]
    made = with_columns_mapped(rows.withColumns({"text_key": text_key(), "text_sum": _text_sum()}), fields, first, "text", drop=["text"])
    made = stage(made.withColumn("row", F.monotonically_increasing_id()), "shingles")
    copied = stage(made.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "copied")
    prints = made.join(_listed(copied, BROADCAST_LISTED), "digest", "left").where("first is null or row = first").withColumn("copies", F.coalesce("copies", F.lit(1)))
    found = links(rows.select("text"), prints)
    roots = stage(components(found), "roots")
    ids = made.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"))
    named = ids.join(roots, ids["row"] == roots["node"], "left").select("digest", "first_id", F.coalesce("root", "row").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.select("digest", "root").join(smallest, "root").select("digest", "root", "component_id")
    return made.select("doc_id", "text_key", "digest").join(labels, "digest", "left").select("doc_id", "text_key", "root", "component_id")
