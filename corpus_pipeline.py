"""A training-data pipeline over ``documents``: five stages, each an operator of ``driftcube.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; :func:`run` writes each stage's rows as Parquet to the shared folder and
reads them again for the next.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcube.llm import bpe, kneser_ney, mixing, near_copies, secrets, simhash
from driftcube.llm.common import prepare, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the Kneser-Ney classifier rejects.

    Null and empty texts are not judged and stay, long ones are judged whole,
    repeated rows and rows without an id each for themselves; a perplexity at a
    threshold stays.  Columns named like the model's own keep their values.  An
    empty table gives an empty one; without trusted documents all stay.
    """
    model = kneser_ney.Classifier(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named = {c: c if c in ("doc_id", "lang", "text") else f"__{i}" for i, c in enumerate(docs.columns)}
    judged = model.judged(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in named.items())), pooled=True).where("keep")
    return judged.select(*(F.col(x).alias(c) for c, x in named.items()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each component of texts whose 5-word shingles have a Jaccard index of 0.8 or more.

    Links come from the SimHash of these shingles by its byte-position index,
    tally and verification; what fingerprints can't tell is sought exactly
    between components.  Null and empty texts are alike and only each other's
    copies; long ones are compared whole; rows without an id stay only where no
    other of their component has one; of rows that repeat an id and a text one
    stays.  Other columns pass, whatever their names; an empty table gives an
    empty one.
    """
    return simhash.deduplicated(docs, found=near_copies.near_copies(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask live-looking credentials in the texts; widely copied examples stay. n_chars follows the text.

    All rows stay.  Null texts stay null, empty and clean ones as they are,
    long ones are scanned whole; overlapping findings are masked as one;
    repeated rows and rows without an id are masked each, and copies of a text
    count as one holder of its secrets.  Other columns pass, whatever their
    names; an empty table gives an empty one.
    """
    return secrets.redacted(docs).selectExpr(*(f"char_length(text) as {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns)).to(docs.schema)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources come to their target weights.

    Texts are never cut, however long.  Null and empty texts have no words and
    come in whole repetitions only; a null source is one of its own; ties of
    the seeded order go by id and size, rows alike in those are decided alike.
    Other columns pass, whatever their names; an empty table gives an empty one.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode the texts of the mix; one row for each of its documents.

    A null text counts as empty and has no tokens; long ones are encoded whole;
    repeated rows and rows without an id are rows of their own.  Other columns
    than doc_id and source are left out; an empty table gives an empty one.
    """
    coded = bpe.encode_texts(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "source", *bpe.digests())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix), ("encode", encode)]

#: SimHash components and the language model are iterations that SQL does not express; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
