"""Quality classifier: perplexity under interpolated modified Kneser-Ney n-grams, between language-specific quantiles.

The models are those of :mod:`driftcube.llm.char_model`: order 4 over the
characters themselves, from all trusted documents that the labels name,
cross-fitted, so a trusted document is scored by a model that has not seen it.

A document stays if its perplexity lies between two thresholds.  Those come
from the trusted documents of its language: their log-perplexities are
standardized (distance from the language's median, times the square root of
the length, as a mean over n characters varies with 1 / sqrt(n)), and the
quantile of these distances, brought back to the document's length, gives the
lowest and the highest perplexity.  So short texts are not judged by chance
alone, and texts that are far too predictable (one word over and over) go like
those that are too surprising.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcube.llm import char_model
from driftcube.llm.common import prepare, stage

#: Most trusted ids that are broadcast to pick the texts of the fit; more of them are joined by a shuffle. All are used either way.
BROADCAST_TRUSTED = 200_000
#: Quantile of the trusted documents' distances, and the factor on it: up to there documents stay.
QUANTILE, MARGIN = 0.999, 1.2
#: Most languages whose thresholds are broadcast; beyond it they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id) of all documents labelled good and not toxic; repeated labels must agree on it, null labels count as bad."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    return good.select("doc_id")


def _distance(median: str) -> Column:
    return F.abs(F.col("surprise") - F.col(median)) * F.sqrt("length")


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """(lang, median, limit) from trusted (lang, surprise, length), a null language as an empty one, and one row (median, limit) of all.

    One rule for every language and for all together: the limit is the
    quantile of the standardized distances from the median, times ``margin``.
    """
    scored = stage(scored.where("surprise is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), "surprise", "length"), "trusted-scores")
    middle, limit = F.percentile_approx("surprise", 0.5, 10_000), F.percentile_approx("d", quantile, 100_000) * margin
    medians = scored.groupBy("lang").agg(middle.alias("median"))
    few = medians.count() <= BROADCAST_LANGUAGES
    off = scored.join(F.broadcast(medians) if few else medians, "lang").select("lang", "median", _distance("median").alias("d"))
    own = off.groupBy("lang").agg(F.first("median").alias("median"), limit.alias("limit"))
    every = scored.crossJoin(F.broadcast(scored.agg(middle.alias("median")))).select("median", _distance("median").alias("d"))  # one row
    return stage(own, "thresholds"), stage(every.agg(F.first("median").alias("median"), limit.alias("limit")), "pooled")


class Classifier:
    """The fitted models, and thresholds by language from all trusted documents, each scored by the model without its fold.

    Repeated rows of a trusted document are fitted and scored each; labels
    without a document and documents without a label do no harm.  Without any
    trusted text nothing is judged and every document stays.  Long texts are
    read whole, in Arrow batches of bounded rows and bytes.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, labels: DataFrame, most_grams: int = char_model.BROADCAST_GRAMS):
        """Fit on the documents that ``labels`` (doc_id, quality, toxic) names as good; ``most_grams`` bounds what is broadcast for scoring."""
        prepare(spark)
        self.most = most_grams
        known = stage(trusted(labels).select(F.col("doc_id").alias("__id")), "trusted")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
        rows = rows.join(F.broadcast(known) if known.count() <= BROADCAST_TRUSTED else known, F.col("doc_id") == F.col("__id")).drop("__id")
        self.model = char_model.tables(char_model.counts(rows, "text", char_model.fold("doc_id")))
        self.limits, self.pooled = thresholds(char_model.with_surprise(rows, "text", "doc_id", self.model, self.most))
        self.few = self.limits.count() <= BROADCAST_LANGUAGES

    def judged(self, docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", pooled: bool = False) -> DataFrame:
        """``docs`` with surprise, length, perplexity, lowest, highest and keep; columns so named are replaced.

        Documents whose perplexity is below ``lowest`` or above ``highest`` are
        not kept.  Documents of a language without trusted documents are judged
        by the median and limit of all languages if ``pooled``, else they stay.
        Null and empty texts have no perplexity and stay.  Repeated rows and
        rows without an id are judged each; an empty table gives an empty one.
        """
        docs = docs.drop("surprise", "length", "perplexity", "lowest", "highest", "keep")
        scored = char_model.with_surprise(docs, text, doc_id, self.model, self.most)
        own = self.limits.select(F.col("lang").alias("__lang"), F.col("median").alias("__m"), F.col("limit").alias("__t"))
        scored = scored.join(F.broadcast(own) if self.few else own, F.coalesce(F.col(lang), F.lit("")) == F.col("__lang"), "left")
        if pooled:
            every = self.pooled.select(F.col("median").alias("__every_m"), F.col("limit").alias("__every_t"))
            scored = scored.crossJoin(F.broadcast(every))  # one row
            scored = scored.withColumns({"__m": F.coalesce("__m", "__every_m"), "__t": F.coalesce("__t", "__every_t")}).drop("__every_m", "__every_t")
        off = F.when(F.col("length") > 0, F.col("__t") / F.sqrt("length"))
        scored = scored.withColumns({"perplexity": F.exp("surprise"), "lowest": F.exp(F.col("__m") - off), "highest": F.exp(F.col("__m") + off)})
        keep = F.coalesce(F.col("perplexity").between(F.col("lowest"), F.col("highest")), F.lit(True))
        return scored.withColumn("keep", keep).drop("__lang", "__m", "__t")
