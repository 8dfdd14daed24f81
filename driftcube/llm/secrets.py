"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every text by pattern; each candidate's value is hashed
and the hashes are aggregated over the corpus by distinct repositories and
distinct owners.  Copies of one text count once, with the smallest of their
owners, so a document that was copied does not make its secrets look shared.  A
value that at least ``WIDE_OWNERS`` owners in ``WIDE_REPOSITORIES``
repositories hold is a widely copied example; all others are live-looking
credentials of their owners.  Besides the three base kinds, long mixed-case
strings with digits (kind ``owned``) are candidates; their counts tell which
of them somebody owns.  DataFrame functions only.

Matches become rows, a row a match, and their offsets are running sums over
the matches of one row and kind, so a text with very many matches costs no
more than in proportion.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcube.llm.common import stage, text_key, text_of

#: The kinds in their order, with pattern, group that is the secret and its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: The kind that the ownership frequency adds; a value needs both cases and a digit.
OWNED = "owned"
OWNED_PATTERN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
#: Owners and repositories from which on a value counts as a widely copied example; it takes both.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 3

#: What stands in a text for a live-looking credential.
MASK = "[credential]"

_ALL = (*KINDS.values(), (OWNED_PATTERN, 0, 24))


def _matches(text: Column, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """A pattern's leftmost non-overlapping matches in order: code points before the match and in it, whether it counts, hash of the value."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def one(m: Column) -> Column:
        good = F.length(m["value"]) >= least
        if kind_no == len(KINDS):
            good = good & m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]") & m["value"].rlike("[0-9]")
        return F.struct(F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("chars"), F.when(good, F.sha2(m["value"], 256)).alias("value_hash"))

    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast("array<struct<gap:int,chars:int,value_hash:string>>")
    return F.when(text.rlike(pattern), F.transform(zipped, one)).otherwise(none)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``found``: for each kind the matches in the text."""
    body = text_of(text)
    kinds = [F.struct(F.lit(i).alias("kind_no"), _matches(body, i, *kind).alias("matches")) for i, kind in enumerate(_ALL)]
    return docs.withColumn("found", F.filter(F.array(*kinds), lambda k: F.size(k["matches"]) > 0))


def spans_of(found: DataFrame) -> DataFrame:
    """(row_no, text_key, owner, repository, start, kind_no, end, value_hash), a row a match that counts."""
    rows = found.select("row_no", "text_key", "owner", "repository", F.explode("found").alias("k"))
    rows = rows.select("row_no", "text_key", "owner", "repository", "k.kind_no", F.posexplode("k.matches").alias("i", "m"))
    upto = F.sum((F.col("m.gap") + F.col("m.chars")).cast("long")).over(Window.partitionBy("row_no", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", upto).where("m.value_hash is not null")
    return rows.select("row_no", "text_key", "owner", "repository", (F.col("end") - F.col("m.chars")).alias("start"), "kind_no", "end", "m.value_hash")


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners) of every candidate value: distinct counts over the corpus, copies of one text counted once.

    (value, text, holder) is reduced before the shuffle too, so a value in a
    third of all rows arrives as one row for each task and text.
    """
    holder = F.min(F.struct("owner", "repository")).alias("holder")
    texts = spans.groupBy("value_hash", "text_key").agg(holder).select("value_hash", "holder.owner", "holder.repository").distinct()
    return texts.groupBy("value_hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(row_no, doc_id, spans) of every row of ``docs``.

    spans: array of (start, kind, end, live, repositories, owners) by start, then kind;
    offsets are code points, ends exclusive.  All findings stay, whatever their
    frequency; ``live`` tells owner-specific values from widely copied ones.

    By default a document's owner is its source and its repository the source
    with the language, as the table names nothing else.  So repositories lie
    within owners, and the number of owners alone decides; where the two are
    given and cross, both do.  Null ones count as one unnamed owner or
    repository.
    Null texts count as empty, and an empty text has no spans.  Texts are
    scanned whole, whatever their length.  Repeated rows and repeated ids are
    scanned each, row_no tells them apart; copies of one text count once in the
    frequencies.  Other columns are left out, an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *_holders(repository, owner), F.col(text).alias("text"))
    found = stage(_numbered(candidates(rows)).drop("text"), "candidates")
    per_row = _judged(spans_of(found))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return found.select("row_no", "doc_id").join(per_row, "row_no", "left").withColumn("spans", F.coalesce("spans", none))


def _holders(repository: Column | None, owner: Column | None) -> list[Column]:
    """Owner and repository as JSON, in which a null one differs from every name."""
    owner = F.col("source") if owner is None else owner
    repository = F.array("source", "lang") if repository is None else F.array(repository.cast("string"))
    return [F.to_json(F.array(owner.cast("string"))).alias("owner"), F.to_json(repository).alias("repository")]


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"text_key": text_key("text"), "row_no": F.monotonically_increasing_id()})


def _judged(spans: DataFrame) -> DataFrame:
    """(row_no, spans) of the rows with findings; a value in very many rows is a skewed key, which adaptive execution splits."""
    judged = spans.join(ownership(spans), "value_hash")
    kind = F.element_at(F.array(*map(F.lit, [*KINDS, OWNED])), F.col("kind_no") + 1)
    live = (F.col("owners") < WIDE_OWNERS) | (F.col("repositories") < WIDE_REPOSITORIES)
    span = F.struct("start", "kind_no", "end", kind.alias("kind"), live.alias("live"), "repositories", "owners")
    return judged.groupBy("row_no").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", repository: Column | None = None, owner: Column | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with every live-looking credential in the text replaced by ``mask``; all rows and columns stay.

    Overlapping findings are masked as one.  Widely copied examples and null
    texts stay as they are, repeated rows are masked each, an empty table gives
    an empty result.  Only texts in which some pattern is found are moved; the
    others pass by.  A text is cut at each of its findings, so one of very many
    live findings costs their number times its length.
    """
    names = docs.columns
    hit = reduce(or_, (text_of(text).rlike(kind[0]) for kind in _ALL))
    packed = docs.where(hit).select(*_holders(repository, owner), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    found = stage(_numbered(candidates(packed)), "scanned")
    live = _judged(spans_of(found.drop("text", "row"))).select("row_no", F.explode(F.filter("spans", lambda s: s["live"])).alias("s")).select("row_no", "s.start", "s.end", "s.kind_no")
    before = F.max("end").over(Window.partitionBy("row_no").orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("covered", F.coalesce(before, F.lit(0)))
    cuts = live.groupBy("row_no").agg(F.max("end").alias("last"), F.sort_array(F.collect_list(F.when(F.col("start") >= F.col("covered"), F.struct("start", "covered")))).alias("cuts"))
    joined = found.select("row_no", "row", "text").join(cuts, "row_no", "left")
    piece = lambda c: F.concat(F.substring(F.col("text"), (c["covered"] + 1).cast("int"), (c["start"] - c["covered"]).cast("int")), F.lit(mask))
    masked = F.concat(F.array_join(F.transform("cuts", piece), ""), F.substring(F.col("text"), (F.col("last") + 1).cast("int"), F.length("text")))
    clean = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(masked)
    changed = joined.select(*((clean if c == text else F.col(f"row.`{c}`")).alias(c) for c in names))
    return docs.where(~hit).union(changed)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
