"""Which atoms a segment covers, and what follows: reconciliation, descendants, conflicts, components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcube.config import DIMENSIONS
from driftcube.functions.keys import key_parts, normalize_dim_value
from driftcube.operators.components import components as connected
from driftcube.operators.ranks import with_rank
from driftcube.storage import stage


def atomic_coverage(segments: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(segment_id, atom_id): a segment covers the atoms that match all its dimensions.

    Each atom is masked in all 2^k ways; the masked ids are joined to the
    segments by id, instead of comparing every segment with every atom.
    """
    deepest = F.broadcast(segments.agg(F.max("slice_depth").alias("atom_depth")))
    atoms = segments.join(deepest).where("slice_depth = atom_depth").select(F.col("segment_id").alias("atom_id"), *dims)
    none = F.lit(None).cast("string")
    masks = [F.to_json(F.array(*(F.col(d) if keep else none for d, keep in zip(dims, how)))) for how in product((True, False), repeat=len(dims))]
    masked = atoms.select("atom_id", F.explode(F.array_distinct(F.array(*masks))).alias("segment_id"))
    return masked.join(segments.select("segment_id").distinct(), "segment_id", "left_semi").select("segment_id", "atom_id")


def candidate_covers_atomic(candidate: Mapping[str, object], atom: Mapping[str, object], dims: Sequence[str] = DIMENSIONS) -> bool:
    """Whether one segment covers one atom: every dimension that the segment fixes has the same value in the atom."""
    pairs = [(normalize_dim_value(candidate.get(d)), normalize_dim_value(atom.get(d))) for d in dims]
    return all(a is None or a == b for a, b in pairs)


def coverage_by_keys(segments: DataFrame) -> DataFrame:
    """(segment_id, atom_id) from ``segment_key`` alone, where the dimensions are not at hand.

    A segment covers the atoms whose parts include all of its own.  Unlike the
    factual coverage the total covers nothing, unless it is an atom itself.
    Each atom's part sets are joined to the segments' by value.
    """
    deepest = F.broadcast(segments.agg(F.max("slice_depth").alias("atom_depth")))
    parts = F.transform(key_parts(F.col("segment_key")), lambda p: F.concat_ws("=", p["dim"], p["value"]))
    rows = segments.select("segment_id", "slice_depth", F.sort_array(F.array_distinct(parts)).alias("parts")).join(deepest)
    atoms = rows.where("slice_depth = atom_depth").select(F.col("segment_id").alias("atom_id"), "parts")
    numbers = F.sequence(F.lit(0), (F.pow(F.lit(2), F.size("parts")) - 1).cast("int"))
    masked = atoms.withColumn("mask", F.explode(numbers))
    masked = masked.select("atom_id", F.expr("filter(parts, (p, i) -> (mask & shiftleft(1, i)) <> 0)").alias("parts"))
    covering = rows.where("size(parts) > 0 or slice_depth = atom_depth").select("segment_id", "parts")
    return masked.join(covering, "parts").select("segment_id", "atom_id").distinct()


def check_coverage(candidates: DataFrame, coverage: DataFrame) -> None:
    """An error for a coverage that cannot be right; a few ids of each fault reach the driver.

    Faults: ids or atoms that are no candidates, blank ones, repeated pairs,
    eligible segments without atoms, and atoms that do not cover themselves only.
    """
    ids = candidates.select("segment_id")
    atoms = candidates.where("is_atom").select(F.col("segment_id").alias("atom_id"))
    eligible = candidates.where("passes_initial_anomaly_filter").select("segment_id")
    faults = {
        "blank ids": coverage.where("coalesce(trim(segment_id), '') = '' or coalesce(trim(atom_id), '') = ''"),
        "unknown segments": coverage.join(ids, "segment_id", "left_anti"),
        "unknown atoms": coverage.join(atoms, "atom_id", "left_anti"),
        "repeated pairs": coverage.groupBy("segment_id", "atom_id").count().where("count > 1"),
        "no coverage": eligible.join(coverage, "segment_id", "left_anti"),
        "atoms that cover others": coverage.join(atoms.select(F.col("atom_id").alias("segment_id")), "segment_id").where("segment_id <> atom_id"),
    }
    for name, found in faults.items():
        if some := [r["segment_id"] for r in found.select("segment_id").limit(5).collect()]:
            raise ValueError(f"atomic coverage, {name}: {some}")


#: Values are added up as decimals of this type, which hold ``DIGITS`` digits behind the point; larger ones as doubles.
DIGITS = 12
EXACT = f"decimal(38,{DIGITS})"
#: What a double is off at most, as a share of it.
UNIT_ROUNDOFF = 2.0**-53


def reconciliation(panel: DataFrame, coverage: DataFrame) -> DataFrame:
    """(segment_id, cal_date, gmv, atom_gmv, error, rounding) of every segment above the atoms.

    Atoms are added up as decimals, so ``error`` does not grow with a sum's size
    nor depend on its order.  ``rounding`` is what the values may differ by
    although those that they were rounded from agree: half the distance of the
    doubles next to each, some 1e-4 at 1e12.  Both sums are null where the
    segment has no atoms, or one of its atoms has no row on that date.
    """
    deepest = F.broadcast(panel.agg(F.max("slice_depth").alias("atom_depth")))
    own = panel.join(deepest).where("slice_depth < atom_depth").select("segment_id", "cal_date", "gmv")
    atoms = panel.select(F.col("segment_id").alias("atom_id"), "cal_date", F.col("gmv").alias("atom_gmv"))
    held = F.col("atom_gmv").try_cast(EXACT)
    sums = coverage.join(atoms, "atom_id").groupBy("segment_id", "cal_date")
    sums = sums.agg(F.sum("atom_gmv").alias("plain"), F.when(F.count(held) == F.count("atom_gmv"), F.try_sum(held)).alias("exact"), F.sum(F.abs("atom_gmv")).alias("gross"), F.count("atom_gmv").alias("n"))
    sizes = coverage.groupBy("segment_id").agg(F.count("*").alias("size"))
    rows = own.join(sums, ["segment_id", "cal_date"], "left").join(sizes, "segment_id", "left").withColumn("apart", F.abs(F.col("gmv").try_cast(EXACT) - F.col("exact")).cast("double"))
    whole, both = F.col("n") == F.col("size"), UNIT_ROUNDOFF * (F.abs("gmv") + F.col("gross"))
    of_sum = F.when(F.col("apart").isNull(), both * (F.col("n") + 1)).otherwise(both + (F.col("n") + 1) * 0.5 * 10.0**-DIGITS)
    error = F.coalesce("apart", F.abs(F.col("gmv") - F.col("plain")))
    found = {"atom_gmv": F.coalesce(F.col("exact").cast("double"), "plain"), "error": error, "rounding": of_sum}
    return rows.select("segment_id", "cal_date", "gmv", *(F.when(whole, c).alias(name) for name, c in found.items()))


def check_reconciliation(panel: DataFrame, coverage: DataFrame, tolerance: float = 1e-4) -> None:
    """An error that names a segment without atoms, or whose value is not the sum of its atoms; and for what a panel must not hold.

    ``tolerance`` is for the values, whatever their size; what doubles of that
    size cannot tell apart (``rounding`` of :func:`reconciliation`) is no error.
    """
    if not 0 <= tolerance < float("inf"):
        raise ValueError(f"the tolerance must be finite and not negative: {tolerance}")
    if panel.isEmpty():
        raise ValueError("an empty panel cannot be reconciled")
    if coverage.isEmpty():
        raise ValueError("no segment has atomic coverage")
    if bad := panel.where(~F.coalesce(F.abs("gmv") < float("inf"), F.lit(False))).first():  # null, NaN or infinite
        raise ValueError(f"segment {bad['segment_id']} on {bad['cal_date']}: gmv is not a finite number")
    if bad := panel.groupBy("segment_id", "cal_date").count().where("count > 1").first():
        raise ValueError(f"segment {bad['segment_id']} on {bad['cal_date']} stands in the panel more than once")
    wrong = reconciliation(panel, coverage).where(F.col("error").isNull() | (F.col("error") - F.col("rounding") > tolerance))
    if bad := wrong.orderBy("segment_id", "cal_date").first():
        raise ValueError(f"segment {bad['segment_id']} on {bad['cal_date']}: {bad['gmv']} is not the sum of its atoms, {bad['atom_gmv']}")


def gross_movement(coverage: DataFrame, metrics: DataFrame) -> DataFrame:
    """(segment_id, gross_atomic): absolute changes of the covered atoms, added up."""
    moves = metrics.select(F.col("segment_id").alias("atom_id"), F.abs("wow_delta_gmv").alias("move"))
    return coverage.join(moves, "atom_id").groupBy("segment_id").agg(F.sum("move").alias("gross_atomic"))


def eligible_coverage(candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """Coverage of the segments that passed the initial filter, with their key and depth."""
    passed = candidates.where("passes_initial_anomaly_filter").select("segment_id", "segment_key", "slice_depth")
    return coverage.join(passed, "segment_id")


def descendants(eligible: DataFrame) -> DataFrame:
    """(segment_id, child_id): deeper segments all of whose atoms the segment covers.

    Whoever covers all atoms of a child covers its rarest one, so a child meets
    only the segments over that atom, and each such pair is verified once: by
    joining the child's other atoms, where it has any, with those of the pair.
    A child of one atom needs no more.
    """
    cover = eligible.select("segment_id", "slice_depth", "atom_id")
    over = cover.groupBy("atom_id").agg(F.count("*").alias("over"))
    sized = cover.join(over, "atom_id").groupBy("segment_id", "slice_depth")
    child = sized.agg(F.count("*").alias("size"), F.min(F.struct("over", "atom_id"))["atom_id"].alias("atom_id"))
    child = stage(child.select(F.col("segment_id").alias("child_id"), F.col("slice_depth").alias("child_depth"), "size", F.col("atom_id").alias("rarest")), "children")
    pairs = stage(cover.join(child, F.col("atom_id") == F.col("rarest")).where("child_depth > slice_depth").select("segment_id", "child_id", "size"), "candidates")
    single = pairs.where("size = 1").select("segment_id", "child_id")
    asked = pairs.where("size > 1").join(cover.select(F.col("segment_id").alias("child_id"), "atom_id"), "child_id")
    held = asked.join(cover.select("segment_id", "atom_id"), ["segment_id", "atom_id"], "left_semi").groupBy("segment_id", "child_id").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return single.union(held.where("n = size").select("segment_id", "child_id"))


def conflict_pairs(eligible: DataFrame) -> DataFrame:
    """(left_id, right_id, shared_atoms): segments that share atoms, the smaller key left."""
    left = eligible.select("atom_id", F.col("segment_id").alias("left_id"), F.col("segment_key").alias("left_key"))
    right = eligible.select("atom_id", F.col("segment_id").alias("right_id"), F.col("segment_key").alias("right_key"))
    pairs = left.join(right, "atom_id").where("left_key < right_key")
    return pairs.groupBy("left_id", "left_key", "right_id", "right_key").agg(F.count("*").alias("shared_atomic_count"), F.sort_array(F.collect_set("atom_id")).alias("shared_atomic_ids"))


def components(eligible: DataFrame) -> DataFrame:
    """(segment_id, component_id): segments connected by shared atoms; C001 holds the smallest key.

    Every atom links its segments to the one of the smallest key, and those
    links go to the component search.
    """
    rows = stage(eligible.select("segment_id", "atom_id", "segment_key"), "links")
    low = rows.groupBy("atom_id").agg(F.min("segment_key").alias("a"))
    roots = stage(connected(rows.join(low, "atom_id").select("a", F.col("segment_key").alias("b"))), "roots")
    found = rows.select("segment_id", "segment_key").distinct().join(roots, F.col("segment_key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "segment_key"))
    numbered = with_rank(found.select("root").distinct(), ["root"], "no")
    return found.join(numbered, "root").select("segment_id", F.format_string("C%03d", F.col("no")).alias("component_id"))


def dag_edges(segments: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(parent_key, child_key) between adjacent depths where the parent's values are among the child's.

    A child's parents are its key with one dimension taken away, so the join is by id.
    """
    none = F.lit(None).cast("string")
    up = [F.when(F.col(gone).isNotNull(), F.to_json(F.array(*(none if d == gone else F.col(d) for d in dims)))) for gone in dims]
    child = segments.where("slice_depth > 0").select(F.col("segment_key").alias("child_key"), F.explode(F.array_compact(F.array(*up))).alias("segment_id"))
    parent = segments.where("slice_depth > 0").select("segment_id", F.col("segment_key").alias("parent_key"))
    return child.join(parent, "segment_id").select("parent_key", "child_key").distinct()
