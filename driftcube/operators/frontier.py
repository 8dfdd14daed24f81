"""Exact packing of components of any size: a frontier of partial choices as a table.

Prices of atoms (:mod:`driftcube.operators.certificate`) turn a packing's score
into what it loses against their bound: the surplus of a segment left out, the
overcharge of one taken, the price of an atom that nobody covers.  No loss is
negative, so whatever loses more than the known packing does is out.

* A first packing comes from rounds of joins: a segment that is the best over
  each of its atoms is taken, and what shares atoms with it goes.
* Segments whose own overcharge is too much are left out, those that cannot be
  left out are taken, and what remains falls into parts without common atoms,
  each held to its own loss.
* The parts are decided together, a few segments a step.  A state is what a
  choice holds of the atoms that later segments need; states that hold the same
  are merged into the best.  States are dealt by what they hold, so a part's
  frontier is spread over all tasks.
* Where a part has more than ``width`` states, those of the least loss are
  followed, which gives a better packing but no proof; the part comes back,
  priced by that packing, with a wider frontier.  What no frontier has decided
  as a whole is never taken for proven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftcube.operators.certificate import prices_of
from driftcube.operators.components import components
from driftcube.operators.ranks import with_rank
from driftcube.storage import release, stage

#: Segments decided in one step, states of a part that are all followed at first, passes before it is an error.
STEP, WIDTH, PASSES = 8, 4_000, 8
#: Rounds of prices before a pass.
ROUNDS = 20
#: Sums that differ by less, absolute or of the part's scores, are ties, for the rule of fewest segments, then lowest keys.
TIE = 1e-9
#: Powers of a segment's number of atoms by which its score is divided to choose the first packing.
POWERS = (0.0, 0.5, 1.0)

_STATE = "array<struct<used:array<string>,loss:double,score:double,names:array<string>>>"


class NotProven(RuntimeError):
    """Frontiers of all widths that were tried left some part undecided."""


def pack_frontier(segments: DataFrame, coverage: DataFrame, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """(component_id, segment_id, selected) of every row of ``segments``, the best set of disjoint segments of each component.

    ``segments`` has component_id, segment_id, segment_key (both unique) and
    anomaly_score; ``coverage`` (segment_id, atom_id).  Scores that are null or
    not positive are never selected; a segment without coverage conflicts with
    nothing.  Of sets that tie the one of fewest segments counts, then that of
    the lowest keys.  No rows give no rows.  A component that no pass proves is
    an error.  The driver sees numbers of rows only.
    """
    score = F.col("anomaly_score").cast("double")
    rows = stage(segments.select("component_id", "segment_id", "segment_key", score.alias("score")), "scored")
    atoms = stage(coverage.select("segment_id", "atom_id").distinct().join(rows.where("score > 0").select("segment_id"), "segment_id"), "covered")
    alone = rows.where("score > 0").join(atoms, "segment_id", "left_anti").select("segment_id")
    found = [alone]
    problem = rows.join(atoms.select("segment_id").distinct(), "segment_id")
    first = first_packing(problem, atoms)
    problem = stage(problem.join(first.withColumn("selected", F.lit(True)), "segment_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False))), "problem")
    for _ in range(PASSES):
        taken, parts = _reduced(problem, atoms)
        best = _decided(parts, width, step)
        done = best.where("not cut").select(F.explode("names").alias("segment_key"))
        found += [taken, parts.select("segment_id", "segment_key").join(done, "segment_key").select("segment_id")]
        open_ = parts.join(best.where("cut").select("part", "names"), "part")
        again = open_.select(F.col("part").alias("component_id"), "segment_id", "segment_key", "score", F.array_contains("names", F.col("segment_key")).alias("selected"))
        problem = stage(again, "problem")
        if problem.isEmpty():
            break
        width *= 4
    else:
        raise NotProven(f"no optimum proven of {problem.select('component_id').distinct().count()} parts with frontiers of {width // 4} states")
    chosen = found[0]
    for more in found[1:]:
        chosen = chosen.union(more)
    chosen = chosen.withColumn("selected", F.lit(True))
    out = rows.join(chosen, "segment_id", "left").select("component_id", "segment_id", F.coalesce("selected", F.lit(False)).alias("selected"))
    return stage(out, "packed")


def first_packing(rows: DataFrame, atoms: DataFrame) -> DataFrame:
    """(segment_id) of a packing that is not the best, but cannot be added to: for each component the best of three orders."""
    sized = atoms.join(rows.select("component_id", "segment_id", "score"), "segment_id").join(atoms.groupBy("segment_id").agg(F.count("*").alias("n")), "segment_id")
    tries = F.explode(F.array(*(F.struct(F.lit(i).alias("try"), (F.col("score") / F.pow("n", F.lit(p))).alias("weight")) for i, p in enumerate(POWERS))))
    left = stage(sized.withColumn("t", tries).select("component_id", "segment_id", "atom_id", "score", "t.try", "t.weight"), "greedy")
    won = []
    while not left.isEmpty():
        top = left.groupBy("try", "atom_id").agg(F.max(F.struct("weight", "segment_id"))["segment_id"].alias("top"))
        over = left.join(top, ["try", "atom_id"]).groupBy("try", "component_id", "segment_id", "score").agg(F.min(F.col("top") == F.col("segment_id")).alias("wins"))
        winners = stage(over.where("wins").select("try", "component_id", "segment_id", "score"), "winners")
        won.append(winners)
        hit = left.join(winners.select("try", "segment_id"), ["try", "segment_id"], "left_semi").select("try", "atom_id")
        gone = left.join(hit, ["try", "atom_id"], "left_semi").select("try", "segment_id").distinct()
        earlier, left = left, stage(left.join(gone, ["try", "segment_id"], "left_anti"), "greedy")
        release(earlier)
    if not won:
        return rows.select("segment_id").limit(0)
    every = won[0]
    for more in won[1:]:
        every = every.union(more)
    sums = every.groupBy("component_id", "try").agg(F.sum("score").alias("sum"))
    best = sums.groupBy("component_id").agg(F.max(F.struct("sum", -F.col("try")))["sum"].alias("sum"), F.max_by("try", F.struct("sum", -F.col("try"))).alias("try"))
    return every.join(best.select("component_id", "try"), ["component_id", "try"], "left_semi").select("segment_id")


def _budgets(rows: DataFrame) -> DataFrame:
    """(part, budget): what the known packing of a part loses, and a little for ties."""
    return rows.groupBy("part").agg((F.sum("short") + TIE * F.greatest(F.lit(1.0), F.sum("score"))).alias("budget"))


def _reduced(problem: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken, parts): segment_id of segments that every best packing holds, and a row each segment still open.

    Parts have part, segment_id, segment_key, score, selected, short and paid
    (what leaving out and taking it loses), budget, and ``atoms``, an array of
    (atom_id, price).
    """
    packing = problem.select("component_id", "segment_id", F.col("score").alias("anomaly_score"), "selected")
    _, prices, short = prices_of(packing, atoms, rounds=ROUNDS)
    cover = atoms.join(problem.select("segment_id", "score"), "segment_id").join(prices.select("atom_id", "price"), "atom_id", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
    cover = stage(cover.select("segment_id", "atom_id", "price"), "priced")
    over = cover.groupBy("segment_id").agg(F.sum("price").alias("charge"))
    rows = problem.join(over, "segment_id").join(short.select("segment_id", "short"), "segment_id", "left")
    paid = F.when(F.col("selected") | (F.col("short") > 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("charge") - F.col("score")))
    rows = stage(rows.withColumn("short", F.coalesce("short", F.lit(0.0))).withColumn("paid", paid).withColumnRenamed("component_id", "part").drop("charge"), "open")
    taken = []
    while True:
        open_ = rows.join(_budgets(rows), "part").where("paid <= budget")
        held = cover.join(open_.select("part", "segment_id", "short", "budget"), "segment_id")
        sole = held.groupBy("atom_id").agg(F.count("*").alias("n"), F.first("segment_id").alias("segment_id"), F.first("price").alias("price")).where("n = 1").groupBy("segment_id").agg(F.sum("price").alias("sole"))
        must = stage(open_.join(sole, "segment_id", "left").where(F.col("short") + F.coalesce("sole", F.lit(0.0)) > F.col("budget")).select("segment_id"), "taken")
        taken.append(must)
        if must.isEmpty() and len(taken) > 1:
            break  # budgets stay as they are
        hit = cover.join(must, "segment_id", "left_semi").select("atom_id")
        gone = cover.join(hit, "atom_id", "left_semi").select("segment_id").distinct()
        free = stage(open_.drop("budget").join(gone, "segment_id", "left_anti"), "open")
        near = cover.join(free.select("segment_id"), "segment_id", "left_semi")
        low = near.groupBy("atom_id").agg(F.min("segment_id").alias("a"))
        roots = components(near.join(low, "atom_id").select("a", F.col("segment_id").alias("b")))
        parted = free.drop("part").join(roots, F.col("segment_id") == F.col("node"), "left").withColumn("part", F.coalesce("root", "segment_id")).drop("node", "root")
        rows = stage(parted.select("part", "segment_id", "segment_key", "score", "selected", "short", "paid"), "open")
    every = taken[0]
    for more in taken[1:]:
        every = every.union(more)
    lists = cover.groupBy("segment_id").agg(F.collect_list(F.struct("atom_id", "price")).alias("atoms"))
    return every, stage(rows.join(_budgets(rows), "part").join(lists, "segment_id"), "parts")


def _decided(parts: DataFrame, width: int, step: int) -> DataFrame:
    """(part, names, cut): keys of the best packing of each part, and whether states were left out on the way."""
    order = [F.col("part"), F.size("atoms").desc(), F.col("segment_key")]
    ranked = stage(with_rank(parts, order, "place"), "ranked")
    begin = ranked.groupBy("part").agg(F.min("place").alias("begin"))
    ranked = ranked.join(begin, "part").withColumn("place", F.col("place") - F.col("begin")).drop("begin")
    last = ranked.select("part", "place", F.explode("atoms").alias("a")).groupBy("part", "a.atom_id").agg(F.max("place").alias("place"), F.max("a.price").alias("price"))
    closing = last.groupBy("part", "place").agg(F.collect_list(F.struct("atom_id", "price")).alias("closing"))
    none = F.array().cast("array<struct<atom_id:string,price:double>>")
    rows = ranked.join(closing, ["part", "place"], "left").withColumn("closing", F.coalesce("closing", none))
    one = F.struct("place", F.col("segment_key").alias("name"), "score", "short", "paid", F.col("atoms.atom_id").alias("atoms"), "closing")
    steps = rows.groupBy("part", F.floor(F.col("place") / step).alias("no")).agg(F.sort_array(F.collect_list(one)).alias("steps"), F.first("budget").alias("budget"))
    steps = stage(steps, "steps")
    known = parts.groupBy("part").agg(F.sum(F.when(F.col("selected"), F.col("score")).otherwise(0.0)).alias("known"), F.collect_list(F.when(F.col("selected"), F.col("segment_key"))).alias("known_names"))
    zero = F.lit(0.0)
    none = F.array().cast("array<string>")
    states = parts.select("part").distinct().select("part", none.alias("used"), zero.alias("loss"), zero.alias("score"), none.alias("names"), F.lit(False).alias("cut"))
    rounds = steps.agg(F.max("no")).first()[0]
    done = []
    for no in range(0 if rounds is None else rounds + 1):
        moved = states.join(steps.where(F.col("no") == no).drop("no"), "part")
        start = F.array(F.struct("used", "loss", "score", "names")).cast(_STATE)
        moved = moved.select("part", "cut", F.explode(F.aggregate("steps", start, _extended)).alias("s")).select("part", "cut", "s.*")
        # of what holds the same atoms the best goes on; the part's flag does not depend on which
        place = F.struct(-F.round("score", 9), F.size("names"), "names")
        merged = moved.groupBy("part", "used").agg(F.min_by(F.struct("loss", "score", "names"), place).alias("s"), F.max("cut").alias("cut"))
        merged = stage(merged.select("part", "used", "s.loss", "s.score", "s.names", "cut"), "frontier")
        states = stage(_followed(merged, width), "followed")
        release(merged)
        done.append(states.join(steps.where(F.col("no") == no + 1).select("part"), "part", "left_anti"))
    if not done:
        return parts.select("part", none.alias("names"), F.lit(False).alias("cut"))
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    ends = every.groupBy("part").agg(F.min_by(F.struct("score", "names"), F.struct(-F.round("score", 9), F.size("names"), "names")).alias("best"), F.max("cut").alias("cut"))
    both = known.join(ends, "part", "left").withColumn("cut", F.coalesce("cut", F.lit(True)))  # no state is left: states were left out
    better = F.coalesce(~F.col("cut") | (F.col("best.score") > F.col("known")), F.lit(False))
    return stage(both.select("part", F.when(better, F.col("best.names")).otherwise(F.col("known_names")).alias("names"), "cut"), "ends")


def _extended(states: Column, s: Column) -> Column:
    """The states after a segment, left out and taken where its atoms are free, that lose no more than the budget."""
    budget = F.col("budget")

    def after(used, loss, score, names):
        open_price = F.aggregate(F.filter(s["closing"], lambda a: ~F.array_contains(used, a["atom_id"])), F.lit(0.0), lambda x, a: x + a["price"])
        return F.struct(F.array_except(used, s["closing"]["atom_id"]).alias("used"), (loss + open_price).alias("loss"), score.alias("score"), names.alias("names"))

    def both(st):
        out = after(st["used"], st["loss"] + s["short"], st["score"], st["names"])
        new = after(F.array_sort(F.concat(st["used"], s["atoms"])), st["loss"] + s["paid"], st["score"] + s["score"], F.array_sort(F.array_append(st["names"], s["name"])))
        return F.when(F.arrays_overlap(st["used"], s["atoms"]), F.array(out)).otherwise(F.array(out, new))

    return F.filter(F.flatten(F.transform(states, both)), lambda st: st["loss"] <= budget)


def _followed(states: DataFrame, width: int) -> DataFrame:
    """``states``, and of parts with more than ``width`` of them those of the least loss, marked as cut."""
    halves = [0.5**k for k in range(1, 21)]
    sizes = states.groupBy("part").agg(F.count("*").alias("n"), F.percentile_approx("loss", halves, 10_000).alias("q")).where(F.col("n") > width)
    most = F.element_at("q", F.least(F.lit(20), F.ceil(F.log2(F.col("n") / width))).cast("int"))
    rows = states.join(sizes.select("part", most.alias("most")), "part", "left")
    return rows.where("most is null or loss <= most").withColumn("cut", F.col("cut") | F.col("most").isNotNull()).drop("most")
