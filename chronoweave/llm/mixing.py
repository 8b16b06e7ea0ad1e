"""Mixing sources to target weights by entropy balancing.

Document rates solve: as near to one copy of everything as can be (Fermi-Dirac entropy between 0 and `most` copies),
subject to each source's tokens meeting its target. The dual has one multiplier per source, and rates are
exponentially tilted: r / (most - r) = exp(lambda_source * x) / (most - 1). Entropy is counted per document (x = the size in
units of the source's mean: tokens are gained and shed where that moves fewest documents, so from the long ones) or per
token (x = 1: long and short texts of a source keep their proportion, and the dual has a closed form). Newton steps on
the dual read sums over documents, which Spark makes from counts by (source, size); rates are then rounded into copies
by a cut along a pseudo-random order that depends on the document alone.

Only DataFrame functions touch the rows, and multipliers, targets and cuts are tables with a row per source: the driver
sees how many sources are left to solve, whatever their number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, n_words, unit

#: Newton steps at most, and the relative error of a source's tokens at which they end.
STEPS, TOLERANCE = 60, 1e-9
#: Cells of the pseudo-random order per source and stratum, at least, and rows that a cell holds, about; running totals
#: are made inside cells, then over cells.
CELLS, CELL_ROWS = 256, 50_000
WEIGHTS = (5, 2, 1)


def _by_source(left: DataFrame, facts: DataFrame, *more: str) -> DataFrame:
    """left with the columns of facts for its source (null is a source) and the columns `more`; rows without facts go.
    Spark broadcasts facts by their size, if at all."""
    names = ["source", *more]
    told = facts.select(*[F.col(c).alias(f"_{c}") for c in names], *[c for c in facts.columns if c not in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(told, same).drop(*[f"_{c}" for c in names])


def targets(totals: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> target: weights go round over the sources by code point, null last; targets stop at
    `most` times the size and the rest is shared again by weight until none is above. That ends where every target is
    min(most * size, level * weight), so the level is found directly: sources are filled in order of most * size / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    t = totals.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("goal", share * F.sum("source_size").over(Window.partitionBy(F.lit(1))))
    t = t.withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("weight_left", F.sum("weight").over(Window.partitionBy(F.lit(1))) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.max(F.when(F.col("left") / F.col("weight_left") * F.col("weight") <= F.col("cap"), F.col("left") / F.col("weight_left"))).over(Window.partitionBy(F.lit(1)))
    t = t.withColumn("level", level)
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def rate(lam, x, most: float):
    """Copies of a document: the tilted rate."""
    return most / (1 + (most - 1) * F.exp(-F.least(F.greatest(lam * x, F.lit(-700.0)), F.lit(700.0))))


def multipliers(scratch: Scratch, cells: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """source, lam: Newton on the dual, all sources in each step, guarded by bisection: a source's tokens grow with its
    multiplier, so every step also narrows a bracket. cells: source, size, n, x. goals: source, source_size, target.
    Sources whose target is their cap (or nothing) have an infinite multiplier and take no part.
    """
    limit = F.lit(math.inf)
    sure = F.when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), limit).when(F.col("target") <= 0, -limit)
    state = goals.select("source", "target", F.coalesce(sure, F.lit(0.0)).alias("lam"), (-limit).alias("low"), limit.alias("high"), sure.isNotNull().alias("done"))
    state = scratch.table(state, "multipliers")
    for _ in range(STEPS):
        open_ = state.where("NOT done")
        if not open_.limit(1).count():
            break
        at = _by_source(cells, open_.select("source", "lam"))
        r = rate(F.col("lam"), F.col("x"), most)
        tokens, slope = F.sum(F.col("n") * F.col("size") * r), F.sum(F.col("n") * F.col("size") * F.col("x") * r * (1 - r / most))
        now = _by_source(open_, at.groupBy("source").agg(tokens.alias("tokens"), slope.alias("slope")))
        now = now.withColumn("gap", F.col("tokens") - F.col("target")).withColumn("met", F.abs("gap") <= TOLERANCE * F.col("target"))
        now = now.withColumn("low", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") < 0, F.col("high")).otherwise(F.col("lam")))
        newton = F.col("lam") - F.try_divide("gap", "slope")
        half = F.when(F.col("low") == -limit, 2 * F.col("high") - 1).when(F.col("high") == limit, 2 * F.col("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when(F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False)), newton).otherwise(half)
        # a multiplier is rounded so that the order of sums leaves no trace
        now = now.select("source", "target", F.when(F.col("met"), F.round("lam", 10)).otherwise(step).alias("lam"), "low", "high", F.col("met").alias("done"))
        state = scratch.table(state.where("done").unionByName(now), "multipliers")
    return state.select("source", "lam")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, text: str = "text", measure: str = "documents", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for every row of docs.

    Null texts have size 0 and are taken never; a null source is a source of its own, last in order; repeated rows
    are rounded as rows of their own; an empty table gives an empty result. Columns beyond doc_id, source and text
    aren't read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    sized = scratch.table(docs.select("doc_id", "source", n_words(F.col(text)).alias("size"), unit(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("mix"))).alias("u")), "sizes")
    return _mixed(sized, ["doc_id"], share, most, weights, measure, scratch)


def _mixed(sized: DataFrame, keep: list[str], share: float, most: float, weights: tuple[int, ...], measure: str, scratch: Scratch) -> DataFrame:
    """Rates and copies of rows that have source, size and u."""
    cells = scratch.table(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = scratch.table(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")), "totals")
    mean = F.greatest(F.col("source_size") / F.col("rows"), F.lit(1e-9))
    facts = totals.select("source", "rows", mean.alias("mean"))
    goals = scratch.table(_by_source(targets(totals.drop("rows"), share, most, weights), facts), "goals")  # a row for each source
    feature = F.lit(1.0) if measure == "tokens" else F.col("size") / F.col("mean")
    x = _by_source(cells, facts).select("source", "size", "n", feature.alias("x"))
    lam = multipliers(scratch, x, goals, most)
    rated = _by_source(sized, scratch.table(_by_source(goals, lam), "rates"))
    tilted = rate(F.col("lam"), feature, most)
    r = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("lam") == math.inf, F.lit(most)).when(F.col("lam") == -math.inf, F.lit(0.0)).otherwise(tilted)
    rated = rated.withColumn("rate", r).withColumn("base", F.floor("rate").cast("long")).withColumn("frac", F.col("rate") - F.col("base"))
    return _rounded(rated, keep, scratch)


def _rounded(rated: DataFrame, keep: list[str], scratch: Scratch) -> DataFrame:
    """Rates to copies: each gets its whole part, and one more where u / frac is low enough. Along that order running
    token totals are exact, and the cut is where a source's total meets what is left of its target. Long texts (above
    a quarter of the mean) are cut first, then short ones make up for the rest, so a source misses its target by about
    a short text. Ties in the order are broken by size and, as far as the rows differ, by the kept columns."""
    n = F.greatest(F.lit(CELLS), F.ceil(F.col("rows") / CELL_ROWS)).cast("long")
    t = rated.withColumn("long_text", (F.col("size") * 4 > F.col("mean")).cast("int")).withColumn("q", F.when(F.col("frac") > 0, F.col("u") / F.col("frac")))
    t = t.withColumn("cell", F.when(F.col("q").isNotNull(), F.least(F.floor(n / (1 + F.lit(1.0) / F.col("q"))), n - 1).cast("int")))
    inside = Window.partitionBy("source", "long_text", "cell").orderBy("q", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    open_rows = scratch.table(t.where("q IS NOT NULL").withColumn("inside", F.sum("size").over(inside)), "order")
    per_cell = open_rows.groupBy("source", "long_text", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("source", "long_text").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.withColumn("offset", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0))).drop("cell_size")
    run = _by_source(open_rows, offsets, "long_text", "cell").withColumn("total", F.col("inside") + F.col("offset"))
    run = scratch.table(run.select(*keep, "source", "size", "source_size", "target", "rate", "base", "frac", "long_text", "total"), "totals")

    left = t.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("base"))).alias("left"))
    expected = run.where("long_text = 1").groupBy("source").agg(F.sum(F.col("size") * F.col("frac")).alias("want"))
    long_cuts = scratch.table(_cuts(run, 1, expected), "cuts")
    met = left.select("source", "left").join(long_cuts.select(F.col("source").alias("_s"), "cut"), F.col("source").eqNullSafe(F.col("_s")), "left")
    short_cuts = _cuts(run, 0, met.select("source", (F.col("left") - F.coalesce("cut", F.lit(0.0))).alias("want")))
    cuts = scratch.table(long_cuts.unionByName(short_cuts), "cuts")
    extra = (F.col("total") <= F.col("cut")).cast("long")
    closed = t.where("q IS NULL").withColumn("extra", F.lit(0).cast("long"))
    both = [d.select(*keep, "size", "source_size", "target", "rate", (F.col("base") + F.col("extra")).alias("copies")) for d in (_by_source(run, cuts, "long_text").withColumn("extra", extra), closed)]
    return both[0].unionByName(both[1]).withColumn("taken", F.col("size") * F.col("copies"))


def _cuts(run: DataFrame, stratum: int, want: DataFrame) -> DataFrame:
    """source, long_text, cut: for each source the running total nearest to what is wanted (0: nothing)."""
    at = _by_source(run.where(F.col("long_text") == stratum).select("source", "total"), want)
    found = at.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("total") <= F.col("want"), F.col("total"))), F.lit(0)).alias("below"),
        F.min(F.when(F.col("total") > F.col("want"), F.col("total"))).alias("above"),
        F.first("want").alias("want"),
    )
    nearer = F.coalesce(F.col("above") - F.col("want") < F.col("want") - F.col("below"), F.lit(False))
    return found.select("source", F.lit(stratum).alias("long_text"), F.when(nearer, F.col("above")).otherwise(F.col("below")).cast("double").alias("cut"))


def mixed_rows(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, measure: str = "documents") -> DataFrame:
    """The mix itself: rows of docs, each as often as its copies. Rates are computed from narrow columns and joined
    back on the row's id, source and text, so the texts move once. Repeated rows, equal in all three, share their
    copies evenly, so that as many rows come out as were taken. Columns of docs may have any names; an empty table gives
    an empty one."""
    scratch = Scratch(docs.sparkSession, "mix")
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))  # noqa: E731  null isn't ''
    key = F.md5(F.concat_ws("\x00", told("doc_id"), told("source"), told("text")))
    sized = scratch.table(docs.select(key.alias("row_key"), "source", n_words(F.col("text")).alias("size")).withColumn("u", unit(F.col("row_key"))), "sizes")
    taken = _mixed(sized, ["row_key"], share, most, weights, measure, scratch)
    taken = scratch.table(taken.groupBy("row_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0"), "taken")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("row_key"))  # so that names can't clash
    out = rows.join(taken.where("n = 1"), "row_key").select("row", "copies")
    if taken.where("n > 1").limit(1).count():
        again = rows.join(taken.where("n > 1"), "row_key").withColumn("k", F.row_number().over(Window.partitionBy("row_key").orderBy(F.lit(1))))
        own = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("k") <= F.col("copies") % F.col("n"), 1).otherwise(0)
        out = out.unionByName(again.withColumn("copies", own).where("copies > 0").select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
