"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

A source's target is its weight's share of all words, at most `max_repeats` times its own words;
what a full source cannot take is shared anew by weight among the others. That is a water level:
`level * weight` where it lies below the cap, the cap elsewhere. It is found in one ordered pass
over the sources, of which there is one row each.

Inside a source the documents stand in the order of the md5 of their ids, pass after pass, and
the mix takes documents from the front until the target is met. Documents are taken whole: the one at the
cut is taken if at least half of it fits, so a source misses its target by half of that document at
most. A document longer than its source's whole target follows the same rule: all of it or nothing. Offsets come from
prefix sums in two levels: over 4,096 slices of the md5 within a source, then over the rows of
one slice, so the rows of a hot source are summed and sorted in as many places.

Each source has a schedule: a weight over training time 0..1, linear between its knots. Its
integral, scaled to the target, is the demand for the source's words by each moment. A document
that begins after d of the words its source gives is placed where that demand is d, the
inverse of the integral, and the corpus is range-sorted by that position.

Null texts have size 0 and are never taken. Null sources are one source, the last. Rows without
an id, and repeated rows, are mixed like any other. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: (time, weight) knots for the 1st, 2nd, 3rd ... source, repeating: fading, steady, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def invert_schedule(knots: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time by which a schedule has used up `share` (0..1) of its integral."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, None
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        if area <= 0:
            continue
        rest = share * total - done
        slope = (b[1] - a[1]) / (b[0] - a[0])
        # The root of slope/2 t^2 + w t = rest, in the form that stays exact for a slope of 0.
        root = F.sqrt(F.greatest(F.lit(a[1] * a[1]) + 2 * slope * rest, F.lit(0.0)))
        time = F.lit(a[0]) + F.try_divide(2 * rest, F.lit(a[1]) + root)
        done += area
        out = F.when(share * total <= done, time) if out is None else out.when(share * total <= done, time)
    return F.lit(0.0) if out is None else F.least(out.otherwise(F.lit(1.0)), F.lit(1.0))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> also `turn` (0-based place in the cycle of weights) and `target`."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_cap_order = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    capped = (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("turn", F.col("place") % len(weights))
        .withColumn("weight", F.get(cycle, F.col("turn")))
        .withColumn("cap", max_repeats * F.col("source_size"))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("fill"), F.col("level")), ignorenulls=True).over(in_cap_order))
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return capped.select("source", "source_size", "turn", target.alias("target"))


def mix(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    schedules: tuple = SCHEDULES,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
) -> DataFrame:
    """The input with `source_size`, `target`, `taken` and `uses`.

    `uses` holds, for every pass in which the document is used, the words taken (all it has) and the training
    position (0..1) at which they stand. Columns of the input with these names are replaced; names that begin with
    `_mix_` are this function's own, and an input that has one is refused.
    """
    if clash := [c for c in sized.columns if c.startswith("_mix_")]:
        raise ValueError(f"columns named {', '.join(clash)} are used inside the mix; rename them")
    key = order_key(F.col(id_col))
    rows = sized.drop("source_size", "target", "taken", "uses").withColumn("_mix_key", key).withColumn("_mix_slice", F.substring("_mix_key", 1, SLICE_DIGITS))
    slices = materialize(rows.groupBy(F.col(source_col).alias("source"), "_mix_slice").agg(F.sum(size_col).alias("slice_size")), "slices")
    within = Window.partitionBy("source").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_repeats)
    starts = slices.withColumn("_mix_start", F.coalesce(F.sum("slice_size").over(within), F.lit(0))).alias("a")
    starts = starts.join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("_mix_source"), F.col("_mix_slice").alias("_mix_slice_of"), "_mix_start", "source_size", "target", F.col("turn").alias("_mix_turn")
    )
    rows = rows.join(starts, F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_slice") == F.col("_mix_slice_of")))
    before = Window.partitionBy("_mix_source", "_mix_slice_of").orderBy("_mix_key", size_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_start", F.col("_mix_start") + F.coalesce(F.sum(size_col).over(before), F.lit(0)))

    goal = F.round("target").cast("bigint")
    uses = []
    for turn in range(max_repeats):
        start = F.col("_mix_start") + turn * F.col("source_size")
        share = F.coalesce(F.try_divide(start.cast("double"), goal.cast("double")), F.lit(0.0))
        position = F.lit(0.0)
        for n, knots in enumerate(schedules):
            position = F.when(F.col("_mix_turn") % len(schedules) == n, invert_schedule(knots, share)).otherwise(position)
        # Whole or not at all: the document at the cut is taken when at least half of it fits.
        fits = (F.col(size_col) > 0) & (2 * (goal - start) >= F.col(size_col))
        words = F.when(fits, F.col(size_col)).otherwise(F.lit(0)).cast("bigint")
        uses.append(F.struct(words.alias("words"), position.alias("position")))
    rows = rows.withColumn("uses", F.filter(F.array(*uses), lambda u: u["words"] > 0))
    rows = rows.withColumn("taken", F.aggregate("uses", F.lit(0).cast("bigint"), lambda a, u: a + u["words"]))
    return rows.drop("_mix_key", "_mix_slice", "_mix_source", "_mix_slice_of", "_mix_start", "_mix_turn")


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per use of a document, whole, range-sorted by training position."""
    rows = mixed.select(*columns, F.explode("uses").alias("_mix_use"))
    return rows.orderBy("_mix_use.position", *[c for c in columns if c == "doc_id"]).select(*columns)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix of a documents table, per document, in the order of first use; texts are read once, for their sizes."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    first = F.get(F.col("uses")["position"], F.lit(0))
    mixed = mix(sized).select("doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("position"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sums),
weighed AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap, 3 * source_size / (place % 3 + 1)::DOUBLE AS fill FROM placed),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER before, 0))::DOUBLE
    / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, place_in_order) AS level FROM (SELECT level, row_number() OVER (ORDER BY fill, place) AS place_in_order, fill FROM levels) WHERE level <= fill),
targets AS (SELECT source, source_size, place, least(cap::DOUBLE, weight * (SELECT level FROM chosen)) AS target FROM weighed),
rows AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place % 3 AS turn, round(t.target)::BIGINT AS goal,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, (CASE WHEN size = 0 THEN 0 ELSE size * ((2 * (goal - start) >= size)::INT + (2 * (goal - start - source_size) >= size)::INT + (2 * (goal - start - 2 * source_size) >= size)::INT) END)::BIGINT AS taken,
    CASE WHEN goal > 0 THEN start / goal::DOUBLE ELSE 0 END AS share
  FROM rows)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(least(1.0, CASE turn
    WHEN 0 THEN 2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0)))
    WHEN 1 THEN share
    ELSE 2 * share / (0.5 + sqrt(greatest(0.25 + 2 * share, 0))) END), 9) END AS position
FROM taken
"""
