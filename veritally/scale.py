"""Building blocks that keep plans whole and balanced when a key is hot or a group is large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.session import materialize

SMALL_SIDE_ROWS = 20_000
"""Most rows a side may have to be sent to every executor."""

HOT_KEY_ROWS = 5_000_000
"""A join key with more rows than this on the large side is spread over several tasks."""

HOT_KEYS = 1_000
"""How many hot keys are looked for."""

SALTS = 32


def spread_scan(scan: DataFrame, key: str) -> DataFrame:
    """Hash the rows of a bare file scan over all slots when the files come in too few pieces.

    Work on long texts is bound by the processor, and a table written as one row group would
    keep one task busy. A table of many row groups has pieces enough and is not shuffled.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 2 * slots:
        return scan
    return scan.repartition(slots, key)


def attach_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = SMALL_SIDE_ROWS,
) -> DataFrame:
    """Join a summary onto a large table without shuffling the large table, if it fits.

    The summary is read once, at most `max_rows + 1` rows of it. Within the bound it becomes
    a broadcast literal table; beyond it the join is a salted shuffle join, so a handful of
    keys holding most of the large side still spread over many tasks. A bound too large for
    the driver's memory is checked by counting a stored copy instead of reading it.
    """
    on = list(on)
    if max_rows > SMALL_SIDE_ROWS:
        stored = materialize(small, "small")
        fits = stored.count() <= max_rows
        return big.join(F.broadcast(stored), on, how) if fits else salted_join(big, stored, on, how)
    head = small.limit(max_rows + 1).collect()
    if len(head) <= max_rows:
        local = big.sparkSession.createDataFrame(head, small.schema)
        return big.join(F.broadcast(local), on, how)
    return salted_join(big, small, on, how)


def settle_small(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """A summary worked out once, for plans that join it several times.

    Within the bound it becomes a literal table, which costs no job to read again; beyond it, a stored one.
    """
    head = df.limit(max_rows + 1).collect()
    if len(head) <= max_rows:
        return df.sparkSession.createDataFrame(head, df.schema)
    return materialize(df, "summary")


def beside(*single_rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row, without a join: stacked, then folded."""
    stacked = single_rows[0]
    for row in single_rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def _check_how(how: str) -> None:
    """The salted side is copied, so a join that keeps its unmatched rows would repeat them."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how!r}")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Shuffle join with every key of the large side spread over `salts` tasks.

    The salt is a hash of the row rather than a random number: a task that is recomputed
    after an executor is lost has to send each row to the same place again.
    """
    _check_how(how)
    on = list(on)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(big)), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def hot_hashes(df: DataFrame, on: Sequence[str], hot_rows: int) -> list[int]:
    """Hashes of the join keys with more than `hot_rows` rows, heaviest first.

    A frequent-items sketch finds them in one pass over the key columns and without a
    shuffle; its size is fixed. It cannot miss a key with more than about one row in 7,500,
    and what it does miss is merely not spread.
    """
    keys = ", ".join(f"`{c}`" for c in on)
    top = df.agg(F.expr(f"approx_top_k(xxhash64({keys}), {HOT_KEYS}, {10 * HOT_KEYS})").alias("t")).first().t
    return [row["item"] for row in top or [] if row["count"] > hot_rows]


def skew_join(
    big: DataFrame,
    unique: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_KEY_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join a large table to one that has at most one row per key, salting only hot keys.

    Rows of a hot key are spread by a hash of the row, and only the hot keys are copied
    `salts` times on the unique side. Without hot keys this is the plain join.
    """
    _check_how(how)
    on = list(on)
    hot = hot_hashes(big, on, hot_rows)
    if not hot:
        return big.join(unique, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    zero = F.lit(0).cast("long")
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*_hashable(big)), F.lit(salts))).otherwise(zero))
    every = F.sequence(zero, F.lit(salts - 1).cast("long"))
    right = unique.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(zero))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Sequence[str],
    scale: float = 1024.0,
) -> DataFrame:
    """Add `<w>_before` (weight at smaller values) and `<w>_total` per key.

    `df` holds one row per (keys, value). A window over a whole key would sort all its
    distinct values in one task, so values are first put in bins of width 1/scale
    (multiplying by a power of two is exact, so bins keep the order), the bin totals are
    accumulated, and only the values of one bin meet in a window.
    """
    keys = list(keys)
    binned = df.withColumn("_bin", F.floor(F.col(value) * F.lit(float(scale))))
    by_key = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    bins = binned.groupBy(*keys, "_bin").agg(*[F.sum(w).alias(w) for w in weights])
    bins = bins.select(
        *keys,
        "_bin",
        *[(F.sum(w).over(by_key) - F.col(w)).alias(f"_{w}_carry") for w in weights],
        *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(value)
    joined = binned.join(bins, [*keys, "_bin"])
    # A window with no key holds one row per bin, never one row per value.
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_{w}_carry") + F.sum(w).over(inside) - F.col(w)).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights],
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    scale: float = 1.0,
) -> DataFrame:
    """Linearly interpolated percentiles per key, without holding a key's values in one task.

    Values are counted, counted again per bin, and only the bins that hold a wanted rank are
    opened. `scale` is the number of bins per unit of the value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return percentiles_from_counts(counts, keys, "_v", "_n", quantiles, scale)


def percentiles_from_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str,
    quantiles: dict[str, float],
    scale: float = 1.0,
) -> DataFrame:
    """The same from a table of distinct values per key and how often each occurs."""
    keys = list(keys)
    counts = df.select(
        *keys, F.col(value).alias("_v"), F.col(count).alias("_n"), F.floor(F.col(value) * F.lit(float(scale))).alias("_bin")
    )
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    upto = F.sum("_bn").over(Window.partitionBy(*keys).orderBy("_bin"))
    total = F.sum("_bn").over(Window.partitionBy(*keys))
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()]
    )
    ranks = (
        bins.select(*keys, "_bin", (upto - F.col("_bn")).alias("_carry"), upto.alias("_upto"), total.alias("_total"))
        .withColumn("_w", F.explode(wanted))
        .withColumn("_pos", F.col("_w.q") * (F.col("_total") - 1))
        .withColumn("_lo", F.floor("_pos"))
        .withColumn("_hi", F.ceil("_pos"))
        .filter(
            F.col("_lo").between(F.col("_carry"), F.col("_upto") - 1)
            | F.col("_hi").between(F.col("_carry"), F.col("_upto") - 1)
        )
        .select(*keys, "_bin", "_carry", "_pos", "_lo", "_hi", F.col("_w.name").alias("_name"))
    )
    inside = Window.partitionBy(*keys, "_name", "_bin").orderBy("_v")
    opened = (
        counts.join(ranks, [*keys, "_bin"])
        .withColumn("_end", F.col("_carry") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(F.col("_start"), F.col("_end") - 1), F.col("_v")))

    picked = opened.groupBy(*keys, "_name").agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max("_pos").alias("_p"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_p") - F.floor("_p"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, value_at)).alias(n) for n in quantiles]
    )


#: Tasks among which the smallest rows of all partitions are merged.
MERGE_TASKS = 64


def _keep_smallest(batches):
    """The `_quota` smallest `_key` of each `_group` in one task, never holding more than twice as many and a batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def smallest(keys: pa.Array, quota: int) -> pa.Array:
        if len(keys) <= quota:
            return keys
        return keys.take(pc.select_k_unstable(pa.table({"k": keys}), k=quota, sort_keys=[("k", "ascending")]))

    held: dict[str, pa.Array] = {}
    quotas: dict[str, int] = {}
    for batch in batches:
        groups = batch.column("_group")
        for group in pc.unique(groups).to_pylist():
            rows = batch.filter(pc.equal(groups, group))
            quota = quotas.setdefault(group, rows.column("_quota")[0].as_py())
            keys = rows.column("_key")
            if group in held:
                keys = pa.concat_arrays([held[group], keys])
            held[group] = keys if len(keys) <= 2 * quota else smallest(keys, quota)
    for group, keys in held.items():
        keys = smallest(keys, quotas[group])
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(keys)), keys, pa.array([quotas[group]] * len(keys), pa.int64())], ["_group", "_key", "_quota"])


def quota_cuts(df: DataFrame, group: Column, key: Column, quota: Column) -> DataFrame:
    """(group, cut): the largest key among the `quota` smallest of every group, which is all that is needed to cut the group.

    A bounded heap per group and task, merged twice: nothing is sorted, and a task hands on no more rows than the
    quotas add up to. `quota` is one number per group, keys are not null.
    """
    narrow = df.select(group.cast("string").alias("_group"), key.alias("_key"), quota.cast("bigint").alias("_quota")).filter("_quota > 0 AND _key IS NOT NULL")
    first = narrow.mapInArrow(_keep_smallest, narrow.schema)
    second = first.repartition(MERGE_TASKS, F.xxhash64("_group", "_key")).mapInArrow(_keep_smallest, narrow.schema)
    last = second.repartition("_group").mapInArrow(_keep_smallest, narrow.schema)
    return last.groupBy("_group").agg(F.max("_key").alias("_cut"))


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    value: Column,
    out: str,
    inclusive: bool,
) -> DataFrame:
    """Running maximum of `value` along `order`, computed chunk by chunk with a carry.

    `chunk` must not decrease along `order`. The input is read twice, so give it a stored table
    rather than an expensive plan. No window ever holds more than one chunk of one
    key, so a document with very many spans is spread over tasks.
    """
    keys, order = list(keys), list(order)
    base = df.withColumn("_val", value)
    tops = base.groupBy(*keys, chunk).agg(F.max("_val").alias("_top"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, chunk, F.max("_top").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    # The inclusive frame takes in peers, so the result does not depend on how ties are sorted.
    inside = (
        inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        if inclusive
        else inside.rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        base.join(carry, [*keys, chunk])
        .withColumn(out, F.greatest(F.max("_val").over(inside), F.col("_carry")))
        .drop("_val", "_carry")
    )


def _in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`df` stored in ranges along `order`, with `_part`, the number of the range, and `_at`, the position inside it.

    One shuffle and one write. The numbers come from the order of the stored rows themselves, so no
    window sorts anything, and they are stored, so a lost executor cannot change them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()  # the partition above 33 bits that count its rows
    return materialize(ranged.withColumn("_at", row).select("*", F.shiftright("_at", 33).alias("_part")).withColumn("_at", F.expr("_at & 8589934591")), "ranges")


def _range_totals(stored: DataFrame, value: Column) -> DataFrame:
    """(_part, _base): the total of `value` in the ranges before each. A row per shuffle partition, whatever the table."""
    totals = sorted((r._part, int(r._sum or 0)) for r in stored.groupBy("_part").agg(F.sum(value).alias("_sum")).collect())
    carried, rows = 0, []
    for part, total in totals:
        rows.append((part, carried))
        carried += total
    return stored.sparkSession.createDataFrame(rows, "_part long, _base long")


def dense_row_number(df: DataFrame, order: str | Sequence[str], out: str, bin_width: int | None = None) -> DataFrame:
    """0-based position along columns that name a row (ties are numbered in any order), however sparse their values.

    Two passes: the rows of every range are counted, and a row's number is its place
    in its range after the counts of the ranges before. Nothing is sorted in one task. `bin_width` has
    no effect any more: ranges follow the rows, not the values.
    """
    order = [order] if isinstance(order, str) else list(order)
    stored = _in_ranges(df, order)
    carry = _range_totals(stored, F.lit(1).cast("long"))
    return stored.join(carry, "_part").withColumn(out, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def prefix_sums(df: DataFrame, order: Sequence[str], weight: str, out: str) -> DataFrame:
    """Adds the total of `weight` over the rows that come earlier in `order`; a window holds one range only."""
    stored = _in_ranges(df, order)
    carry = _range_totals(stored, F.col(weight))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(weight).over(inside), F.lit(0).cast("long"))
    return stored.withColumn(out, before).join(carry, "_part").withColumn(out, F.col(out) + F.col("_base")).drop("_part", "_at", "_base")
