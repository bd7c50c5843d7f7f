"""Ranges of an order and exact order statistics, for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.operators.tables import broadcast_if_few, written

#: Rows that one task may sort, or whose distinct values it may hold.
TASK_ROWS = 1_000_000
#: Ranges at most (a power of two), and sampled keys for each of them.
RANGES, SAMPLES = 512, 40
#: Bits of a value that one pass of a selection counts by; they divide 64.
DIGIT = 16


def with_range(rows: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """rows with `part`, their range in order of the keys, of about TASK_ROWS; and how many ranges there are.

    The bounds are those of a sample, at most RANGES x SAMPLES x 2 keys on the driver or so. A
    row's range follows from its keys alone, so a lost task gives the same again; it is found by
    bisection of the bounds.
    """
    n = rows.count()
    parts = min(RANGES, -(-n // TASK_ROWS))
    if parts <= 1:
        return rows.withColumn("part", F.lit(0)), 1
    sample = rows.select(*keys).sample(min(1.0, parts * SAMPLES / n), 7).orderBy(*keys).limit(2 * RANGES * SAMPLES).collect()
    if not sample:
        return rows.withColumn("part", F.lit(0)), 1
    bounds = [sample[k * len(sample) // parts] for k in range(1, parts)]
    types = [rows.schema[k].dataType for k in keys]
    literals = F.array(*(F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, b, types, strict=True))) for b in bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def step(at: Column, size: Column) -> Column:
        fits = F.coalesce(F.get(literals, at + size - 1) <= F.struct(*keys), F.lit(False))
        return F.when((at + size <= len(bounds)) & fits, at + size).otherwise(at)

    return rows.withColumn("part", F.aggregate(steps, F.lit(0), step)), parts


def with_previous(rows: DataFrame, value: str, name: str, group: str, *order: str) -> DataFrame:
    """Add `name`: the value of the row before in the order, within the group; null for a group's first row.

    Rows of a null group are a group too. Rows are dealt out by range, so that few groups don't
    mean few tasks. A range's first row takes the last value of the range before it; these are
    as many rows as ranges and groups that begin or end in them.
    """
    ranged, parts = with_range(rows, group, *order)
    within = Window.partitionBy("part", group).orderBy(*order)
    seen = ranged.withColumn("_before", F.lag(F.struct(value)).over(within))
    if parts == 1:
        return seen.withColumn(name, F.col(f"_before.{value}")).drop("part", "_before")
    last = ranged.groupBy("part", F.col(group).alias("_group")).agg(F.max_by(F.struct(F.col(value).alias("_border")), F.struct(*order)).alias("_last"))
    borders = last.select(F.col("part").alias("_part"), "_group", F.lag("_last").over(Window.partitionBy("_group").orderBy("part")).alias("_last")).where("_last IS NOT NULL")
    joined = seen.join(broadcast_if_few(borders), (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn(name, F.when(F.col("_before").isNotNull(), F.col(f"_before.{value}")).otherwise(F.col("_last._border"))).drop("part", "_before", "_part", "_group", "_last")


def ordered_bits(value: Column) -> Column:
    """A double as a bigint in the same order: its exponent and mantissa, negated below zero; NaN is the greatest, and null stays.

    -0.0 and 0.0 are one. The exponent that the logarithm gives is put right where rounding took
    it across a power of two; numbers below the least power have that one's.
    """
    value = value.cast("double")
    size = F.abs(value)
    guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.coalesce(F.log2(size), F.lit(-1022.0))).cast("double")))
    share = size / F.pow(F.lit(2.0), guess)
    exponent = F.when(share >= 2, guess + 1).when((share < 1) & (guess > -1022), guess - 1).otherwise(guess)
    share = size / F.pow(F.lit(2.0), exponent)
    bits = (exponent.cast("bigint") + 1022) * (1 << 52) + (share * float(1 << 52)).cast("bigint")
    bits = F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(size == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(value < 0, -bits).otherwise(bits)


def select_ranks(values: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """by, tag, value: of each group the value that has so many smaller or equal ones before it in order.

    values: by, value (double, not null); ranks: by, tag, rank (from 0, below the group's size).
    Values are counted by their first DIGIT bits, the digit that holds the rank is chosen, and the
    next pass counts those by their next DIGIT bits, until one value is left. What is shuffled is
    counts, however many values are equal. values are read 64 / DIGIT times at most.
    """
    group = [f"_g{k}" for k in range(len(by))]
    keyed = values.select(*(F.col(b).alias(g) for b, g in zip(by, group, strict=True)), F.col("value").alias("_value"), ordered_bits(F.col("value")).alias("_bits"))
    state = ranks.select(*by, "tag", F.col("rank").cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftright("_bits", shift)
        upper = F.shiftright("_bits", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("bigint")
        wanted = state.select(*(F.col(b).alias(f"_w{k}") for k, b in enumerate(by)), F.col("prefix").alias("_wanted")).distinct()
        same = F.col("_upper") == F.col("_wanted")
        for k, g in enumerate(group):
            same &= F.col(g).eqNullSafe(F.col(f"_w{k}"))
        held = keyed.withColumns({"_upper": upper, "_digit": digit}).join(broadcast_if_few(wanted), same, "left_semi")
        counts = held.groupBy(*group, "_upper", "_digit").agg(F.count("*").alias("_n"), F.min("_value").alias("_least"), F.max("_value").alias("_most"))
        order = Window.partitionBy(*group, "_upper").orderBy("_digit")
        counts = counts.withColumn("_upto", F.sum("_n").over(order))
        here = F.col("_upper") == F.col("prefix")
        for g, b in zip(group, by, strict=True):
            here &= F.col(g).eqNullSafe(F.col(b))
        here &= (F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n"))
        chosen = counts.join(broadcast_if_few(state), here)
        state = written(chosen.select(*by, "tag", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank"), F.col("_digit").alias("prefix"), F.col("_least").alias("value"), F.col("_most").alias("most")))
        if not state.where("value < most").limit(1).count():
            break
    return state.select(*by, "tag", "value")


def summary(rows: DataFrame, aggregates: list[Column], percentiles: dict[str, tuple[str, float]], n: int | None = None) -> DataFrame:
    """One row: the aggregates, and exact percentiles name -> (column, share), interpolated between neighbours; null if there is no value.

    Up to TASK_ROWS rows Spark's exact percentile answers in the same pass. Beyond, it would
    hold every distinct value in one task; then the values are written as a table and the
    percentiles' two neighbours are selected by their bits.
    """
    if n is None:
        n = rows.limit(TASK_ROWS + 1).count()
    if n <= TASK_ROWS:
        return rows.agg(*aggregates, *(F.percentile(c, p).alias(name) for name, (c, p) in percentiles.items()))
    columns = sorted({c for c, _ in percentiles.values()})
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    values = written(rows.select(F.inline(pairs)).where("value IS NOT NULL"))
    sizes = {r["column"]: r["count"] for r in values.groupBy("column").count().collect()}
    wanted = []
    for name, (c, p) in percentiles.items():
        if sizes.get(c):
            low = int(p * (sizes[c] - 1))
            wanted += [(c, f"{name}/{side}", min(low + side, sizes[c] - 1)) for side in (0, 1)]
    out = rows.agg(*aggregates)
    if wanted:
        found = select_ranks(values, rows.sparkSession.createDataFrame(wanted, "column string, tag string, rank bigint"), ["column"])
        row = found.agg(*(F.max(F.when(F.col("tag") == tag, F.col("value"))).alias(tag) for _, tag, _ in wanted))
        out = out.crossJoin(row)  # one row each
    shares = {name: p * (sizes.get(c, 1) - 1) % 1 for name, (c, p) in percentiles.items()}
    low, high = (lambda name: F.col(f"`{name}/0`")), (lambda name: F.col(f"`{name}/1`"))
    none = F.lit(None).cast("double")
    exact = [(low(k) + (high(k) - low(k)) * shares[k] if sizes.get(percentiles[k][0]) else none).alias(k) for k in percentiles]
    return out.select(*(c for c in rows.limit(0).agg(*aggregates).columns), *exact)
