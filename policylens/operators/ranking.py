"""Global order without a single-task sort: ranks, running sums, selection, ordered splits.

An order is a list of column names or (name, "desc") pairs. Missing keys come last.

Two ways are used. Where every row needs its rank or running sum, rows are cut into slices by ranges of the
whole sort key (so that a score shared by a third of the rows is still split by the next key), each
slice is numbered on its own, and the slices' totals, one row each, are added up and joined back. Rows
are shuffled once: to Spark's own ranges for a rank, and for a running sum to slices whose numbers are
computed from sampled keys and are the partition numbers, so that the sum within a slice finds its rows in place.
Where only a few positions are needed (a top-k cut, a train/test border), the keys at these positions
are found by narrowing passes of counts, and no row is shuffled at all.
"""

from dataclasses import dataclass, field
from itertools import groupby
from math import ceil

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from policylens.schema import POLICY_ID
from policylens.sources.staging import settled, stage

FAN_OUT = 64
SAMPLE_PER_CUT = 32
SETTLE_ROWS = 200_000
SLICE_ROWS = 50_000
HASH_RANGE = 1 << 40


def parse_order(order_by):
    """[(name, ascending)] from names and (name, "desc") pairs."""
    pairs = [(o, "asc") if isinstance(o, str) else tuple(o) for o in order_by]
    return [(name, direction == "asc") for name, direction in pairs]


def sort_columns(order):
    return [
        F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()
        for name, ascending in order
    ]


def _compare(name, ascending, value):
    """(before, at) a key value for each row, never null: missing keys come last and equal each other."""
    column = F.col(name)
    if value is None:
        return column.isNotNull(), column.isNull()
    bound, no = F.lit(value), F.lit(False)
    return F.coalesce(column < bound if ascending else column > bound, no), F.coalesce(column == bound, no)


def _reaches(name, ascending, value):
    """Whether a row's key is before or at a value: one comparison, never null."""
    if value is None:
        return F.lit(True)
    column, bound = F.col(name), F.lit(value)
    return F.coalesce(column <= bound if ascending else column >= bound, F.lit(False))


def at_or_before(order, key):
    """Whether a row stands at or before `key`. A shorter key stands for the last row that begins with it."""
    *leading, ((name, ascending), value) = zip(order, key)
    reached = _reaches(name, ascending, value)
    for (name, ascending), value in reversed(leading):
        before, at = _compare(name, ascending, value)
        reached = before | (at & reached)
    return reached


def same_key(order, key):
    equal = F.lit(True)
    for (name, ascending), value in zip(order, key):
        equal = equal & _compare(name, ascending, value)[1]
    return equal


# ---- ranks and running sums of every row ------------------------------------------------------


def global_rank(df, order_by, rank_col="rn"):
    """1-based rank of every row in a total order: one range shuffle and one stored pass."""
    order = parse_order(order_by)
    in_slice = 33
    laid = stage(
        df.repartitionByRange(*sort_columns(order))
        .sortWithinPartitions(*sort_columns(order))
        .withColumn("_seen", F.monotonically_increasing_id()),
        "rank",
    )
    laid = laid.select(
        *df.columns,
        F.shiftright("_seen", in_slice).alias("_slice"),
        F.col("_seen").bitwiseAND(F.lit((1 << in_slice) - 1)).alias("_place"),
    )
    counts = laid.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    # One row per slice on the broadcast side.
    return (
        laid.join(F.broadcast(starts), "_slice")
        .select(*df.columns, (F.col("_start") + F.col("_place") + 1).alias(rank_col))
    )


def _slice_cuts(df, order):
    """Keys that cut the order into slices of about equal rows.

    There is a slice for each shuffle partition, or fewer where each would have less than `SLICE_ROWS` rows. The
    sample of rows, `SAMPLE_PER_CUT` a slice in the mean, only chooses where to cut.
    """
    names = [name for name, _ in order]
    total = df.count()
    slices = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / SLICE_ROWS))
    if slices < 2:
        return []
    drawn = (
        df.select(*names).where(F.rand(SLICE_ROWS) < slices * SAMPLE_PER_CUT / total)
        .groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(*sort_columns(order))
        .collect()
    )
    return _choose_cuts(
        [(tuple(row[name] for name in names), row["_n"]) for row in drawn],
        _Bracket(None, None, 0, total), slices)


def prefix_sums(df, order_by, sums, by=(), totals=None, few_groups=False):
    """Inclusive running sums along an order, per group when `by` is given.

    `sums` maps output names to columns of `df`; `totals` maps further output names to those of the
    running sums and adds their value at the end of the group. A group is cut into as many slices as
    its size asks for, since it is the first part of the range key and no partitioning key of its own.

    `df` is read three times, to count, to sample and to lay out, and shuffled in the last of them only; an input
    that is dear to derive should be stored first.

    The slice totals have at most one row per slice and one more per group. Without groups, or when
    the caller vouches by `few_groups` that they are as few as columns or models, that is small for
    certain; otherwise their number is checked.
    """
    order, by, totals = parse_order(order_by), list(by), totals or {}
    range_key = [(c, True) for c in by] + order
    cuts = _slice_cuts(df, range_key)
    within = (
        Window.partitionBy("_slice", *by).orderBy(*sort_columns(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = stage(
        df.withColumn("_slice", _cut_index(range_key, cuts))
        .repartitionById(len(cuts) + 1, F.col("_slice"))
        .select("*", *[F.sum(c).over(within).alias(name) for name, c in sums.items()]),
        "running",
    )
    slices = laid.groupBy("_slice", *by).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        F.col("_slice").alias("_s"), *[F.col(c).alias(f"_by_{c}") for c in by],
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"_total_{name}") for name, n in totals.items()],
    )
    matched = F.col("_slice") == F.col("_s")
    for c in by:
        matched = matched & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    starts = F.broadcast(starts) if few_groups or not by else settled(starts)
    return laid.join(starts, matched).select(
        *df.columns,
        *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums],
        *[F.col(f"_total_{name}").alias(name) for name in totals],
    )


def grouped_quantiles(df, by, value, probabilities, few_groups=False):
    """Exact quantiles by group with linear interpolation, missing values left out.

    Works on distinct values with their counts, so a group never has to fit in one task. A group of
    missing values only gets null quantiles.
    """
    counts = stage(df.groupBy(*by, value).agg(F.count(value).alias("_n")), "counts")
    sized = prefix_sums(counts, [value], {"_upto": "_n"}, by, {"_size": "_upto"}, few_groups)
    picks = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("_size") - 1)
        for end, place in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            covers = (place >= F.col("_upto") - F.col("_n")) & (place < F.col("_upto"))
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{end}{i}"))
    picked = sized.groupBy(*by, "_size").agg(*picks)
    columns = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("_size") - 1)
        share = position - F.floor(position)
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        columns.append((low + (high - low) * share).alias(f"q{i}"))
    return picked.select(*by, *columns)


# ---- keys at a few positions ------------------------------------------------------------------


@dataclass
class _Bracket:
    """A stretch of the order, from just after key `low` up to and with key `high`."""

    low: tuple | None
    high: tuple | None
    start: int
    rows: int
    ranks: list = field(default_factory=list)
    divisible: bool = True

    def holds(self, order):
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & ~at_or_before(order, self.low)
        if self.high is not None:
            inside = inside & at_or_before(order, self.high)
        return inside


@dataclass(frozen=True)
class Position:
    """A key, how many rows stand before it and how many rows have it."""

    key: tuple
    rows_before: int
    rows_at: int


def _pick_bracket(brackets, order):
    chain = F.when(brackets[0].holds(order), 0)
    for i, bracket in enumerate(brackets[1:], start=1):
        chain = chain.when(bracket.holds(order), i)
    return chain


def _cut_index(order, cuts):
    """Index of the first cut at or after the row, by a balanced tree of comparisons."""

    def tree(first, last):
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(at_or_before(order, cuts[middle]), tree(first, middle)).otherwise(
            tree(middle + 1, last))

    return tree(0, len(cuts))


def _sample_cuts(keyed, order, brackets):
    """Cut keys for each bracket from a hash sample of its distinct keys; bounded by the fan-out."""
    names = [name for name, _ in order]
    wanted = FAN_OUT * SAMPLE_PER_CUT
    draw = F.pmod(F.xxhash64(*names), F.lit(HASH_RANGE))
    quota = F.lit(0)
    for i, bracket in enumerate(brackets):
        quota = F.when(F.col("_bracket") == i, F.lit(HASH_RANGE * wanted // max(bracket.rows, wanted))).otherwise(quota)
    sample = (
        keyed.withColumn("_bracket", _pick_bracket(brackets, order))
        .where(F.col("_bracket").isNotNull() & (draw < quota))
        .groupBy("_bracket", *names).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy("_bracket", *sort_columns(order))
        .collect()
    )
    return [
        _choose_cuts(
            [(tuple(row[name] for name in names), row["_n"]) for row in sample if row["_bracket"] == i],
            bracket)
        for i, bracket in enumerate(brackets)]


def _choose_cuts(drawn, bracket, parts=FAN_OUT):
    """Ascending cuts into about `parts` of equal weight, on as few leading key columns as will do.

    A leading value heavier than one step is cut off on both sides and divided by the next column.
    """
    step = max(1, sum(n for _, n in drawn) // parts)
    cuts = []

    def walk(keys, depth):
        passed, previous = 0, None
        for prefix, members in groupby(keys, key=lambda drawn_key: drawn_key[0][:depth]):
            members = list(members)
            weight = sum(n for _, n in members)
            passed += weight
            if weight > step:
                if previous is not None and passed > weight:
                    cuts.append(previous)
                if len(members) > 1:
                    walk(members, depth + 1)
            if passed >= step:
                cuts.append(prefix)
                passed = 0
            previous = prefix

    walk(drawn, 1)
    # A beginning of the upper end reaches at least as far as the end itself.
    return [cut for cut in cuts if bracket.high is None or bracket.high[:len(cut)] != cut]


def _narrow(keyed, order, brackets):
    """Replace each bracket by the parts of it that hold the wanted ranks.

    A bracket that offers no cut is one key as far as the sample can tell; it is left for good.
    """
    cuts = _sample_cuts(keyed, order, brackets)
    part = F.lit(0)
    for i, chosen in enumerate(cuts):
        part = F.when(F.col("_bracket") == i, _cut_index(order, chosen)).otherwise(part)
    counted = (
        keyed.withColumn("_bracket", _pick_bracket(brackets, order))
        .where(F.col("_bracket").isNotNull())
        .groupBy("_bracket", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .collect()
    )
    narrowed = []
    for i, (bracket, chosen) in enumerate(zip(brackets, cuts)):
        sizes = {row["_part"]: row["_n"] for row in counted if row["_bracket"] == i}
        start = bracket.start
        for p in range(len(chosen) + 1):
            rows = sizes.get(p, 0)
            ranks = [r for r in bracket.ranks if start < r <= start + rows]
            if ranks:
                narrowed.append(_Bracket(
                    chosen[p - 1] if p else bracket.low,
                    chosen[p] if p < len(chosen) else bracket.high,
                    start, rows, ranks, bool(chosen)))
            start += rows
    return narrowed


def _narrow_down(keyed, order, brackets, settle_rows):
    """Narrow until every bracket has at most `settle_rows` rows or cannot be divided."""
    wide = [b for b in brackets if b.rows > settle_rows and b.divisible]
    if not wide:
        return brackets
    settled = [b for b in brackets if b not in wide]
    return _narrow_down(keyed, order, settled + _narrow(keyed, order, wide), settle_rows)


def keys_at_ranks(df, order_by, ranks, total=None, settle_rows=SETTLE_ROWS):
    """The `Position` at each 1-based rank of the order; ranks outside the table are left out.

    `total` is the row count of `df`, if the caller knows it.

    Each pass divides the stretches that hold a wanted rank by the fan-out; it reads the key columns
    and shuffles counts only. Stretches of at most `settle_rows` rows are ranked exactly.
    """
    order = parse_order(order_by)
    names = [name for name, _ in order]
    keyed = df.select(*names)
    total = keyed.count() if total is None else total
    wanted = sorted({int(r) for r in ranks if 1 <= r <= total})
    if not wanted:
        return {}
    brackets = _narrow_down(keyed, order, [_Bracket(None, None, 0, total, wanted)], settle_rows)
    within = (
        Window.partitionBy("_bracket").orderBy(*sort_columns(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.lit(0).cast("long")
    hit = F.lit(False)
    for i, bracket in enumerate(brackets):
        mine = F.col("_bracket") == i
        starts = F.when(mine, F.lit(bracket.start).cast("long")).otherwise(starts)
        for rank in bracket.ranks:
            hit = hit | (mine & (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank))
    settled = (
        keyed.withColumn("_bracket", _pick_bracket(brackets, order))
        .where(F.col("_bracket").isNotNull())
        .groupBy("_bracket", *names).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(within))
        .withColumn("_upto", F.col("_upto") + starts)
        .where(hit)
        .collect()
    )
    found = {}
    for row in settled:
        position = Position(tuple(row[n] for n in names), row["_upto"] - row["_n"], row["_n"])
        for rank in wanted:
            if position.rows_before < rank <= row["_upto"]:
                found[rank] = position
    return found


# ---- ordered splits ---------------------------------------------------------------------------


def _border(positions, rank, order):
    """Condition 'among the first `rank` rows'."""
    if rank <= 0:
        return F.lit(False)
    position = positions[rank]
    if position.rows_before + position.rows_at != rank:
        raise ValueError("the order leaves rows tied at the border; add a unique column to it")
    return at_or_before(order, position.key)


def by_position(df, order_by, name="_id_length"):
    """(table, order): without an order given, policies are ordered by the number in their id.

    Ids grow by a digit from time to time, so the longer id is the later one.
    """
    if order_by is not None:
        return df, order_by
    return df.withColumn(name, F.length(POLICY_ID)), (name, POLICY_ID)


def split_ordered(df, order_by=None, train_share=0.80, part_col="part"):
    """Mark the first floor(share * n) rows of the order as train and the rest as test."""
    keyed, order_by = by_position(df, order_by)
    order = parse_order(order_by)
    total = df.count()
    border = int(total * train_share)
    positions = keys_at_ranks(keyed, order_by, [border], total)
    part = F.when(_border(positions, border, order), "train").otherwise("test")
    return keyed.select(*df.columns, part.alias(part_col))


def time_blocks(df, order_by=None, k=5, block_col="block"):
    """Number the blocks of an expanding split: 0 is only ever trained on, 1 to k are tested in turn.

    Each tested block has floor(n / (k + 1)) rows; fold f trains on the blocks before f and tests f.
    """
    keyed, order_by = by_position(df, order_by)
    order = parse_order(order_by)
    total = df.count()
    size = total // (k + 1)
    if size == 0:
        raise ValueError(f"{total} rows cannot be cut into {k + 1} blocks")
    borders = [total - (k - i) * size for i in range(k)]
    positions = keys_at_ranks(keyed, order_by, borders, total)
    block = F.lit(0)
    for border in borders:
        block = block + (~_border(positions, border, order)).cast("int")
    return keyed.select(*df.columns, block.alias(block_col))


def time_folds(df, order_by=None, k=5):
    """Expanding folds laid out: one row per (fold, row) with role train or test."""
    return (
        time_blocks(df, order_by, k, "_block")
        .withColumn("fold", F.explode(F.sequence(F.greatest(F.col("_block"), F.lit(1)), F.lit(k))))
        .withColumn("role", F.when(F.col("fold") == F.col("_block"), "test").otherwise("train"))
        .drop("_block")
    )
