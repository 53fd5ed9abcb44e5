"""Ranking inside snapshots: top-k, global order, shares, Pareto prefixes.

A snapshot (``server_name, collected_at``) can be any size, so nothing here
sorts a whole snapshot in one task unless the caller vouches for its size with
``strategy="plain"``.

The order is always "by" columns (numeric, descending, NULL last) followed by
entity columns (ascending).  The entity columns should identify a row within
its group; where they do not, a hash of the whole row decides, so ranks are
reproducible and any crowd of equal measures can be split.  NULL is a group
like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetgauge.functions.arithmetic import percent_of
from fleetgauge.operators.prefilter import among, filterable, unpruned
from fleetgauge.sources.schemas import KEYS

# Up to this k Spark prunes row_number() <= k before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
_PRUNED_K = 1000
# Rows one task is meant to sort: a group of more is cut into ranges of about
# that many.
_RANGE_ROWS = 1_000_000
# Least bytes of a row, to tell from an input's size that no group can be larger than a range.
_ROW_BYTES = 64
# Candidates for each cut, of which one is used: ranges come out more even.
_CANDIDATES = 8
# Cuts of one array.  Groups that need more are cut in two steps.
_FAN = 1024
# Rows of a hot group meet its cuts in so many parts.
_PARTS = 1024


def ordering(by: Sequence[str], entity: Sequence[str] = ()) -> list[Column]:
    """Sort columns of the common order."""
    return [F.desc_nulls_last(c) for c in by] + [F.asc_nulls_first(c) for c in entity]


def sort_filtered(df: DataFrame, spread: Sequence[str | Column], *order: str | Column) -> DataFrame:
    """Global sort of what a filter leaves of a scan.

    A global sort first samples its input for the range bounds.  Through the
    exchange (over the ``spread`` columns) both passes read the few rows left,
    instead of scanning and filtering the source a second time.
    """
    return df.repartition(*spread).orderBy(*order)


def _window(group: Sequence[str], by: Sequence[str] = (), entity: Sequence[str] = (), frame: str = "") -> str:
    order = ", ".join([f"{c} DESC NULLS LAST" for c in by] + [f"{c} ASC NULLS FIRST" for c in entity])
    return f"OVER (PARTITION BY {', '.join(group)} {f'ORDER BY {order}' if order else ''} {frame})"


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def top_k(
    df: DataFrame, by: Sequence[str], entity: Sequence[str], k: int, group: Sequence[str] = KEYS
) -> DataFrame:
    """First ``k`` rows of every group, ``row_rank`` an INT.

    For the usual small k every task keeps only its own best k rows of a group
    before the shuffle, so a hot group costs k rows per task.  Beyond that the
    rows are ranked range by range, with the same result.
    """
    columns = [f"`{c}`" for c in df.columns]
    if k <= _PRUNED_K:
        ranked = df.selectExpr("*", f"row_number() {_window(group, by, entity)} AS row_rank")
    else:
        ranked = ordered(df, by, entity, group=group)
    return ranked.where(f"row_rank <= {k}").selectExpr(*columns, "CAST(row_rank AS INT) AS row_rank")


def ordered(
    df: DataFrame,
    by: Sequence[str],
    entity: Sequence[str],
    measure: str | None = None,
    group: Sequence[str] = KEYS,
    strategy: str = "bucketed",
    below: float | None = None,
    range_rows: int = _RANGE_ROWS,
) -> DataFrame:
    """Add ``row_rank`` and, for a measure, ``prior_sum`` and ``group_sum``.

    ``prior_sum`` is the measure's total over the rows before this one,
    ``group_sum`` over the whole group.  ``below`` keeps only the rows whose
    prior sum is under that percentage of the group's sum.

    ``plain`` orders a group in one task.  ``bucketed`` cuts groups of more than
    ``range_rows`` rows into ranges, one task each: counts and sums of the
    ranges give every range its offset.  Which groups those are is found within
    the same plan, so nothing runs before an action: the rows are dealt out
    once, by their hash, and all that follows reads that exchange.  A filter
    of fixed size tells the rows of hot groups from the others; a group it
    takes for hot is cut as well, into one range, and so are all groups if
    their names are collated.  An input that is small as a
    whole has no large group: it is planned as ``plain``, by Spark's estimate.
    """
    if strategy not in ("plain", "bucketed"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "plain" or _estimated_bytes(df) <= range_rows * _ROW_BYTES:
        return _below(_ranked(df, by, entity, measure, group), below)

    if not filterable(df, group):
        return _by_range(df, by, entity, measure, group, below, range_rows)

    dealt = df.repartition(F.xxhash64(*(f"`{c}`" for c in df.columns)))
    sizes = dealt.groupBy(*group).agg(F.expr(f"sum(1L + {unpruned(df.columns)}) AS group_rows"))
    # Zero, but no constant to Spark: a filter that can be moved would go below the exchange, which then is one for each branch.
    zero = F.rand(0).cast("int")
    is_hot = among(sizes.where(f"group_rows > {range_rows}"), group).cast("int") + zero == 1
    cool = _below(_ranked(dealt.where(~is_hot), by, entity, measure, group), below)
    cut = _by_range(dealt.where(is_hot), by, entity, measure, group, below, range_rows)
    # Sums of sums can be wider decimals.
    return cool.union(cut.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in cool.schema)))


def _estimated_bytes(df: DataFrame) -> int:
    """Size of a frame by the files it reads, as Spark estimates it for joins; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _by_range(
    df: DataFrame,
    by: Sequence[str],
    entity: Sequence[str],
    measure: str | None,
    group: Sequence[str],
    below: float | None,
    range_rows: int,
) -> DataFrame:
    """The same for groups of any size, range by range."""
    ranges = [*group, "coarse", "fine"]
    placed = df.selectExpr("*", "CAST(0 AS BIGINT) AS coarse", "CAST(0 AS BIGINT) AS fine")
    placed = _cut(placed, by, entity, group, range_rows * _FAN, "coarse")
    placed = _cut(placed, by, entity, [*group, "coarse"], range_rows, "fine")
    # Offsets of the ranges; a group that was not cut is one range and needs none.
    before = _window(group, entity=["coarse", "fine"], frame=_BEFORE)
    exprs = [f"coalesce(sum(n) {before}, 0) AS n_before"]
    if measure is not None:
        exprs += [f"coalesce(sum(s) {before}, 0) AS s_before", f"sum(s) {_window(group)} AS s_group"]
    offsets = (
        placed.groupBy(*ranges)
        .agg(F.expr("count(*) AS n"), *([F.sum(measure).alias("s")] if measure else []))
        .selectExpr(*(f"`{c}` AS `at_{c}`" for c in ranges), *exprs)
    )
    if measure is not None and below is not None:
        # Whole ranges past the threshold never reach the row-level sort.
        offsets = offsets.where(f"s_before < {_limit('s_group', below)}")
    same = [placed[c].eqNullSafe(offsets[f"at_{c}"]) for c in group] + [placed[c] == offsets[f"at_{c}"] for c in ranges[-2:]]
    joined = placed.join(offsets, same).drop(*(f"at_{c}" for c in ranges))
    inside = _ranked(joined, by, entity, measure, ranges)
    exprs = ["n_before + row_rank AS row_rank"]
    if measure is not None:
        exprs += ["s_before + prior_sum AS prior_sum", "s_group AS group_sum"]
    columns = [f"`{c}`" for c in df.columns]
    return _below(inside.selectExpr(*columns, *exprs), below)


def _ranked(
    df: DataFrame, by: Sequence[str], entity: Sequence[str], measure: str | None, group: Sequence[str]
) -> DataFrame:
    """Rank and sums with each group in one task."""
    exprs = [f"CAST(row_number() {_window(group, by, entity)} AS BIGINT) AS row_rank"]
    if measure is not None:
        exprs += [
            f"coalesce(sum({measure}) {_window(group, by, entity, _BEFORE)}, 0) AS prior_sum",
            f"sum({measure}) {_window(group)} AS group_sum",
        ]
    return df.selectExpr("*", *exprs)


def _below(ranked: DataFrame, below: float | None) -> DataFrame:
    return ranked if below is None else ranked.where(f"prior_sum < {_limit('group_sum', below)}")


def _cut(
    df: DataFrame, by: Sequence[str], entity: Sequence[str], keys: Sequence[str], rows: int, name: str
) -> DataFrame:
    """Set column ``name`` to the range, of about ``rows`` rows, that a row falls in.

    A group is cut at some of its own rows, picked by a hash of the row.  The
    choice depends on values alone, so a task that is run again sees the same
    ranges.  It only balances the work: rows are neither dropped nor reordered,
    whatever the cuts.  Cuts are as many as the rows ask for; they reach the
    rows in ``_PARTS`` copies, which is a fixed fraction of the group.
    """
    columns = [f"`{c}`" for c in df.columns]
    values = [c for c in df.columns if c not in ("coarse", "fine")]
    tie = f"xxhash64({', '.join(f'`{c}`' for c in values)})"
    # Ascending comparison of this struct is the common order.
    position = f"struct({', '.join([f'{c} IS NULL, -{c}' for c in by] + list(entity))}, {tie})"
    picked = df.where(f"pmod({tie}, {max(1, rows // _CANDIDATES)}) = 0")
    every = f"transform(sequence({_CANDIDATES}, size(found), {_CANDIDATES}), i -> get(found, i - 1))"
    cuts = (
        picked.selectExpr(*keys, f"{tie} AS tie", f"{position} AS position")
        # Equal rows cannot be told apart: one of them is enough.  (Sets cannot hold collated names.)
        .dropDuplicates([*keys, "tie"])
        .groupBy(*keys)
        .agg(F.expr("array_sort(collect_list(position)) AS found"))
        .where(f"size(found) >= {_CANDIDATES}")
        .selectExpr(*(f"`{c}` AS `cut_{c}`" for c in keys), f"{every} AS cuts")
        .selectExpr("*", f"explode(sequence(0, {_PARTS - 1})) AS cut_part")
    )
    spread = df.selectExpr("*", f"pmod(xxhash64({tie}, 'part'), {_PARTS}) AS part", f"{position} AS position")
    same = [spread[c].eqNullSafe(cuts[f"cut_{c}"]) for c in keys] + [spread["part"] == cuts["cut_part"]]
    # The number of cuts up to a row, by binary search over the bits of the answer.
    steps = "sequence(CAST(floor(log2(size(cuts))) AS INT), 0, -1)"
    step = "shiftleft(1, bit)"
    search = (
        f"aggregate({steps}, 0, (at, bit) -> IF(get(cuts, at + {step} - 1) <= position, at + {step}, at))"
    )
    found = f"CAST(IF(cuts IS NULL, 0, {search}) AS BIGINT)"
    return spread.join(cuts, same, "left").selectExpr(
        *(f"{found} AS `{name}`" if c == f"`{name}`" else c for c in columns)
    )


def _limit(total: str, percent: float) -> str:
    """Integers below this are under ``percent`` of ``total``; exact, and 0 for an empty total."""
    return f"CAST(ceil(CAST({total} AS DECIMAL(20,0)) * {percent}BD * 0.01BD) AS BIGINT)"


def share_rank(
    df: DataFrame,
    measure: str,
    entity: Sequence[str],
    group: Sequence[str] = KEYS,
    strategy: str = "bucketed",
) -> DataFrame:
    """Add the rank by ``measure`` and its percentage of the group's total."""
    ranked = ordered(df, [measure], entity, measure, group, strategy)
    return ranked.selectExpr("*", f"{percent_of(measure, 'group_sum', 2)} AS share")


def pareto_prefix(
    df: DataFrame,
    measure: str,
    entity: Sequence[str],
    threshold: float = 95,
    group: Sequence[str] = KEYS,
    strategy: str = "bucketed",
) -> DataFrame:
    """Largest contributors that together reach ``threshold`` percent of a group.

    A row stays while the share of the rows before it is still under the
    threshold, so the row that crosses it is kept and the first always is.
    Adds ``row_rank``, ``prior_sum`` and ``group_sum``.
    """
    known = df.where(f"{measure} IS NOT NULL")
    return ordered(known, [measure], entity, measure, group, strategy, below=threshold)
