"""Point-in-time history: what was known of a key strictly before a cutoff.

``last_n_before`` takes one window pass over the history, which turns every row into the running
aggregate of the last n rows up to it, and one pass over history and targets together, which hands
each target the last such state strictly before its cutoff. Cost is a sort of history and targets by
key, never targets x history. Rows of one moment are ordered by descending id, so that of equal
times the smallest id counts as the latest, as in ``ORDER BY ended_at DESC, game_id ASC``.

``lists_before`` and ``sums_before`` deal out history and targets together, once and as narrow rows: a target is given lists of
the last rows, or sums over all rows, without a state that would travel with every row of the history.

A key of over ``BUCKET_ROWS`` rows is cut into stretches of time, and each stretch is given the last n rows of those before it (from a
table of n rows a stretch): then a task works on one stretch, whatever share of the history one key has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.session import settled

TARGET_GAME, MISSING_ENDED_AT, END_NOT_BEFORE_CUTOFF = "TARGET_GAME", "MISSING_ENDED_AT", "END_NOT_BEFORE_CUTOFF"


def exclusion_reason(game_id: Column, ended_at: Column, target_id: Column, cutoff: Column) -> Column:
    """Why a match is no history of a target, null if it is; the first reason counts."""
    return (
        F.when(game_id == target_id, TARGET_GAME)
        .when(ended_at.isNull(), MISSING_ENDED_AT)
        .when(ended_at >= cutoff, END_NOT_BEFORE_CUTOFF)
    )


BUCKET_ROWS = 1_000_000


def by_stretches(history: DataFrame, targets: DataFrame, keys: Sequence[str], n: int, ts: str, id_col: str, cutoff: str, bucket_rows: int, within: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """History and targets with ``stretch__``, and the last n rows (of each value of ``within``) before each stretch of a large key among its own.

    Stretches are cut at times, so rows of one moment stay together. Keys of up to ``bucket_rows`` rows are one stretch.
    """
    zero = F.lit(0).alias("stretch__")
    own = history.where(F.col(ts).isNotNull())
    if history.count() <= bucket_rows:
        return history.select("*", zero), targets.select("*", zero)
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows__")).where(F.col("rows__") > bucket_rows)
    hot = settled(sizes.withColumn("cuts__", F.ceil(F.col("rows__") / bucket_rows).cast("int")), "hot-keys")  # fewer than all rows / bucket_rows
    most = hot.agg(F.max("cuts__")).first()[0]
    if not most:
        return history.select("*", zero), targets.select("*", zero)
    same = lambda a, b, more=(): [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, *more)]
    of_hot = own.alias("o").join(F.broadcast(hot.select(*keys).alias("h")), same("o", "h"), "left_semi")
    marks = ", ".join(f"{i / most}D" for i in range(1, most))
    at = of_hot.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("at__"))
    cuts = settled(at.groupBy(*keys).agg(F.array_distinct(F.expr(f"percentile_approx(at__, array({marks}), 10000)")).alias("cuts__")), "hot-cuts")
    steps = [F.lit(1 << i) for i in reversed(range(most.bit_length()))]

    def placed(rows: DataFrame, time: str) -> DataFrame:
        """The number of cuts before each row, by binary search: a key may have thousands of cuts."""
        at = F.unix_micros(F.col(f"o.{time}").cast("timestamp"))
        found = rows.alias("o").join(F.broadcast(cuts.alias("h")), same("o", "h"), "left")
        passed = F.aggregate(F.array(*steps), F.lit(0), lambda low, step: F.when(F.get("h.cuts__", low + step - 1) < at, low + step).otherwise(low))
        return found.select("o.*", passed.alias("stretch__"))

    rows = placed(own, ts)
    recent = Window.partitionBy(*keys, *within, "stretch__").orderBy(F.desc(ts), id_col)
    tails = placed(of_hot, ts).withColumn("n__", F.row_number().over(recent)).where(F.col("n__") <= n)
    # one row a stretch: its tail, newest first, and of all tails before it the newest n
    row = F.struct("n__", F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("row__"))
    newest = F.array_sort(F.collect_list(row), lambda a, b: a["n__"] - b["n__"])
    lists = tails.groupBy(*keys, *within, "stretch__").agg(newest.alias("tail__"))
    order = Window.partitionBy(*keys, *within).orderBy("stretch__")
    upto = F.slice(F.flatten(F.reverse(F.collect_list("tail__").over(order.rowsBetween(1 - n, Window.currentRow)))), 1, n)
    lists = lists.select(*keys, *within, "stretch__", upto.alias("upto__"))
    empty = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("cuts__"))).alias("stretch__"))
    if within:  # a value of those may have no rows in a stretch
        empty = empty.alias("o").join(of_hot.select(*keys, *within).distinct().alias("h"), same("o", "h")).select("o.*", *(f"h.{c}" for c in within))
    lists = empty.alias("o").join(lists.alias("h"), [*same("o", "h", within), F.col("o.stretch__") == F.col("h.stretch__")], "left").select("o.*", "h.upto__")
    before = F.last("upto__", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    carried = lists.select("stretch__", before.alias("before__")).select("stretch__", F.explode("before__").alias("c__")).select("stretch__", "c__.row__.*")
    return rows.unionByName(carried), placed(targets, cutoff)


def last_n_before(
    history: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    n: int | None,
    states: dict[str, Column | tuple[int, Column]],
    ts: str = "ended_at",
    id_col: str = "game_id",
    cutoff: str = "cutoff",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``targets`` with each of ``states``, an aggregate of the last n (None: all) rows of its keys before its cutoff.

    A state may be a pair of a smaller n of its own and the aggregate. States are null where there is no such row. Targets
    keep all their columns and may repeat; null keys match null keys.
    """
    columns = targets.columns
    if n is not None:
        history, targets = by_stretches(history, targets, keys, n, ts, id_col, cutoff, bucket_rows)
        keys = [*keys, "stretch__"]
    order = Window.partitionBy(*keys).orderBy(ts, F.desc(id_col))
    frame = lambda m: order.rowsBetween(Window.unboundedPreceding if m is None else 1 - m, Window.currentRow)
    over = {s: e if isinstance(e, tuple) else (n, e) for s, e in states.items()}
    own = history.where(F.col(ts).isNotNull())
    own = own.select(
        *keys,
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at__"),
        F.struct(*(e.over(frame(m)).alias(s) for s, (m, e) in over.items())).alias("state__"),
        (~F.lead(ts).over(order).eqNullSafe(F.col(ts))).alias("last__"),
    ).where("last__")
    rest = [c for c in columns if c not in keys]
    asked = targets.select(*keys, F.unix_micros(F.col(cutoff).cast("timestamp")).alias("at__"), F.struct(F.lit(True).alias("asked__"), *(F.col(c) for c in rest)).alias("row__"))
    both = own.select(*keys, "at__", "state__").unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("at__").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("seen__", F.last("state__", ignorenulls=True).over(before)).where("row__ IS NOT NULL")
    return seen.select(*(F.col(c) if c in keys else F.col(f"row__.{c}") for c in columns), *(F.col(f"seen__.{s}").alias(s) for s in states))


def lists_before(
    history: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    lists: Sequence[tuple[int, Column, Sequence[str], Callable[[Column], Sequence[Column]]]],
    ts: str = "ended_at",
    id_col: str = "game_id",
    cutoff: str = "cutoff",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``targets`` (without the cutoff) with columns made of lists of the last rows of the history before their cutoff.

    Each of ``lists`` is a number n, a value of the history's columns, further columns that, beside ``keys``, those last
    n rows share with the target, and a function of the list, oldest first, that gives the named columns wanted of it.
    History and targets may have columns of one name and type, which travel as one.
    """
    columns = [c for c in targets.columns if c != cutoff]
    within = list(dict.fromkeys(k for _, _, more, _ in lists for k in more))
    history, targets = by_stretches(history, targets, keys, max(n for n, *_ in lists), ts, id_col, cutoff, bucket_rows, within)
    keys = [*keys, "stretch__"]
    rows, asked = _as_one(history, targets, ts, cutoff), F.col("asked__")
    for i, more in enumerate(dict.fromkeys(tuple(more) for _, _, more, _ in lists)):
        own = [(n, value, columns_of) for n, value, m, columns_of in lists if tuple(m) == more]
        # each row is given the number of the last row of the history up to it; of equal times the smallest id comes last, targets come first
        order = Window.partitionBy(*keys, *more).orderBy("at__", F.desc("asked__"), F.desc(id_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("n__", F.count(F.when(~asked, True)).over(order))
        frame = lambda n: Window.partitionBy(*keys, *more).orderBy("n__").rangeBetween(1 - n, Window.currentRow)  # noqa: B023, E731
        found = rows.withColumns({f"list_{i}_{j}__": F.collect_list(F.when(~asked, value)).over(frame(n)) for j, (n, value, _) in enumerate(own)})
        made = [c for j, (_, _, columns_of) in enumerate(own) for c in columns_of(F.when(asked, F.col(f"list_{i}_{j}__")))]
        rows = found.select(*(c for c in rows.columns if c != "n__"), *made)  # lists end here: the next sort has narrow rows
    return rows.where(asked).select(*columns, *(c for c in rows.columns if c not in {*columns, *history.columns, *targets.columns, "at__", "asked__"}))


def _as_one(history: DataFrame, targets: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows of the history with a time, and targets (``asked__``), with their time as ``at__``."""
    moment = lambda df, c, asked: df.withColumns({"at__": F.unix_micros(F.col(c).cast("timestamp")), "asked__": F.lit(asked)}).drop(c)
    return moment(history.where(F.col(ts).isNotNull()), ts, False).unionByName(moment(targets, cutoff, True), allowMissingColumns=True)


def sums_before(history: DataFrame, targets: DataFrame, keys: Sequence[str], sums: dict[str, Column], ts: str = "ended_at", cutoff: str = "cutoff") -> DataFrame:
    """``targets`` (without the cutoff) with ``sums``, aggregates that pass over nulls, of all rows of their keys before their cutoff; null keys match null keys."""
    before = Window.partitionBy(*keys).orderBy("at__").rangeBetween(Window.unboundedPreceding, -1)
    rows = _as_one(history, targets, ts, cutoff).withColumns({name: e.over(before) for name, e in sums.items()})
    return rows.where("asked__").select(*(c for c in targets.columns if c != cutoff), *sums)


def nth_end(history: DataFrame, keys: Sequence[str], n: int, ts: str = "ended_at", name: str = "nth_end") -> DataFrame:
    """The keys of at least n rows with a time, each once, with the time of their n-th row. A cutoff has n rows before it if it is after that time.

    Of each key a task sends on n rows at most.
    """
    order = Window.partitionBy(*keys).orderBy(ts)
    first = history.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias(name), F.row_number().over(order).alias("n__")).where(F.col("n__") <= n)
    return first.where(F.col("n__") == n).drop("n__")


def reason_counts(history: DataFrame, targets: DataFrame, keys: Sequence[str], ts: str = "ended_at", id_col: str = "game_id", cutoff: str = "cutoff") -> DataFrame:
    """(reason, n): how many matches of its keys each reason keeps out of a target's history, or ACCEPTED, over all targets.

    ``targets`` have the ids of their own matches. Counted by running sums and grouped counts, never target by match.
    """
    seen = last_n_before(history, targets, keys, None, {"earlier__": F.count(F.lit(1))}, ts, id_col, cutoff)
    whole = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("all__"), F.count_if(F.col(ts).isNull()).alias("open__"))
    own = history.groupBy(id_col, *keys).agg(F.count(F.lit(1)).alias("self__"), F.count_if(F.col(ts).isNull()).alias("self_open__"), F.sort_array(F.collect_list(ts)).alias("ends__"))
    seen = seen.join(whole, list(keys), "left").join(own, [id_col, *keys], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own_earlier = F.coalesce(F.size(F.filter("ends__", lambda e: e < F.col(cutoff))), F.lit(0))
    accepted = zero("earlier__") - own_earlier
    missing = zero("open__") - zero("self_open__")
    late = zero("all__") - zero("self__") - missing - accepted
    counts = F.array(*(F.struct(F.lit(r).alias("reason"), n.cast("long").alias("n")) for r, n in ((TARGET_GAME, zero("self__")), (MISSING_ENDED_AT, missing), (END_NOT_BEFORE_CUTOFF, late), ("ACCEPTED", accepted))))
    found = seen.select(F.explode(counts).alias("c")).groupBy("c.reason").agg(F.sum("c.n").alias("n"))
    return found.where("n > 0")


def rate(wins: Column, games: Column) -> Column:
    """Share of wins; null, never 0 or 0.5, without games."""
    return F.when(games > 0, wins / games)


def continuity(roster: Column, previous: Column) -> Column:
    """Players in common with the previous roster, of five."""
    return F.when(previous.isNotNull(), F.size(F.array_intersect(roster, previous)) / 5)
