"""Scans of series longer than a task: a series is cut by time, each piece is reduced to a small state, the states are scanned and handed back.

A piece holds the rows of one span of time of one series. Windows over rows are partitioned by series
and piece; only one row a piece is ever ordered along a whole series. Results are those of a window
over the whole series, whatever the width of a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugewright.functions.stats import DAY, micros

#: Microseconds of a piece: a reading every second gives 600,000 rows.
WIDTH = 7 * DAY

ORDER = ("ts", "value")


def cut(m: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows with ``_piece``, the span of time that holds their ts; rows without a time have a piece of their own, before all others."""
    return m.withColumn("_piece", F.floor(micros("ts") / width).cast("long"))


def within(keys: Sequence[str], *order: str) -> WindowSpec:
    """Along the rows of one piece."""
    return Window.partitionBy(*keys, "_piece").orderBy(*(order or ORDER))


def along(keys: Sequence[str]) -> WindowSpec:
    """Along the pieces of a series, one row each."""
    return Window.partitionBy(*keys).orderBy(F.col("_piece").asc_nulls_first())


def meet(rows: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their state; a null key meets null."""
    on = states.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in states.columns if c not in keys])
    alike = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    condition = alike[0]
    for c in alike[1:]:
        condition = condition & c
    return rows.join(on, condition, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def handed_on(rows: DataFrame, keys: Sequence[str], states: dict[str, Column], scan: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Rows (with _piece) and what the pieces before theirs hand on.

    ``states`` are aggregates of one piece; ``scan`` makes columns from the window over the pieces of
    a series, such as the sum of a state over all before.
    """
    by = [*keys, "_piece"]
    reduced = rows.groupBy(*by).agg(*[c.alias(n) for n, c in states.items()])
    window = along(keys)
    return meet(rows, reduced.select(*by, *[f(window).alias(n) for n, f in scan.items()]), by)


def before(window: WindowSpec) -> WindowSpec:
    """All pieces before one's own."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def after(window: WindowSpec) -> WindowSpec:
    """All pieces after one's own."""
    return window.rowsBetween(1, Window.unboundedFollowing)


def with_previous(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Rows (with _piece) and a value of the row before, in this piece or the last one that has rows."""
    told = handed_on(rows.withColumn("_own", F.struct(value.alias("v"))), keys, {"_last": F.max_by("_own", F.struct(*ORDER))}, {"_before": lambda w: F.lag("_last").over(w)})
    return told.withColumn(name, F.coalesce(F.lag("_own").over(within(keys)), F.col("_before"))["v"]).drop("_own", "_before")


def run_numbers(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], starts: Callable[[Column, Column], Column], name: str = "_run") -> DataFrame:
    """Rows (with _piece) and the number of their run along the series, from 1.

    ``starts`` says of the row before and a row, as structs of ``columns``, whether a run begins; the
    first row of a series begins one. Inside a piece that is a sum over its rows; where pieces meet,
    their last and first rows decide.
    """
    by, order = [*keys, "_piece"], (*ORDER, *[c for c in columns if c not in ORDER])
    window = within(keys, *order)
    begins = lambda p, c: F.coalesce(starts(p, c), F.lit(False)).cast("int")
    held = rows.withColumn("_c", F.struct(*columns)).withColumn("_p", F.lag("_c").over(window))
    held = held.withColumn("_s", F.when(F.col("_p").isNull(), 0).otherwise(begins(F.col("_p"), F.col("_c"))))
    held = held.withColumn("_local", F.sum("_s").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_p")
    at = F.struct(*order)
    states = held.groupBy(*by).agg(F.sum("_s").alias("_total"), F.min_by("_c", at).alias("_first"), F.max_by("_c", at).alias("_last"))
    scan = along(keys)
    states = states.withColumn("_pl", F.lag("_last").over(scan)).withColumn("_meets", F.when(F.col("_pl").isNull(), 1).otherwise(begins(F.col("_pl"), F.col("_first"))))
    offset = F.sum("_meets").over(scan.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_total").over(before(scan)), F.lit(0))
    return meet(held, states.select(*by, offset.alias("_offset")), by).withColumn(name, F.col("_local") + F.col("_offset")).drop("_c", "_s", "_local", "_offset")


def widened_by_time(rows: DataFrame, reach: int, width: int = WIDTH) -> DataFrame:
    """Rows in their own piece (``_own`` true) and in every later one that begins less than ``reach`` microseconds after them.

    A frame of that length back from a row of a piece then lies in its piece.
    """
    at = micros("ts")
    home = F.floor(at / width).cast("long")
    spread = rows.withColumn("_home", home).withColumn("_piece", F.explode_outer(F.sequence(home, F.floor((at + reach) / width).cast("long"))))
    return spread.withColumn("_own", F.col("_piece").eqNullSafe(F.col("_home"))).drop("_home")


def widened_by_rows(rows: DataFrame, keys: Sequence[str], back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows (with _piece) in their own piece (``_own`` true), and the nearest ts and value of so many rows of the pieces around it.

    Each piece hands on that many of its own last (and first) rows at most; where a piece has fewer,
    those of the pieces beyond it follow.
    """
    by = [*keys, "_piece"]
    own = rows.withColumn("_own", F.lit(True))
    out = own

    def around(n: int, order: WindowSpec, frame: Callable[[WindowSpec], WindowSpec], last: bool) -> DataFrame:
        ends = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
        held = ends.groupBy(*by).agg(F.collect_list(F.struct(F.col("_piece").alias("p"), F.col("_n").alias("n"), *ORDER)).alias("_rows"))
        held = held.withColumn("_near", F.flatten(F.collect_list("_rows").over(frame(along(keys)))))
        # the nearest rows: nearest pieces first, then nearest to the border
        rank = lambda r: F.struct((-F.coalesce(r["p"], F.lit(-(1 << 40))) if last else F.coalesce(r["p"], F.lit(-(1 << 40)))).alias("p"), r["n"].alias("n"), r["ts"].alias("ts"), r["value"].alias("value"))
        nearest = F.slice(F.array_sort(F.transform("_near", rank)), 1, n)
        return held.select(*by, F.explode(nearest).alias("r")).select(*by, F.col("r.ts").alias("ts"), F.col("r.value").alias("value"), F.lit(False).alias("_own"))

    if back:
        backwards = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in ORDER])
        out = out.unionByName(around(back, backwards, lambda w: w.rowsBetween(-back, -1), True), allowMissingColumns=True)
    if ahead:
        out = out.unionByName(around(ahead, within(keys), lambda w: w.rowsBetween(1, ahead), False), allowMissingColumns=True)
    return out
