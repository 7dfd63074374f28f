"""Prefixes and neighbours in groups of any size: a large group is cut in pieces, and what passes between them is composed.

A window over a statement is one task, however long the statement is. Here rows of a large group are dealt to pieces by
ranges of their order, windows work within pieces, each piece is summed up in one row (its last values, its counts, its
first row), and a window over those few rows gives each piece what comes before or after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import plain_unions, settled

#: Rows above which a group is cut, and the pieces it is cut in at most; a power of two.
LARGE, PIECES = 200_000, 256
PIECE = "__piece"


@dataclass(frozen=True)
class Ordered:
    """Rows in groups (`by`) in the order of a number. All have a PIECE; it is 0 throughout unless a group was cut."""

    rows: DataFrame
    by: tuple[str, ...]
    order: str
    cut: bool

    @staticmethod
    def of(rows: DataFrame, by: list[str], order: str) -> Ordered:
        """Groups of more than LARGE rows are cut at quantiles of their order, which are estimated; any cut gives the same results.

        Group sizes are counted first, from the columns `by` alone.
        """
        plain_unions(rows.sparkSession)
        large = rows.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > LARGE).select(*by)
        if large.isEmpty():
            return Ordered(rows.withColumn(PIECE, F.lit(0)), tuple(by), order, False)
        rows, large = settled(rows), settled(large)
        held = _meet(rows.select(*by, order), large.withColumn("__in", F.lit(True)), by).filter("__in")
        bounds = held.groupBy(*by).agg(F.percentile_approx(order, [i / PIECES for i in range(1, PIECES)], 10_000).alias("__bounds"))
        # How many bounds are below the row, by halving; none for groups without bounds.
        steps = F.array(*[F.lit(PIECES >> i) for i in range(1, PIECES.bit_length())])
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.col("__bounds")[at + step - 1] < F.col(order), at + step).otherwise(at))
        return Ordered(settled(_meet(rows, bounds, by).withColumn(PIECE, below).drop("__bounds")), tuple(by), order, True)

    def then(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """With the rows changed one by one or left out; `by`, the order and PIECE have to stay."""
        return replace(self, rows=change(self.rows))

    def spread(self, tasks: int) -> Ordered:
        """With groups, or pieces of them, dealt to so many tasks, where windows find them: what is added next is computed there."""
        return replace(self, rows=self.rows.repartition(tasks, *self.by, *([PIECE] if self.cut else [])))

    def _settled(self) -> Ordered:
        """Once groups are cut, rows are read twice in each step, so that they are written before."""
        return replace(self, rows=settled(self.rows)) if self.cut else self

    def _window(self):
        return Window.partitionBy(*self.by, *([PIECE] if self.cut else [])).orderBy(self.order)

    def _composed(self, rows: DataFrame, edges: DataFrame, own: dict[str, Column]) -> Ordered:
        """rows with edges of each piece joined; own: the result of a name, from its local column and its edge."""
        wide = _meet(rows, edges, [*self.by, PIECE])
        return replace(self, rows=wide.select(*self.rows.columns, *[c.alias(n) for n, c in own.items()]))

    def carried(self, last: dict[str, Column] | None = None, last_before: dict[str, Column] | None = None, count: dict[str, Column] | None = None, count_before: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> Ordered:
        """With columns: the last value that is not null (a null row counts as none), how many rows hold a condition, and the
        sum of whole numbers, up to and with the row, or before it."""
        here = self._settled()
        w = here._window()
        to, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
        values, counts = {**(last or {}), **(last_before or {})}, {**(count or {}), **(count_before or {})}
        frame = lambda n: before if n in (last_before or {}) or n in (count_before or {}) else to
        local = {n: F.last(e, ignorenulls=True).over(frame(n)) for n, e in values.items()}
        local |= {n: F.coalesce(F.count_if(F.coalesce(e, F.lit(False))).over(frame(n)), F.lit(0)) for n, e in counts.items()}
        local |= {n: F.coalesce(F.sum(e).over(to), F.lit(0)) for n, e in (total or {}).items()}
        if not here.cut:
            return replace(here, rows=here.rows.select("*", *[c.alias(n) for n, c in local.items()]))
        rows = here.rows.select("*", *[c.alias(f"__own_{n}") for n, c in local.items()])
        sums = [F.max_by(F.struct(e.alias("v")), F.when(e.isNotNull(), F.col(here.order))).alias(n) for n, e in values.items()]
        sums += [F.count_if(F.coalesce(e, F.lit(False))).alias(n) for n, e in counts.items()]
        sums += [F.sum(e).alias(n) for n, e in (total or {}).items()]
        counts = {**counts, **(total or {})}
        past = Window.partitionBy(*here.by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        edges = here.rows.groupBy(*here.by, PIECE).agg(*sums)
        edges = edges.select(*here.by, PIECE, *[F.last(n, ignorenulls=True).over(past).alias(f"__at_{n}") for n in values], *[F.sum(n).over(past).alias(f"__at_{n}") for n in counts])
        own = {n: F.coalesce(f"__own_{n}", F.col(f"__at_{n}")["v"]) for n in values} | {n: F.col(f"__own_{n}") + F.coalesce(f"__at_{n}", F.lit(0)) for n in counts}
        return here._composed(rows, edges.filter(F.col(PIECE) > 0), own)

    def followed(self, lead: dict[str, Column]) -> Ordered:
        """With columns of the next row of the group; null at its end."""
        here = self._settled()
        local = {n: F.lead(F.struct(e.alias("v"))).over(here._window()) for n, e in lead.items()}
        if not here.cut:
            return replace(here, rows=here.rows.select("*", *[c["v"].alias(n) for n, c in local.items()]))
        rows = here.rows.select("*", *[c.alias(f"__own_{n}") for n, c in local.items()])
        edges = here.rows.groupBy(*here.by, PIECE).agg(*[F.min_by(F.struct(e.alias("v")), here.order).alias(n) for n, e in lead.items()])
        pieces = Window.partitionBy(*here.by).orderBy(PIECE)
        edges = edges.select(*here.by, PIECE, *[F.lead(n).over(pieces).alias(f"__at_{n}") for n in lead])
        return here._composed(rows, edges, {n: F.coalesce(f"__own_{n}", f"__at_{n}")["v"] for n in lead})


def _meet(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of few, which has a row a key at most; null keys are keys."""
    other = [c for c in few.columns if c not in keys]
    right = few.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *other)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return rows.join(right, same, "left").select(*rows.columns, *other)
