"""The time stage: all variables of a spec as few grouped aggregations as there are chains of periods.

Variables whose steps begin alike share the beginning: every reduction from one table
to one period is an expression of a single groupBy, and equal expressions are one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.functions import periods
from terrapane.functions.reducers import aggregates, result
from terrapane.functions.transforms import interact, power, spline
from terrapane.plans.spec import AggregateStep, Step, TransformStep, parse, step_names


@dataclass
class _Item:
    """A variable on its way: its outputs' names and columns so far, and the steps left."""

    base: str
    outputs: list[tuple[str, str]]
    steps: list[Step]


@dataclass
class _Table:
    """Rows of (cell_id, time) and columns by what they hold; frequency None for samples."""

    df: DataFrame
    frequency: str | None
    known: dict[Any, str] = field(default_factory=dict)
    added: dict[str, Column] = field(default_factory=dict)

    def column(self, key: Any, make) -> str:
        if key not in self.known:
            self.known[key] = name = f"x{len(self.known)}"
            self.added[name] = make()
        return self.known[key]

    def flush(self) -> None:
        if self.added:
            self.df = self.df.withColumns(self.added)
            self.added = {}


class TimeStage:
    """Compiles a spec over a cube of cell_id, time and value.

    missing="sparse": the rows there are make a window.  missing="dense": all cells share the cube's
    time axis, so a cell that lacks a step of a period misses a sample there, and a period between
    the first and the last without any step is missing as a whole.

    `axis` has the steps in a column time; without it they are read from the cube's times, which is one more
    scan, of that column alone.  All reductions take their periods from it: none runs for the sake of another.
    """

    def __init__(self, cube: DataFrame, missing: str = "sparse", calendar: str = "standard", axis: DataFrame | None = None):
        if missing not in ("sparse", "dense"):
            raise ValueError(f"missing must be 'sparse' or 'dense', not {missing!r}")
        self.cube, self.missing, self.calendar = cube, missing, periods.calendar_of(calendar)
        self.steps = (cube if axis is None else axis).select("time").distinct()

    def label(self, time: Column, frequency: str) -> Column:
        return periods.label(time, frequency) if self.calendar == "standard" else periods.cf_label(time, frequency, self.calendar)

    def run(self, spec: Mapping[str, Any]) -> dict[str, tuple[DataFrame, list[str]]]:
        """For each chain of periods, like "date-month", a table of cell_id, time and its outputs, and their names."""
        items = [_Item(name, [(name, "value")], steps) for name, steps in parse(spec).items()]
        out: dict[str, tuple[DataFrame, list[str]]] = {}
        self._advance(_Table(self.cube, None), items, (), out)
        return out

    def _advance(self, table: _Table, items: list[_Item], chain: tuple[str, ...], out: dict) -> None:
        waiting: dict[str, list[_Item]] = {}
        done: list[tuple[str, str]] = []
        for item in items:
            while item.steps and isinstance(item.steps[0], TransformStep):
                item.outputs = [new for key, column in item.outputs for new in self._transform(table, key, column, item.base, item.steps[0])]
                item.steps = item.steps[1:]
            if item.steps:
                waiting.setdefault(item.steps[0].groupby, []).append(item)
            else:
                done += item.outputs
        table.flush()
        if done:
            out["-".join(chain) or "samples"] = (table.df.select("cell_id", "time", *[F.col(c).alias(k) for k, c in done]), [k for k, _ in done])
        for frequency, group in waiting.items():
            self._advance(self._reduce(table, frequency, group), group, (*chain, frequency), out)

    def _transform(self, table: _Table, key: str, column: str, base: str, step: TransformStep) -> list[tuple[str, str]]:
        names = step_names(key, base, step)
        v = F.col(column)
        if step.transform in ("power", "spline"):
            table.flush()  # the column may be one just made
        if step.transform == "power":
            return [(n, table.column(("power", column, e), lambda e=e: power(v, e))) for n, e in zip(names, step.exp, strict=True)]
        if step.transform == "spline":
            return [(n, table.column(("spline", column, i), lambda i=i: spline(v)[i])) for i, n in enumerate(names)]
        if isinstance(step.inter, DataFrame):
            table.flush()
            other = f"i{len(table.known)}"
            table.df = table.df.join(step.inter.select("cell_id", "time", F.col("value").alias(other)), ["cell_id", "time"], "left")
        else:
            other = step.inter
        table.flush()
        return [(key, table.column(("inter", column, other), lambda: interact(v, F.col(other))))]

    def _reduce(self, table: _Table, frequency: str, group: list[_Item]) -> _Table:
        made: dict[str, Column] = {}
        results: dict[str, tuple] = {}
        known: dict[Any, str] = {}
        for item in group:
            step: AggregateStep = item.steps[0]
            item.steps = item.steps[1:]
            outputs = []
            for key, column in item.outputs:
                for name, t in zip(step_names(key, item.base, step), step.ddargs or (None,), strict=True):
                    what = (column, step.calc, t)
                    if what not in known:
                        known[what] = f"r{len(known)}"
                        made |= aggregates(step.calc, F.col(column), t, known[what], F.col("n__time"), column)
                        results[known[what]] = (step.calc, t, column)
                    outputs.append((name, known[what]))
            item.outputs = outputs
        rows = table.df.withColumns({"time": self.label(F.col("time"), frequency), "n__time": F.col("time")})
        grouped = rows.groupBy("cell_id", "time").agg(F.count(F.lit(1)).alias("n__rows"), *[c.alias(n) for n, c in made.items()])
        expected = F.col("n__rows")
        if self.missing == "dense":
            # a row for each period: there are fewer than four million dates from the year 1 to 9999
            grouped = grouped.join(F.broadcast(self.axis(table, frequency)), "time")
            expected = F.col("n__expected")
        df = grouped.select("cell_id", "time", *[result(calc, t, n, expected, samples).alias(n) for n, (calc, t, samples) in results.items()])
        return _Table(df, frequency)

    def axis(self, table: _Table, frequency: str) -> DataFrame:
        """How many steps of the table's time axis fall into each period: time and n__expected."""
        steps = self.steps if table.frequency is None else self.calendar_between(self.steps.select(self.label(F.col("time"), table.frequency).alias("time")), table.frequency)
        return steps.select(self.label(F.col("time"), frequency).alias("time")).groupBy("time").agg(F.count(F.lit(1)).alias("n__expected"))

    def calendar_between(self, df: DataFrame, frequency: str) -> DataFrame:
        """Labels of all periods from the first to the last in `df`, those without rows too."""
        number = periods.period_number(F.col("time"), frequency, self.calendar)
        if self.calendar != "standard" and frequency == "date":
            # days of a CF calendar: from the numbers that are there, and the gaps between them by arithmetic
            ends = df.select(number.alias("k")).agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a IS NOT NULL")
            days = ends.select(F.explode(F.sequence("a", "b")).alias("k"))
            return days.select(cf_date(F.col("k"), self.calendar).alias("time"))
        ends = df.select(number.alias("k")).agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a IS NOT NULL")
        return ends.select(F.explode(F.sequence("a", "b")).alias("k")).select(periods.label_of_number(F.col("k"), frequency, self.calendar).alias("time"))

    def filled(self, df: DataFrame, frequency: str) -> DataFrame:
        """`df` with a row of NULLs for each cell and each period between the first and the last that it lacks."""
        cells = df.select("cell_id").distinct()
        return cells.join(F.broadcast(self.calendar_between(df, frequency))).join(df, ["cell_id", "time"], "left")


def cf_date(ordinal: Column, calendar: str) -> Column:
    """The day of a CF calendar from days since year 0."""
    if calendar == "360_day":
        year, rest = F.floor(ordinal / 360), F.pmod(ordinal, F.lit(360))
        month, day = F.floor(rest / 30) + 1, F.pmod(rest, F.lit(30)) + 1
    else:
        length = 365 if calendar == "noleap" else 366
        year, rest = F.floor(ordinal / length), F.pmod(ordinal, F.lit(length))
        starts = periods._month_starts(calendar)
        month = reduce(lambda a, s: a + F.when(rest >= s, 1).otherwise(0), starts, F.lit(0))
        day = rest - F.element_at(F.array(*[F.lit(s) for s in starts]), month) + 1
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"), F.lit(0).alias("second_of_day"))


def aggregate_time(cube: DataFrame, spec: Mapping[str, Any], missing: str = "sparse", calendar: str = "standard", axis: DataFrame | None = None) -> DataFrame:
    """cell_id, time and all outputs.  Tables of different chains meet in a full outer join: mixed periods share few times."""
    tables = TimeStage(cube, missing, calendar, axis).run(spec)
    return reduce(lambda a, b: a.join(b, ["cell_id", "time"], "full_outer"), [df for df, _ in tables.values()])
