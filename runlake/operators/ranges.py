"""Ordered operations per key, split by rank.

A plain window puts every row of a key into one task. Here a key of more than ``rows`` rows
is cut at quantiles of its order into ranges of neighbouring ranks; windows run per (key,
range), in one shuffle of the rows, and a small table of border rows (one per range of a cut
key) carries what crosses a border. Results equal the plain window functions, null keys
included, whatever the quantiles are.

Order columns may be timestamps, dates or integers (nulls come first); the first one is cut
first, and a range that holds a single value of it is cut by the next one. A key is cut into
at most ``2 * QUANTILES`` ranges a column, and into no more than its rows ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.session import scratch_path

ROWS = 1_000_000
QUANTILES = 200
#: Every so many borders one is kept apart, to look among them first.
_STEP = 20
_LEAST = -(1 << 62)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A written table: its size is known to the planner, which broadcasts it or not."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _number(df: DataFrame, column: str) -> Column:
    """An integer in the order of the column."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        n = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        n = F.unix_date(c).cast("long")
    elif isinstance(kind, T.IntegralType):
        n = c.cast("long")
    else:
        raise TypeError(f"{column}: only timestamps, dates and integers can be cut into ranges")
    return F.coalesce(n, F.lit(_LEAST))


def _cuts(df: DataFrame, group: list[str], value: Column, rows: int, *extra: Column) -> DataFrame:
    """Borders of every group with more than ``rows`` rows: its quantiles, about ``rows`` rows
    apart where there are enough, and the values just after them, so that a value which fills a
    quantile has a range of its own. ``__few`` has every ``_STEP``-th of them."""
    q = F.percentile_approx(value, [i / QUANTILES for i in range(1, QUANTILES)], QUANTILES * 50)
    d = df.groupBy(*group).agg(q.alias("__q"), F.count(F.lit(1)).alias("__n"), *extra).filter(F.col("__n") > rows)
    d = d.withColumn("__each", F.greatest(F.expr(f"{rows * QUANTILES} div __n"), F.lit(1)))
    d = d.withColumn("__q", F.filter("__q", lambda _, i: (i + 1) % F.col("__each") == 0))
    d = d.withColumn("__cuts", F.array_sort(F.array_distinct(F.concat("__q", F.transform("__q", lambda x: x + 1)))))
    return d.withColumn("__few", F.filter("__cuts", lambda _, i: i % _STEP == 0)).drop("__q", "__n", "__each")


def _placed(d: DataFrame, name: str, value: Column) -> DataFrame:
    """``name``: how many borders lie at or below the value; 0 where there are none."""
    below = lambda a: F.coalesce(F.size(F.filter(a, lambda b: b <= value)), F.lit(0))
    d = d.withColumn("__at", F.greatest(below("__few") - 1, F.lit(0)) * _STEP)
    return d.withColumn(name, F.col("__at") + below(F.slice("__cuts", F.col("__at") + 1, F.lit(_STEP)))).drop("__at", "__cuts", "__few")


class Ranged:
    """Rows of a table with their key and range; each method adds columns and returns the
    rows again, ``result()`` ends with the plain table."""

    def __init__(self, df: DataFrame, keys: str | Sequence[str], order: Sequence[str], rows: int = ROWS):
        self.order, self.keys, self.places = list(order), [keys] if isinstance(keys, str) else list(keys), []
        d = df.withColumn("__k", F.struct(*[F.col(k) for k in self.keys]))
        many = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows)
        hot = _stored(many.select(F.struct(*[F.col(k) for k in self.keys]).alias("__k")), "hot-keys")
        #: The rows of cut keys, on which borders are found; None where no key has a second range.
        self.hot: DataFrame | None = None
        if hot.isEmpty():
            self.df = d.withColumn("__g", F.struct("__k", F.array(F.lit(0)).alias("__range")))
            return
        first = _number(df, self.order[0])
        cuts = _stored(_cuts(d.join(hot, "__k", "left_semi"), ["__k"], first, rows), "range-cuts")
        d = _placed(d.join(cuts, "__k", "left").withColumn("__cut", F.col("__cuts").isNotNull()), "__r0", first)
        self.places = ["__r0"]
        for i, column in enumerate(self.order[1:], 1):
            group, value, before = ["__k", *self.places], _number(df, column), _number(df, self.order[i - 1])
            again = _cuts(d.filter("__cut"), group, value, rows, (F.min(before) == F.max(before)).alias("__one"))
            again = _stored(again.filter("__one").drop("__one"), "range-cuts")
            if again.isEmpty():
                break
            d = _placed(d.join(again, group, "left"), f"__r{i}", value)
            self.places.append(f"__r{i}")
        self.df = d.withColumn("__g", F.struct("__k", F.array(*self.places).alias("__range")))
        self.hot = self.df.filter("__cut")

    def result(self) -> DataFrame:
        return self.df.drop("__k", "__g", "__cut", *self.places)

    def with_column(self, name: str, value: Column) -> Ranged:
        return self._both(lambda d: d.withColumn(name, value))

    def _both(self, step: Callable[[DataFrame], DataFrame]) -> Ranged:
        out = object.__new__(Ranged)
        out.order, out.keys, out.places, out.df = self.order, self.keys, self.places, step(self.df)
        out.hot = step(self.hot) if self.hot is not None else None
        return out

    def _window(self):
        # the columns of __g, as they are: they sort faster than the struct
        return Window.partitionBy(*self.keys, *self.places).orderBy(*self.order)

    def _across(self, border: Column, reach: Callable[[Column, object], Column], forward: bool) -> DataFrame | None:
        """Of every range of a cut key, ``__edge``: what the ranges before it (after it, unless
        ``forward``) hand over. ``border`` aggregates a range to one value."""
        if self.hot is None:
            return None
        # backwards too the frame grows from the first row on: one that shrinks towards the last
        # row is gone through again for every row
        w = Window.partitionBy("__k").orderBy(F.col("__g.__range").asc() if forward else F.col("__g.__range").desc())
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        one = self.hot.groupBy("__g").agg(border.alias("__border")).withColumn("__k", F.col("__g.__k"))
        return _stored(one.select("__g", reach(F.col("__border"), w).alias("__edge")), "range-borders")

    def _add(self, name: str, inside: Column, edges: DataFrame | None, join: Callable[[Column, Column], Column]) -> Ranged:
        def step(d: DataFrame) -> DataFrame:
            d = d.withColumn(name, inside)
            if edges is None:
                return d
            return d.join(edges, "__g", "left").withColumn(name, join(F.col(name), F.col("__edge"))).drop("__edge")
        return self._both(step)

    def neighbours(self, before: Mapping[str, str] | None = None, after: Mapping[str, str] | None = None) -> Ranged:
        """Of the row before (after) in the key's order the columns named, as
        ``before={"prev_status": "run_status"}``; null where there is none."""
        out, at = self, F.struct(*self.order)
        for named, forward in ((before, True), (after, False)):
            if not named:
                continue
            value = F.struct(*[F.col(c).alias(n) for n, c in named.items()])
            border = F.max_by(value, at) if forward else F.min_by(value, at)
            edges = out._across(border, lambda b, w: F.last(b).over(w), forward)
            beside = (F.lag(value) if forward else F.lead(value)).over(self._window())
            out = out._add("__beside", beside, edges, F.coalesce)
            out = out._both(lambda d, named=named: d.withColumns({n: F.col(f"__beside.{n}") for n in named}).drop("__beside"))
        return out

    def running(self, name: str, value: Column | None = None, inclusive: bool = True) -> Ranged:
        """The running sum of ``value`` (1: the row's ordinal) in the key's order."""
        value = F.coalesce(value, F.lit(0)).cast("long") if value is not None else F.lit(1).cast("long")
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        edges = self._across(F.sum(value), lambda b, w: F.sum(b).over(w), True)
        return self._add(name, F.coalesce(F.sum(value).over(w), F.lit(0)), edges, lambda x, e: x + F.coalesce(e, F.lit(0)))

    def latest(self, name: str, value: Column) -> Ranged:
        """The last non-null ``value`` at or before the row in the key's order."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edges = self._across(F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))),
                             lambda b, w: F.last(b, ignorenulls=True).over(w), True)
        return self._add(name, F.last(value, ignorenulls=True).over(w), edges, F.coalesce)

    def following(self, name: str, value: Column) -> Ranged:
        """The first non-null ``value`` after the row in the key's order."""
        # the order's reverse by row numbers, ties included, with a frame that grows
        out = self._both(lambda d: d.withColumn("__no", F.row_number().over(self._window())))
        w = Window.partitionBy(*self.keys, *self.places).orderBy(F.col("__no").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edges = self._across(F.min_by(value, F.when(value.isNotNull(), F.struct(*self.order))),
                             lambda b, w: F.last(b, ignorenulls=True).over(w), False)
        out = out._add(name, F.last(value, ignorenulls=True).over(w), edges, F.coalesce)
        return out._both(lambda d: d.drop("__no"))
