"""Five-field cron texts as tables of values.

Each field becomes a sorted int array: ``*``, ``n``, ``a-b``, ``*/s``,
``a-b/s``, ``a/s`` (a up to the field maximum) and comma lists of those; months
and weekdays also by name, and macros such as ``@daily``. Weekday 0 and 7 are
both Sunday.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field order and ranges of classic cron.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


# What the macros and names of classic cron stand for.
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
          "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
WEEKDAYS = "SUN MON TUE WED THU FRI SAT".split()


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


#: Month and weekday names as numbers.
NAMES = {"month": {n: i + 1 for i, n in enumerate(MONTHS)}, "weekday": {n: i for i, n in enumerate(WEEKDAYS)}}


def cron_fields(text: Column) -> Column:
    """The fields of a cron text, a macro's meaning in place of the macro."""
    trimmed = F.trim(text)
    return F.split(F.coalesce(F.try_element_at(_literal_map(MACROS), F.lower(trimmed)), trimmed), r"\s+")


def parse_cron(texts: DataFrame, column: str = "schedule") -> DataFrame:
    """The distinct texts, each with its ``minute``, ``hour``, ``day``, ``month`` and ``weekday``
    values (sorted int arrays), ``day_star`` and ``weekday_star`` (whether the field starts with
    ``*``) and ``ok``, false where the text is no cron text (the arrays are null then).

    Fields and their comma items are rows of their own, read column by column, and one
    aggregation puts each text together again: the shuffle of the distinct texts serves both.
    """
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("__i"))
    d = texts.select(column).distinct().select(column, F.posexplode_outer(cron_fields(F.col(column))).alias("__i", "__field"))
    d = d.select(column, "__i", F.col("__field").startswith("*").alias("__star"),
                 of([lo for _, lo, _ in FIELDS]).alias("__lo"), of([hi for _, _, hi in FIELDS]).alias("__hi"),
                 of([7 if hi == 7 else hi - lo + 1 for _, lo, hi in FIELDS]).alias("__span"),
                 F.explode_outer(F.split("__field", ",")).alias("__item"))
    d = d.withColumn("__parts", F.split("__item", "/"))
    d = d.withColumns({"__base": F.get("__parts", F.lit(0)), "__stepped": F.size("__parts") > 1,
                       "__step": F.when(F.size("__parts") > 1, F.get("__parts", F.lit(1)).try_cast("int")).otherwise(F.lit(1))})
    d = d.withColumn("__ends", F.split("__base", "-"))
    number = {}
    for name, at in (("__from", 0), ("__to", 1)):
        word = F.get("__ends", F.lit(at))
        named = F.when(F.col("__i") == 3, F.try_element_at(_literal_map(NAMES["month"]), F.upper(word))).when(
            F.col("__i") == 4, F.try_element_at(_literal_map(NAMES["weekday"]), F.upper(word)))
        number[name] = F.coalesce(word.try_cast("int"), named)
    d = d.withColumns(number)
    star = F.col("__base") == "*"
    d = d.withColumns({"__a": F.when(star, F.col("__lo")).otherwise(F.col("__from")),
                       "__b": F.when(star, F.col("__hi")).when(F.size("__ends") > 1, F.col("__to"))
                               .when(F.col("__stepped"), F.col("__hi")).otherwise(F.col("__from"))})
    d = d.withColumn("__valid", F.coalesce(
        (F.size("__parts") <= 2) & (F.size("__ends") <= 2) & F.col("__a").between(F.col("__lo"), F.col("__hi"))
        & F.col("__b").between(F.col("__lo"), F.col("__hi")) & (F.col("__step") > 0), F.lit(False)))
    # a range that ends before it starts wraps around; a sequence must not fail on what is not valid
    up_to = F.when(F.col("__a") <= F.col("__b"), F.col("__b")).otherwise(F.col("__b") + F.col("__span"))
    d = d.withColumn("__values", F.when(F.col("__valid"), F.sequence("__a", up_to, F.when(F.col("__valid"), F.col("__step")).otherwise(1))))
    d = d.withColumn("__values", F.transform("__values", lambda x: F.when(
        F.col("__i") == 4, F.pmod(x, F.lit(7))).when(x > F.col("__hi"), x - F.col("__span")).otherwise(x)))
    found = lambda i: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("__i") == i, F.col("__values"))))))
    d = d.groupBy(column).agg(
        (F.min("__valid") & (F.max("__i") == 4)).alias("__ok"), *[found(i).alias(name) for i, (name, _, _) in enumerate(FIELDS)],
        F.bool_or((F.col("__i") == 2) & F.col("__star")).alias("day_star"),
        F.bool_or((F.col("__i") == 4) & F.col("__star")).alias("weekday_star"))
    ok = F.coalesce("__ok", F.lit(False))
    return d.select(column, *[F.when(ok, F.col(name)).alias(name) for name, _, _ in FIELDS], "day_star", "weekday_star", ok.alias("ok"))


def fire_days(start: str, end: str, day_rule: str = "or") -> Column:
    """Dates in [start, end) on which the parsed text of the row fires.

    ``day_rule='or'`` is classic cron: when both day-of-month and weekday are
    restricted a day matches either; otherwise both must match. ``'and'``
    always needs both.
    """
    days = F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1), F.expr("INTERVAL 1 DAY"))

    def ok(d: Column) -> Column:
        dom = F.array_contains("day", F.dayofmonth(d))
        dow = F.array_contains("weekday", F.dayofweek(d) - 1)
        if day_rule == "and":
            day_ok = dom & dow
        else:
            day_ok = F.when(F.col("day_star") | F.col("weekday_star"), dom & dow).otherwise(dom | dow)
        return F.array_contains("month", F.month(d)) & day_ok

    return F.filter(days, ok)
