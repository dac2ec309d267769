"""Column functions for run-log text (all built-in expressions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must match the runner's log format.
# A stored line is: timestamp TAB severity TAB message, timestamp in UTC with
# second precision written as 2024-01-31T09:05:00Z.
TS_TEXT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
TS_PARSE_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"
FIELD_SEP = "\t"
# The emitter is the first bracketed word of the message, lazily matched.
EMITTER_PATTERN = r"\[(.*?)\]"
# Text-format events get this prefix; JSON events none.
TEXT_PREFIX = "[dbt] "
# Newlines inside a message are flattened to two spaces.
NEWLINE_REPLACEMENT = "  "


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_entry(raw: Column | str, keep_tabs: bool = False) -> Column:
    """Split a stored line into struct<ts, severity, emitter, message>.

    ``ts`` is a UTC instant (TimestampType). The message is the *last* tab
    field, so a message holding tabs keeps only its last piece; with
    ``keep_tabs=True`` fields 3.. are joined back instead. A line without tabs
    or with a malformed time has null ``severity`` or ``ts``; see ``malformed``.
    """
    parts = F.split(_c(raw), FIELD_SEP)
    if keep_tabs:
        message = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), FIELD_SEP)
    else:
        message = F.element_at(parts, -1)
    return F.struct(
        F.try_to_timestamp(F.try_element_at(parts, F.lit(1)), F.lit(TS_PARSE_FORMAT)).alias("ts"),
        F.try_element_at(parts, F.lit(2)).alias("severity"),
        F.regexp_extract(message, EMITTER_PATTERN, 1).alias("emitter"),
        message.alias("message"),
    )


def malformed(raw: Column | str) -> Column:
    """True for lines that are not time TAB severity TAB message."""
    parts = F.split(_c(raw), FIELD_SEP)
    ts = F.try_to_timestamp(F.try_element_at(parts, F.lit(1)), F.lit(TS_PARSE_FORMAT))
    return F.coalesce((F.size(parts) < 3) | ts.isNull(), F.lit(True))


def format_entry(ts: Column | str, severity: Column | str, message: Column | str) -> Column:
    """Stored text of one line; ``ts`` is rendered in the session time zone
    (UTC for every session this library builds) to whole seconds."""
    return F.concat_ws(FIELD_SEP, F.date_format(_c(ts), TS_TEXT_FORMAT), F.upper(_c(severity)), _c(message))


def flatten_newlines(message: Column | str) -> Column:
    return F.replace(_c(message), F.lit("\n"), F.lit(NEWLINE_REPLACEMENT))


def prefix_message(message: Column | str, log_format: Column | str) -> Column:
    """Text events get the runner prefix, JSON events are kept as they are;
    both have newlines flattened."""
    flat = flatten_newlines(message)
    return F.when(_c(log_format) == F.lit("json"), flat).otherwise(F.concat(F.lit(TEXT_PREFIX), flat))


JSON_EVENT_SCHEMA = "info struct<level: string, msg: string>, level string, msg string"


def json_event(text: Column | str) -> Column:
    """struct<level, msg> of a JSON log event, from its ``info`` object or else its
    top level; null fields when absent or malformed."""
    e = F.from_json(_c(text), JSON_EVENT_SCHEMA)
    return F.struct(F.coalesce(e["info"]["level"], e["level"]).alias("level"),
                    F.coalesce(e["info"]["msg"], e["msg"]).alias("msg"))


def to_json_event(level: Column | str, msg: Column | str) -> Column:
    """JSON text of a log event with ``level`` and ``msg``."""
    return F.to_json(F.struct(_c(level).alias("level"), _c(msg).alias("msg")))


# Node-result lines, with or without the emitter before them and cut off anywhere
# inside the bracket, look like
#   "2 of 8 OK loaded seed file test.test_seed ... [INSERT 1 in 0.51s]"
#   "3 of 8 FAIL 1 not_null_my_first_dbt_model_id ... [FAIL 1 in 0.30s]"
NODE_RESULT_PATTERN = (r"^(?:\[[^\]]*\] )?(\d+) of (\d+) (OK|PASS|FAIL \d+|WARN \d+|ERROR|SKIP)"
                       r" (.*?)\s*\.{3,}\s*\[([A-Z]+(?: \d+)?)(?: in (\d+(?:\.\d+)?)s)?")


def with_node_result(df: DataFrame, line: str, out: str = "r") -> DataFrame:
    """Add ``out`` = struct<idx, total, status, failures, node, result,
    elapsed> parsed from the node-result line in column ``line``; all fields
    null when the line is not one.

    One regex pass per line: the groups are rewritten into a separator-joined
    text and split in one projection; the struct reads the parts in the next
    (Catalyst keeps the two apart because the split is not cheap to repeat).
    """
    sep = "\u0001"
    whole = "^" + NODE_RESULT_PATTERN.lstrip("^") + ".*$"
    groups = sep.join(f"${i}" for i in range(1, 7))
    raw = F.split(F.regexp_replace(F.col(line), whole, groups), sep)
    d = df.withColumn("__parts", F.when(F.size(raw) == 6, raw))
    p = F.col("__parts")
    status = F.element_at(p, 3)
    n = F.substring_index(status, " ", -1)
    r = F.struct(
        F.element_at(p, 1).cast("bigint").alias("idx"),
        F.element_at(p, 2).cast("bigint").alias("total"),
        F.substring_index(status, " ", 1).alias("status"),
        F.when(F.instr(status, " ") > 0, n.cast("bigint")).otherwise(
            F.when(p.isNotNull(), F.lit(0).cast("bigint"))).alias("failures"),
        F.element_at(p, 4).alias("node"),
        F.element_at(p, 5).alias("result"),
        F.nullif(F.element_at(p, 6), F.lit("")).cast("double").alias("elapsed"),
    )
    return d.withColumn(out, r).drop("__parts")


def to_local(ts: Column | str, tz: Column | str) -> Column:
    """Wall-clock time in ``tz`` of a UTC instant."""
    return F.from_utc_timestamp(_c(ts), _c(tz) if isinstance(tz, Column) else tz)
