"""Column functions for pipeline command text and run naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags of the runner's commands, and this library's own default names.
SELECT_FLAG = "--select"
SELECT_EQ_TOKEN = "--select="
ALL_NODES = "*"
SCHEDULE_FLAG = "--schedule"
SCHEDULE_NAME_FLAG = "--schedule-name"
DEFAULT_SCHEDULE_PREFIX = "schedule-"
JOB_ID_PREFIX = "u"
FOLDER_DATE_FORMAT = "yyyy-MM-dd"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: A run of plain, escaped and quoted text; a quote that is never closed is plain text.
PIECE = r"""'[^']*'|"(?:[^"\\]|\\.)*"|\\.|[^\s'"\\]+|['"\\]"""


def split_args(command: Column | str) -> Column:
    r"""Tokens of a command, split at white space as a shell does: single quotes keep all,
    double quotes all but ``\"`` and ``\\``, a backslash the next character. A blank
    command has no tokens."""
    def plain(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        return (F.when(piece.rlike(r"(?s)^'.*'$"), inner)
                .when(piece.rlike(r'(?s)^".*"$') & (F.length(piece) > 1), F.regexp_replace(inner, r'\\(["\\])', "$1"))
                .when(piece.startswith("\\") & (F.length(piece) > 1), F.substring(piece, 2, 1)).otherwise(piece))

    tokens = F.regexp_extract_all(_c(command), F.lit(f"(?s)(?:{PIECE})+"), F.lit(0))
    return F.transform(tokens, lambda t: F.array_join(
        F.transform(F.regexp_extract_all(t, F.lit(f"(?s){PIECE}"), F.lit(0)), plain), ""))


def parse_command(command: Column | str, strict: bool = False) -> Column:
    """struct<verb, selection, args>.

    ``selection`` is the token after ``--select``; a bare ``--select=`` token
    selects "" and no selector selects "*". A ``--select=X`` token counts as no
    selection unless ``strict=True``, which reads X from it. ``--select`` as
    the last token selects null.
    """
    args = split_args(command)
    pos = F.array_position(args, SELECT_FLAG)
    sel = F.when(pos > 0, F.try_element_at(args, (pos + 1).cast("int")))
    if strict:
        n = len(SELECT_EQ_TOKEN)
        eq = F.filter(args, lambda a: a.startswith(SELECT_EQ_TOKEN) & (F.length(a) > n))
        sel = sel.when(F.size(eq) > 0, F.substring(F.element_at(eq, 1), n + 1, 1 << 30))
    sel = sel.when(F.array_contains(args, SELECT_EQ_TOKEN), F.lit("")).otherwise(F.lit(ALL_NODES))
    return F.struct(F.try_element_at(args, F.lit(1)).alias("verb"), sel.alias("selection"), args.alias("args"))


def with_flag(args: Column | str, flag: str, value: Column | str) -> Column:
    """Append ``flag value`` unless the flag is already present."""
    a = _c(args)
    v = value if isinstance(value, Column) else F.lit(value)
    return F.when(F.array_contains(a, flag), a).otherwise(F.concat(a, F.array(F.lit(flag), v)))


def folder_name(day: Column | str, run_id: Column | str) -> Column:
    """Artifact folder ``yyyy-MM-dd-<run id>``."""
    return F.concat_ws("-", F.date_format(_c(day), FOLDER_DATE_FORMAT), _c(run_id))


def job_id(run_id: Column | str) -> Column:
    """Container job id: ``u`` + the run id without dashes."""
    return F.concat(F.lit(JOB_ID_PREFIX), F.replace(_c(run_id), F.lit("-"), F.lit("")))


def schedule_name(name: Column | str, run_id: Column | str) -> Column:
    """The given schedule name, else ``schedule-<run id>``."""
    return F.coalesce(_c(name), F.concat(F.lit(DEFAULT_SCHEDULE_PREFIX), _c(run_id)))
