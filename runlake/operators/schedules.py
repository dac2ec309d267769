"""Schedule tables: deployed(name, command, schedule, timezone, target) and
requested(name, command, schedule). Diffs, plan application, lookups, cron
expansion into fire times and fire/run matching."""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.functions.cron import fire_days, parse_cron
from runlake.operators.ordinal import global_ordinal
from runlake.operators.ranges import ROWS, Ranged

JOB_DESCRIPTION_PREFIX = "[schedule job] "
ENABLED = "ENABLED"
ACTION_RANK = {"add": 1, "delete": 2, "redeploy": 3}
DELETED_MESSAGE = "Schedule {name} deleted"
NOTHING_TO_DELETE = "Nothing to delete, schedule {name} does not exist or is disabled in {where}"
NOT_FOUND = "Found no schedule named '{name}'"
RETRY_COUNT = 2
MAX_RETRY_SECONDS = 120


def _fmt(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a fixed message with columns (no Python per row)."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(pre), cols[key]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def schedule_diff(deployed: DataFrame, requested: DataFrame, compare: str = "always") -> DataFrame:
    """Plan rows (name, action, command, schedule, action_rank).

    requested only -> add; deployed only -> delete; in both -> redeploy when
    different. ``compare='always'`` treats every common name as different (the
    stored record has more fields than the request, so whole records never
    match); ``compare='fields'`` compares command and schedule null-safely.
    """
    d = deployed.select("name", F.col("command").alias("__d_cmd"), F.col("schedule").alias("__d_sch"),
                        F.lit(True).alias("__d"))
    r = requested.select("name", F.col("command").alias("__r_cmd"), F.col("schedule").alias("__r_sch"),
                         F.lit(True).alias("__r"))
    j = d.join(r, "name", "full_outer")
    both = F.col("__d").isNotNull() & F.col("__r").isNotNull()
    if compare == "always":
        differs = F.lit(True)
    elif compare == "fields":
        differs = ~(F.col("__d_cmd").eqNullSafe(F.col("__r_cmd")) & F.col("__d_sch").eqNullSafe(F.col("__r_sch")))
    else:
        raise ValueError(f"compare must be 'always' or 'fields', not {compare!r}")
    action = (F.when(F.col("__d").isNull(), "add").when(F.col("__r").isNull(), "delete")
              .when(both & differs, "redeploy"))
    rank = F.when(action == "add", 1).when(action == "delete", 2).when(action == "redeploy", 3)
    return (j.select("name", action.alias("action"),
                     F.coalesce("__r_cmd", "__d_cmd").alias("command"),
                     F.coalesce("__r_sch", "__d_sch").alias("schedule"),
                     rank.alias("action_rank"))
            .filter(F.col("action").isNotNull()))


def order_plan(plan: DataFrame) -> DataFrame:
    """Print order: adds, then deletes, then redeploys, by name."""
    return plan.orderBy("action_rank", "name")


def plan_positions(plan: DataFrame) -> DataFrame:
    """Print order as a ``position`` column (1-based), numbered with a
    range-partitioned global ordinal rather than a one-task window."""
    return global_ordinal(plan, [F.col("action_rank"), F.col("name")], "position")


def delete_schedules(deployed: DataFrame, names: DataFrame, where: str = "project/location") -> tuple[DataFrame, DataFrame]:
    """(remaining, outcomes) of deleting ``names`` (column ``name``); deleting
    an absent name is not an error, its outcome says nothing was deleted."""
    remaining = deployed.join(names.select("name"), "name", "left_anti")
    hit = deployed.select("name", F.lit(True).alias("__hit")).dropDuplicates(["name"])
    o = names.select("name").join(hit, "name", "left")
    deleted = F.coalesce(F.col("__hit"), F.lit(False))
    msg = F.when(deleted, _fmt(DELETED_MESSAGE, name=F.col("name"))).otherwise(
        _fmt(NOTHING_TO_DELETE, name=F.col("name"), where=F.lit(where)))
    return remaining, o.select("name", deleted.alias("deleted"), msg.alias("message"))


def upsert_schedules(deployed: DataFrame, new: DataFrame) -> DataFrame:
    """Create-or-replace by name: an existing name is replaced whole."""
    return deployed.join(new.select("name"), "name", "left_anti").unionByName(new, allowMissingColumns=True)


def deploy_set(plan: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested records whose plan action is add or redeploy (disjoint sets)."""
    todo = plan.filter(F.col("action").isin("add", "redeploy")).select("name")
    return requested.join(todo, "name", "left_semi")


def apply_plan(deployed: DataFrame, requested: DataFrame, plan: DataFrame,
               timezone: str = "UTC", target: str | None = None) -> DataFrame:
    """Delete every ``delete``, then create-or-replace ``add`` and ``redeploy``
    from ``requested`` (new records get ``timezone`` and ``target``)."""
    dels = plan.filter(F.col("action") == "delete").select("name")
    remaining, _ = delete_schedules(deployed, dels)
    new = (deploy_set(plan, requested)
           .withColumn("timezone", F.lit(timezone))
           .withColumn("target", F.lit(target).cast("string")))
    cols = [c for c in deployed.columns if c in new.columns]
    return upsert_schedules(remaining.select(*cols), new.select(*cols))


def describe_schedules(deployed: DataFrame, names: DataFrame) -> DataFrame:
    """One row per asked name: the first deployed record with exactly that name
    (smallest command, then schedule, on duplicates), else a not-found message.
    The first match is a ``min_by`` aggregate, combined map-side."""
    rec = F.struct(*[F.col(c) for c in deployed.columns if c != "name"])
    first = (deployed.groupBy("name")
             .agg(F.min_by(rec, F.struct("command", "schedule")).alias("__r"))
             .select("name", "__r.*").withColumn("__found", F.lit(True)))
    j = names.select("name").join(first, "name", "left")
    found = F.coalesce(F.col("__found"), F.lit(False))
    msg = F.when(found, F.concat_ws("", F.col("name"), F.lit(": "), F.col("command"), F.lit(" @ "), F.col("schedule")))
    msg = msg.otherwise(_fmt(NOT_FOUND, name=F.col("name")))
    return j.withColumn("found", found).withColumn("message", msg).drop("__found")


def list_schedules(jobs: DataFrame, prefix: str = JOB_DESCRIPTION_PREFIX) -> DataFrame:
    """Scheduler jobs (job_name path, description, state, schedule, time_zone,
    uri) -> deployed: only enabled jobs whose description has the prefix; name
    is the last path segment, command the description with every prefix
    occurrence removed."""
    keep = F.col("description").startswith(prefix) & (F.col("state") == ENABLED)
    return jobs.filter(keep).select(
        F.element_at(F.split("job_name", "/"), -1).alias("name"),
        F.replace(F.col("description"), F.lit(prefix), F.lit("")).alias("command"),
        "schedule", F.col("time_zone").alias("timezone"), F.col("uri").alias("target"))


def known_zones(spark: SparkSession) -> DataFrame:
    """The zone names that schedules may have (about 600 rows)."""
    return spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones() | {"Z"})], "timezone string")


def _zone_shifts(schedules: DataFrame, start: str, end: str) -> DataFrame:
    """The known zones of the schedules with ``__shift``: the seconds that a zone is ahead of UTC
    where they are the same at every hour of [start, end], else null."""
    hours = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR"))

    def ahead(t: Column) -> Column:
        utc = t.cast("timestamp")
        return F.unix_seconds(F.from_utc_timestamp(utc, F.col("timezone"))) - F.unix_seconds(utc)

    shifts = F.array_distinct(F.transform(hours, ahead))
    zones = schedules.select("timezone").distinct().join(F.broadcast(known_zones(schedules.sparkSession)), "timezone")
    return zones.select(F.col("timezone").alias("__zone"), F.when(F.size(shifts) == 1, F.get(shifts, F.lit(0))).alias("__shift"))


def expand_schedules(schedules: DataFrame, start: str, end: str, day_rule: str = "or") -> DataFrame:
    """Every fire time in the UTC horizon [start, end) of each schedule's cron text.

    Days and hours are those of the schedule's ``timezone`` (null: UTC) where it has
    that column: fires are made for the local days that the horizon touches, one more
    on either side, turned into UTC and cut to the horizon. A local time that a zone
    skips (clocks go forward) does not fire; one that it has twice fires once, at the
    earlier instant. Texts that are no cron text and unknown zones fire never;
    ``rejected_schedules`` lists them.

    Cron texts repeat across schedules, so each distinct text is parsed once
    into its fire days, hours and minutes (small arrays); the arrays join back
    to the schedules on the text (AQE broadcasts them when small) and every
    schedule row then generates its own fires with ``explode``: no pairs
    beyond the output itself.
    """
    zoned = "timezone" in schedules.columns
    first, last = (dt.date.fromisoformat(str(x)[:10]) for x in (start, end))
    days = [str(first - dt.timedelta(1)), str(last + dt.timedelta(2))] if zoned else [str(first), str(last + dt.timedelta(1))]
    texts = parse_cron(schedules).filter("ok").select(
        "schedule", fire_days(*days, day_rule).alias("__days"), F.col("hour").alias("__hours"), F.col("minute").alias("__mins"))
    d = schedules.join(texts, "schedule", "inner")
    if zoned:
        # a local time of the horizon that a zone has twice lies within a day of a change of clocks
        zones = _zone_shifts(schedules, str(first - dt.timedelta(3)), str(last + dt.timedelta(4)))
        d = d.join(F.broadcast(zones), d["timezone"] == zones["__zone"], "left")  # about 600 rows
        d = d.filter(F.col("__zone").isNotNull() | F.col("timezone").isNull())
    # a schedule grows to thousands of fires: deal the short table out first, by a number that
    # adaptive execution, which sees its bytes only, does not lower
    d = d.repartition(int(schedules.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # explode_outer + null filter: a plain explode lets the optimizer infer a
    # size(__days) > 0 filter and push the whole parse below the distinct.
    d = (d.withColumn("__day", F.explode_outer("__days")).withColumn("__h", F.explode_outer("__hours"))
         .withColumn("__m", F.explode_outer("__mins"))
         .filter(F.col("__day").isNotNull() & F.col("__h").isNotNull() & F.col("__m").isNotNull()))
    midnight, second = F.col("__day").cast("timestamp_ntz"), F.expr("INTERVAL '1' SECOND")
    after = F.col("__h") * 3600 + F.col("__m") * 60
    if not zoned:
        d = d.withColumn("fire_ts", midnight + after * second)
    else:
        # a zone whose clocks do not change is so many seconds ahead; the others' fires are turned
        # one by one (an unknown zone never reaches that, which would end the job on it)
        shift = F.when(F.col("__zone").isNull(), F.lit(0)).otherwise(F.col("__shift"))
        zone, local = F.coalesce("__zone", F.lit("UTC")), (midnight + after * second).cast("timestamp")
        utc = F.to_utc_timestamp(local, zone)
        d = d.withColumn("fire_ts", F.when(shift.isNotNull(), midnight + (after - shift) * second).when(
            F.from_utc_timestamp(utc, zone) == local, utc.cast("timestamp_ntz")))
    horizon = [F.lit(x).cast("timestamp_ntz") for x in (start, end)]
    return (d.filter((F.col("fire_ts") >= horizon[0]) & (F.col("fire_ts") < horizon[1]))
            .drop("__days", "__hours", "__mins", "__day", "__h", "__m", "__zone", "__shift"))


def rejected_schedules(schedules: DataFrame) -> DataFrame:
    """The schedules whose text is no cron text (or null), or whose zone is unknown;
    each distinct text is parsed once."""
    bad = parse_cron(schedules).select(F.struct("schedule").alias("__text"), (~F.col("ok")).alias("__bad"))
    d = schedules.withColumn("__text", F.struct("schedule")).join(bad, "__text").drop("__text")
    if "timezone" not in schedules.columns:
        return d.filter("__bad").drop("__bad")
    zones = known_zones(schedules.sparkSession).select(F.col("timezone").alias("__zone"))
    d = d.join(F.broadcast(zones), d["timezone"] == zones["__zone"], "left")
    return (d.filter(F.col("__bad") | F.col("timezone").isNotNull() & F.col("__zone").isNull())
            .drop("__bad", "__zone"))


def fire_run_id(name: Column, fire_ts: Column) -> Column:
    """Deterministic id of the run a fire creates (replay-safe, unlike uuid())."""
    return F.sha2(F.concat_ws("|", name, F.date_format(fire_ts, "yyyy-MM-dd'T'HH:mm:ss")), 256)


def materialise_fires(fires: DataFrame, base_state: DataFrame, key: str = "name") -> DataFrame:
    """Each fire copies its schedule's base run record under a new run id; all
    other fields (status, folder, offset, command) are carried as they are."""
    base = base_state.withColumnRenamed("run_id", "base_run_id")
    j = fires.select(key, "fire_ts").join(base, key, "inner")
    return j.withColumn("run_id", fire_run_id(F.col(key).cast("string"), F.col("fire_ts")))


def fire_adherence(fires: DataFrame, runs: DataFrame, key: str, tolerance_s: int | None = None,
                   rows: int = ROWS) -> DataFrame:
    """For each fire (key, fire_ts): the first run (key, run_ts) started at or
    after it and before the key's next fire, else ``missed``.

    As-of match without a range join and in one pass over each input: fires
    and runs are merged per key in time order (a fire sorts before a run at
    the same instant); every row takes the latest fire at or before it, within
    ranges of neighbouring ranks (``ranges.Ranged``); one aggregation per (key,
    latest fire) then gives each fire its first run.
    """
    ftype = fires.schema["fire_ts"].dataType
    f = fires.select(F.col(key).alias("__key"), F.col("fire_ts").alias("__t"), F.lit(0).alias("__kind"))
    r = runs.select(F.col(key).alias("__key"), F.col("run_ts").cast(ftype).alias("__t"), F.lit(1).alias("__kind"))
    u = Ranged(f.unionByName(r), "__key", ["__t", "__kind"], rows)
    u = u.latest("__last", F.when(F.col("__kind") == 0, F.col("__t"))).result()
    g = (u.filter(F.col("__last").isNotNull())
         .groupBy("__key", "__last")
         .agg(F.min(F.when(F.col("__kind") == 1, F.col("__t"))).alias("first_run_ts")))
    out = g.select(F.col("__key").alias(key), F.col("__last").alias("fire_ts"), "first_run_ts")
    delay = F.unix_timestamp("first_run_ts") - F.unix_timestamp("fire_ts")
    ok = F.col("first_run_ts").isNotNull()
    if tolerance_s is not None:
        ok = ok & (delay <= tolerance_s)
    return (out.withColumn("delay_s", delay)
            .withColumn("status", F.when(ok, "on_time" if tolerance_s is not None else "ran").otherwise("missed")))


def retry_attempts(fires: DataFrame, starts: DataFrame, key: str, fire_ts: str = "fire_ts", start_ts: str = "run_ts",
                   start_id: str = "start_id", max_s: int = MAX_RETRY_SECONDS, retries: int = RETRY_COUNT,
                   rows: int = ROWS) -> DataFrame:
    """Attempts of each fire: the first ``retries + 1`` starts of its key from the fire
    on and within ``max_s`` seconds (the first one is the run, the others its retries).

    ``fires`` (key, fire_ts) and ``starts`` (key, run_ts, start_id) are merged per key in
    time order and the starts numbered (``ranges.Ranged``), so a fire knows how many
    starts lie before it; attempt k is the start with that number + k, found by an
    equi-join on (key, number). No pairs are formed beyond ``retries + 1`` a fire,
    however many starts a key has in the interval, and a hot key spreads by number.
    A null key matches the null key."""
    ttype = starts.schema[start_ts].dataType
    f = fires.select(F.col(key).alias("__key"), F.col(fire_ts).cast(ttype).alias("__t"), F.lit(0).alias("__kind"),
                     F.lit(None).cast("long").alias("__id"))
    s = starts.select(F.col(key).alias("__key"), F.col(start_ts).alias("__t"), F.lit(1).alias("__kind"),
                      F.col(start_id).cast("long").alias("__id"))
    u = Ranged(f.unionByName(s), "__key", ["__t", "__kind", "__id"], rows)
    u = u.running("__n", F.when(F.col("__kind") == 1, 1)).result()
    wanted = u.filter(F.col("__kind") == 0).select(
        "__key", F.col("__t").alias("__fire"), "__n", F.explode(F.sequence(F.lit(1), F.lit(retries + 1))).alias("attempt"))
    wanted = wanted.select(F.struct("__key", (F.col("__n") + F.col("attempt")).alias("__n")).alias("__at"), "__key", "__fire", "attempt")
    found = u.filter(F.col("__kind") == 1).select(F.struct("__key", "__n").alias("__at"), "__id", "__t")
    delay = F.unix_micros(F.col("__t").cast("timestamp")) - F.unix_micros(F.col("__fire").cast("timestamp"))
    return (wanted.join(found, "__at").withColumn("delay_us", delay).filter(F.col("delay_us") <= max_s * 1_000_000)
            .select(F.col("__key").alias(key), F.col("__fire").alias(fire_ts), F.col("attempt").cast("bigint").alias("attempt"),
                    F.col("__id").alias(start_id), F.col("__t").alias(start_ts), "delay_us"))
