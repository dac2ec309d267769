"""Independent SQL (DuckDB dialect) for every registered query.

Each string reads the driver's tables directly and re-derives its inputs the
way ``runlake.plans.bindings`` does, so the Spark plan and the SQL share no
code. Results are flat scalar columns with the same names as the Spark side.
"""

from __future__ import annotations

TAB = "chr(9)"

# ---------------------------------------------------------------- B-log
B_LOG = f"""
ev AS (
  SELECT event_id, ts, user_id AS run_id, event_type, value, props,
    CASE WHEN event_type = 'signup' AND value >= 90 THEN 'WARNING'
         WHEN event_type = 'error' THEN 'ERROR'
         WHEN event_type = 'signup' THEN 'WARN'
         WHEN event_type = 'purchase' THEN 'INFO'
         WHEN event_type = 'click' THEN 'NOTICE'
         ELSE 'DEBUG' END AS severity,
    CASE WHEN event_type IN ('signup', 'error') THEN 'job' ELSE 'dbt' END AS emitter
  FROM events),
blog AS (
  SELECT run_id, event_id, event_type, ts, severity, emitter,
    row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS line_no,
    '[' || emitter || '] ' || event_type || ' ' || props AS message
  FROM ev),
lines AS (
  SELECT run_id, line_no,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || {TAB} || severity || {TAB} || message AS raw
  FROM blog),
entries AS (
  SELECT run_id, line_no,
    strptime(split_part(raw, {TAB}, 1), '%Y-%m-%dT%H:%M:%SZ') AS ts,
    split_part(raw, {TAB}, 2) AS severity,
    regexp_extract(split_part(raw, {TAB}, -1), '\\[(.*?)\\]', 1) AS emitter,
    split_part(raw, {TAB}, -1) AS message
  FROM lines)
"""

SEVERITY_DIM = """
sev(name, lookup_rank, registered_rank) AS (VALUES
  ('DEFAULT', 0, 1), ('DEBUG', 10, 10), ('INFO', 20, 20), ('NOTICE', 20, 15),
  ('WARN', 30, 30), ('ERROR', 40, 40), ('CRITICAL', 50, 50), ('ALERT', 50, 60),
  ('EMERGENCY', 50, 100), ('WARNING', NULL, 30), ('FATAL', NULL, 50), ('NOTSET', NULL, 0))
"""

RUN_LEVELS = """
levels AS (
  SELECT c_custkey AS run_id,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'debug' WHEN 'BUILDING' THEN 'info'
      WHEN 'FURNITURE' THEN 'warn' WHEN 'MACHINERY' THEN 'error' END AS log_level
  FROM customer)
"""

OFFSETS = """
offs AS (
  SELECT run_id, line_no, raw, CAST(strlen(raw) AS BIGINT) AS n_bytes,
    CAST(COALESCE(SUM(strlen(raw) + 1) OVER (PARTITION BY run_id ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
  FROM lines)
"""

# ---------------------------------------------------------------- B-state
B_STATE = """
orders_ev AS (
  SELECT o_custkey AS run_id, o_orderkey AS seq, o_orderdate AS ts,
    CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' END AS s,
    'run --select ' || replace(lower(o_orderpriority), ' ', '_') AS c,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS b
  FROM orders),
run_events AS (
  SELECT run_id, seq, ts, 'run_status' AS field, s AS value FROM orders_ev
  UNION ALL SELECT run_id, seq, ts, 'user_command', c FROM orders_ev
  UNION ALL SELECT run_id, seq, ts, 'log_starting_byte', b FROM orders_ev),
status_ev AS (
  SELECT run_id, seq, ts, value AS run_status FROM run_events WHERE field = 'run_status'),
run_state AS (
  SELECT run_id,
    arg_max(value, (ts, seq)) FILTER (WHERE field = 'run_status') AS run_status,
    arg_max(value, (ts, seq)) FILTER (WHERE field = 'user_command') AS user_command,
    CAST(arg_max(value, (ts, seq)) FILTER (WHERE field = 'log_starting_byte') AS BIGINT) AS log_starting_byte
  FROM run_events GROUP BY run_id)
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLES: dict[str, str] = {}

ORACLES["parse_logs"] = _with(B_LOG) + """
SELECT run_id, line_no, ts, severity, emitter, message,
  (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris' AS local_ts
FROM entries
"""

ORACLES["flatten_newlines"] = """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'json' ELSE 'text' END AS log_format,
  replace(text, chr(10), '  ') AS flat FROM documents)
SELECT doc_id, log_format,
  CASE WHEN log_format = 'json' THEN flat ELSE '[dbt] ' || flat END AS message,
  CAST(length(CASE WHEN log_format = 'json' THEN flat ELSE '[dbt] ' || flat END) AS BIGINT) AS n_chars
FROM d
"""

ORACLES["json_fields"] = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  lower(CASE WHEN event_type = 'signup' AND value >= 90 THEN 'WARNING'
             WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN'
             WHEN event_type = 'purchase' THEN 'INFO' WHEN event_type = 'click' THEN 'NOTICE'
             ELSE 'DEBUG' END) AS level,
  event_type || ' ' || props AS msg
FROM events
"""

ORACLES["severity_rank"] = _with(B_LOG, SEVERITY_DIM) + """
SELECT e.run_id, e.line_no, e.severity, CAST(s.lookup_rank AS INTEGER) AS severity_rank
FROM entries e JOIN sev s ON upper(e.severity) = s.name
WHERE s.lookup_rank IS NOT NULL
"""

ORACLES["unknown_severity"] = _with(B_LOG, SEVERITY_DIM) + """
SELECT severity, count(*) AS n_lines FROM entries
WHERE upper(severity) NOT IN (SELECT name FROM sev WHERE lookup_rank IS NOT NULL)
GROUP BY severity
"""

ORACLES["level_filter"] = _with(B_LOG, SEVERITY_DIM, RUN_LEVELS) + """
SELECT e.run_id, e.line_no, e.severity,
  CAST(s.registered_rank AS INTEGER) AS event_rank,
  CAST(COALESCE(r.registered_rank, 20) AS INTEGER) AS min_rank
FROM entries e
LEFT JOIN sev s ON upper(e.severity) = s.name
LEFT JOIN levels l ON e.run_id = l.run_id
LEFT JOIN sev r ON upper(COALESCE(l.log_level, 'info')) = r.name
WHERE s.registered_rank >= COALESCE(r.registered_rank, 20)
"""

ORACLES["hidden_lines"] = _with(B_LOG, SEVERITY_DIM, RUN_LEVELS) + """
SELECT e.run_id, e.line_no, e.severity
FROM entries e
LEFT JOIN sev s ON upper(e.severity) = s.name
LEFT JOIN levels l ON e.run_id = l.run_id
LEFT JOIN sev r ON upper(COALESCE(l.log_level, 'info')) = r.name
WHERE NOT coalesce(s.registered_rank >= COALESCE(r.registered_rank, 20), false)
"""

ORACLES["override_levels"] = _with(B_LOG, SEVERITY_DIM, RUN_LEVELS) + """
SELECT e.run_id, CAST(COALESCE(r.registered_rank, 20) AS INTEGER) AS min_rank, count(*) AS n_lines
FROM entries e
LEFT JOIN sev s ON upper(e.severity) = s.name
LEFT JOIN levels l ON e.run_id = l.run_id
LEFT JOIN sev r ON upper(COALESCE(l.log_level, 'info')) = r.name
WHERE s.registered_rank >= COALESCE(r.registered_rank, 20)
GROUP BY 1, 2
"""

ORACLES["byte_offsets"] = _with(B_LOG, OFFSETS) + """
SELECT run_id, line_no, n_bytes, start_byte FROM offs
"""

ORACLES["hot_run_offsets"] = _with(B_LOG.replace(
    "SELECT event_id, ts, user_id AS run_id,",
    "SELECT event_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE user_id END AS run_id,"),
    OFFSETS) + """
SELECT run_id, line_no, n_bytes, start_byte FROM offs
"""

ORACLES["read_since"] = _with(B_LOG, OFFSETS) + """
, cur AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN CAST(SUM(n_bytes + 1) - 1 AS BIGINT) ELSE run_id * 100 END AS cursor FROM offs GROUP BY run_id)
SELECT o.run_id, o.line_no, o.start_byte, c.cursor,
  CASE WHEN o.start_byte >= c.cursor THEN o.raw ELSE substr(o.raw, CAST(c.cursor - o.start_byte + 1 AS INTEGER)) END AS piece,
  (c.cursor - o.start_byte > 0) AS partial
FROM offs o JOIN cur c ON o.run_id = c.run_id
JOIN (SELECT run_id, CAST(SUM(n_bytes + 1) - 1 AS BIGINT) AS size FROM offs GROUP BY run_id) s ON s.run_id = o.run_id
WHERE o.start_byte + o.n_bytes >= c.cursor AND s.size > c.cursor
"""

ORACLES["read_since_cursor"] = _with(B_LOG, OFFSETS) + """
, cur AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN CAST(SUM(n_bytes + 1) - 1 AS BIGINT) ELSE run_id * 100 END AS cursor FROM offs GROUP BY run_id),
sizes AS (SELECT run_id, CAST(SUM(n_bytes + 1) - 1 AS BIGINT) AS size FROM offs GROUP BY run_id)
SELECT c.run_id, CAST(c.cursor AS BIGINT) AS cursor, s.size,
  CAST(CASE WHEN s.size > c.cursor THEN s.size + 1 ELSE c.cursor END AS BIGINT) AS new_cursor
FROM cur c JOIN sizes s ON c.run_id = s.run_id
"""

ORACLES["ordered_log"] = _with(B_LOG, B_STATE) + """
SELECT l.run_id, CAST((l.line_no - 1) // 1000 AS BIGINT) AS chunk_no,
  min(l.line_no) AS first_line, max(l.line_no) AS last_line, count(*) AS n_lines,
  string_agg(l.raw, chr(10) ORDER BY l.line_no) AS text, any_value(s.run_status) AS run_status
FROM lines l LEFT JOIN run_state s ON l.run_id = s.run_id
GROUP BY l.run_id, (l.line_no - 1) // 1000
"""

ORACLES["run_summary"] = _with(B_LOG) + """
SELECT run_id, count(*) AS n_lines,
  count(*) FILTER (WHERE upper(severity) = 'ERROR') AS n_errors,
  min(ts) AS first_ts, max(ts) AS last_ts,
  max(ts) FILTER (WHERE starts_with(message, '[dbt] purchase')) AS finish_ts,
  COALESCE(bool_or(starts_with(message, '[job] signup')), false) AS succeeded,
  max(ts) FILTER (WHERE starts_with(message, '[dbt] purchase')) IS NOT NULL AS finished,
  CAST(epoch(COALESCE(max(ts) FILTER (WHERE starts_with(message, '[dbt] purchase')), max(ts)))
       - epoch(min(ts)) AS BIGINT) AS duration_s
FROM entries GROUP BY run_id
"""

ORACLES["log_counts_rollup"] = _with(B_LOG) + """
SELECT date_trunc('day', ts) AS day, severity, emitter, count(*) AS n_lines,
  CAST(grouping(date_trunc('day', ts), severity, emitter) AS BIGINT) AS gid
FROM entries
WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY ROLLUP (date_trunc('day', ts), severity, emitter)
"""

# ---------------------------------------------------------------- runs
ORACLES["status_compaction"] = _with(B_STATE) + """
SELECT run_id, run_status, user_command, log_starting_byte FROM run_state
"""

TRANSITIONS = """
t AS (
  SELECT run_id, seq, ts, run_status,
    lag(run_status) OVER (PARTITION BY run_id ORDER BY ts, seq) AS prev_status,
    lead(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) AS next_ts
  FROM status_ev),
allowed(a_prev, a_cur) AS (VALUES ('scheduled', 'running'), ('running', 'running'),
  ('running', 'success'), ('running', 'failed'), ('success', 'running'))
SELECT t.run_id, t.seq, t.ts, t.run_status, t.prev_status, t.next_ts,
  CAST(CAST(epoch(t.next_ts) - epoch(t.ts) AS BIGINT) AS DOUBLE) AS secs_in_status,
  CASE WHEN t.prev_status IS NULL THEN t.run_status IN ('scheduled', 'running')
       ELSE a.a_prev IS NOT NULL END AS allowed
FROM t LEFT JOIN allowed a ON t.prev_status = a.a_prev AND t.run_status = a.a_cur
"""
ORACLES["status_transitions"] = _with(B_STATE, TRANSITIONS)

ORACLES["status_pivot"] = _with(B_STATE) + """
, g AS (
  SELECT date_trunc('day', ts) AS day,
    count(*) FILTER (WHERE run_status = 'scheduled') AS scheduled,
    count(*) FILTER (WHERE run_status = 'running') AS running,
    count(*) FILTER (WHERE run_status = 'success') AS success,
    count(*) FILTER (WHERE run_status = 'failed') AS failed
  FROM status_ev GROUP BY 1)
SELECT *, CASE WHEN success + failed > 0 THEN round(failed / (success + failed), 4) END AS failure_rate FROM g
"""

ORACLES["live_runs"] = _with(B_STATE) + """
SELECT run_id, run_status, user_command, log_starting_byte FROM run_state
WHERE run_status IN ('pending', 'running')
"""

ORACLES["version_mismatch"] = """
SELECT s.s_suppkey, s.s_nationkey AS nationkey, '1.' || CAST(s.s_nationkey % 4 AS VARCHAR) AS client_version,
  '1.' || CAST(n.n_regionkey AS VARCHAR) AS server_version
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE '1.' || CAST(s.s_nationkey % 4 AS VARCHAR) IS DISTINCT FROM '1.' || CAST(n.n_regionkey AS VARCHAR)
"""

# ---------------------------------------------------------------- B-sched
B_SCHED = """
sched_base AS (
  SELECT p_partkey, p_size, p_type, p_name || '-' || CAST(p_partkey AS VARCHAR) AS name,
    'run --select ' || replace(lower(p_brand), 'brand#', 'model_') AS command,
    CASE WHEN p_type = 'ECONOMY' AND p_size % 10 = 0 THEN '@daily'
         WHEN p_type = 'ECONOMY' THEN CAST(p_size % 60 AS VARCHAR) || ' ' || CAST(p_partkey % 24 AS VARCHAR) || ' * * *'
         WHEN p_type = 'SMALL' THEN '*/15 ' || CAST(p_partkey % 24 AS VARCHAR) || ' * * MON-FRI'
         WHEN p_type = 'MEDIUM' THEN CAST(p_size AS VARCHAR) || ' 21-3/2 * * *'
         WHEN p_type = 'LARGE' THEN '0 ' || CAST(p_partkey % 24 AS VARCHAR) || ' 1,15 jan-JUN *'
         WHEN p_type = 'PROMO' THEN '30 6 * * 0,Sat'
         ELSE CAST(p_size % 60 AS VARCHAR) || ' ' || CAST(p_partkey % 24 AS VARCHAR) || ' 4 * 6' END AS schedule
  FROM part),
deployed AS (
  SELECT name, command, schedule, ['UTC', 'Europe/Paris', 'America/New_York', 'Asia/Kolkata', NULL][p_partkey % 5 + 1] AS timezone,
    'prod' AS target, p_partkey AS schedule_key, p_type, p_size
  FROM sched_base WHERE p_size <= 40),
requested AS (
  SELECT name, CASE p_type WHEN 'PROMO' THEN replace(command, 'run ', 'build ')
                           WHEN 'STANDARD' THEN replace(command, '--select ', '--select=')
                           ELSE command END AS command, schedule
  FROM sched_base WHERE p_size > 10)
"""


def _diff(fields: bool) -> str:
    differs = ("(d.command IS DISTINCT FROM r.command OR d.schedule IS DISTINCT FROM r.schedule)"
               if fields else "true")
    return f"""
diff AS (
  SELECT COALESCE(r.name, d.name) AS name,
    CASE WHEN d.name IS NULL THEN 'add' WHEN r.name IS NULL THEN 'delete'
         WHEN {differs} THEN 'redeploy' END AS action,
    COALESCE(r.command, d.command) AS command, COALESCE(r.schedule, d.schedule) AS schedule
  FROM deployed d FULL OUTER JOIN requested r ON d.name = r.name)
"""


ORACLES["schedule_specs"] = _with(B_SCHED) + """
SELECT r.name, r.command, r.schedule, k.kind FROM requested r, (VALUES ('yaml'), ('jsonl')) AS k(kind)
"""
ORACLES["schedule_diff"] = _with(B_SCHED, _diff(False)) + """
SELECT name, action, command, schedule,
  CAST(CASE action WHEN 'add' THEN 1 WHEN 'delete' THEN 2 ELSE 3 END AS INTEGER) AS action_rank
FROM diff WHERE action IS NOT NULL
"""

ORACLES["schedule_diff_fields"] = _with(B_SCHED, _diff(True)) + """
SELECT name, action, command, schedule,
  CAST(CASE action WHEN 'add' THEN 1 WHEN 'delete' THEN 2 ELSE 3 END AS INTEGER) AS action_rank
FROM diff WHERE action IS NOT NULL
"""

ORACLES["plan_order"] = _with(B_SCHED, _diff(True)) + """
SELECT row_number() OVER (ORDER BY CASE action WHEN 'add' THEN 1 WHEN 'delete' THEN 2 ELSE 3 END, name) AS position,
  action, name
FROM diff WHERE action IS NOT NULL
"""

ORACLES["run_lookup"] = _with(B_STATE) + """
SELECT run_id, run_status, user_command, log_starting_byte FROM run_state
WHERE run_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
"""

ORACLES["apply_plan"] = _with(B_SCHED, _diff(True)) + """
SELECT name, command, schedule FROM deployed d
WHERE NOT EXISTS (SELECT 1 FROM diff p WHERE p.name = d.name AND p.action IN ('delete', 'add', 'redeploy'))
UNION ALL
SELECT r.name, r.command, r.schedule FROM requested r
WHERE EXISTS (SELECT 1 FROM diff p WHERE p.name = r.name AND p.action IN ('add', 'redeploy'))
"""

ORACLES["describe_schedules"] = _with(B_SCHED) + """
SELECT r.name, d.name IS NOT NULL AS found, d.command, d.schedule,
  CASE WHEN d.name IS NOT NULL THEN d.name || ': ' || d.command || ' @ ' || d.schedule
       ELSE 'Found no schedule named ''' || r.name || '''' END AS message
FROM requested r LEFT JOIN deployed d ON r.name = d.name
"""

ORACLES["delete_outcomes"] = _with(B_SCHED) + """
SELECT r.name, d.name IS NOT NULL AS deleted,
  CASE WHEN d.name IS NOT NULL THEN 'Schedule ' || r.name || ' deleted'
       ELSE 'Nothing to delete, schedule ' || r.name || ' does not exist or is disabled in runlake/europe-west1' END AS message
FROM requested r LEFT JOIN deployed d ON r.name = d.name
"""

ORACLES["active_schedules"] = _with(B_SCHED) + """
, jobs AS (
  SELECT 'projects/runlake/locations/europe-west1/jobs/' || name AS job_name,
    CASE WHEN p_type = 'SMALL' THEN command ELSE '[schedule job] ' || command END AS description,
    CASE WHEN p_type = 'LARGE' THEN 'PAUSED' ELSE 'ENABLED' END AS state,
    schedule, 'UTC' AS time_zone,
    'https://runner.example/schedule/' || CAST(p_partkey AS VARCHAR) || '/start' AS uri
  FROM sched_base WHERE p_size <= 40)
SELECT split_part(job_name, '/', -1) AS name, replace(description, '[schedule job] ', '') AS command,
  schedule, time_zone AS timezone, uri AS target,
  '2024-01-01-' || split_part(job_name, '/', -1) AS folder,
  'u' || replace(split_part(job_name, '/', -1), '-', '') AS job_id,
  'schedule-' || split_part(job_name, '/', -1) AS default_name
FROM jobs WHERE starts_with(description, '[schedule job] ') AND state = 'ENABLED'
"""


# What each derived cron text means, written down by part type rather than parsed.
FIRES = """
cron AS (
  SELECT *, p_type = 'ECONOMY' AND p_size % 10 = 0 AS daily,
    CASE WHEN p_type = 'ECONOMY' AND p_size % 10 = 0 THEN [0]
         WHEN p_type = 'SMALL' THEN [0, 15, 30, 45] WHEN p_type = 'MEDIUM' THEN [p_size]
         WHEN p_type = 'LARGE' THEN [0] WHEN p_type = 'PROMO' THEN [30] ELSE [p_size % 60] END AS c_min,
    CASE WHEN p_type = 'ECONOMY' AND p_size % 10 = 0 THEN [0]
         WHEN p_type = 'MEDIUM' THEN [21, 23, 1, 3] WHEN p_type = 'PROMO' THEN [6] ELSE [schedule_key % 24] END AS c_hour
  FROM deployed),
days AS (SELECT CAST(d AS DATE) AS d FROM generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) g(d)),
fire_days AS (
  SELECT c.*, days.d FROM cron c, days
  WHERE CASE c.p_type WHEN 'SMALL' THEN dayofweek(days.d) BETWEEN 1 AND 5
                      WHEN 'LARGE' THEN day(days.d) IN (1, 15) AND month(days.d) BETWEEN 1 AND 6
                      WHEN 'PROMO' THEN dayofweek(days.d) IN (0, 6)
                      WHEN 'ECONOMY' THEN true WHEN 'MEDIUM' THEN true
                      ELSE day(days.d) = 4 OR dayofweek(days.d) = 6 END),
local_fires AS (
  SELECT name, schedule, schedule_key, command, coalesce(timezone, 'UTC') AS zone,
    CAST(d AS TIMESTAMP) + to_hours(CAST(h AS BIGINT)) + to_minutes(CAST(m AS BIGINT)) AS local_ts
  FROM (SELECT *, unnest(c_hour) AS h FROM fire_days) x, unnest(x.c_min) AS u(m)),
fires AS MATERIALIZED (
  SELECT name, schedule, schedule_key, command, fire_ts
  FROM (SELECT *, timezone('UTC', timezone(zone, local_ts)) AS fire_ts FROM local_fires)
  WHERE fire_ts >= TIMESTAMP '2024-01-01' AND fire_ts < TIMESTAMP '2024-01-31')
"""

# As-of: a run belongs to the fire that lies at or before it and has no later one before the run.
ADHERENCE = """
next_fires AS MATERIALIZED (
  SELECT schedule_key, fire_ts, lead(fire_ts) OVER (PARTITION BY schedule_key ORDER BY fire_ts) AS next_ts
  FROM (SELECT DISTINCT schedule_key, fire_ts FROM fires)),
matched AS (
  SELECT f.schedule_key, f.fire_ts, min(r.run_ts) AS first_run_ts
  FROM next_fires f JOIN runs r ON coalesce(r.schedule_key, -1) = coalesce(f.schedule_key, -1)
   AND r.run_ts >= f.fire_ts AND r.run_ts < coalesce(f.next_ts, TIMESTAMP '9999-01-01')
  GROUP BY f.schedule_key, f.fire_ts)
SELECT f.schedule_key, f.fire_ts, m.first_run_ts,
  CAST(CAST(floor(epoch(m.first_run_ts)) AS BIGINT) - CAST(floor(epoch(f.fire_ts)) AS BIGINT) AS DOUBLE) AS delay_s,
  CASE WHEN m.first_run_ts IS NOT NULL THEN 'ran' ELSE 'missed' END AS status
FROM next_fires f LEFT JOIN matched m ON f.schedule_key IS NOT DISTINCT FROM m.schedule_key AND f.fire_ts = m.fire_ts
"""

RETRIES = """
tries AS (
  SELECT f.schedule_key, f.fire_ts, r.start_id, r.run_ts,
    row_number() OVER (PARTITION BY f.schedule_key, f.fire_ts ORDER BY r.run_ts, r.start_id) AS attempt
  FROM (SELECT DISTINCT schedule_key, fire_ts FROM fires) f JOIN runs r ON coalesce(r.schedule_key, -1) = coalesce(f.schedule_key, -1)
   AND r.run_ts >= f.fire_ts AND r.run_ts <= f.fire_ts + INTERVAL 120 SECOND)
SELECT schedule_key, fire_ts, attempt, start_id, run_ts, epoch_us(run_ts) - epoch_us(fire_ts) AS delay_us
FROM tries WHERE attempt <= 3
"""

B_HOT = """
runs AS MATERIALIZED (
  SELECT CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type <> 'signup' THEN user_id END AS schedule_key,
    CASE WHEN event_type IN ('view', 'click') THEN TIMESTAMP '2024-01-10 08:00:00' + to_seconds(CAST(event_id % 3600 AS BIGINT))
         ELSE ts END AS run_ts, event_id AS start_id
  FROM events),
fires AS MATERIALIZED (
  SELECT DISTINCT CASE WHEN o_orderkey % 5 < 2 THEN 0 WHEN o_orderkey % 5 > 2 THEN o_custkey END AS schedule_key,
    CASE WHEN o_orderkey % 5 < 2 THEN TIMESTAMP '2024-01-10 08:00:00' + to_seconds(CAST(o_orderkey % 3600 AS BIGINT))
         ELSE TIMESTAMP '2024-01-01' + to_seconds(CAST((o_orderkey * 37) % 2592000 AS BIGINT)) END AS fire_ts
  FROM orders)
"""

B_HOT_WRITES = """
status_ev AS (
  SELECT CASE WHEN o_orderkey % 5 < 2 THEN 0 WHEN o_orderkey % 5 > 2 THEN o_custkey END AS run_id, o_orderkey AS seq,
    CASE WHEN o_orderkey % 5 < 2 THEN TIMESTAMP '1998-01-10 08:00:00' + to_seconds(CAST(o_orderkey % 600 AS BIGINT))
         ELSE o_orderdate END AS ts,
    CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' END AS run_status,
    o_orderpriority AS priority
  FROM orders)
"""

ORACLES["expand_cron"] = _with(B_SCHED, FIRES) + """
SELECT name, schedule, fire_ts FROM fires
"""

ORACLES["materialise_fires"] = _with(B_SCHED, FIRES) + """
SELECT f.name, f.fire_ts, 'base-' || f.name AS base_run_id, 'scheduled' AS run_status,
  f.command AS user_command, '2024-01-01-' || f.name AS cloud_storage_folder,
  CAST(0 AS BIGINT) AS log_starting_byte,
  sha256(f.name || '|' || strftime(f.fire_ts, '%Y-%m-%dT%H:%M:%S')) AS run_id
FROM fires f
"""

_RUNS = "runs AS (SELECT user_id AS schedule_key, ts AS run_ts, event_id AS start_id FROM events)"
ORACLES["fire_adherence"] = _with(B_SCHED, FIRES, _RUNS, ADHERENCE)
ORACLES["retry_attempts"] = _with(B_SCHED, FIRES, _RUNS, RETRIES)
ORACLES["hot_transitions"] = _with(B_HOT_WRITES, TRANSITIONS)
ORACLES["hot_adherence"] = _with(B_HOT, ADHERENCE)
ORACLES["hot_retries"] = _with(B_HOT, RETRIES)

ORACLES["command_parse"] = _with(B_SCHED) + """
, a AS (SELECT name, command, schedule, string_split(trim(command), ' ') AS args FROM requested),
b AS (
  SELECT *, list_position(args, '--select') AS pos,
    list_filter(args, lambda x: starts_with(x, '--select=') AND length(x) > 9) AS eq,
    CASE WHEN list_contains(args, '--schedule') THEN args ELSE list_concat(args, ['--schedule', schedule]) END AS a1
  FROM a)
SELECT name, command, args[1] AS verb,
  CASE WHEN pos > 0 THEN args[pos + 1] WHEN list_contains(args, '--select=') THEN '' ELSE '*' END AS selection,
  CASE WHEN pos > 0 THEN args[pos + 1] WHEN len(eq) > 0 THEN substr(eq[1], 10)
       WHEN list_contains(args, '--select=') THEN '' ELSE '*' END AS selection_strict,
  array_to_string(CASE WHEN list_contains(a1, '--schedule-name') THEN a1
                       ELSE list_concat(a1, ['--schedule-name', name]) END, ' ') AS submitted
FROM b
"""

# ---------------------------------------------------------------- checks
CUST_NULLS = """
cust AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS c_nationkey,
  c_acctbal, c_mktsegment FROM customer)
"""


def _status(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 'PASS' ELSE 'FAIL ' || CAST({x} AS VARCHAR) END"


ORACLES["check_not_null"] = _with(CUST_NULLS) + f"""
, c AS (SELECT count(*) FILTER (WHERE c_nationkey IS NULL) AS failures, count(*) AS rows FROM cust)
SELECT 'customer' AS model, 'c_nationkey' AS column, 'not_null' AS "check", failures, rows,
  {_status("failures")} AS status FROM c
"""

ORACLES["check_unique"] = f"""
WITH d AS (SELECT count(*) AS failures FROM (
  SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) > 1))
SELECT 'lineitem' AS model, 'l_orderkey,l_linenumber' AS column, 'unique' AS "check", failures,
  {_status("failures")} AS status FROM d
"""


def _nn(model: str, src: str, col: str) -> str:
    return (f"SELECT '{model}' AS model, '{col}' AS \"column\", 'not_null' AS chk, "
            f"count(*) FILTER (WHERE {col} IS NULL) AS failures FROM {src}")


def _uq(model: str, src: str, cols: str) -> str:
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols.split(","))
    return (f"SELECT '{model}' AS model, '{cols}' AS \"column\", 'unique' AS chk, count(*) AS failures FROM "
            f"(SELECT {cols} FROM {src} WHERE {where} GROUP BY {cols} HAVING count(*) > 1)")


ORACLES["check_report"] = _with(CUST_NULLS) + f"""
, r AS (
  {_nn("customer", "cust", "c_nationkey")} UNION ALL {_nn("customer", "cust", "c_name")}
  UNION ALL {_uq("customer", "cust", "c_custkey")} UNION ALL {_uq("orders", "orders", "o_orderkey")}
  UNION ALL {_nn("orders", "orders", "o_custkey")}
  UNION ALL {_uq("lineitem", "lineitem", "l_orderkey,l_linenumber")}
  UNION ALL {_nn("lineitem", "lineitem", "l_shipdate")})
SELECT chk || '_' || model || '_' || replace("column", ',', '_') AS name, model, "column", chk AS "check",
  CAST(failures AS BIGINT) AS failures, {_status("failures")} AS status
FROM r
"""


def _prof(col: str, numeric: bool) -> str:
    lo = f"CAST(min({col}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    hi = f"CAST(max({col}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    los = "CAST(NULL AS VARCHAR)" if numeric else f"min({col})"
    his = "CAST(NULL AS VARCHAR)" if numeric else f"max({col})"
    return (f"SELECT '{col}' AS column, count(*) AS n_rows, count(*) FILTER (WHERE {col} IS NULL) AS n_nulls, "
            f"count(DISTINCT {col}) AS n_distinct, {lo} AS min_num, {hi} AS max_num, {los} AS min_str, "
            f"{his} AS max_str FROM cust")


ORACLES["profile_columns"] = _with(CUST_NULLS) + " UNION ALL ".join([
    _prof("c_custkey", True), _prof("c_name", False), _prof("c_nationkey", True),
    _prof("c_acctbal", True), _prof("c_mktsegment", False)])

# ---------------------------------------------------------------- B-graph
B_GRAPH = """
gnodes AS (
  SELECT 'n' || CAST(p_partkey AS VARCHAR) AS node_id,
    CASE p_type WHEN 'ECONOMY' THEN 'seed' WHEN 'LARGE' THEN 'test' WHEN 'PROMO' THEN 'snapshot'
      ELSE 'model' END AS resource_type,
    p_name AS name, '/projects/' || replace(lower(p_brand), 'brand#', 'p') AS root_path, p_partkey, p_size
  FROM part),
gedges AS (
  SELECT 'n' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR) AS parent_id,
    'n' || CAST(p_partkey AS VARCHAR) AS child_id
  FROM part WHERE p_partkey > 1)
"""

ORACLES["dag_levels"] = "WITH RECURSIVE " + _with(B_GRAPH)[5:] + """
, lv(node_id, level) AS (
  SELECT node_id, 0 FROM gnodes WHERE node_id NOT IN (SELECT child_id FROM gedges)
  UNION ALL
  SELECT e.child_id, lv.level + 1 FROM lv JOIN gedges e ON e.parent_id = lv.node_id)
SELECT node_id, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY node_id
"""

ORACLES["skip_propagation"] = "WITH RECURSIVE " + _with(B_GRAPH)[5:] + """
, failed AS (SELECT node_id FROM gnodes WHERE p_size = 1),
d(node_id, depth) AS (
  SELECT e.child_id, 1 FROM gedges e JOIN failed f ON e.parent_id = f.node_id
  UNION
  SELECT e.child_id, d.depth + 1 FROM d JOIN gedges e ON e.parent_id = d.node_id)
SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM d
WHERE node_id NOT IN (SELECT node_id FROM failed) GROUP BY node_id
"""

ORACLES["closure"] = "WITH RECURSIVE " + _with(B_GRAPH)[5:] + """
, start AS (SELECT node_id FROM gnodes WHERE p_size = 50),
u(node_id, depth) AS (
  SELECT e.parent_id, 1 FROM gedges e JOIN start s ON e.child_id = s.node_id
  UNION
  SELECT e.parent_id, u.depth + 1 FROM u JOIN gedges e ON e.child_id = u.node_id)
SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM u
WHERE node_id NOT IN (SELECT node_id FROM start) GROUP BY node_id
"""

ORACLES["select_nodes"] = _with(B_GRAPH) + """
SELECT node_id, name, resource_type FROM gnodes
WHERE name IN (SELECT p_name FROM part WHERE p_size = 25 UNION ALL SELECT 'no_such_model')
"""

ORACLES["list_nodes"] = _with(B_GRAPH) + """
SELECT node_id, resource_type, name FROM gnodes WHERE resource_type IN ('seed', 'snapshot')
"""

ORACLES["retry_set"] = _with(B_GRAPH) + """
, res AS (
  SELECT 'n' || CAST(l_partkey AS VARCHAR) AS node_id,
    CASE l_returnflag WHEN 'N' THEN 'success' WHEN 'A' THEN 'fail' ELSE 'error' END AS status,
    l_shipdate, l_orderkey, l_linenumber FROM lineitem),
last AS (SELECT node_id, arg_max(status, (l_shipdate, l_orderkey, l_linenumber, status)) AS s FROM res GROUP BY node_id)
SELECT node_id, name, resource_type FROM gnodes g
WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.node_id = g.node_id AND l.s = 'success')
"""

ORACLES["seed_root_path"] = _with(B_GRAPH) + """
SELECT node_id, resource_type, CASE WHEN resource_type = 'seed' THEN '.' ELSE root_path END AS root_path FROM gnodes
"""

# ---------------------------------------------------------------- settings, files
B_SET = """
settings AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS scope, c_mktsegment AS key,
    CASE WHEN c_acctbal >= 0 THEN c_name END AS value, c_custkey AS priority, c_custkey AS seq,
    CASE WHEN c_acctbal < 0 THEN 'delete' ELSE 'set' END AS op
  FROM customer)
"""

ORACLES["config_layers"] = _with(B_SET) + """
SELECT scope, key, arg_max(value, priority) FILTER (WHERE value IS NOT NULL) AS value,
  CAST(max(priority) FILTER (WHERE value IS NOT NULL) AS DOUBLE) AS priority,
  COALESCE(arg_max(value, priority) FILTER (WHERE value IS NOT NULL), 'default_' || lower(key)) AS effective
FROM settings GROUP BY scope, key
"""

ORACLES["kv_tombstones"] = _with(B_SET) + """
, last AS (SELECT scope, key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM settings GROUP BY scope, key)
SELECT scope, key, value FROM last WHERE op <> 'delete'
"""

ORACLES["map_overlay"] = """
SELECT c_custkey, 'log_format' AS key, 'json' AS value FROM customer
UNION ALL SELECT c_custkey, 'log_level', 'debug' FROM customer
UNION ALL SELECT c_custkey, 'debug', 'true' FROM customer
UNION ALL SELECT c_custkey, 'target', 'prod' FROM customer WHERE c_acctbal > 0
"""

ORACLES["path_prefix"] = """
WITH p AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS root FROM pages),
q AS (
  SELECT *, replace(url, root, '') AS rel_path, split_part(url, '/', -1) AS base_name,
    CASE WHEN starts_with(url, 'https') THEN 'manifest' WHEN ends_with(url, '.html') THEN 'seeds_path'
      ELSE 'log_path' END AS key FROM p),
r AS (SELECT *, CASE WHEN ends_with(url, '#top') THEN rel_path ELSE regexp_replace(rel_path, '^/+', '') END AS v FROM q)
SELECT page_id, root, rel_path, base_name, key,
  CASE WHEN key IN ('manifest', 'extra_packages', 'seeds_path') AND v IS NOT NULL
       THEN CASE WHEN starts_with(v, '/') THEN v ELSE '/srv/project/' || v END
       ELSE v END AS value
FROM r
"""

ORACLES["artifact_collisions"] = """
WITH f AS (
  SELECT url AS path, CAST(strlen(html) AS BIGINT) AS length,
    regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS folder,
    regexp_replace(split_part(url, '/', -1), '[?#].*$', '') AS base_name
  FROM pages)
SELECT folder, base_name, count(*) AS n_files, min(path) AS first_path, max(path) AS last_path,
  CAST(sum(length) AS BIGINT) AS total_bytes,
  count(*) FILTER (WHERE ends_with(lower(base_name), '.csv')) AS n_csv
FROM f GROUP BY folder, base_name HAVING count(*) > 1
"""

ORACLES["flatten_lists"] = """
SELECT s_suppkey, s_nationkey, CAST(0 AS BIGINT) AS pos, s_name AS item FROM supplier WHERE s_acctbal >= 0
UNION ALL
SELECT s_suppkey, s_nationkey, CAST(1 AS BIGINT), s_name || '-replica' FROM supplier WHERE s_acctbal >= 0
"""

# ---------------------------------------------------------------- history, ranking
ORACLES["snapshot_history"] = """
WITH o AS (
  SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_orderpriority,
    row_number() OVER w AS rn,
    lag(o_orderstatus) OVER w AS p_status, lag(o_orderpriority) OVER w AS p_prio
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
v AS (
  SELECT * FROM o WHERE rn = 1 OR o_orderstatus IS DISTINCT FROM p_status OR o_orderpriority IS DISTINCT FROM p_prio)
SELECT o_custkey, row_number() OVER w AS version, o_orderstatus, o_orderpriority,
  o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to,
  lead(o_orderdate) OVER w IS NULL AS is_current, o_orderkey AS from_seq
FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""

ORACLES["hot_snapshot"] = _with(B_HOT_WRITES) + """
, o AS (
  SELECT *, row_number() OVER w AS rn, lag(run_status) OVER w AS p_status, lag(priority) OVER w AS p_prio
  FROM status_ev WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
v AS (SELECT * FROM o WHERE rn = 1 OR run_status IS DISTINCT FROM p_status OR priority IS DISTINCT FROM p_prio)
SELECT run_id, row_number() OVER w AS version, run_status, priority, ts AS valid_from, lead(ts) OVER w AS valid_to,
  lead(ts) OVER w IS NULL AS is_current, seq AS from_seq
FROM v WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)
"""

ORACLES["snapshot_step"] = """
WITH h AS (
  SELECT CASE WHEN c_custkey <> 1 THEN c_custkey END AS k, c_nationkey, c_mktsegment,
    CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2023-09-01' END AS valid_to FROM customer),
c AS (
  SELECT CASE WHEN c_custkey <> 1 THEN c_custkey END AS k,
    CASE WHEN c_custkey <> 1 AND c_nationkey % 2 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, c_mktsegment
  FROM customer WHERE c_nationkey <> 7),
open_rows AS (SELECT * FROM h WHERE valid_to IS NULL),
rows AS (
  SELECT k, c_nationkey, c_mktsegment, TIMESTAMP '2023-06-01' AS valid_from, valid_to FROM h WHERE valid_to IS NOT NULL
  UNION ALL
  SELECT o.k, o.c_nationkey, o.c_mktsegment, TIMESTAMP '2023-06-01',
    CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.k IS NOT DISTINCT FROM o.k AND c.c_nationkey = o.c_nationkey) THEN NULL
         ELSE TIMESTAMP '2024-01-01' END
  FROM open_rows o
  UNION ALL
  SELECT c.k, c.c_nationkey, c.c_mktsegment, TIMESTAMP '2024-01-01', NULL FROM c
  WHERE NOT EXISTS (SELECT 1 FROM open_rows o WHERE o.k IS NOT DISTINCT FROM c.k AND o.c_nationkey = c.c_nationkey))
SELECT CAST(k AS DOUBLE) AS k, c_nationkey, c_mktsegment, valid_from, valid_to FROM rows
"""

ORACLES["node_results"] = """
WITH l AS (
  SELECT date_trunc('day', l_shipdate) AS day, l_linenumber, l_partkey, l_returnflag,
    CAST(floor(l_quantity) AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS cents
  FROM lineitem),
r AS (
  SELECT day, CAST(l_linenumber AS BIGINT) AS idx, CAST(7 AS BIGINT) AS total,
    CASE l_returnflag WHEN 'N' THEN 'OK' WHEN 'A' THEN 'PASS' ELSE 'FAIL' END AS status,
    CASE WHEN l_returnflag IN ('N', 'A') THEN 0 ELSE q END AS failures,
    'model_' || CAST(l_partkey AS VARCHAR) AS node,
    CASE l_returnflag WHEN 'N' THEN 'SUCCESS ' || CAST(q AS VARCHAR) WHEN 'A' THEN 'PASS'
      ELSE 'FAIL ' || CAST(q AS VARCHAR) END AS result,
    CAST(CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS elapsed
  FROM l),
k AS (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY elapsed DESC NULLS LAST, node, idx, status, failures, result) AS rank
  FROM r)
SELECT day, rank, idx, total, status, failures, node, result, elapsed FROM k WHERE rank <= 3
"""

ORACLES["top_revenue_runs"] = """
SELECT o_custkey AS run_id, round(sum(o_totalprice), 2) AS total, count(*) AS n_orders
FROM orders GROUP BY o_custkey ORDER BY total DESC, run_id LIMIT 10
"""

# ---------------------------------------------------------------- sources, sinks, models
ORACLES["seed_roundtrip"] = "SELECT * FROM nation"
ORACLES["log_roundtrip"] = _with(B_LOG) + "SELECT run_id, line_no, raw FROM lines"
ORACLES["log_text_roundtrip"] = _with(B_LOG) + "SELECT CAST(run_id AS BIGINT) AS run_id, line_no, raw FROM lines"
ORACLES["state_roundtrip"] = _with(B_STATE) + "SELECT run_id, run_status, user_command, log_starting_byte FROM run_state"
ORACLES["model_chain"] = """
WITH recent_orders AS (
  WITH open_orders AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderstatus = 'O'),
       done_orders AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderstatus = 'F')
  SELECT * FROM open_orders UNION ALL SELECT * FROM done_orders)
SELECT c.c_custkey, c.c_mktsegment, r.id FROM recent_orders r
JOIN customer c ON c.c_custkey = r.o_custkey WHERE c.c_mktsegment = 'BUILDING'
"""
ORACLES["null_removal"] = _with(CUST_NULLS) + "SELECT c_custkey, c_nationkey FROM cust WHERE c_nationkey IS NOT NULL"
ORACLES["object_listing"] = _with(B_LOG) + """
SELECT CAST(run_id AS VARCHAR) || '.txt' AS rel_path, CAST(run_id AS VARCHAR) || '.txt' AS base_name, '' AS folder,
  CAST(sum(strlen(raw) + 1) AS BIGINT) AS length
FROM lines GROUP BY run_id
"""
ORACLES["seed_listing"] = """
SELECT c_name || ['.csv', '.CSV', '.csv.gz', '.txt'][c_custkey % 4 + 1] AS base_name FROM customer WHERE c_custkey % 4 < 2
"""
ORACLES["first_match"] = """
SELECT c_custkey, CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderdate
FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth
  FROM orders WHERE starts_with(o_orderpriority, '1')) o ON o_custkey = c_custkey AND nth = 1
"""
ORACLES["clone_check"] = "SELECT * FROM region"

# ---------------------------------------------------------------- streaming (batch equivalents)
ORACLES["stream_tail"] = _with(B_LOG) + "SELECT run_id, line_no, raw FROM lines"
ORACLES["stream_status"] = _with(B_STATE) + "SELECT run_id, run_status, user_command, log_starting_byte FROM run_state"
ORACLES["stream_windows"] = """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  event_type, count(*) AS n
FROM events GROUP BY 1, 2, 3
"""
ORACLES["stream_sessions"] = """
WITH e AS (
  SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev_ts FROM events),
s AS (
  SELECT user_id, ts, sum(CASE WHEN prev_ts IS NULL OR ts >= prev_ts + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
  FROM e),
g AS (
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
    count(*) AS n_lines, max(ts) AS last_ts
  FROM s GROUP BY user_id, sid)
SELECT * FROM g
"""
ORACLES["stream_dedup"] = "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events"
ORACLES["stream_late"] = """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  event_type, count(*) AS n, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-15') AS n_late
FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2, 3
"""
ORACLES["tail_growing"] = _with(B_LOG) + """
SELECT 'a' AS consumer, run_id, line_no, raw,
  CAST(CASE WHEN line_no <= 20 THEN 0 WHEN line_no <= 45 THEN 1 ELSE 2 END AS BIGINT) AS batch FROM lines
UNION ALL SELECT 'b', run_id, line_no, raw, 0 FROM lines
"""
ORACLES["log_objects_roundtrip"] = _with(B_LOG) + "SELECT CAST(run_id AS BIGINT) AS run_id, line_no, raw FROM lines"
ORACLES["run_point_lookup"] = _with(B_STATE) + "SELECT run_id, run_status, user_command, log_starting_byte FROM run_state WHERE run_id = 7"

ORACLES["dag_levels_cyclic"] = "WITH RECURSIVE " + _with(B_GRAPH)[5:] + """
, behind(node_id) AS (
  SELECT 'n20' UNION SELECT e.child_id FROM behind b JOIN gedges e ON e.parent_id = b.node_id),
lv(node_id, level) AS (
  SELECT node_id, 0 FROM gnodes WHERE node_id NOT IN (SELECT child_id FROM gedges)
  UNION ALL
  SELECT e.child_id, lv.level + 1 FROM lv JOIN gedges e ON e.parent_id = lv.node_id)
SELECT node_id, CASE WHEN node_id NOT IN (SELECT node_id FROM behind) THEN CAST(max(level) AS DOUBLE) END AS level,
  node_id IN ('n20', 'n40') AS on_cycle
FROM lv GROUP BY node_id
"""

ORACLES["graph_selectors"] = "WITH RECURSIVE " + _with(B_GRAPH)[5:] + """
, up(node_id, left_) AS (
  SELECT * FROM (VALUES ('n77', 99), ('n150', 2))
  UNION SELECT e.parent_id, up.left_ - 1 FROM up JOIN gedges e ON e.child_id = up.node_id WHERE up.left_ > 0),
down(node_id, left_) AS (
  SELECT * FROM (VALUES ('n5', 99), ('n9', 1))
  UNION SELECT e.child_id, down.left_ - 1 FROM down JOIN gedges e ON e.parent_id = down.node_id WHERE down.left_ > 0)
SELECT node_id FROM gnodes
WHERE node_id IN (SELECT node_id FROM up UNION ALL SELECT node_id FROM down) OR node_id = 'n3'
"""

ORACLES["manifest_levels"] = "WITH RECURSIVE " + _with(B_GRAPH)[5:] + """
, lv(node_id, level) AS (
  SELECT node_id, 0 FROM gnodes WHERE node_id NOT IN (SELECT child_id FROM gedges)
  UNION ALL
  SELECT e.child_id, lv.level + 1 FROM lv JOIN gedges e ON e.parent_id = lv.node_id)
SELECT g.node_id, CAST(max(level) AS INTEGER) AS level, any_value(resource_type) AS resource_type,
  any_value(root_path) AS root_path, 'table' AS how
FROM lv JOIN gnodes g ON g.node_id = lv.node_id GROUP BY g.node_id
"""


def _merged(col: str, numeric: bool) -> str:
    lo = f"CAST(min({col}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    hi = f"CAST(max({col}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    text = f"strftime({col}, '%Y-%m-%d %H:%M:%S')" if col == "o_orderdate" else f"CAST({col} AS VARCHAR)"
    los, his = ("CAST(NULL AS VARCHAR)",) * 2 if numeric else (f"min({text})", f"max({text})")
    return (f"SELECT '{col}' AS column, count(*) AS n_rows, count(*) FILTER (WHERE {col} IS NULL) AS n_nulls, "
            f"{lo} AS min_num, {hi} AS max_num, {los} AS min_str, {his} AS max_str, true AS near FROM orders")


ORACLES["profile_merged"] = " UNION ALL ".join([
    _merged("o_orderkey", True), _merged("o_custkey", True), _merged("o_orderstatus", False), _merged("o_totalprice", True),
    _merged("o_orderdate", False), _merged("o_orderpriority", False)])

ORACLES["project_build"] = """
WITH recent_orders AS (
  SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'F')),
customer_orders AS (
  SELECT c.c_custkey, c.c_mktsegment, r.id FROM recent_orders r
  JOIN customer c ON c.c_custkey = r.o_custkey WHERE c.c_mktsegment = 'BUILDING'),
nation_customers AS (
  SELECT c.c_custkey, c.c_nationkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
f AS (
  SELECT
    (SELECT count(*) FROM (SELECT id FROM recent_orders GROUP BY id HAVING count(*) > 1)) AS u_recent,
    (SELECT count(*) FROM customer_orders WHERE id IS NULL) AS nn_co,
    (SELECT count(*) FROM (SELECT c_custkey FROM customer_orders GROUP BY c_custkey HAVING count(*) > 1)) AS u_co,
    (SELECT count(*) FROM (SELECT c_custkey FROM nation_customers GROUP BY c_custkey HAVING count(*) > 1)) AS u_nc),
nodes(node_id, resource_type, lvl, failures, rows, result) AS (
  SELECT 'model.recent_orders', 'model', 0, 0, (SELECT count(*) FROM recent_orders),
         'SELECT ' || CAST((SELECT count(*) FROM recent_orders) AS VARCHAR)
  UNION ALL SELECT 'seed.nation_seed', 'seed', 0, 0, (SELECT count(*) FROM nation),
         'INSERT ' || CAST((SELECT count(*) FROM nation) AS VARCHAR)
  UNION ALL SELECT 'model.nation_customers', 'model', 1, 0, (SELECT count(*) FROM nation_customers),
         'SELECT ' || CAST((SELECT count(*) FROM nation_customers) AS VARCHAR)
  UNION ALL SELECT 'test.unique_recent_orders_id', 'test', 1, u_recent, NULL, NULL FROM f
  UNION ALL SELECT 'model.customer_orders', 'model', 2, 0, NULL, 'CREATE VIEW'
  UNION ALL SELECT 'test.unique_nation_customers_c_custkey', 'test', 2, u_nc, NULL, NULL FROM f
  UNION ALL SELECT 'test.not_null_customer_orders_id', 'test', 3, nn_co, NULL, NULL FROM f
  UNION ALL SELECT 'test.unique_customer_orders_c_custkey', 'test', 3, u_co, NULL, NULL FROM f
  UNION ALL SELECT 'model.building_nations', 'model', 4, 0, NULL, 'CREATE VIEW'),
ordered AS (SELECT *, row_number() OVER (ORDER BY lvl, node_id) AS idx FROM nodes),
skips AS (
  SELECT (SELECT failures FROM nodes WHERE node_id = 'test.not_null_customer_orders_id') > 0
      OR (SELECT failures FROM nodes WHERE node_id = 'test.unique_customer_orders_c_custkey') > 0
      OR (SELECT failures FROM nodes WHERE node_id = 'test.unique_nation_customers_c_custkey') > 0 AS skip_bn,
    (SELECT failures FROM nodes WHERE node_id = 'test.unique_recent_orders_id') > 0 AS skip_co)
SELECT CAST(idx AS BIGINT) AS idx, CAST(9 AS BIGINT) AS total, node_id, resource_type,
  CASE WHEN (node_id = 'model.building_nations' AND (s.skip_bn OR s.skip_co))
         OR (node_id IN ('model.customer_orders', 'test.not_null_customer_orders_id',
                         'test.unique_customer_orders_c_custkey') AND s.skip_co) THEN 'SKIP'
       WHEN resource_type = 'test' AND failures > 0 THEN 'FAIL ' || CAST(failures AS VARCHAR)
       WHEN resource_type = 'test' THEN 'PASS' ELSE 'OK' END AS status,
  CAST(CASE WHEN (node_id IN ('test.not_null_customer_orders_id', 'test.unique_customer_orders_c_custkey')
                  AND s.skip_co) THEN 0 ELSE failures END AS BIGINT) AS failures,
  CAST(rows AS DOUBLE) AS rows,
  CASE WHEN (node_id = 'model.building_nations' AND (s.skip_bn OR s.skip_co))
         OR (node_id IN ('model.customer_orders', 'test.not_null_customer_orders_id',
                         'test.unique_customer_orders_c_custkey') AND s.skip_co) THEN 'SKIP'
       WHEN resource_type = 'test' AND failures > 0 THEN 'FAIL ' || CAST(failures AS VARCHAR)
       WHEN resource_type = 'test' THEN 'PASS' ELSE result END AS result
FROM ordered, skips s
"""

ORACLES["rejected_schedules"] = """
SELECT p_partkey, ['0 9 * * MON-FRI', '30 6 1 JAN,JUL *', '0 22-2 * * *', '@daily', '*/0 * * * *', '0 9 * *', '@reboot',
                   '61 0 * * *'][CAST(p_partkey % 8 AS INTEGER) + 1] AS schedule
FROM part WHERE p_partkey % 8 >= 4
"""
ORACLES["malformed_lines"] = """
SELECT false AS malformed, count(*) AS n_lines FROM events
UNION ALL SELECT true, count(*) FROM events
"""
