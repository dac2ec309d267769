"""Operator 3: secret scans with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256). The ledger, a Parquet
folder, records which rule versions have seen which blob, and the findings. A scan
takes the distinct blobs of its input, drops the (blob, rule version) pairs the ledger
holds, scans one copy of each blob left for its missing rules only, appends both
tables, and joins the findings back to all paths. A new rule version rescans; a new
path with old content costs nothing.

A blob's copies are told apart by (blob, id) so that no copy is scanned twice and a
popular blob is not gathered in one task; findings join back on the blob, the small
side holding one row per blob with findings.

Edge cases: a null text is the empty blob; repeated rows and ids share their blob's
findings; a lone surrogate cannot occur in a string column; very long texts are
scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.common import slices, stored
from runlake.session import ensure_checkpoint_dir, scratch_path

# The base patterns, in order, as (kind, pattern, flags, group, least length).
BASE = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
)
#: Further kinds that this library adds.
MORE = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 1),
    ("signed_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, 40),
    ("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,200}:[^\s/@]{1,200}@", 0, 0, 1),
)
RULES = tuple((*r, 1) for r in BASE + MORE)  # each with its version
#: Runs of hex digits shorter than any finding need not be looked at: the same matches survive.
_FASTER = {BASE[2][1]: r"[0-9a-f]{24,}"}
FINDINGS = "sha string, rule string, kind string, place int, start bigint, stop bigint"


def rule_name(rule: tuple) -> str:
    return f"{rule[0]}@{rule[5]}"


def find(text: str, rules: list[tuple[int, tuple]]) -> list[tuple[str, str, int, int, int]]:
    """(rule, kind, place of the kind, start, stop) in code points, stop exclusive."""
    out = []
    for place, (kind, pattern, flags, group, least, version) in rules:
        for m in re.finditer(_FASTER.get(pattern, pattern), text, flags):
            if len(m[group]) >= least:
                out.append((f"{kind}@{version}", kind, place, m.start(), m.end()))
    return out


def scan_secrets(versions: DataFrame, ledger: str | None = None, rules: tuple = RULES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, sha, spans (array of kind, place, start, stop by
    start, then place). ``ledger`` is a folder that outlives the call; by default a
    new one in the shared folder."""
    spark = versions.sparkSession
    ensure_checkpoint_dir(spark)
    ledger = ledger or scratch_path(spark, "secret-ledger")
    rows = versions.select(versions[id_col].alias("doc_id"), F.coalesce(versions[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    # a null id becomes a value of its own type's text, so that it can be joined on
    addressed = rows.withColumn("at", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    known = _table(spark, f"{ledger}/scanned", "sha string, rule string")
    names = F.array(*[F.lit(rule_name(r)) for r in rules])
    seen = known.filter(F.col("rule").isin([rule_name(r) for r in rules])).groupBy("sha").agg(F.collect_set("rule").alias("seen"))
    blobs = (addressed.groupBy("sha").agg(F.min("at").alias("at")).join(seen, "sha", "left")
             .withColumn("missing", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
             .filter(F.size("missing") > 0).select("sha", "at", "missing"))
    blobs = stored(blobs, "unseen-blobs")

    def scan(batches):
        for batch in slices(batches, "text"):
            found = []
            for sha, text, missing in zip(*(batch.column(i).to_pylist() for i in range(3))):
                todo = [(i, r) for i, r in enumerate(rules) if rule_name(r) in missing]
                found += [(sha, *f) for f in find(text, todo)]
            cols = list(zip(*found)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                ["sha", "rule", "kind", "place", "start", "stop"])

    new = (addressed.join(blobs, ["sha", "at"]).select("sha", "text", "missing").mapInArrow(scan, FINDINGS).distinct())
    new.write.mode("append").parquet(f"{ledger}/findings")
    blobs.select("sha", F.explode("missing").alias("rule")).write.mode("append").parquet(f"{ledger}/scanned")
    # a retried run may have appended twice; findings of rules not asked for stay out
    found = (spark.read.schema(FINDINGS).parquet(f"{ledger}/findings")
             .filter(F.col("rule").isin([rule_name(r) for r in rules])).distinct())
    place = {r[0]: i for i, r in enumerate(rules)}
    order = F.create_map(*[x for k, i in place.items() for x in (F.lit(k), F.lit(i))])
    per_blob = found.groupBy("sha").agg(F.array_sort(F.collect_list(
        F.struct("start", order[F.col("kind")].alias("place"), "stop", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start: bigint, place: int, stop: bigint, kind: string>>")
    return rows.select("doc_id", "sha").join(per_blob, "sha", "left").select(
        "doc_id", "sha", F.coalesce("spans", none).alias("spans"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger table, empty before its first scan."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
