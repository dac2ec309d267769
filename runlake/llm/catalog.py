"""Queries ``opN_*`` over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.common import stored, table
from runlake.llm.decontam import contamination
from runlake.llm.exact_dedup import exact_duplicates
from runlake.llm.jaccard import near_duplicates
from runlake.llm.lexical_search import ranked_search
from runlake.llm.main_text import main_texts
from runlake.llm.packing import pack_documents
from runlake.llm.periodic_runs import best_run, periodic_runs
from runlake.llm.repeats import repeated_passages
from runlake.llm.secret_scan import BASE, scan_secrets
from runlake.llm.token_files import token_files
from runlake.llm.toxicity import score_documents, train
from runlake.llm.url_filter import host_rule, judge_urls, pattern_rule
from runlake.llm.warc import audit, copy_files, record_table, shared_folder, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# The rules of the query, and patterns of this library for urls that none of them fits.
URL_RULES = [host_rule("allow", "com", "/"), host_rule("block", "example.com", "/en/"),
             host_rule("allow", "www.example.com", "/en/"), host_rule("block", "net", "/es/"),
             host_rule("block", "net", "/fr/")]
URL_PATTERNS = [pattern_rule("block", p) for p in ("/ads/", "/login/", "/cart/", "sessionid=", "/calendar/*/day/")]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES + URL_PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op1_url_filter"] = """
WITH u AS (
    SELECT page_id, coalesce(url, '') AS url,
           CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages),
p AS (
    SELECT page_id, url,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u),
r(host, path, action) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
    SELECT p.page_id, p.url, p.host, p.path, r.host || r.path AS rule, r.action,
           row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS nth
    FROM p LEFT JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(lower(url), '/ads/|/login/|/cart/|sessionid=|/calendar/.*/day/')
                             THEN 'block' ELSE 'allow' END) AS verdict
FROM best WHERE nth = 1"""


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    names = [r[0] for r in BASE]
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "first_word", "last_word", "other_doc_id")


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op5_exact_dedup"] = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""


@query
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, a replica in which about one record in 256 has a
    flipped byte (chosen by a hash of its id), and the audit's verdict on each page."""
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    index = write_warc(pages, f"{folder}/a")
    copy_files(index, f"{folder}/a", f"{folder}/b", lambda key: hashlib.sha256(key.encode()).digest()[0] == 0x7F)
    a = stored(record_table(index, f"{folder}/a"), "records")
    b = stored(record_table(index, f"{folder}/b"), "records")
    bad = audit(a, b).select("file", "nth", F.lit(False).alias("intact"))
    return (a.join(bad, ["file", "nth"], "left")
            .select(F.col("record_id").cast("long").alias("page_id"), F.coalesce("intact", F.lit(True)).alias("intact")))


ORACLES["op6_warc_fixity"] = """
SELECT page_id, substr(sha256(CAST(page_id AS VARCHAR)), 1, 2) <> '7f' AS intact FROM pages"""


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]).cast("long"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLES["op7_benchmark_decontamination"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
seen AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM seen JOIN win USING (n, k)),
words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is not held out (it teaches nothing either)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, network).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files(table(spark, sf_dir, "documents"))
    return files.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents),
b AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t
    FROM benchmark),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w)::BIGINT AS n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
weights AS (
    SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM b) GROUP BY t), totals),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM b JOIN tf USING (t) JOIN weights USING (t), totals GROUP BY item_id, doc_id),
placed AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""



@query
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def collapsed_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting: of one document in ten the words from a on repeat with period p."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null document id leaves its words as they are."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=collapsed_words)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("best", best_run(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
