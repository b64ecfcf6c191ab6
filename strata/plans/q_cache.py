"""Queries: cache operators (H3-H7) over ``events`` keyed (user_id, event_type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as K
from ..operators import rules as R
from ..sources.tables import table
from .catalog import query
from .q_rules import RULES_SQL

KEYS = ["user_id", "event_type"]
AS_OF = "2024-01-15 00:00:00"
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_FMT = "'%Y-%m-%d %H:%M:%S.%f'"


def _as_of():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def _upserted(events):
    return K.cache_upsert(events, KEYS, "ts", "value", "event_id")


def _cache(spark, sf_dir):
    """The cache as it stands at AS_OF, for the lookups."""
    return _upserted(table(spark, sf_dir, "events").filter(F.col("ts") < _as_of()))


def _requests(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.filter((F.col("ts") >= _as_of()) & (F.col("ts") < _as_of() + F.expr("INTERVAL 1 DAY")))


UPSERT_SQL = f"""up AS (SELECT user_id, event_type, ts, event_id AS write_id, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE ts < TIMESTAMP '{AS_OF}') WHERE rn = 1),
req AS (SELECT DISTINCT user_id, event_type FROM events
        WHERE ts >= TIMESTAMP '{AS_OF}' AND ts < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY),
valid AS (SELECT * FROM up WHERE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) < 86400000000)"""


LAST_SQL = """last AS (SELECT user_id, event_type, max(struct_pack(ts := ts, id := event_id, value := value)) AS w
    FROM events GROUP BY user_id, event_type)"""


@query("cache_upsert", f"""WITH {LAST_SQL}
SELECT user_id, event_type, strftime(w.ts, {DUCK_FMT}) AS ts, w.id AS write_id, w.value AS value FROM last""")
def q_cache_upsert(spark, sf_dir):
    return _upserted(table(spark, sf_dir, "events")).withColumn("ts", F.date_format("ts", TS_FMT))


@query("cache_hits", f"""WITH {UPSERT_SQL}
SELECT r.user_id, r.event_type, strftime(v.ts, {DUCK_FMT}) AS ts, v.write_id, v.value
FROM req r JOIN valid v ON v.user_id = r.user_id AND v.event_type = r.event_type""")
def q_cache_hits(spark, sf_dir):
    hits = K.cache_hits(_requests(spark, sf_dir), _cache(spark, sf_dir), KEYS, _as_of())
    return hits.select(*KEYS, F.date_format("ts", TS_FMT).alias("ts"), "write_id", "value")


@query("cache_misses", f"""WITH {UPSERT_SQL}
SELECT r.user_id, r.event_type FROM req r
WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.user_id = r.user_id AND v.event_type = r.event_type)""")
def q_cache_misses(spark, sf_dir):
    return K.cache_misses(_requests(spark, sf_dir), _cache(spark, sf_dir), KEYS, _as_of())


@query("cache_evict", f"""WITH {LAST_SQL}
SELECT user_id, event_type, strftime(w.ts, {DUCK_FMT}) AS ts, w.id AS write_id FROM last
ORDER BY w.ts DESC, user_id, event_type LIMIT 1000""")
def q_cache_evict(spark, sf_dir):
    kept = K.cache_evict(_upserted(table(spark, sf_dir, "events")), KEYS)
    return kept.select(*KEYS, F.date_format("ts", TS_FMT).alias("ts"), "write_id")


@query("dedupe_work", f"""WITH h AS (SELECT doc_id, sha256(text) AS hash, text FROM documents),
rep AS (SELECT hash, min(doc_id) AS rep_id FROM h GROUP BY hash),
lines AS (SELECT r.hash, unnest(string_split(h.text, chr(10))) AS line FROM rep r JOIN h ON h.doc_id = r.rep_id),
n AS (SELECT l.hash, count(*) AS n FROM lines l JOIN {RULES_SQL} r ON r.rlang = '*' AND regexp_matches(l.line, r.regex) GROUP BY l.hash)
SELECT h.doc_id, h.hash, rep.rep_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_findings
FROM h JOIN rep ON rep.hash = h.hash LEFT JOIN n ON n.hash = h.hash""")
def q_dedupe_work(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def work(reps):
        f = R.with_findings(reps.withColumn("_lang", F.lit("")), "text", "_lang")
        return f.select("_hash", "rep_id", F.size("findings").cast("bigint").alias("n_findings"))
    out = K.dedupe_work(docs, "doc_id", "text", work)
    return out.select("doc_id", F.col("_hash").alias("hash"), "rep_id", "n_findings")


TTL_SQL = """WITH RECURSIVE e AS (
    SELECT user_id, event_type, event_id, ts,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_type, rn, ts AS anchor, true AS kept FROM e WHERE rn = 1
      UNION ALL
      SELECT e.user_id, e.event_type, e.rn,
             CASE WHEN epoch_us(e.ts) - epoch_us(r.anchor) >= 86400000000 THEN e.ts ELSE r.anchor END,
             epoch_us(e.ts) - epoch_us(r.anchor) >= 86400000000
      FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT e.user_id, e.event_type, e.event_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn WHERE r.kept"""


@query("ttl_dedupe", TTL_SQL, kind="R")
def q_ttl_dedupe(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(*KEYS, "event_id", "ts")
    kept = K.ttl_dedupe(ev, KEYS, "ts", "event_id")
    return kept.select(*KEYS, "event_id", F.date_format("ts", TS_FMT).alias("ts"))
