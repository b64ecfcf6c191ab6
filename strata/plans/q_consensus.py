"""Queries: consensus of several verdicts per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import SEVERITY_BUCKETS
from ..operators import consensus as A
from ..sources.tables import table
from .catalog import query
from .sqlparts import values

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def votes(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    cwe = (F.when(et == "error", F.concat(F.lit("CWE-"), (20 + k % 3).cast("string")))
           .when(et == "purchase", F.lit("")).when(et == "view", F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("CWE-"), (78 + k % 2).cast("string"))))
    risk = F.when(et == "signup", F.lit(None).cast("double")).otherwise(F.floor(F.col("value") / 5) / 10)
    fix = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 5 == 0, F.lit("")).otherwise(et)
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col("ts"))
    return ev.select("user_id", micros.alias("t_us"), "event_id", (F.col("value") >= 10).alias("flag"),
                     cwe.alias("cwe"), risk.alias("risk"), fix.alias("fix"))


VOTES_SQL = """v AS (SELECT user_id, ts, event_id, value >= 10 AS flag,
    CASE event_type WHEN 'error' THEN 'CWE-' || CAST(20 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS VARCHAR)
                    WHEN 'purchase' THEN '' WHEN 'view' THEN NULL
                    ELSE 'CWE-' || CAST(78 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS VARCHAR) END AS cwe,
    CASE WHEN event_type = 'signup' THEN NULL ELSE floor(value / 5) / 10 END AS risk,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 = 0 THEN NULL
         WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 0 THEN '' ELSE event_type END AS fix
  FROM events)"""


@query("consensus", f"""WITH {VOTES_SQL},
base AS (SELECT user_id, count(*) AS n, avg(CASE WHEN coalesce(flag, false) THEN 1 ELSE 0 END) >= 0.7 AS vul,
                list_sort(list(coalesce(risk, 0.0))) AS risks FROM v GROUP BY user_id),
cc AS (SELECT user_id, cwe, count(*) AS c, min(ts) AS ft, arg_min(event_id, (ts, event_id)) AS fe FROM v
       WHERE cwe IS NOT NULL AND cwe <> '' GROUP BY user_id, cwe),
cw AS (SELECT user_id, cwe FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, ft, fe) AS rn
       FROM cc) WHERE rn = 1),
fx AS (SELECT user_id, f, count(*) AS c, min(ts) AS ft, arg_min(event_id, (ts, event_id)) AS fe
       FROM (SELECT user_id, coalesce(fix, '') AS f, ts, event_id FROM v) GROUP BY user_id, f),
fw AS (SELECT user_id, f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, ft, fe) AS rn FROM fx) WHERE rn = 1),
c1 AS (SELECT user_id, max(c) AS m FROM (SELECT user_id, cwe, count(*) AS c FROM v GROUP BY user_id, cwe) GROUP BY user_id),
c2 AS (SELECT user_id, max(c) AS m FROM (SELECT user_id, fix, count(*) AS c FROM v GROUP BY user_id, fix) GROUP BY user_id)
SELECT b.user_id, CAST(b.n AS BIGINT) AS n_votes, b.vul AS is_vulnerability, cw.cwe, b.risks[b.n // 2 + 1] AS risk_level,
       fw.f AS fix_code, round(least(c1.m, c2.m) / b.n, 6) AS confidence
FROM base b LEFT JOIN cw USING (user_id) LEFT JOIN fw USING (user_id) JOIN c1 USING (user_id) JOIN c2 USING (user_id)""")
def q_consensus(spark, sf_dir):
    v = votes(spark, sf_dir)
    return A.consensus(v, ["user_id"], [F.col("t_us"), F.col("event_id")])


@query("consensus_missing", """SELECT c_custkey AS user_id, 'No valid analyses available' AS error FROM customer
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = customer.c_custkey)""")
def q_consensus_missing(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return A.consensus_missing(groups, table(spark, sf_dir, "events"), ["user_id"])


BUCKETS_SQL = values(SEVERITY_BUCKETS, ["bucket", "lo", "hi"])


@query("severity_histogram", f"""WITH r AS (SELECT floor(value / 2.5) / 20 AS risk FROM events)
SELECT b.bucket AS severity_bucket, CAST(count(*) AS BIGINT) AS n_events, min(r.risk) AS min_risk, max(r.risk) AS max_risk
FROM r LEFT JOIN {BUCKETS_SQL} b ON r.risk BETWEEN b.lo AND b.hi GROUP BY b.bucket""")
def q_severity_histogram(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.floor(F.col("value") / 2.5) / 20).alias("risk"))
    return (ev.withColumn("severity_bucket", A.severity_bucket("risk")).groupBy("severity_bucket")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_events"), F.min("risk").alias("min_risk"),
                 F.max("risk").alias("max_risk")))
