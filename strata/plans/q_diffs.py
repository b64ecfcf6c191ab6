"""Queries: near-copy pairs, diff statistics, diff texts, snapshot comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffs as D
from ..sources.tables import table
from .catalog import query
from .sqlparts import l1, pystrip

PAIRS_SQL = f"""h AS (SELECT doc_id, sha256(text) AS th, text FROM documents),
rep AS (SELECT min(doc_id) AS id FROM h GROUP BY th),
rt AS (SELECT h.doc_id AS id, h.text FROM h JOIN rep ON rep.id = h.doc_id),
rl AS (SELECT id, unnest({l1('text')}) AS line FROM rt),
tl AS (SELECT DISTINCT id, sha256({pystrip('line')}) AS tok FROM rl WHERE length({pystrip('line')}) >= 1),
tn AS (SELECT id, count(*) AS n FROM tl GROUP BY id),
tc AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n_common FROM tl a JOIN tl b ON a.tok = b.tok AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT tc.id_a, tc.id_b, CAST(na.n AS INTEGER) AS n_a, CAST(nb.n AS INTEGER) AS n_b, CAST(tc.n_common AS INTEGER) AS n_common
          FROM tc JOIN tn na ON na.id = tc.id_a JOIN tn nb ON nb.id = tc.id_b
          WHERE tc.n_common * 2 >= na.n + nb.n - tc.n_common)"""


def _pairs(spark, sf_dir):
    return D.near_copy_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("near_copy_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def q_near_copy_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("near_copy_members", """SELECT d.doc_id, (SELECT min(o.doc_id) FROM documents o WHERE o.text IS NOT DISTINCT FROM d.text) AS rep_id
FROM documents d""")
def q_near_copy_members(spark, sf_dir):
    """Which representative of ``near_copy_pairs`` and ``diff_stats`` stands for each document."""
    return D.copy_members(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("diff_stats", f"""WITH {PAIRS_SQL},
lc AS (SELECT doc_id AS id, line, count(*) AS c FROM (SELECT doc_id, unnest({l1('text')}) AS line FROM documents) GROUP BY ALL),
pa AS (SELECT p.id_a, p.id_b, lc.line, lc.c AS ca FROM pairs p JOIN lc ON lc.id = p.id_a),
pb AS (SELECT p.id_a, p.id_b, lc.line, lc.c AS cb FROM pairs p JOIN lc ON lc.id = p.id_b),
j AS (SELECT coalesce(pa.id_a, pb.id_a) AS id_a, coalesce(pa.id_b, pb.id_b) AS id_b, coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb
      FROM pa FULL OUTER JOIN pb ON pa.id_a = pb.id_a AND pa.id_b = pb.id_b AND pa.line = pb.line)
SELECT id_a, id_b, CAST(sum(least(ca, cb)) AS BIGINT) AS n_kept, CAST(sum(ca - least(ca, cb)) AS BIGINT) AS n_removed,
       CAST(sum(cb - least(ca, cb)) AS BIGINT) AS n_added FROM j GROUP BY id_a, id_b""")
def q_diff_stats(spark, sf_dir):
    return D.diff_stats(_pairs(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text")


SNAP_SQL = """WITH b AS (SELECT min(ts) AS lo, date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) AS cut FROM events),
ev AS (SELECT user_id, ts < (SELECT cut FROM b) AS is_old,
        CAST(date_diff('day', CAST(CASE WHEN ts < (SELECT cut FROM b) THEN (SELECT lo FROM b) ELSE (SELECT cut FROM b) END AS DATE), CAST(ts AS DATE)) AS INTEGER) AS day_no,
        CAST(hour(ts) AS INTEGER) AS hr, event_type AS item FROM events),
old AS (SELECT * FROM ev WHERE is_old), new AS (SELECT * FROM ev WHERE NOT is_old),
lst AS (SELECT user_id, day_no, max(hr) AS lh FROM old GROUP BY ALL),
ol AS (SELECT o.user_id, o.day_no, o.item FROM old o JOIN lst l ON l.user_id = o.user_id AND l.day_no = o.day_no WHERE o.hr = l.lh),
nr AS (SELECT DISTINCT user_id, day_no, hr FROM new),
ad AS (SELECT n.user_id, n.day_no, n.hr, count(*) AS n, string_agg(DISTINCT n.item, ',' ORDER BY n.item) AS s FROM new n
       WHERE NOT EXISTS (SELECT 1 FROM ol WHERE ol.user_id = n.user_id AND ol.day_no = n.day_no AND ol.item = n.item) GROUP BY ALL),
rm AS (SELECT r.user_id, r.day_no, r.hr, count(*) AS n, string_agg(DISTINCT ol.item, ',' ORDER BY ol.item) AS s
       FROM ol JOIN nr r ON r.user_id = ol.user_id AND r.day_no = ol.day_no
       WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.user_id = r.user_id AND n.day_no = r.day_no AND n.hr = r.hr AND n.item = ol.item)
       GROUP BY ALL)
SELECT nr.user_id, nr.day_no, nr.hr AS hour, CAST(coalesce(ad.n, 0) AS BIGINT) AS n_added, coalesce(ad.s, '') AS added,
       CAST(coalesce(rm.n, 0) AS BIGINT) AS n_removed, coalesce(rm.s, '') AS removed
FROM nr LEFT JOIN ad ON ad.user_id = nr.user_id AND ad.day_no = nr.day_no AND ad.hr = nr.hr
        LEFT JOIN rm ON rm.user_id = nr.user_id AND rm.day_no = nr.day_no AND rm.hr = nr.hr"""


@query("compare_snapshots", SNAP_SQL)
def q_compare_snapshots(spark, sf_dir):
    """The later half of the events' time against the earlier one; days count from the first event and from the cut, a midnight."""
    ev = table(spark, sf_dir, "events")
    lo = ev.agg(F.min("ts")).scalar()
    cut = ev.agg(F.date_trunc("DAY", F.min("ts") + (F.max("ts") - F.min("ts")) / 2)).scalar()
    timed = ev.select("user_id", "ts", lo.alias("lo"), cut.alias("cut"), "event_type")
    is_old = F.col("ts") < F.col("cut")
    items = timed.select("user_id", is_old.alias("is_old"),
                         F.datediff(F.col("ts").cast("date"), F.when(is_old, F.col("lo")).otherwise(F.col("cut")).cast("date")).alias("day_no"),
                         F.hour("ts").alias("hour"), F.col("event_type").alias("item"))
    old = items.filter("is_old").drop("is_old")
    new = items.filter(~F.col("is_old")).drop("is_old")
    return D.compare_snapshots(old, new, ["user_id", "day_no"], "hour", "item")
