"""DuckDB SQL for the queries that SQL can express."""

# of repeated rows of one id and text one stays; a null id is the smallest
OP2 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP6 = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$')
            AND starts_with(path, '/') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""

# the base counts of each document, then for every stratum, rule and cutoff an exact binomial test
OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT rid, i, words[i:i + 2] AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT rid, win FROM win GROUP BY rid, win HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT win.rid, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (rid, win)) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
m AS (
  SELECT *, [n_symbols / nullif(n_words, 0), n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0),
             n_upper / nullif(word_chars, 0), n_bangs / nullif(n_words, 0), word_chars / nullif(n_words * 20, 0)] AS ratios
  FROM c),
cuts AS (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0]::DOUBLE[]) AS cutoff),
tests AS (
  SELECT stratum, rule, cutoff, sum(quality) AS n_good,
    sum(CASE WHEN quality = 1 AND coalesce(ratios[rule], 0) > cutoff THEN 1 ELSE 0 END) AS lost,
    sum(CASE WHEN quality = 0 AND coalesce(ratios[rule], 0) > cutoff THEN 1 ELSE 0 END) AS caught
  FROM m JOIN labels USING (doc_id), range(1, 7) AS x(rule), cuts WHERE quality IN (0, 1) GROUP BY ALL),
tails AS (
  SELECT stratum, rule, cutoff, sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.05 / 6) + (n_good - i) * ln(1 - 0.05 / 6))) AS tail,
    any_value(caught) - 20 * any_value(lost) AS caught
  FROM (SELECT *, unnest(range(0, CAST(lost AS BIGINT) + 1)) AS i FROM tests WHERE n_good > 0 AND lost < 0.05 / 6 * n_good) GROUP BY ALL),
used AS (
  SELECT stratum, rule, max(cutoff) AS cutoff FROM tails
  WHERE tail <= 0.05 / (SELECT count(*) FROM tests) AND caught > 0
    AND (stratum, rule, caught) IN (SELECT (stratum, rule, max(caught)) FROM tails WHERE tail <= 0.05 / (SELECT count(*) FROM tests) GROUP BY stratum, rule)
  GROUP BY stratum, rule),
hit AS (
  SELECT rid, string_agg(['symbols', 'dup_lines', 'repeats', 'upper', 'bangs', 'word_length'][rule], ',' ORDER BY rule) AS names
  FROM m JOIN used USING (stratum) WHERE ratios[rule] > cutoff GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce(names, '') AS rejected_by,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND names IS NULL AS kept
FROM m LEFT JOIN hit USING (rid)
"""

SQL = {"op2_exact_dedup": OP2, "op6_url_filter": OP6, "op8_quality_rules": OP8}
