"""SQL that says what operators must return, where SQL can: it compares every window and every histogram plainly."""

from __future__ import annotations

from mudlark.llm import quality

SUFFIX = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), n AS (
  SELECT *, CAST(length(h) / 2 AS BIGINT) AS n_bytes FROM d
), parts AS (
  SELECT r, c, n_bytes, substring(h, 2 * c + 1, 2 * (1024 + 399)) AS part FROM (SELECT r, h, n_bytes, unnest(range(0, greatest(n_bytes - 399, 0), 1024)) AS c FROM n)
), w AS (
  SELECT r, c, part, unnest(range(0, least(1024, n_bytes - 399 - c))) AS j FROM parts
), m AS (
  SELECT r, c + j AS k, md5(substring(part, 2 * j + 1, 800)) AS m FROM w
), s AS (
  SELECT r, k FROM m WHERE m IN (SELECT m FROM m GROUP BY m HAVING count(*) > 1)
), o AS (
  SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 400 THEN 0 ELSE 1 END AS opens FROM s
), i AS (
  SELECT r, k, sum(opens) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM o
), p AS (
  SELECT r, island, min(k) AS a, max(k) + 400 AS b FROM i GROUP BY r, island
), g AS (
  SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS x, a AS y FROM p
  UNION ALL SELECT r, max(b), max(n_bytes) FROM p JOIN n USING (r) GROUP BY r
), kept AS (
  SELECT r, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kh FROM g JOIN n USING (r) GROUP BY r
), totals AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY r
), ww AS (
  SELECT r, ws, unnest(range(0, greatest(len(ws) - 50, 0))) AS k FROM n
), wm AS (
  SELECT r, k, md5(array_to_string(ws[k + 1 : k + 51], ' ')) AS m FROM ww
), wr AS (
  SELECT r, k, coalesce(lag(k) OVER (PARTITION BY r ORDER BY k), -51) AS before FROM wm WHERE m IN (SELECT m FROM wm GROUP BY m HAVING count(*) > 1)
), words AS (
  SELECT r, sum(least(51, k - before)) AS n_passage_words FROM wr GROUP BY r
)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kh, h))) AS kept_sha256, CAST(coalesce(n_passage_words, 0) AS BIGINT) AS n_passage_words
FROM n LEFT JOIN totals USING (r) LEFT JOIN kept USING (r) LEFT JOIN words USING (r)
"""


def words(texts) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


def quality_sql(char_limit: float = 0.25, char_least: int = 200, word_least: int = 75) -> str:
    """All of op6: the count rules, both histograms, the references and the verdict."""
    classes = [p.replace("'", "''") for p in quality.CLASSES.values()]
    counts = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))" for p in classes)
    n, m = len(quality.CLASSES) + 1, len(quality.COMMON) + 1

    def distance(p: str, q: str) -> str:
        part = lambda i: f"(CASE WHEN {p}[{i}] > 0 THEN {p}[{i}] * log2(2 * {p}[{i}] / ({p}[{i}] + {q}[{i}])) ELSE 0.0 END + CASE WHEN {q}[{i}] > 0 THEN {q}[{i}] * log2(2 * {q}[{i}] / ({p}[{i}] + {q}[{i}])) ELSE 0.0 END)"
        return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({q}) + 1), lambda i: {part('i')})) / 2))"

    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({words(quality.LANGUAGES)[1:-1]}) THEN lang END AS lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), u AS (
  SELECT r, unnest(range(0, greatest(len(ws) - 2, 0))) AS k, ws FROM t
), v AS (
  SELECT r, k, array_to_string(ws[k + 1 : k + 3], ' ') AS x FROM u
), c AS (
  SELECT r, k, coalesce(lag(k) OVER (PARTITION BY r ORDER BY k), -3) AS before FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS times FROM v) WHERE times > 1
), reps AS (
  SELECT r, sum(least(3, k - before)) AS n_repeat_words FROM c GROUP BY r
), b AS (
  SELECT t.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         [{counts}] AS kinds, list_transform(ws, lambda x: lower(x)) AS lows
  FROM t LEFT JOIN reps USING (r)
), h AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         list_append(kinds, length(t) - list_sum(kinds)) AS chars,
         list_filter(lows, lambda x: list_contains({words(quality.COMMON)}, x)) AS known
  FROM b
), f AS (
  SELECT *, list_append(list_transform({words(quality.COMMON)}, lambda x: len(list_filter(known, lambda y: y = x))), n_words - len(known)) AS commons FROM h
), cells AS (
  SELECT lang, 'chars' AS name, unnest(range(1, {n + 1})) AS i, unnest(chars) AS x FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, 'commons', unnest(range(1, {m + 1})), unnest(commons) FROM f WHERE NOT base_failed
), pooled AS (
  SELECT name, list(x / whole ORDER BY i) AS q FROM (SELECT name, i, sum(x) AS x, sum(sum(x)) OVER (PARTITION BY name) AS whole FROM cells GROUP BY name, i) GROUP BY name
), own AS (
  SELECT lang, name, list(x / whole ORDER BY i) AS q FROM (SELECT lang, name, i, sum(x) AS x, sum(sum(x)) OVER (PARTITION BY lang, name) AS whole FROM cells WHERE lang IS NOT NULL GROUP BY lang, name, i) WHERE whole > 0 GROUP BY lang, name
), g AS (
  SELECT f.*, coalesce(oc.q, pc.q, list_transform(range(0, {n}), lambda i: 1.0 / {n})) AS qc, coalesce(ow.q, pw.q, list_transform(range(0, {m}), lambda i: 1.0 / {m})) AS qw,
         CASE WHEN length(t) > 0 THEN list_transform(chars, lambda x: x / length(t)) END AS pc_, CASE WHEN n_words > 0 THEN list_transform(commons, lambda x: x / n_words) END AS pw_,
         list_append(list_transform(range(0, {m - 1}), lambda i: 0.0), 1.0) AS none
  FROM f LEFT JOIN own oc ON oc.lang = f.lang AND oc.name = 'chars' LEFT JOIN own ow ON ow.lang = f.lang AND ow.name = 'commons'
         LEFT JOIN pooled pc ON pc.name = 'chars' LEFT JOIN pooled pw ON pw.name = 'commons'
), j AS (
  SELECT *, {distance("pc_", "qc")} AS dc, {distance("pw_", "qw")} AS dw, {distance("none", "qw")} AS top FROM g
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(word_chars >= {char_least} AND dc > {char_limit}, false)
       AND NOT coalesce(n_words >= {word_least} AND 1 - qw[{m}] >= {quality.COMMON_LEAST} AND dw > top * (0.75 + 0.25 * sqrt({word_least}.0 / greatest(n_words, 1))), false) AS kept,
       CAST(round(dc, 4) AS DOUBLE) AS char_distance, CAST(round(dw, 4) AS DOUBLE) AS word_distance
FROM j
"""
