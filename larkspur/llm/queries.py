"""Registered queries of the pipeline operators, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, html_text, mixing, packing, quality, secrets, simhash, suffix_dedup, url_rules, wavelet


#: Hosts whose MD5 digest is lower count as listed: one in four.
LISTED = "4"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_lines(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.content_text(_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(_table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' labels say nothing about URLs, so a labelled page is bad too if its host is on a list: those whose digest is low."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1)
    known = pages.select(F.col("page_id").alias("doc_id"), (F.md5(host) < LISTED).alias("listed")).join(labels, "doc_id")
    return url_rules.judge_urls(pages, known.select("doc_id", F.when(F.col("listed"), 0).otherwise(F.col("quality")).alias("quality")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


_EXACT = """
SELECT doc_id, keep_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies
  FROM documents WHERE text IS NOT NULL
) WHERE copies > 1
"""


def _quality_sql() -> str:
    w = quality.WEIGHTS
    symbols = "".join("\\" + c for c in quality.SYMBOLS)
    ends = quality.ENDS.replace("'", "''")
    score = " + ".join(f"CASE WHEN {test} THEN {w[k]} ELSE 0 END" for k, test in {
        "bias": "true", "symbols_2pct": "sym * 50 >= size", "symbols_10pct": "sym * 10 >= size",
        "upper_half": "upper * 2 >= greatest(letters, 1)", "short_20": "size < 20", "short_40": "size < 40",
        "no_end": f"NOT (size > 0 AND contains('{ends}', right(line, 1)))",
        "repeats": "again * 4 >= greatest(many, 1)", "digits_20pct": "digits * 5 >= size",
    }.items())
    stay, start = quality.STAY, quality.START
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, i, x.line AS line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs) x
),
counted AS (
  SELECT rid, i, line, length(line) AS size,
    length(regexp_replace(line, '[\\t\\n\\x0b\\f\\r ]', '', 'g')) AS solid,
    length(regexp_replace(line, '[^a-zA-Z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS letters,
    length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper,
    length(regexp_replace(line, '[^0-9]', '', 'g')) AS digits,
    length(regexp_replace(line, '[^{symbols}]', '', 'g')) AS sym,
    len(ws) AS many, len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS again
  FROM (SELECT *, list_filter(string_split(line, ' '), lambda v: v <> '') AS ws FROM lines)
),
scored AS (SELECT rid, i, solid, CASE WHEN solid = 0 THEN 0 ELSE {score} END AS s FROM counted),
forward AS (
  SELECT rid, i, CAST(0 AS BIGINT) AS c, CAST({start} + s AS BIGINT) AS b, 0 AS from_c, 0 AS from_b FROM scored WHERE i = 1
  UNION ALL
  SELECT f.rid, s.i, CAST(greatest(f.c + {stay}, f.b) AS BIGINT), CAST(greatest(f.b + {stay}, f.c) + s.s AS BIGINT),
    CASE WHEN f.b > f.c + {stay} THEN 1 ELSE 0 END, CASE WHEN f.b + {stay} > f.c THEN 1 ELSE 0 END
  FROM forward f JOIN scored s ON s.rid = f.rid AND s.i = f.i + 1
),
backward AS (
  SELECT f.rid, f.i, CASE WHEN f.b > f.c THEN 1 ELSE 0 END AS state FROM forward f
  JOIN (SELECT rid, max(i) AS i FROM forward GROUP BY rid) e ON e.rid = f.rid AND e.i = f.i
  UNION ALL
  SELECT b.rid, b.i - 1, CASE WHEN b.state = 1 THEN f.from_b ELSE f.from_c END
  FROM backward b JOIN forward f ON f.rid = b.rid AND f.i = b.i WHERE b.i > 1
),
judged AS (
  SELECT b.rid, count(*) AS n_lines, sum(1 - state) AS content_lines, sum(solid) AS chars, sum(solid * (1 - state)) AS content_chars
  FROM backward b JOIN scored s ON s.rid = b.rid AND s.i = b.i GROUP BY b.rid
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(content_lines AS BIGINT) AS content_lines, CAST(chars AS BIGINT) AS chars,
  CAST(content_chars AS BIGINT) AS content_chars, chars > 0 AND content_chars * 1000 >= chars * {int(quality.MIN_SHARE * 1000)} AS keep
FROM judged JOIN docs USING (rid)
"""


def _mixing_sql() -> str:
    r, size = mixing.RESOLUTION, mixing.BLOCK_CHARS
    return f"""
WITH RECURSIVE flat AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, coalesce(length(text), 0) AS n FROM documents
),
totals AS (
  SELECT s, CAST(floor(sqrt(sum(n))) AS BIGINT) AS w, CAST(greatest(1, (sum(n) + {size - 1}) // {size}) AS BIGINT) AS many FROM flat GROUP BY s
),
listed AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS ws, list(many ORDER BY s) AS many, list(0::BIGINT ORDER BY s) AS zero FROM totals),
-- One row a slot, and one where an epoch begins (pick 0): parts of the sources with blocks left, then the earliest deadline of the released blocks.
slots AS (
  SELECT 0::BIGINT AS slot, 0::BIGINT AS t, names, ws, many, zero, many AS rest, zero AS qs, zero AS had, 0::BIGINT AS pick, true AS fresh FROM listed
  UNION ALL
  SELECT CASE WHEN go THEN slot + 1 ELSE slot END, CASE WHEN fresh THEN 0 WHEN go THEN t + 1 ELSE t END, names, ws, many, zero,
    CASE WHEN go THEN list_transform(range(1, k + 1), lambda j: rest[j] - CASE WHEN j = p THEN 1 ELSE 0 END) ELSE rest END,
    CASE WHEN fresh THEN list_transform(range(1, k + 1), lambda j: CASE WHEN rest[j] = 0 THEN 0
      ELSE base[j] + more // act + CASE WHEN len(list_filter(range(1, k + 1), lambda i: rest[i] > 0 AND (over[i] > over[j] OR over[i] = over[j] AND i < j))) < more % act THEN 1 ELSE 0 END END) ELSE qs END,
    CASE WHEN fresh THEN zero WHEN go THEN list_transform(range(1, k + 1), lambda j: had[j] + CASE WHEN j = p THEN 1 ELSE 0 END) ELSE had END,
    CASE WHEN go THEN p ELSE 0 END, NOT fresh AND NOT go
  FROM (
    SELECT *, {r} - list_sum(base) AS more, NOT fresh AND rest[p] > 0 AS go FROM (
      SELECT *, list_transform(range(1, k + 1), lambda j: CASE WHEN rest[j] = 0 THEN 0 ELSE 1 + ws[j] * ({r} - act) // total END) AS base,
        list_transform(range(1, k + 1), lambda j: CASE WHEN rest[j] = 0 THEN 0 ELSE ws[j] * ({r} - act) % total END) AS over FROM (
        SELECT *, CAST(len(names) AS BIGINT) AS k, len(list_filter(rest, lambda x: x > 0)) AS act,
          CAST(greatest(1, list_sum(list_transform(range(1, len(names) + 1), lambda j: CASE WHEN rest[j] > 0 THEN ws[j] ELSE 0 END))) AS BIGINT) AS total,
          list_min(list_transform(list_filter(range(1, len(names) + 1), lambda j: qs[j] > 0 AND had[j] * {r} // greatest(qs[j], 1) <= t),
            lambda j: ((had[j] + 1) * {r} + qs[j] - 1) // qs[j] * 1000000 + j)) % 1000000 AS p
        FROM slots WHERE list_sum(rest) > 0
      )
    )
  )
),
picks AS (SELECT names[pick] AS s, slot - 1 AS slot, many[pick] - rest[pick] - 1 AS block FROM slots WHERE pick > 0),
placed AS (
  SELECT doc_id, source, s, coalesce(sum(n) OVER (PARTITION BY s ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM flat
),
cut AS (SELECT doc_id, source, s, CAST(least(before // {size}, many - 1) AS BIGINT) AS block FROM placed JOIN totals USING (s))
SELECT doc_id, source, block, slot FROM cut JOIN picks USING (s, block)
"""


def _url_sql() -> str:
    u = url_rules
    return f"""
WITH flat AS (
  SELECT page_id, url, list_sort(list_distinct(list_transform(
    list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', ''), '[^a-z0-9\\-]+'), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '#' ELSE t END))) AS tokens
  FROM pages
),
known AS (
  SELECT row_number() OVER () AS rid, tokens, bad FROM flat
  JOIN (SELECT doc_id, min(CASE WHEN listed THEN 0 ELSE quality END) = 0 AS bad
    FROM labels JOIN (SELECT page_id AS doc_id, md5(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1)) < '{LISTED}' AS listed FROM pages) USING (doc_id)
    WHERE listed OR quality IS NOT NULL GROUP BY doc_id) l ON l.doc_id = flat.page_id
),
bound AS (SELECT greatest(ceil({u.MIN_SUPPORT} * count(*)), {u.MIN_COUNT}) AS least FROM known),
item AS (SELECT rid, bad, unnest(tokens) AS t FROM known),
often AS (SELECT t FROM item GROUP BY t HAVING count(*) FILTER (bad) >= (SELECT least FROM bound)),
kept AS (SELECT rid, bad, t FROM item SEMI JOIN often USING (t)),
found AS (
  SELECT [t] AS rule, count(*) AS seen, count(*) FILTER (bad) AS bad FROM kept GROUP BY ALL
  UNION ALL SELECT [a.t, b.t], count(*), count(*) FILTER (a.bad) FROM kept a JOIN kept b ON a.rid = b.rid AND a.t < b.t GROUP BY a.t, b.t
  UNION ALL SELECT [a.t, b.t, c.t], count(*), count(*) FILTER (a.bad) FROM kept a JOIN kept b ON a.rid = b.rid AND a.t < b.t
    JOIN kept c ON b.rid = c.rid AND b.t < c.t GROUP BY a.t, b.t, c.t
),
rules AS (
  SELECT rule, bad * 1000 // seen AS confidence FROM found WHERE bad >= (SELECT least FROM bound) AND bad * 1000 >= seen * {u.MIN_CONFIDENCE}
),
pruned AS (
  SELECT * FROM rules m WHERE NOT EXISTS (
    SELECT 1 FROM rules f WHERE len(f.rule) < len(m.rule) AND list_has_all(m.rule, f.rule) AND f.confidence >= m.confidence
  )
),
hits AS (
  SELECT url, count(*) AS n_rules, max(confidence) AS confidence
  FROM (SELECT DISTINCT url, tokens FROM flat) f JOIN pruned p ON list_has_all(f.tokens, p.rule) GROUP BY url
)
SELECT page_id, url, coalesce(n_rules, 0) AS n_rules, coalesce(confidence, 0) AS confidence, n_rules IS NOT NULL AS drop
FROM flat LEFT JOIN hits USING (url)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _quality_sql(), "op2_exact_dedup": _EXACT, "op4_source_mixing": _mixing_sql(), "op10_url_rules": _url_sql()}
