"""All registered queries of the engine's own operators over whole tables, with their SQL.

Names begin with the operator's number in the survey. Queries without SQL are
iterative or random and are tested by their invariants.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text, vectors
from larkspur.operators import batches, decompose, evaluate, images, learn, ngrams, numbering, sparse, terms
from larkspur.operators.lineage import cut, scratch_path
from larkspur import apps
from larkspur.plans import nodes
from larkspur.plans import pipeline as P
from larkspur.plans.nodes import padded_fft
from larkspur.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(c: str = "text") -> Column:
    return text.tokenize(text.lower(text.trim(F.col(c))))


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").withColumn("w", words())


def talk(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").withColumn("w", words())


def vecs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label", vectors.to_double(F.col("embedding")).alias("v"))


def flat(df: DataFrame, v: Column, name: str = "x", digits: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode(v).alias("i", "y")).select("vec_id", "i", (F.round("y", digits) + 0.0).alias(name))


def wide(spark: SparkSession, m: np.ndarray, *names: str) -> DataFrame:
    """A small matrix as rows (row, col, value)."""
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], f"{names[0]} int, {names[1]} int, {names[2]} double")


_SEP = r"[!-/:-@\[-`{-~ \t\n\x0B\f\r]+"
_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _tok(of: str, cols: str) -> str:
    return f"""tok AS (
  SELECT {cols}, CASE WHEN t = '' THEN [''] ELSE list_slice(a, 1, coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: a[i] <> '')), 0)) END AS w
  FROM (SELECT {cols}, t, regexp_split_to_array(t, '{_SEP}') AS a FROM (SELECT {cols}, lower(regexp_replace(text, '{_TRIM}', '', 'g')) AS t FROM {of}))
)"""


_DOCS, _TALK = _tok("documents", "doc_id, lang"), _tok("conversations", "conv_id, turn")
_EACH = "SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos, lang FROM tok"
_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_FLAT = f"WITH {_VEC}, f AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM v)"

# ---- text and n-grams


@query(f"WITH {_DOCS} SELECT doc_id, CAST(pos AS INT) AS pos, term AS token FROM ({_EACH})")
def n1_n2_n3_tokens(s, d):
    return docs(s, d).select("doc_id", F.posexplode_outer("w").alias("pos", "token")).where("token IS NOT NULL")


@query(f"""WITH {_DOCS}, g AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS ngram FROM tok, (SELECT unnest([1, 2]) AS n))
SELECT doc_id, CAST(n AS INT) AS n, ngram, count(*) AS cnt FROM g GROUP BY doc_id, n, ngram""")
def n4_ngrams(s, d):
    return terms.gram_counts(table(s, d, "documents"), "doc_id", "text", 1, 2)


@query(f"""WITH {_DOCS}, g AS (
  SELECT unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS ngram FROM tok)
SELECT ngram, count(*) AS cnt FROM g GROUP BY ngram ORDER BY cnt DESC, ngram LIMIT 100""")
def n5_p16_ngram_counts_top(s, d):
    return terms.all_grams(table(s, d, "documents"), "text", 2).orderBy(F.desc("cnt"), "ngram").limit(100)


@query(f"""WITH {_DOCS} SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS weight, round(ln(1 + count(*)), 6) AS log_weight, CAST(1 AS DOUBLE) AS presence
FROM ({_EACH}) GROUP BY doc_id, term""")
def n7_term_frequency(s, d):
    return terms.frequency(table(s, d, "documents"), "doc_id", "text").withColumn("weight", F.col("n").cast("double")).select(
        "doc_id", "term", "weight", F.round(F.log1p("weight"), 6).alias("log_weight"), F.lit(1.0).alias("presence")
    )


_RANKS = "r AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS idx FROM {} GROUP BY term)"


@query(f"""WITH {_DOCS}, e AS ({_EACH}), {_RANKS.format("(SELECT term FROM e WHERE lang = 'en')")}
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(coalesce(idx, -1) AS INT) AS idx FROM e LEFT JOIN r USING (term)""")
def n10_word_frequency_encode(s, d):
    t = table(s, d, "documents").withColumn("own", F.coalesce(F.col("lang") == "en", F.lit(False)))
    counts = cut(terms.word_counts(t, "own", "text"))
    ranks = cut(ngrams.ranked(counts.where("count > 0").select("word", "count")).select("word", "idx"))
    most = counts.orderBy(F.desc("all")).limit(terms.COMMON).join(ranks, "word", "left").select("word", F.coalesce("idx", F.lit(-1)).alias("idx"))
    return terms.encode(t, "doc_id", "text", [tuple(r) for r in most.collect()], ranks)


_LM = f"""{_TALK}, uni AS (SELECT term, count(*) AS c FROM (SELECT unnest(w) AS term FROM tok) GROUP BY term),
spots AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM tok),
many AS (SELECT n, CASE n WHEN 1 THEN w[i] WHEN 2 THEN w[i] || ' ' || w[i + 1] ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g,
  CASE n WHEN 2 THEN w[i] WHEN 3 THEN w[i] || ' ' || w[i + 1] END AS ctx FROM spots, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)),
grams AS (SELECT n, g, ctx, count(*) AS c FROM many GROUP BY n, g, ctx),
scores AS (SELECT a.n, a.g, a.c / CAST(b.c AS DOUBLE) AS score FROM grams a JOIN grams b ON b.n = a.n - 1 AND b.g = a.ctx WHERE a.n > 1)"""


def _model(s, d):
    w = talk(s, d)
    uni = w.select(F.explode_outer("w").alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("count"))
    return ngrams.backoff_scores(ngrams.counts(w, text.ngrams(F.col("w"), 2, 3)), uni), uni


@query(f"WITH {_LM} SELECT g AS ngram, round(score, 9) AS score FROM scores")
def n15_stupid_backoff_scores(s, d):
    return _model(s, d)[0].select(F.array_join("ngram", " ").alias("ngram"), F.round("score", 9).alias("score"))


@query(f"""WITH {_LM}, {_tok("benchmark", "item_id").replace("tok AS", "b AS", 1)},
q AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g3, w[i + 1] || ' ' || w[i + 2] AS g2, w[i + 2] AS g1 FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM b)),
known AS (SELECT n, g, score FROM scores UNION ALL SELECT 1, term, c / CAST((SELECT sum(c) FROM uni) AS DOUBLE) FROM uni)
SELECT q.g3 AS ngram, round(coalesce(k3.score, k2.score * 0.4, k1.score * 0.4 * 0.4, 0), 9) AS score
FROM q LEFT JOIN known k3 ON k3.n = 3 AND k3.g = q.g3 LEFT JOIN known k2 ON k2.n = 2 AND k2.g = q.g2 LEFT JOIN known k1 ON k1.n = 1 AND k1.g = q.g1""")
def n16_stupid_backoff_query(s, d):
    scores, uni = _model(s, d)
    asked = table(s, d, "benchmark").select(F.explode(text.ngrams(words(), 3, 3)).alias("ngram"))
    return ngrams.backoff_query(asked, scores, uni, 3).select(F.array_join("ngram", " ").alias("ngram"), F.round("score", 9).alias("score"))


@query(f"""WITH {_TALK}, {_RANKS.format("(SELECT unnest(w) AS term FROM tok)")},
e AS (SELECT conv_id, turn, pos, idx FROM (SELECT conv_id, turn, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM tok) JOIN r USING (term)),
g AS (SELECT idx AS a, lead(idx) OVER w AS b, lead(idx, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT (2::BIGINT << 60) | (a << 40) | (b << 20) | c AS packed, CAST(a AS INT) AS first_word, CAST(c AS INT) AS last_word, 3 AS n,
  (1::BIGINT << 60) | (b << 40) | (c << 20) AS no_first, (1::BIGINT << 60) | (a << 40) | (b << 20) AS no_last, count(*) AS cnt
FROM g WHERE c IS NOT NULL GROUP BY a, b, c""")
def n12_bitpack_ngrams(s, d):
    w = talk(s, d)
    key = F.struct("conv_id", "turn")
    coded = ngrams.encode(w.withColumn("k", key), "k", F.col("w"), ngrams.word_ranks(w, F.col("w")))
    seq = coded.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("s")).select(F.transform("s", lambda p: p["idx"]).alias("s"))
    packed = seq.select(F.explode(text.ngrams(F.col("s").cast("array<string>"), 3, 3)).alias("g")).groupBy(text.pack_ngram(F.col("g").cast("array<bigint>")).alias("packed")).agg(F.count("*").alias("cnt"))
    p = F.col("packed")
    return packed.select(
        "packed", text.unpack_word(p, 0).alias("first_word"), text.unpack_word(p, 2).alias("last_word"), text.ngram_order(p).alias("n"),
        text.remove_farthest_word(p).alias("no_first"), text.remove_current_word(p).alias("no_last"), "cnt",
    )


@query(f"""WITH {_DOCS}, e AS ({_EACH}), h AS (SELECT term, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(term) + 1),
  lambda i: CAST(unicode(substr(term, i, 1)) AS BIGINT))), lambda a, b: (a * 31 + b) & 4294967295) AS h FROM (SELECT DISTINCT term FROM e)),
b AS (SELECT term, CAST((((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 4096) + 4096) % 4096 AS INT) AS bucket FROM (SELECT term, CASE WHEN term = '' THEN 0 ELSE h END AS h FROM h))
SELECT doc_id, bucket, count(*) AS cnt FROM e JOIN b USING (term) GROUP BY doc_id, bucket""")
def n8_hashing_tf(s, d):
    return terms.hashed_counts(table(s, d, "documents"), "doc_id", "text", 4096)


_M = 4294967295


def _rot(x: str, r: int) -> str:
    return f"((({x}) << {r}) & {_M} | (({x}) >> {32 - r}))"


def _step(h: str, k: str) -> str:
    """A round of 32-bit murmur in unsigned whole numbers."""
    return f"({_rot(f'xor({h}, {k})', 13)} * 5 + 3864292196) & {_M}"


_N9 = f"""WITH {_DOCS}, e AS ({_EACH}), h AS (SELECT term, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(term) + 1),
  lambda i: CAST(unicode(substr(term, i, 1)) AS BIGINT))), lambda a, b: (a * 31 + b) & {_M}) AS h FROM (SELECT DISTINCT term FROM e)),
k AS (SELECT term, CAST(({_rot(f"(x * 3432918353) & {_M}", 15)} * 461845907) & {_M} AS UBIGINT) AS k FROM (SELECT term, CAST(CASE WHEN term = '' THEN 0 ELSE h END AS UBIGINT) AS x FROM h)),
t AS (SELECT doc_id, k AS ka, lead(k) OVER w AS kb, lead(k, 2) OVER w AS kc FROM e JOIN k USING (term) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h1 AS (SELECT *, CAST({_step("83007::UBIGINT", "ka")} AS UBIGINT) AS h1 FROM t), h2 AS (SELECT *, CAST({_step("h1", "kb")} AS UBIGINT) AS h2 FROM h1),
h3 AS (SELECT *, CAST({_step("h2", "kc")} AS UBIGINT) AS h3 FROM h2),
o AS (SELECT doc_id, xor(h1, 1::UBIGINT) AS f FROM h3 UNION ALL SELECT doc_id, xor(h2, 2::UBIGINT) FROM h3 WHERE h2 IS NOT NULL UNION ALL SELECT doc_id, xor(h3, 3::UBIGINT) FROM h3 WHERE h3 IS NOT NULL),
a AS (SELECT doc_id, (xor(f, f >> 16) * 2246822507) & {_M} AS f FROM o), b AS (SELECT doc_id, (xor(f, f >> 13) * 3266489909) & {_M} AS f FROM a)
SELECT doc_id, CAST(xor(f, f >> 16) & 65535 AS INT) AS bucket, count(*) AS cnt FROM b GROUP BY ALL"""


@query(_N9)
def n9_ngrams_hashing_tf(s, d):
    return terms.hashed_counts(table(s, d, "documents"), "doc_id", "text", 1 << 16, 1, 3, rolled=True)


@query(f"""WITH {_TALK}, spots AS (SELECT w, unnest(range(1, len(w))) AS i FROM tok) SELECT w[i] || ' ' || w[i + 1] AS ngram, count(*) AS cnt FROM spots GROUP BY ALL""")
def n5_n14_counts_by_partition(s, d):
    """Counts of each partition alone, laid together by their first two words and added."""
    c = ngrams.counts(talk(s, d), text.ngrams(F.col("w"), 2, 2), add=False)
    c = numbering.partition_by(c, ngrams.initial_bigram_partition(F.col("ngram"), 8), 8)
    return c.groupBy(F.array_join("ngram", " ").alias("ngram")).agg(F.sum("count").alias("cnt"))


@query(f"""WITH {_TALK}, spots AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM tok))
SELECT a || ' ' || b || ' ' || c AS ngram, c AS last, a || ' ' || b AS context, b || ' ' || c AS backoff FROM spots""")
def n13_ngram_indexer(s, d):
    g = talk(s, d).select(F.explode_outer(text.ngrams(F.col("w"), 3, 3)).alias("g")).where("g IS NOT NULL").distinct()
    g = F.col("g"), g
    return g[1].select(F.array_join(g[0], " ").alias("ngram"), ngrams.word_at(g[0], 2).alias("last"), F.array_join(ngrams.context(g[0]), " ").alias("context"), F.array_join(ngrams.backoff(g[0]), " ").alias("backoff"))


# ---- sparse features

_SEEN = f"e AS ({_EACH}), seen AS (SELECT term, count(*) AS c, min(doc_id * 1000000 + pos) AS first FROM e GROUP BY term)"


@query(f"WITH {_DOCS}, {_SEEN} SELECT term, CAST(row_number() OVER (ORDER BY first, term) - 1 AS INT) AS idx FROM seen")
def f1_all_sparse_features(s, d):
    return sparse.in_order(terms.seen(table(s, d, "documents"), "doc_id", "text"))


_COMMON = f"WITH {_DOCS}, {_SEEN}, sp AS (SELECT term, CAST(row_number() OVER (ORDER BY c DESC, first DESC, term) - 1 AS INT) AS idx FROM seen)"


@query(f"{_COMMON} SELECT term, idx FROM sp WHERE idx < 1000")
def f2_common_sparse_features(s, d):
    return sparse.most_common(terms.seen(table(s, d, "documents"), "doc_id", "text"), 1000)


@query(f"{_COMMON} SELECT doc_id, idx, CAST(count(*) AS DOUBLE) AS val FROM e JOIN sp USING (term) WHERE idx < 1000 GROUP BY doc_id, idx")
def f3_sparse_vectorize(s, d):
    t = table(s, d, "documents")
    space = terms.most_common(t, "doc_id", "text", 1000)
    return terms.in_space(t, "doc_id", "text", space).select("doc_id", "idx", F.col("n").cast("double").alias("val"))


@query(f"{_FLAT} SELECT vec_id, CAST(i AS INT) AS i, round(x, 6) AS x FROM f WHERE x <> 0 AND i % 2 = 0")
def f4_f5_sparsify_densify(s, d):
    half = F.transform(F.col("v"), lambda x, i: F.when(i % 2 == 0, x).otherwise(0.0))
    back = vectors.densify(vectors.sparsify(half))
    # Zeros go before the rest is rounded: what rounds to 0 stays.
    entries = vecs(s, d).select("vec_id", F.posexplode(back).alias("i", "x")).where("x <> 0")
    return entries.withColumn("x", F.round("x", 6) + 0.0)


# ---- vectors


@query("SELECT vec_id, CAST(k AS INT) AS class, CAST(CASE WHEN k = label THEN 1 ELSE -1 END AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(0, 10)) AS k)")
def v10_class_label_indicators(s, d):
    return vecs(s, d).select("vec_id", F.posexplode(vectors.indicators(F.col("label"), 10)).alias("class", "x"))


@query("""SELECT doc_id, CAST(k AS INT) AS class, CAST(CASE WHEN (k = 0 AND quality = 1) OR (k = 1 AND toxic = 1) THEN 1 ELSE -1 END AS DOUBLE) AS x
FROM labels JOIN documents USING (doc_id), (SELECT unnest([0, 1]) AS k)""")
def v11_multi_label_indicators(s, d):
    both = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    held = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)))
    return both.select("doc_id", F.posexplode(vectors.multi_indicators(held, 2)).alias("class", "x"))


@query(f"{_FLAT} SELECT vec_id, CAST(i AS INT) AS i, round(greatest(0, x - 0.01::DOUBLE), 6) AS x FROM f")
def v1_linear_rectifier(s, d):
    return flat(vecs(s, d), vectors.linear_rectifier(F.col("v"), 0.0, 0.01))


@query(f"{_FLAT} SELECT vec_id, CAST(i AS INT) AS i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 2.2e-16), 6) AS x FROM f")
def v2_normalize_rows(s, d):
    return flat(vecs(s, d), vectors.normalize(F.col("v")))


@query(f"{_FLAT} SELECT vec_id, CAST(i AS INT) AS i, round(sign(x) * sqrt(abs(x)), 6) AS x FROM f")
def v3_v4_signed_hellinger(s, d):
    return flat(vecs(s, d), vectors.signed_hellinger(F.col("v")))


@query(f"{_FLAT} SELECT vec_id, CAST(i AS INT) AS i, round(x * CASE WHEN (i * 7 + 3) % 5 < 2 THEN -1 ELSE 1 END, 6) AS x FROM f")
def v6_random_sign(s, d):
    signs = vectors.array_of([-1 if (i * 7 + 3) % 5 < 2 else 1 for i in range(64)])
    return flat(vecs(s, d), vectors.multiply(F.col("v"), signs))


@query(f"{_FLAT} SELECT vec_id, CAST(k AS INT) AS i, round(sum(x * cos(2 * pi() * i * k / 64)), 4) + 0 AS x FROM f, (SELECT unnest(range(0, 32)) AS k) GROUP BY vec_id, k")
def v5_padded_fft(s, d):
    return flat(vecs(s, d), batches.map_vectors(padded_fft, F.col("v")), digits=4)


@query(f"""{_FLAT} SELECT vec_id, CAST(k AS INT) AS i, round(cos(sum(x * sin(CAST(i * 3 + k * 5 AS DOUBLE))) + k * 0.1::DOUBLE), 5) + 0 AS x
FROM f, (SELECT unnest(range(0, 16)) AS k) GROUP BY vec_id, k""")
def v7_cosine_random_features(s, d):
    w = np.sin(np.arange(64)[:, None] * 3.0 + np.arange(16) * 5.0)
    return flat(vecs(s, d), batches.map_vectors(lambda m: np.cos(m @ w + np.arange(16) * 0.1), F.col("v")), digits=5)


@query(f"{_FLAT} SELECT vec_id, CAST(i // 10 AS INT) AS block, CAST(i % 10 AS INT) AS i, round(x, 6) AS x FROM f")
def v12_vector_split(s, d):
    b = vecs(s, d).select("vec_id", F.posexplode(vectors.split(F.col("v"), 10)).alias("block", "b"))
    return b.select("vec_id", "block", F.posexplode("b").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"{_FLAT} SELECT vec_id, CAST(i AS INT) AS i, round(x, 6) AS x FROM f UNION ALL SELECT vec_id, CAST(i + 64 AS INT), round(-x, 6) FROM f")
def v13_u8_vector_combine(s, d):
    return flat(vecs(s, d), vectors.combine(F.col("v"), F.transform("v", lambda x: -x)))


@query(f"{_FLAT} SELECT vec_id, CAST(rank - 1 AS INT) AS rank, CAST(i AS INT) AS class FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM f WHERE i < 10) WHERE rank <= 3")
def v8_v9_topk_classifier(s, d):
    scores = F.slice("v", 1, 10)
    top = vecs(s, d).select("vec_id", vectors.argmax(scores).alias("best"), vectors.top_k(scores, 3).alias("t"))
    return top.where(F.col("best") == F.col("t")[0]).select("vec_id", F.posexplode("t").alias("rank", "class"))


@query(f"""{_FLAT}, r AS (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM f WHERE i < 10)
SELECT round(100 * (1 - sum(CASE WHEN i = label AND rank <= 3 THEN 1 ELSE 0 END) / CAST(count(DISTINCT vec_id) AS DOUBLE)), 6) AS error_pct FROM r""")
def v23_topk_error(s, d):
    e = evaluate.top_k_error(vecs(s, d), vectors.top_k(F.slice("v", 1, 10), 3), F.col("label"))
    return e.select(F.round("error_pct", 6).alias("error_pct"))


@query(f"{_FLAT} SELECT vec_id, CAST(i AS INT) AS i, round((x - avg(x) OVER w) / sqrt(var_samp(x) OVER w + 1), 6) + 0 AS x FROM f WINDOW w AS (PARTITION BY vec_id)")
def v22_row_statistics(s, d):
    return flat(vecs(s, d), vectors.row_statistics_normalize(F.col("v")))


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 1000")
def v18_sampler(s, d):
    """The size rows of smallest digest: a sample that doesn't depend on partitions."""
    return table(s, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(1000)


@query("SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)")
def p6_label_join(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id")


@query("SELECT kind, count(*) AS n FROM (SELECT 'documents' AS kind FROM documents UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT 'conversations' FROM conversations) GROUP BY kind")
def p18_union_sources(s, d):
    parts = [table(s, d, t).select(F.lit(t).alias("kind")) for t in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


# ---- scaling, reduction, clustering


@query(f"""{_FLAT}, m AS (SELECT i, avg(x) AS mean, stddev_samp(x) AS sd FROM f GROUP BY i)
SELECT vec_id, CAST(i AS INT) AS i, round((x - mean) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END, 5) + 0 AS x FROM f JOIN m USING (i)""")
def r1_standard_scaler(s, d):
    v = vecs(s, d)
    return flat(v, learn.standard_scaler(v, F.col("v"), 64).apply(F.col("v")), digits=5)


@query(f"""{_FLAT} SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_samp(a.x, b.x), 8) + 0 AS cov FROM f a JOIN f b USING (vec_id) GROUP BY a.i, b.i""")
def r6_covariance(s, d):
    cov, _ = decompose.covariance(vecs(s, d), F.col("v"), 64)
    return wide(s, np.round(cov, 8) + 0.0, "i", "j", "cov")


@query(f"{_FLAT} SELECT label AS class, CAST(i AS INT) AS i, round(avg(x), 6) + 0 AS mean FROM f GROUP BY label, i")
def r12_class_means(s, d):
    return vecs(s, d).select("label", F.posexplode("v").alias("i", "x")).groupBy(F.col("label").alias("class"), "i").agg((F.round(F.avg("x"), 6) + 0.0).alias("mean"))


def _centers(k: int) -> np.ndarray:
    return np.sin(np.arange(k)[:, None] * 7.0 + np.arange(64) * 0.3)


@query(f"""{_FLAT}, dist AS (SELECT vec_id, k, sum(pow(x - sin(k * 7 + i * 0.3::DOUBLE), 2)) AS far FROM f, (SELECT unnest(range(0, 8)) AS k) GROUP BY vec_id, k)
SELECT vec_id, CAST(arg_min(k, (far, k)) AS INT) AS cluster FROM dist GROUP BY vec_id""")
def c2_kmeans_assign(s, d):
    hot = vectors.one_hot_nearest(F.col("v"), _centers(8).tolist())
    return vecs(s, d).select("vec_id", vectors.argmax(hot).alias("cluster"))


@query(f"""WITH {_VEC}, p AS (SELECT vec_id, k, exp(-0.5 * (pow((v[1] - 0.1 * (k - 1)) / 0.2, 2) + pow((v[2] + 0.1 * (k - 1)) / 0.2, 2))) AS e FROM v, (SELECT unnest(range(0, 3)) AS k)),
q AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS q FROM p), t AS (SELECT vec_id, k, CASE WHEN q < 1e-4 THEN 0 ELSE q END AS q FROM q)
SELECT vec_id, CAST(k AS INT) AS i, round(q / sum(q) OVER (PARTITION BY vec_id), 6) AS x FROM t""")
def c4_gmm_posterior(s, d):
    m = decompose.Mixture(np.array([[-0.1, 0.1], [0, 0], [0.1, -0.1]]), np.full((3, 2), 0.04), np.full(3, 1 / 3))
    return flat(vecs(s, d), m.apply(F.slice("v", 1, 2)))


@query(f"""{_FLAT} SELECT vec_id, CAST(k AS INT) AS i, round(exp(-0.1::DOUBLE * sum(pow(x - sin(k * 7 + i * 0.3::DOUBLE), 2))), 6) AS x
FROM f, (SELECT unnest(range(0, 20)) AS k) GROUP BY vec_id, k""")
def l16_l17_rbf_kernel_block(s, d):
    c = _centers(20)
    return flat(vecs(s, d), batches.map_vectors(lambda m: learn.gaussian_kernel(m, c, 0.1), F.col("v")))


@query(f"{_FLAT} SELECT vec_id, CAST(k AS INT) AS i, round(sum(x * cos(CAST(i + k AS DOUBLE))) + k, 5) + 0 AS x FROM f, (SELECT unnest(range(0, 4)) AS k) GROUP BY vec_id, k")
def l1_linear_map(s, d):
    m = learn.LinearMapper(np.cos(np.arange(64)[:, None] + np.arange(4) * 1.0), np.arange(4) * 1.0)
    return flat(vecs(s, d), m.apply(F.col("v")), digits=5)


@query(f"{_FLAT} SELECT vec_id, CAST(k AS INT) AS i, round(sum(x * cos(CAST(i + k AS DOUBLE))), 5) + 0 AS x FROM f, (SELECT unnest(range(0, 4)) AS k) WHERE x > 0 GROUP BY vec_id, k")
def l2_sparse_linear_map(s, d):
    entries = vecs(s, d).select(F.col("vec_id").alias("row"), F.posexplode("v").alias("idx", "value")).where("value > 0")
    w = wide(s, np.cos(np.arange(64)[:, None] + np.arange(4) * 1.0), "idx", "k", "w")
    return learn.sparse_linear(entries, w).select(F.col("row").alias("vec_id"), F.col("k").alias("i"), (F.round("y", 5) + 0.0).alias("x"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def l4_least_squares_line(s, d):
    t = table(s, d, "lineitem")
    m = learn.least_squares(t, F.array(F.col("l_quantity").cast("double")), F.array(F.col("l_extendedprice").cast("double")), 1, 1)
    slope, mean = float(m.weights[0, 0]), float(m.scaler.mean[0])
    return s.createDataFrame([(round(slope, 4), round(float(m.intercept[0]) - slope * mean, 3))], "slope double, intercept double")


def _det(m: list[list[str]]) -> str:
    """Determinant as an SQL expression."""
    terms = []
    for p in permutations(range(len(m))):
        sign = "-" if sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2 else "+"
        terms.append(f"{sign} " + " * ".join(m[i][p[i]] for i in range(len(p))))
    return "(" + " ".join(terms) + ")"


_XS = ["l_quantity / 50", "l_discount * 10", "l_tax * 10", "(l_quantity - 25) * (l_discount * 10 - 0.5) / 5"]
_YS = ["l_extendedprice / 10000", "CAST(l_linenumber AS DOUBLE)"]
_XX = [[f"xx{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
_CRAMER = ", ".join(f"{_det([[f'xy{i}{k}' if j == c else _XX[i][j] for j in range(4)] for i in range(4)])} / det AS w{c}{k}" for c in range(4) for k in range(2))
_SUMS = ", ".join([f"covar_samp({_XS[i]}, {_XS[j]}) AS xx{i}{j}" for i in range(4) for j in range(i, 4)] + [f"covar_samp({_XS[i]}, {_YS[k]}) AS xy{i}{k}" for i in range(4) for k in range(2)])
_MEANS = ", ".join([f"avg({x}) AS mx{i}" for i, x in enumerate(_XS)] + [f"avg({y}) AS my{k}" for k, y in enumerate(_YS)])
_ROWS = " UNION ALL ".join([f"SELECT {c} AS feature, {k} AS target, round(w{c}{k}, 4) AS weight FROM w" for c in range(4) for k in range(2)] + [f"SELECT 4, {k}, round(my{k} - ({' + '.join(f'w{c}{k} * mx{c}' for c in range(4))}), 4) FROM w" for k in range(2)])


def _by_solver(s, d, solve):
    t = table(s, d, "lineitem").select(F.array(*[F.expr(x).cast("double") for x in _XS]).alias("x"), F.array(*[F.expr(y).cast("double") for y in _YS]).alias("y"))
    m = solve(t, F.col("x"), F.col("y"))
    rows = np.vstack([m.weights, m.intercept - m.scaler.mean @ m.weights])
    return s.createDataFrame([(i, k, float(round(rows[i, k], 4))) for i in range(5) for k in range(2)], "feature int, target int, weight double")


_L4 = f"WITH s AS (SELECT {_SUMS}, {_MEANS} FROM lineitem), d AS (SELECT *, {_det(_XX)} AS det FROM s), w AS (SELECT *, {_CRAMER} FROM d) {_ROWS}"


@query(_L4)
def l4_normal_equations(s, d):
    return _by_solver(s, d, lambda t, x, y: learn.least_squares(t, x, y, 4, 2))


@query(_L4)
def l6_block_coordinate_descent(s, d):
    """Blocks of two features; the product of all of them is never made."""
    return _by_solver(s, d, lambda t, x, y: learn.block_least_squares(t, x, y, 4, 2, 2, 25, gram_bytes=0))


@query(_L4)
def l10_l12_dense_lbfgs(s, d):
    return _by_solver(s, d, lambda t, x, y: learn.lbfgs_least_squares(t, x, y, 4, 2, rounds=60, tolerance=1e-15))


# ---- learners without SQL: training error and invariants


def _targets(label: Column) -> Column:
    return vectors.indicators(label, 10)


def _error(df: DataFrame, scores: Column, name: str) -> DataFrame:
    return df.select(vectors.argmax(scores).alias("p"), "label").agg(F.lit(name).alias("solver"), F.round(F.avg((F.col("p") != F.col("label")).cast("double")) * 100, 3).alias("error_pct"))


@query()
def l4_l6_l7_l8_l10_l14_solvers(s, d):
    v = vecs(s, d)
    x, y = F.col("v"), _targets(F.col("label"))
    found = {
        "exact": learn.least_squares(v, x, y, 64, 10, 0.1), "block": learn.block_least_squares(v, x, y, 64, 10, 16, 3, 0.1),
        "weighted": learn.class_weighted_least_squares(v, x, F.col("label"), 64, 10, 1e-3, 0.5), "block_weighted": learn.class_weighted_least_squares(v, x, F.col("label"), 64, 10, 1e-3, 0.5, 16, 3),
        "lbfgs": learn.lbfgs_least_squares(v, x, y, 64, 10, 1e-4, 20),
    }
    chosen = learn.choose_solver(v.count(), 64, 10, 1.0, 16)
    found["chosen"] = found[{"dense_lbfgs": "lbfgs", "sparse_lbfgs": "lbfgs"}.get(chosen, chosen)]
    out = None
    for name, m in found.items():
        e = _error(v, m.apply(x), name)
        out = e if out is None else out.union(e)
    return out


@query()
def l11_sparse_lbfgs(s, d):
    w = cut(table(s, d, "documents").select("doc_id", "text").join(table(s, d, "labels"), "doc_id").select("doc_id", "text", (F.col("quality") * 2.0 - 1).alias("y")))
    space = terms.most_common(w, "doc_id", "text", 500)
    weights, b = learn.sparse_lbfgs_of_rows(terms.vectors(w, ["y"], "text", space, dense=False), 500, 1e-3, 20)
    return s.createDataFrame([(int(i), float(round(x, 6))) for i, x in enumerate([*weights, b])], "idx int, weight double")


@query()
def l19_l20_kernel_ridge(s, d):
    """Trained on all rows, a block of them at a time; applied to every row."""
    v = vecs(s, d)
    m = learn.kernel_ridge(v, F.col("v"), _targets(F.col("label")), 64, 10, 0.5, 1e-2, 512, 1)
    return m.scores(v, F.col("v")).select("vec_id", vectors.argmax(F.col("scores")).alias("class"))


@query()
def r2_r4_r6_pca_project(s, d):
    v = vecs(s, d)
    return flat(v, decompose.project(F.col("v"), decompose.pca_tall_skinny(v, F.col("v"), 64, 4)), digits=5)


@query()
def r12_lda_project(s, d):
    v = vecs(s, d)
    return flat(v, decompose.discriminants(v, F.col("v"), F.col("label"), 64, 10, 4).apply(F.col("v")), digits=5)


_NEAR = f"""{_FLAT}, c AS (SELECT k, i, sin(k * 7 + i * 0.3::DOUBLE) AS c FROM (SELECT unnest(range(0, 8)) AS k), (SELECT unnest(range(0, 64)) AS i)),
dist AS (SELECT vec_id, k, sum(pow(x - c, 2)) AS far FROM f JOIN c USING (i) GROUP BY vec_id, k), own AS (SELECT vec_id, arg_min(k, (far, k)) AS k FROM dist GROUP BY vec_id)"""


@query(f"""{_NEAR}, m AS (SELECT k, i, avg(x) AS m FROM f JOIN own USING (vec_id) GROUP BY k, i)
SELECT CAST(k AS INT) AS cluster, CAST(i AS INT) AS i, round(coalesce(m, c), 6) + 0 AS x FROM c LEFT JOIN m USING (k, i)""")
def c1_lloyd_round(s, d):
    v = vecs(s, d)
    return wide(s, np.round(decompose.kmeans(v, F.col("v"), 64, _centers(8), 1), 6) + 0.0, "cluster", "i", "x")


@query()
def c1_kmeans_fit(s, d):
    """k-means++ seeds and Lloyd's rounds, all over the rows."""
    v = vecs(s, d)
    return wide(s, np.round(decompose.kmeans(v, F.col("v"), 64, decompose.kmeans_seeds(v, F.col("v"), 64, 8), 10), 6), "cluster", "i", "x")


_EM = f"""{_FLAT}, c AS (SELECT k, i, 0.1 * sin(k * 7 + i * 0.3::DOUBLE) AS c FROM (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(0, 64)) AS i)), var AS (SELECT i, var_samp(x) AS v FROM f GROUP BY i),
e AS (SELECT vec_id, k, -0.5 * sum(pow(x - c, 2) / v) AS e FROM f JOIN c USING (i) JOIN var USING (i) GROUP BY vec_id, k),
p AS (SELECT vec_id, k, exp(e - max(e) OVER w) / sum(exp(e - m)) OVER w AS p FROM (SELECT *, max(e) OVER (PARTITION BY vec_id) AS m FROM e) WINDOW w AS (PARTITION BY vec_id)),
q AS (SELECT vec_id, k, q / sum(q) OVER (PARTITION BY vec_id) AS q FROM (SELECT vec_id, k, CASE WHEN p < 1e-4 THEN 0 ELSE p END AS q FROM p)),
s AS (SELECT k, i, sum(q) AS n, sum(q * x) / sum(q) AS mean, sum(q * x * x) / sum(q) AS sq FROM q JOIN f USING (vec_id) GROUP BY k, i)
SELECT CAST(k AS INT) AS k, CAST(i AS INT) AS i, round(mean, 5) + 0 AS mean, round(greatest(sq - mean * mean, 0.01 * v, 1e-9), 5) AS var, round(n / (SELECT count(DISTINCT vec_id) FROM f), 5) AS weight FROM s JOIN var USING (i)"""


@query(_EM)
def c3_em_round(s, d):
    v = vecs(s, d)
    m = decompose.gaussian_mixture(v, F.col("v"), 64, _centers(4) * 0.1, 1, 0)
    return s.createDataFrame(
        [(k, i, float(round(m.means[k, i], 5)) + 0.0, float(round(m.variances[k, i], 5)), float(round(m.weights[k], 5))) for k in range(4) for i in range(64)], "k int, i int, mean double, var double, weight double"
    )


def _cells(s, d) -> DataFrame:
    """Each vector as a matrix of eight descriptors of eight values."""
    return vecs(s, d).select("vec_id", "label", vectors.split(F.col("v"), 8).alias("v"))


@query(f"""{_FLAT}, g AS (SELECT vec_id, i // 8 AS n, i % 8 AS j, x FROM f), c AS (SELECT k, j, 0.1 * sin(k * 7 + j * 0.3::DOUBLE) AS c FROM (SELECT unnest(range(0, 3)) AS k), (SELECT unnest(range(0, 8)) AS j)),
e AS (SELECT vec_id, n, k, exp(-0.5 * sum(pow(x - c, 2) / 0.04::DOUBLE)) AS e FROM g JOIN c USING (j) GROUP BY vec_id, n, k),
p AS (SELECT vec_id, n, k, e / sum(e) OVER (PARTITION BY vec_id, n) AS p FROM e), q AS (SELECT vec_id, n, k, q / sum(q) OVER (PARTITION BY vec_id, n) AS q FROM (SELECT vec_id, n, k, CASE WHEN p < 1e-4 THEN 0 ELSE p END AS q FROM p)),
s AS (SELECT vec_id, k, j, c, sum(q) / 8 AS s0, sum(q * x) / 8 AS s1, sum(q * x * x) / 8 AS s2 FROM q JOIN g USING (vec_id, n) JOIN c USING (k, j) GROUP BY vec_id, k, j, c)
SELECT vec_id, CAST(k * 8 + j AS INT) AS i, round((s1 - c * s0) / (0.2::DOUBLE * sqrt(1.0::DOUBLE / 3)), 5) + 0 AS x FROM s
UNION ALL SELECT vec_id, CAST(24 + k * 8 + j AS INT), round((s2 - 2 * c * s1 + (c * c - 0.04::DOUBLE) * s0) / (0.04::DOUBLE * sqrt(2.0::DOUBLE / 3)), 5) + 0 FROM s""")
def c5_fisher_vectors(s, d):
    m = decompose.Mixture(_centers(3)[:, :8] * 0.1, np.full((3, 8), 0.04), np.full(3, 1 / 3))
    return flat(_cells(s, d), decompose.fisher_vectors(F.col("v"), m), digits=5)


@query()
def c6_c7_fisher_encoder_fit(s, d):
    v = _cells(s, d)
    m = decompose.fisher_encoder(v, F.col("v"), 8, 4, rounds=10, least_mass=1)
    return flat(v, decompose.fisher_vectors(F.col("v"), m), digits=5)


@query(f"{_FLAT} SELECT vec_id, CAST(i // 8 AS INT) AS n, CAST(k AS INT) AS i, round(sum(x * cos(CAST(i % 8 + k AS DOUBLE))), 5) + 0 AS x FROM f, (SELECT unnest(range(0, 3)) AS k) GROUP BY vec_id, i // 8, k")
def r3_v14_project_columns(s, d):
    """Every column of a matrix projected, the matrix flattened."""
    p = decompose.project_columns(F.col("v"), np.cos(np.arange(8)[:, None] + np.arange(3) * 1.0))
    x = _cells(s, d).select("vec_id", F.posexplode(vectors.vectorize_matrix(p)).alias("at", "x"))
    return x.select("vec_id", F.floor(F.col("at") / 3).cast("int").alias("n"), (F.col("at") % 3).alias("i"), (F.round("x", 5) + 0.0).alias("x"))


@query()
def r8_r9_r10_column_pca(s, d):
    """Directions of the columns of all matrices, factorised where the rows are and on the driver: one row for each way."""
    out = []
    for how in ("local", "distributed"):
        m = decompose.column_pca(_cells(s, d), F.col("v"), 8, 3, how)
        out += [(how, i, j, float(round(m[i, j], 5))) for i in range(8) for j in range(3)]
    return s.createDataFrame(out, "how string, i int, j int, x double")


@query(f"{_FLAT}, g AS (SELECT DISTINCT vec_id, i // 8 AS n FROM f) SELECT vec_id, 5 AS drawn, true AS own FROM (SELECT DISTINCT vec_id FROM g)")
def v17_column_sampler(s, d):
    """Five columns of each matrix, drawn from its own."""
    x = _cells(s, d).withColumn("s", decompose.column_sample(F.col("v"), 5, 3))
    return x.select("vec_id", F.size("s").alias("drawn"), (F.size(F.array_except("s", "v")) == 0).alias("own"))


@query()
def l21_logistic_regression(s, d):
    from pyspark.ml.functions import array_to_vector

    v = vecs(s, d).select("vec_id", array_to_vector("v").alias("features"), F.col("label").cast("double").alias("label"))
    return learn.logistic_regression(v, "features", "label", 0.01, 20).transform(v).select("vec_id", F.col("prediction").cast("int").alias("class"))


# ---- naive Bayes and whole applications

_BAYES = f"""{_DOCS}, e AS ({_EACH}), t AS (SELECT doc_id, lang AS class, term, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY doc_id, lang, term),
cls AS (SELECT lang AS class, count(*) AS n FROM documents GROUP BY lang), pi AS (SELECT class, ln(n + 1) - ln((SELECT sum(n) + count(*) FROM cls)) AS pi FROM cls),
cs AS (SELECT class, term, sum(n) AS s FROM t GROUP BY class, term), vocab AS (SELECT count(DISTINCT term) AS v FROM t),
norm AS (SELECT class, ln(sum(s) + (SELECT v FROM vocab)) AS norm FROM cs GROUP BY class)"""


def _bayes(s, d):
    """(term, s0 ...) counts by class, the classes' documents and the logarithms of their smoothed totals."""
    t = table(s, d, "documents")
    classes = [(r["lang"], r["n"]) for r in t.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]
    counts = cut(terms.class_counts(t, "lang", [c for c, _ in classes], "text"))
    norm = counts.agg(*[F.log(F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) + F.count("*")).alias(f"n{k}") for k in range(len(classes))]).first() if classes else ()
    return counts, classes, list(norm)


@query(f"WITH {_BAYES} SELECT class, term, round(ln(s + 1) - norm, 6) AS theta FROM cs JOIN norm USING (class) UNION ALL SELECT class, NULL, round(-norm, 6) FROM norm")
def l22_naive_bayes_fit(s, d):
    counts, classes, norm = _bayes(s, d)
    each = counts.select("term", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"s{k}").alias("s"), F.lit(norm[k]).alias("norm")) for k, (c, _) in enumerate(classes)])).alias("e"))
    theta = each.where("e.s IS NOT NULL").select("e.class", "term", F.round(F.log(F.col("e.s") + 1) - F.col("e.norm"), 6).alias("theta"))
    rest = s.createDataFrame([(c, None, float(-norm[k])) for k, (c, _) in enumerate(classes)], "class string, term string, theta double")
    return theta.unionByName(rest.withColumn("theta", F.round("theta", 6)))


_PREDICT = f"""{_BAYES}, sc AS (
  SELECT r.doc_id, p.class, p.pi + coalesce(x.s, 0) AS score FROM documents r, pi p LEFT JOIN LATERAL (SELECT 0) ON true LEFT JOIN (
    SELECT t.doc_id, norm.class, sum(t.n * (ln(coalesce(cs.s, 0) + 1) - norm.norm)) AS s FROM t CROSS JOIN norm LEFT JOIN cs ON cs.class = norm.class AND cs.term = t.term GROUP BY t.doc_id, norm.class
  ) x ON x.doc_id = r.doc_id AND x.class = p.class),
best AS (SELECT doc_id, arg_max(class, (score, class)) AS class FROM sc GROUP BY doc_id)""".replace(" LEFT JOIN LATERAL (SELECT 0) ON true", "")


def _predicted(s, d):
    """(doc_id, class) of the best class of every document."""
    counts, classes, norm = _bayes(s, d)
    names, total = [f"s{k}" for k in range(len(classes))], sum(n for _, n in classes) + len(classes)
    some = [F.coalesce(c, F.lit(0.0)) for c in names]
    theta = counts.select("term", *[(F.log(x + 1) - norm[k]).alias(f"s{k}") for k, x in enumerate(some)], sum(some, F.lit(0.0)).alias("n_all"))
    sums = terms.weighted_sums(table(s, d, "documents"), "doc_id", "text", theta, names, F.col("n_all"))
    scores = [F.struct((F.col(f"s{k}") + float(np.log(n + 1) - np.log(total))).alias("score"), F.lit(c).alias("class")) for k, (c, n) in enumerate(classes)]
    return sums.select("doc_id", F.array_max(F.array(*scores))["class"].alias("class"))


@query(f"WITH {_PREDICT} SELECT doc_id, class FROM best")
def l22_naive_bayes_predict(s, d):
    return _predicted(s, d)


@query(f"WITH {_PREDICT} SELECT lang AS actual, class AS predicted, count(*) AS n FROM best JOIN documents USING (doc_id) GROUP BY lang, class")
def l22_naive_bayes_confusion(s, d):
    rows = table(s, d, "documents").select("doc_id", F.col("lang").alias("actual"))
    return _predicted(s, d).withColumnRenamed("class", "predicted").join(rows, "doc_id").groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@query()
def a3_review_pipeline(s, d):
    """Presence of common n-grams, logistic regression on the quality label, binary metrics."""
    w = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("quality").alias("label"))
    p = apps.reviews(w, 2, 1000, 1e-3)(w).get()
    return evaluate.binary_metrics(evaluate.contingency(p, F.col("class") == 1, F.col("label") == 1))


def _samples(s, d) -> DataFrame:
    return vecs(s, d).select(F.col("vec_id").alias("id"), F.col("v").alias("x"), "label")


def _tally(p: DataFrame, rows: DataFrame, classes: int = 10) -> DataFrame:
    return evaluate.confusion(p.select("id", "class").join(rows.select("id", "label"), "id"), F.col("class"), F.col("label"), classes)


@query()
def a1_random_fft_pipeline(s, d):
    t = _samples(s, d)
    return _tally(apps.random_fft(t, 10, 64, 4, 64)(t).get(), t)


@query()
def a5_cosine_speech_pipeline(s, d):
    t = _samples(s, d)
    return _tally(apps.cosine_speech(t, 10, 64, 128, 2, 0.5, "gaussian", 0.1, 2)(t).get(), t)


@query()
def a2_news_groups_pipeline(s, d):
    """Documents by language: n-grams, presence, common features, naive Bayes."""
    langs = ["de", "en", "es", "fr"]
    t = table(s, d, "documents").where(F.col("lang").isin(langs)).select(F.col("doc_id").alias("id"), "text", (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int").alias("label"))
    return _tally(apps.news_groups(t, 4, 2, 500)(t).get(), t, 4)


def _scenes(s, d, x: int = 8, y: int = 8, c: int = 1) -> DataFrame:
    return pictures(s, d, x, y, c).join(vecs(s, d).select("vec_id", "label"), "vec_id").select(F.col("vec_id").alias("id"), F.col("image").alias("x"), "label")


@query()
def a6_linear_pixels_pipeline(s, d):
    t = _scenes(s, d)
    return _tally(apps.linear_pixels(t, 10, 0.1)(t).get(), t)


@query()
def a7_random_filters_pipeline(s, d):
    t = _scenes(s, d)
    return _tally(apps.random_filters(t, 10, 8, 3, 1, 0.1, 3, 3, 1.0)(t).get(), t)


@query()
def a8_patch_filters_pipeline(s, d):
    """Filters from sampled patches, whitened; convolution, rectifier, pools, block least squares."""
    t = _scenes(s, d)
    return _tally(apps.patch_classes(t, 10, 8, 3, 0.1, 3, 3, 1.0, sample=2000)(t).get(), t)


@query()
def a9_patch_kernel_pipeline(s, d):
    t = _scenes(s, d)
    return _tally(apps.patch_classes(t, 10, 8, 3, 0.1, 3, 3, 0.1, (0.01, 1024, 1), sample=2000)(t).get(), t)


@query()
def a10_a11_augmented_pipeline(s, d):
    """Crops and flips to learn from; corners and center, as they are and flipped, averaged to decide."""
    t = _scenes(s, d)
    pipe = apps.patch_classes(apps.augmented_patches(t, 6, 2), 10, 8, 3, 0.1, 3, 3, 1.0, sample=2000)
    return apps.augmented_classes(pipe, t, 6, 10).select(F.col("name").alias("vec_id"), "class")


def _larger(m: np.ndarray) -> np.ndarray:
    """Every pixel of the first channel as five by five."""
    return m[..., :1].repeat(5, -3).repeat(5, -2)


def _large(s, d) -> DataFrame:
    """Pictures five times as large, of three channels."""
    return nodes.computed(_scenes(s, d), "x", images.map_images(F.col("x"), lambda m: np.repeat(_larger(m), 3, -1)))


@query()
def a12_sift_fisher_pipeline(s, d):
    t = _large(s, d)
    p = apps.sift_fisher(t, 10, 8, 4, 0.5, 64, 4, (8, 4, 1, 1), least_mass=1, rounds=3)(t).get()
    return evaluate.average_precision(p.select("id", "scores").join(t.select("id", "label"), "id"), "id", F.col("scores"), F.array("label"))


@query()
def a13_sift_lcs_fisher_pipeline(s, d):
    t = _large(s, d)
    p = apps.sift_lcs_fisher(t, 10, 8, 4, 0.1, 0.25, 64, 4, (8, 4, 1, 1), (8, 12, 4), least_mass=1, rounds=3)(t).get()
    joined = p.select("id", "scores").join(t.select("id", "label"), "id")
    return evaluate.top_k_error(joined, vectors.top_k(F.col("scores"), 5), F.col("label"))


# ---- pipelines, sources and partitions


@query(f"""{_FLAT}, n AS (SELECT vec_id, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 2.2e-16) AS x FROM f)
SELECT vec_id, CAST(i AS INT) AS i, round(x, 6) AS x FROM n UNION ALL SELECT vec_id, CAST(i + 64 AS INT), round(greatest(0, x - 0.01::DOUBLE), 6) FROM f""")
def u8_gathered_branches(s, d):
    both = P.Pipeline.gather("vec_id", a=nodes.steps("normalize", source="v", target="v"), b=nodes.steps(("rectify_vector", 0.0, 0.01), source="v", target="v"))
    return flat(both.and_then(nodes.Combine(("a_v", "b_v"), "v"))(vecs(s, d)).get(), F.col("v"))


@query(f"""{_FLAT}, g AS (SELECT vec_id, i, sign(x) * sqrt(abs(x)) AS x FROM f), m AS (SELECT i, avg(x) AS mean, stddev_samp(x) AS sd FROM g GROUP BY i)
SELECT vec_id, CAST(i AS INT) AS i, round((x - mean) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END, 5) + 0 AS x FROM g JOIN m USING (i)""")
def u3_u6_u10_fitted_pipeline(s, d):
    """A step, then an estimator fitted behind it; the fitted pipeline is applied."""
    v = vecs(s, d)
    fitted = nodes.steps("signed_hellinger", source="v", target="v").and_then(nodes.Scale(source="v"), v).fit(P.Environment())
    return flat(fitted.transform(v), F.col("v"), digits=5)


def _written(df: DataFrame) -> str:
    """Folder of the table as lines of text, kept where checkpoints are."""
    path = scratch_path(df.sparkSession, "lines")
    df.write.text(path)
    return path


@query(f"{_FLAT} SELECT CAST(x AS DOUBLE) AS first, n FROM (SELECT vec_id, round(max(CASE WHEN i = 0 THEN x END), 6) AS x, count(*) AS n FROM f GROUP BY vec_id)")
def s1_dense_csv(s, d):
    """Vectors written as lines of numbers and read again."""
    path = _written(vecs(s, d).select(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("value")))
    r = readers.dense_csv(s, path)
    return r.select(F.round(F.get("features", F.lit(0)), 6).alias("first"), F.size("features").cast("long").alias("n"))


@query("SELECT CAST(n_chars % 5 >= 3 AS INT) AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def s2_reviews(s, d):
    """Documents written as JSON reviews with a score and read again."""
    path = _written(table(s, d, "documents").select(F.to_json(F.struct((F.col("n_chars") % 5).cast("double").alias("overall"), F.col("text").alias("reviewText"))).alias("value")))
    return readers.reviews(s, path, 3).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT CAST(label AS INT) AS label, count(*) AS n FROM embeddings GROUP BY label")
def s5_row_labelled(s, d):
    """Features and, apart from them, lines of row and label."""
    v = vecs(s, d).select((F.col("vec_id")).alias("row_id"), F.col("v").alias("features"), "label")
    path = _written(v.select(F.concat_ws(" ", F.col("row_id") + 1, F.col("label") + 1).alias("value")))
    return readers.row_labelled(v.select("row_id", "features"), s.read.text(path)).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations)")
def s10_text_lines(s, d):
    path = _written(table(s, d, "conversations").select(F.coalesce("text", F.lit("")).alias("value")))
    return readers.lines(s, path).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT count(*) AS n FROM events")
def p5_e9_partition_indexes(s, d):
    """Rows counted under the index of their partition, which agrees with the counts by partition."""
    t = table(s, d, "events").select("event_id").repartition(4)
    by = numbering.map_partitions_with_index(t, _count_under, "p int, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return by.agg(F.sum("n").alias("n"))


def _count_under(index: int, batches):
    import pyarrow as pa

    n = sum(b.num_rows for b in batches)
    yield pa.RecordBatch.from_arrays([pa.array([index], pa.int32()), pa.array([n], pa.int64())], names=["p", "n"])


# ---- evaluation

_RULE = "SELECT e.label AS actual, list_position(v[1:10], list_max(v[1:10])) - 1 AS predicted FROM v e"
_MATRIX = f"WITH {_VEC}, p AS ({_RULE}), m AS (SELECT a AS actual, b AS predicted, count(p.actual) AS n FROM (SELECT unnest(range(0, 10)) AS a), (SELECT unnest(range(0, 10)) AS b) LEFT JOIN p ON p.actual = a AND p.predicted = b GROUP BY a, b)"


def _matrix(s, d):
    v = vecs(s, d).withColumn("p", vectors.argmax(F.slice("v", 1, 10)))
    return evaluate.confusion(v, F.col("p"), F.col("label"), 10)


@query(f"""WITH {_VEC}, p AS ({_RULE}) SELECT CAST(a AS INT) AS actual, CAST(b AS INT) AS predicted, (SELECT count(*) FROM p WHERE p.actual = a AND p.predicted = b) AS n
FROM (SELECT unnest(range(0, 10)) AS a), (SELECT unnest(range(0, 10)) AS b)""")
def e3_confusion_matrix(s, d):
    return _matrix(s, d)


@query(f"""WITH {_VEC}, p AS ({_RULE}), c AS (SELECT k, (SELECT count(*) FROM p WHERE actual = k AND predicted = k) AS tp, (SELECT count(*) FROM p WHERE actual = k) AS a,
  (SELECT count(*) FROM p WHERE predicted = k) AS q, (SELECT count(*) FROM p) AS n FROM (SELECT unnest(range(0, 10)) AS k)),
r AS (SELECT *, CASE WHEN q = 0 THEN 'nan'::DOUBLE ELSE tp / q::DOUBLE END AS pr, CASE WHEN a = 0 THEN 'nan'::DOUBLE ELSE tp / a::DOUBLE END AS re, CASE WHEN a + q = 0 THEN 'nan'::DOUBLE ELSE 2 * tp / (a + q)::DOUBLE END AS fs FROM c)
SELECT round(avg((n - a - q + 2 * tp) / n::DOUBLE), 6) AS avg_accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(fs), 6) AS macro_f_score,
  round(sum(tp) / max(n)::DOUBLE, 6) AS total_accuracy, round(sum(tp) / sum(q)::DOUBLE, 6) AS micro_precision FROM r""")
def e4_multiclass_metrics(s, d):
    m = evaluate.multiclass_metrics(_matrix(s, d))
    return m.select(*[F.round(c, 6).alias(c) for c in ("avg_accuracy", "macro_precision", "macro_recall", "macro_f_score", "total_accuracy", "micro_precision")])


@query("""WITH p AS (SELECT n_chars > 200 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), c AS (
  SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (NOT p AND a) AS fn FROM p)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
  round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round(2 * tp / (2 * tp + fn + fp)::DOUBLE, 6) AS f_score FROM c""")
def e2_binary_metrics(s, d):
    both = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    m = evaluate.binary_metrics(evaluate.contingency(both, F.col("n_chars") > 200, F.col("quality") == 1))
    return m.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "precision", "specificity", "f_score")])


_POINTS = ", ".join(f"coalesce(max(CASE WHEN r10 >= {t} THEN p END), 0)" for t in range(11)).replace(", coalesce", " + coalesce")


@query(f"""{_FLAT}, h AS (SELECT vec_id, i AS class, x, CASE WHEN label = i THEN 1 ELSE 0 END AS hit FROM f WHERE i < 10),
r AS (SELECT class, sum(hit) OVER w AS tp, count(*) OVER w AS k, sum(hit) OVER (PARTITION BY class) AS n FROM h WINDOW w AS (PARTITION BY class ORDER BY x DESC, vec_id DESC ROWS UNBOUNDED PRECEDING)),
p AS (SELECT class, tp / k::DOUBLE AS p, tp * 10 / n::DOUBLE AS r10 FROM r)
SELECT CAST(class AS INT) AS class, round(({_POINTS}) / 11, 6) AS ap FROM p GROUP BY class""")
def e6_mean_average_precision(s, d):
    ap = evaluate.average_precision(vecs(s, d), "vec_id", F.slice("v", 1, 10), F.array("label"))
    return ap.select("class", F.round("ap", 6).alias("ap"))


@query(f"""{_FLAT}, a AS (SELECT vec_id // 5 AS name, i, avg(x) AS s FROM f WHERE i < 10 GROUP BY name, i)
SELECT name, CAST(arg_min(i, (-s, i)) AS INT) AS class FROM a GROUP BY name""")
def e7_augmented_average(s, d):
    v = vecs(s, d).withColumn("name", F.floor(F.col("vec_id") / 5))
    return evaluate.augmented(v, "name", F.slice("v", 1, 10), 10)


@query(f"""{_FLAT}, b AS (SELECT vec_id // 5 AS name, i, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) - 1 AS r FROM f WHERE i < 10), a AS (SELECT name, i, sum(r) AS s FROM b GROUP BY name, i)
SELECT name, CAST(arg_min(i, (-s, i)) AS INT) AS class FROM a GROUP BY name""")
def e7_augmented_borda(s, d):
    v = vecs(s, d).withColumn("name", F.floor(F.col("vec_id") / 5))
    return evaluate.augmented(v, "name", F.slice("v", 1, 10), 10, "borda")


# ---- images, 8 x 8 x 1 (or 4 x 4 x 4) from the embeddings


def pictures(s, d, x: int = 8, y: int = 8, c: int = 1) -> DataFrame:
    return vecs(s, d).select("vec_id", F.struct(F.lit(x).alias("x_dim"), F.lit(y).alias("y_dim"), F.lit(c).alias("num_channels"), F.col("v").alias("data")).alias("image"))


@query(f"{_FLAT} SELECT vec_id, CAST(i // 4 AS INT) AS i, round(sqrt(sum(x * x) / 4), 6) AS x FROM f GROUP BY vec_id, i // 4")
def i2_i3_gray(s, d):
    return flat(pictures(s, d, 4, 4, 4), images.vectorize(images.grayscale(F.col("image"))))


@query(f"{_FLAT} SELECT vec_id, CAST((i // 4) * 3 + i % 4 AS INT) AS i, round(x / 255, 9) AS x FROM f WHERE i < 64 AND i % 4 < 3")
def i1_pixel_scaler(s, d):
    three = vecs(s, d).withColumn("v", F.filter("v", lambda x, i: i % 4 < 3))
    img = three.select("vec_id", F.struct(F.lit(4).alias("x_dim"), F.lit(4).alias("y_dim"), F.lit(3).alias("num_channels"), F.col("v").alias("data")).alias("image"))
    return flat(img, images.vectorize(images.scale_pixels(F.col("image"))), digits=9)


@query(f"""{_FLAT}, o AS (SELECT vec_id, i, x, unnest([0, 1]) AS neg FROM f) SELECT vec_id, CAST(i * 2 + neg AS INT) AS i,
  round(greatest(0, CASE WHEN neg = 0 THEN x - 0.01::DOUBLE ELSE -x - 0.01::DOUBLE END), 6) AS x FROM o""")
def i10_symmetric_rectifier(s, d):
    return flat(pictures(s, d), images.vectorize(images.rectify(F.col("image"), 0.0, 0.01)))


@query(f"""{_FLAT}, p AS (SELECT vec_id, x, i % 8 AS r, i // 8 AS c FROM f), w AS (SELECT unnest(range(0, 5, 2)) AS a), u AS (SELECT unnest(range(0, 5, 2)) AS b)
SELECT vec_id, CAST((a // 2) * 3 + b // 2 AS INT) AS k, CAST((r - a) + (c - b) * 4 AS INT) AS i, round(x, 6) AS x FROM p, w, u WHERE r >= a AND r < a + 4 AND c >= b AND c < b + 4""")
def i5_windower(s, d):
    w = pictures(s, d).select("vec_id", F.posexplode(images.map_images(F.col("image"), lambda m: images.windows(m, 2, 4), many=True)).alias("k", "w"))
    return w.select("vec_id", "k", F.posexplode("w.data").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""{_FLAT}, p AS (SELECT vec_id, x, i % 8 AS r, i // 8 AS c FROM f), a AS (SELECT unnest([2, 5]) AS a), b AS (SELECT unnest([2, 5]) AS b)
SELECT vec_id, CAST((a // 3) + (b // 3) * 2 AS INT) AS i, round(sum(x), 5) + 0 AS x FROM p, a, b WHERE r >= a - 2 AND r < a + 2 AND c >= b - 2 AND c < b + 2 GROUP BY vec_id, a, b""")
def i9_pooler(s, d):
    return flat(pictures(s, d), images.vectorize(images.map_images(F.col("image"), lambda m: images.pool(m, 3, 4))), digits=5)


@query(f"{_FLAT} SELECT vec_id, CAST((i % 8 - 1) + (i // 8 - 2) * 4 AS INT) AS i, round(x, 6) AS x FROM f WHERE i % 8 BETWEEN 1 AND 4 AND i // 8 BETWEEN 2 AND 6")
def i4_cropper(s, d):
    return flat(pictures(s, d), images.vectorize(images.map_images(F.col("image"), lambda m: images.crop(m, 1, 2, 5, 7))))


@query(f"{_FLAT} SELECT vec_id, copy, CAST(i AS INT) AS i, round(x, 6) AS x FROM f, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS copy)")
def i20_augmenter(s, d):
    return images.augment(vecs(s, d), 3).select("vec_id", "copy", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""{_FLAT}, p AS (SELECT vec_id, x, i % 8 AS r, i // 8 AS c FROM f), k AS (SELECT unnest(range(0, 2)) AS k)
SELECT vec_id, CAST((a + b * 6) * 2 + k AS INT) AS i, round(sum(x * cos(CAST(k + (r - a) + (c - b) * 3 AS DOUBLE))), 5) + 0 AS x
FROM p, (SELECT unnest(range(0, 6)) AS a), (SELECT unnest(range(0, 6)) AS b), k WHERE r >= a AND r < a + 3 AND c >= b AND c < b + 3 GROUP BY vec_id, a, b, k""")
def i11_convolver(s, d):
    f = np.cos(np.arange(2)[:, None] + np.arange(9) * 1.0)
    return flat(pictures(s, d), images.vectorize(images.map_images(F.col("image"), lambda m: images.convolve(m, f, 3, normalize=False))), digits=5)


@query(f"""{_FLAT}, p AS (SELECT vec_id, x, i % 8 AS r, i // 8 AS c FROM f), w AS (SELECT * FROM (VALUES (0, 0, 0), (1, 4, 0), (2, 0, 4), (3, 4, 4), (4, 2, 2)) t(k, a, b))
SELECT vec_id, CAST(2 * k + turned AS INT) AS k, CAST((r - a) + CASE WHEN turned = 1 THEN 3 - (c - b) ELSE c - b END * 4 AS INT) AS i, round(x, 6) AS x FROM p, w, (SELECT unnest([0, 1]) AS turned) WHERE r >= a AND r < a + 4 AND c >= b AND c < b + 4""")
def i6_center_corner_patches(s, d):
    img = pictures(s, d)
    five = images.map_images(F.col("image"), lambda m: images.center_corner_patches(m, 4, 4, True), many=True)
    return img.select("vec_id", F.posexplode(five).alias("k", "p")).select("vec_id", "k", F.posexplode("p.data").alias("i", "x")).withColumn("x", F.round("x", 6))


@query()
def i7_i8_random_patches(s, d):
    """Crops and flips drawn by each row."""
    img, seed = pictures(s, d), F.xxhash64("vec_id", F.lit(12334))
    k = img.select("vec_id", F.posexplode(images.random_patches_of(F.col("image"), 3, 4, 4, seed)).alias("k", "p"))
    k = k.withColumn("p", images.random_flips(F.col("p"), 0.5, F.xxhash64("vec_id", "k")))
    return k.select("vec_id", "k", F.round(F.aggregate("p.data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("p.data", F.lit(0)), 6).alias("first"))


@query()
def i12_i13_i14_i16_descriptors(s, d):
    """Number and mean of the values of each kind of descriptor on enlarged pictures."""
    img = pictures(s, d)
    big = _larger
    kinds = {
        "hog": lambda m: images.hog(np.repeat(big(m), 3, -1), 8), "lcs": lambda m: images.local_color_statistics(big(m), 6, 8, 3),
        "daisy": lambda m: images.daisy(big(m), stride=6), "sift": lambda m: images.dense_sift(big(m), 8, 4, 1),
    }
    found = images.descriptor_totals(img, "vec_id", "image", kinds)
    return found.select("vec_id", "kind", "n", F.round("mean", 4).alias("mean"))


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def p10_event_totals(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
