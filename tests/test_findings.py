"""Faults that reviews of large tables and odd inputs have found."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from larkspur import catalogue


def equals_sql(spark, name, tmp_path, tables):
    """The query over tables (name: list of dicts and schema) against its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    cur = con.execute(catalogue.SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    text = lambda x: f"{x + 0.0:.9g}" if isinstance(x, float) else str(x)
    want = sorted(tuple(text(r[i]) for i in at) for r in cur.fetchall())
    assert want and sorted(tuple(text(r[c]) for c in cols) for r in df.collect()) == want


def test_values_that_round_to_zero_are_no_zeros(spark, tmp_path):
    v = [0.0] * 64
    v[0], v[2], v[4], v[5] = 1e-8, -1e-8, 0.5, 0.25
    equals_sql(spark, "f4_f5_sparsify_densify", tmp_path, {"embeddings": ([(1, v, 3), (2, [0.0] * 64, 1)], "vec_id long, embedding array<float>, label int")})


def pictures(spark, n, x=8, y=8):
    from larkspur.operators import images

    rng = np.random.default_rng(6)
    rows = [(i, (x, y, 1, rng.random(x * y).tolist()) if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows, f"id int, x {images.SCHEMA}")


def test_images_of_a_batch_are_worked_on_together(spark):
    """stacks of images give what single ones give, null images null, and few of their descriptors are held at a time."""
    from larkspur.operators import images
    from larkspur.plans import nodes

    rng = np.random.default_rng(7)
    stack = rng.random((4, 24, 30, 3))
    for fn in (lambda m: images.hog(m, 6), lambda m: images.daisy(m, border=8), lambda m: images.dense_sift(m, 4, 3, 2), lambda m: images.local_color_statistics(m, 4, 6, 3), lambda m: images.pool(m, 3, 4), images.gray):
        assert np.allclose(fn(stack), [fn(m) for m in stack])
    odd = stack[0].copy()
    odd[3, 3] = np.nan
    assert 0 < np.isnan(images.conv2d(odd, np.ones(11), np.ones(11))).sum() < odd.size
    df = pictures(spark, 20)
    both = nodes.steps(("rectify", 0.0, 0.1), ("pool", 3, 4), "image_vector")(df).get().orderBy("id").collect()
    whole = {r.id: r.x for r in df.collect()}
    for r in both:
        assert (r.x is None) == (whole[r.id] is None)
        if r.x:
            m = images.unpack(*whole[r.id])
            want = images.pool(np.concatenate([np.maximum(0, m - 0.1), np.maximum(0, -m - 0.1)], axis=2), 3, 4)
            assert np.allclose(r.x, images.pack(want)["data"])
    seen = []
    found = images._described(df.where("id % 7 > 0").toArrow().column("x").combine_chunks(), lambda m: (seen.append(len(m)), np.ones((len(m), 5, 3)))[1])
    assert sum(seen) == 17 and len(found) == 17 and found[0].as_py() == [[1.0] * 5] * 3
    none = df.limit(0)
    assert nodes.steps("gray", ("sift", 4, 2, 1))(none).get().collect() == []


def test_kernel_ridge_passes_over_groups_of_blocks(spark, monkeypatch):
    """one pass over the rows for many blocks; pieces of the kernel matrix, with the weights of one block after another."""
    from larkspur.operators import learn

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(60, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").coalesce(1)
    passes, real = [], learn.sum_batches
    monkeypatch.setattr(learn, "sum_batches", lambda *a: (passes.append(1), real(*a))[1])
    monkeypatch.setattr(learn, "KERNEL_ROWS", (7, 11))
    m = learn.kernel_ridge(df, F.col("x"), F.col("y"), 3, 2, 0.5, 0.5, 6, 2)
    assert len(passes) == 2
    k, w = learn.gaussian_kernel(x, x, 0.5), np.zeros((60, 2))
    for _ in range(2):
        for b in range(10):
            at = np.arange(60) % 10 == b
            w[at] = np.linalg.solve(k[np.ix_(at, at)] + 0.5 * np.eye(6), y[at] - k[at] @ w + k[np.ix_(at, at)] @ w[at])
    test = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "i int, v array<double>")
    assert np.allclose([r.scores for r in m.scores(test, F.col("v")).orderBy("i").collect()], k @ w)


ODD = ["", "   ", None, "!!! ", "a", " .a b", "\x01a\x01 b\x01", "a  b--a b", "Ünïcödé 日本 😀x, É\x0bé", "x\ny\tz", "...", "a\x00.b", "İI ß", "b a b a b a", "\x00", "tail. ", "¿qué? "]


def documents(rng, n):
    made = [(i, t, "en") for i, t in enumerate(ODD)]
    alphabet = list("ab .,!-\n") + ["é", "日", "😀", "Zz"]
    return made + [(len(made) + i, "".join(rng.choice(alphabet, rng.integers(0, 40))), ["en", "de", "fr"][i % 3]) for i in range(n)]


def test_tokens_and_hashes_equal_those_of_columns(spark, monkeypatch):
    """Terms are found, counted and hashed in Python as by Spark's functions, in slices of any size."""
    from collections import Counter

    from larkspur.functions import murmur, text
    from larkspur.operators import terms

    docs = spark.createDataFrame(documents(np.random.default_rng(9), 120), "doc_id long, text string, lang string")
    known = docs.select("doc_id", text.tokenize(text.lower(text.trim(F.col("text")))).alias("w")).select("doc_id", "w", F.transform("w", text.java_hash).alias("h"))
    want = {r.doc_id: (r.w, r.h) for r in known.collect()}
    col = docs.orderBy("doc_id").select(F.lower("text").alias("t")).toArrow().column("t").combine_chunks()
    for size in (1 << 22, 50):
        monkeypatch.setattr(terms, "SLICE", size)
        got = {i: ([], [], [], []) for i in range(len(col))}
        for a, t in terms.tokens(col):
            names, hashes, g = t.terms.to_pylist(), terms.java_hashes(t.terms), t.grams(1, 3)
            rows, rolled = murmur.ngram_hashes_of(hashes[t.code], t.row, 1, 3)
            for r, p, c in zip(t.row, t.pos, t.code):
                assert p == len(got[a + r][0])
                got[a + r][0].append(names[c])
                got[a + r][1].append(int(hashes[c]))
            for r, c in zip(g.row, g.code):
                got[a + r][2].append(g.terms[int(c)].as_py())
            for r, h in zip(rows, rolled):
                got[a + r][3].append(int(h))
        for i, (w, h) in want.items():
            w, h = w or [], h or []
            assert (got[i][0], got[i][1]) == (w, h)
            assert got[i][2] == [" ".join(w[j : j + n]) for n in (1, 2, 3) for j in range(len(w) - n + 1)]
            assert Counter(got[i][3]) == Counter(murmur.ngram_hashes(np.array(h), 1, 3).tolist())


def test_counts_of_texts_equal_sql_also_where_keys_are_repeated(spark, tmp_path, monkeypatch):
    """No shuffle of every term, and the rows of one key still add up."""
    from larkspur.operators import terms

    rows = [r for r in documents(np.random.default_rng(10), 80) if not set("😀İ") & set(r[1] or "")]
    rows += [(rows[k][0], "again a b a", "en") for k in (3, 5, 20)] + [(5, "b", "en")]
    tables = {"documents": (rows, "doc_id long, text string, lang string")}
    for most in (terms.REPEATED, 1):
        monkeypatch.setattr(terms, "REPEATED", most)
        for name in ("n4_ngrams", "n5_p16_ngram_counts_top", "n7_term_frequency", "n8_hashing_tf", "n9_ngrams_hashing_tf", "f3_sparse_vectorize"):
            if name != "n9_ngrams_hashing_tf":  # its SQL runs n-grams on from row to row of one key
                equals_sql(spark, name, tmp_path, tables)
    tables["documents"] = (rows[:-4], tables["documents"][1])
    equals_sql(spark, "n9_ngrams_hashing_tf", tmp_path, tables)
    df = catalogue.QUERIES["n4_ngrams"](spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_bayes_and_codes_of_texts_equal_sql(spark, tmp_path, monkeypatch):
    """only rare terms are joined, and it doesn't matter which are."""
    from larkspur.operators import terms

    rows = [r for r in documents(np.random.default_rng(11), 80) if not set("😀İ\x00") & set(r[1] or "")]
    for most in (terms.COMMON, 3):
        monkeypatch.setattr(terms, "COMMON", most)
        for name in ("l22_naive_bayes_fit", "l22_naive_bayes_predict", "l22_naive_bayes_confusion", "n10_word_frequency_encode"):
            equals_sql(spark, name, tmp_path, {"documents": (rows, "doc_id long, text string, lang string")})


def test_text_vectors_equal_those_of_token_columns(spark, monkeypatch):
    """Features of n-grams of texts, in slices, as the steps on arrays of strings make them."""
    from larkspur import apps
    from larkspur.operators import terms
    from larkspur.plans import nodes

    monkeypatch.setattr(terms, "SLICE", 200)
    df = spark.createDataFrame(documents(np.random.default_rng(12), 60), "id long, text string, lang string").where("text IS NOT NULL")
    new = nodes.CommonTexts(25, 1, 2).with_data(df)(df).get()
    old = apps.TERMS.and_then(apps.Grams(1, 2)).and_then(nodes.CommonFeatures(25), df)(df).get()
    assert {r.id: r.x for r in new.collect()} == {r.id: r.x for r in old.collect()}
    thin = {r.id: (r.i, r.v) for r in terms.vectors(df, ["id"], "text", [("a", 4), ("b", 1)], presence=False, dense=False).collect()}
    for r in terms.vectors(df, ["id"], "text", [("a", 1), ("b", 0)], presence=False).collect():
        i, v = thin[r.id]
        assert dict(zip(i, v)) == {k: n for k, n in ((4, r.x[1]), (1, r.x[0])) if n}


def test_counts_by_partition_are_sorted_runs(spark):
    """no table of a partition's n-grams in Python; runs go on from batch to batch."""
    from larkspur.operators import ngrams

    df = spark.createDataFrame([([["a", "b"], ["b", "c"]] * 3,), ([["b", "c"]],)], "g array<array<string>>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = ngrams.counts(df, F.col("g"), add=False)
        assert sorted((*r.ngram, r["count"]) for r in got.collect()) == [("a", "b", 3), ("b", "c", 4)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" in plan and "Exchange" not in plan


def test_block_descent_reads_its_rows_once(spark):
    """rows are read once and kept as blocks of bytes for all passes."""
    from larkspur.operators import learn

    rng, read = np.random.default_rng(13), spark.sparkContext.accumulator(0)
    a = rng.normal(size=(40, 4))
    seen = F.udf(lambda v: (read.add(1), v)[1], "array<double>")
    df = spark.createDataFrame([(x.tolist(), [float(x @ [1, 2, 3, 4])]) for x in a], "x array<double>, y array<double>").withColumn("x", seen("x"))
    m = learn.block_least_squares(df, F.col("x"), F.col("y"), 4, 1, 2, 30, gram_bytes=0)
    assert np.allclose(m.weights[:, 0], [1, 2, 3, 4], atol=1e-4) and read.value == 40


def test_common_terms_are_told_apart_by_where_they_appear(spark, monkeypatch):
    """The same space as by the first place of every term, whatever ties there are; terms are added up without a sort."""
    from larkspur.operators import sparse, terms

    df = spark.createDataFrame(documents(np.random.default_rng(14), 60), "id long, text string, lang string")
    for ties in (10_000, 1):
        monkeypatch.setattr(terms, "TIES", ties)
        for size in (1, 7, 40, 100_000):
            want = sparse.most_common(terms.seen(df, "id", "text", 1, 2), size)
            assert dict(terms.most_common(df, "id", "text", size, 1, 2)) == {r.term: r.idx for r in want.collect()}
    assert terms.most_common(df.limit(0), "id", "text", 5) == []
