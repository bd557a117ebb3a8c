"""Text, vector and n-gram functions against golden values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import murmur, text, vectors
from larkspur.operators import evaluate, ngrams, sparse


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()] or ["id"])
    return row.select(col.alias("x")).first()[0]


def test_strings(spark):
    a, b = "  The quick BROWN fo.X ", " ! !.,)JumpeD. ovER the LAZy DOG.. ! "
    assert one(spark, text.trim(F.lit("\t " + a + "\n"))) == a.strip()
    assert one(spark, text.tokenize(F.lit(a))) == ["", "The", "quick", "BROWN", "fo", "X"]
    assert one(spark, text.tokenize(F.lit(b))) == ["", "JumpeD", "ovER", "the", "LAZy", "DOG"]
    assert one(spark, text.tokenize(F.lit(""))) == [""] and one(spark, text.tokenize(F.lit(" .. "))) == []


def test_ngrams(spark):
    got = one(spark, text.ngrams(text.tokenize(F.lit("Pipelines are awesome")), 1, 3))
    assert got == [["Pipelines"], ["Pipelines", "are"], ["Pipelines", "are", "awesome"], ["are"], ["are", "awesome"], ["awesome"]]
    assert one(spark, text.ngrams(F.array().cast("array<string>"), 1, 2)) == []
    with pytest.raises(ValueError):
        text.ngrams(F.lit(None), 0, 1)


def test_packed_ngrams(spark):
    pack = lambda *w: one(spark, text.pack_ngram(F.array(*[F.lit(x) for x in w])))
    assert pack(1) == 1 << 40 and pack(1, 1) == (1 << 60) + (1 << 40) + (1 << 20) and pack(1, 1, 1) == (1 << 61) + (1 << 40) + (1 << 20) + 1
    p = F.lit(pack(7, 8, 9))
    assert [one(spark, text.unpack_word(p, k)) for k in range(3)] == [7, 8, 9] and one(spark, text.ngram_order(p)) == 3
    assert one(spark, text.remove_farthest_word(p)) == pack(8, 9) and one(spark, text.remove_current_word(p)) == pack(7, 8)
    with pytest.raises(Exception):
        pack(1 << 20)


def test_hashes(spark):
    assert one(spark, text.java_hash(F.lit("hello"))) == 99162322 and one(spark, text.java_hash(F.lit(""))) == 0
    assert one(spark, text.java_hash(F.lit("😀"))) == 0xD83D * 31 + 0xDE00
    h = np.array([5, -7, 11])
    every = murmur.ngram_hashes(h, 1, 2)
    assert every.tolist() == [*murmur.ngram_hashes(h, 1, 1), *murmur.ngram_hashes(h, 2, 2)] and len(every) == 5
    assert murmur.ngram_hashes(h[1:], 2, 2)[0] == murmur.ngram_hashes(h, 2, 2)[1]


def test_word_ranks_and_backoff(spark):
    df = spark.createDataFrame([(0, "Winter coming"), (1, "Winter Winter is coming")], "k int, text string").withColumn("w", text.tokenize(F.col("text")))
    ranks = ngrams.word_ranks(df, F.col("w"))
    assert {r.word: r.idx for r in ranks.collect()} == {"Winter": 0, "coming": 1, "is": 2}
    other = spark.createDataFrame([(0, ["hi", "Winter"])], "k int, w array<string>")
    assert [(r.pos, r.idx) for r in ngrams.encode(other, "k", F.col("w"), ranks).orderBy("pos").collect()] == [(0, -1), (1, 0)]
    df = spark.createDataFrame([("Winter is coming",), ("Finals are coming",), ("Summer is coming really soon",)], "text string").withColumn("w", text.tokenize(F.col("text")))
    uni = df.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    scores = ngrams.backoff_scores(ngrams.counts(df, text.ngrams(F.col("w"), 2, 5)), uni)
    ask = lambda *g: ngrams.backoff_query(spark.createDataFrame([(list(g),)], "ngram array<string>"), scores, uni, 3).first().score
    assert ask("is", "coming") == 1.0 and ask("is", "coming", "really") == 0.5
    assert ask("is", "unseen-coming") == 0 and abs(ask("Finals", "coming") - 0.4 * 3 / 11) < 1e-12


def test_vectors(spark):
    v = F.array(*[F.lit(x) for x in (-10.0, 42.4, -43.0, 23.0)])
    assert one(spark, vectors.top_k(v, 2)) == [1, 3] and one(spark, vectors.top_k(v, 9)) == [1, 3, 0, 2] and one(spark, vectors.argmax(v)) == 1
    assert one(spark, vectors.indicators(F.lit(2), 4)) == [-1, -1, 1, -1]
    with pytest.raises(Exception):
        one(spark, vectors.indicators(F.lit(4), 4))
    assert one(spark, vectors.multi_indicators(F.array(F.lit(2), F.lit(1)), 4)) == [-1, 1, 1, -1]
    assert one(spark, vectors.split(v, 3)) == [[-10, 42.4, -43], [23]]
    z = F.array(*[F.lit(x) for x in (0.0, 2.0, 0.0)])
    assert one(spark, vectors.densify(vectors.sparsify(z))) == [0, 2, 0] and one(spark, vectors.normalize(z)) == [0, 1, 0]
    assert one(spark, vectors.one_hot_nearest(z, [[0, 0, 0], [0, 2, 1], [0, 2, -1]])) == [0, 1, 0]
    assert one(spark, vectors.signed_hellinger(F.array(F.lit(-4.0)))) == [-2]


def test_common_features(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["c", "b"]), (2, ["c", "a"])], "k int, t array<string>")
    f = lambda **kw: {r.term: r.idx for r in sparse.common_features(df, "k", F.col("t"), 2, **kw).collect()}
    assert f() == {"c": 0, "b": 1} and f(tie="earliest") == {"a": 0, "b": 1}
    assert {r.term: r.idx for r in sparse.all_features(df, "k", F.col("t")).collect()} == {"a": 0, "b": 1, "c": 2}


def test_metrics(spark):
    data = [(True, True)] * 6 + [(False, True)] * 2 + [(True, False)] + [(False, False)] * 3
    m = evaluate.binary_metrics(evaluate.contingency(spark.createDataFrame(data, "p boolean, a boolean"), F.col("p"), F.col("a"))).first()
    assert (m.tp, m.fp, m.tn, m.fn) == (6, 1, 3, 2) and abs(m.recall - 0.75) < 1e-12 and abs(m.precision - 6 / 7) < 1e-12 and abs(m.accuracy - 0.75) < 1e-12
    none = evaluate.binary_metrics(evaluate.contingency(spark.createDataFrame([], "p boolean, a boolean"), F.col("p"), F.col("a"))).first()
    assert np.isnan(none.accuracy) and none.tp == 0
    mat = evaluate.confusion(spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "p int, a int"), F.col("p"), F.col("a"), 3)
    assert "a = 0" in evaluate.print_confusion(mat, 3) and evaluate.small_label(26) == "ab"
    rank = spark.createDataFrame([(k, s, [c]) for k, (s, c) in enumerate([([0.9, 0.1], 0), ([0.8, 0.7], 1), ([0.1, 0.9], 1)])], "r int, s array<double>, l array<int>")
    assert {r["class"]: r.ap for r in evaluate.average_precision(rank, "r", F.col("s"), F.col("l")).collect()} == {0: 1.0, 1: 1.0}
