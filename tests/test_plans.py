"""The pipeline graph and its rules, sources, streaming, and the catalogue against SQL."""

import io
import os
import tarfile
from dataclasses import dataclass

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import catalogue
from larkspur.plans import pipeline as P
from larkspur.plans.graph import Graph, node
from larkspur.sources import readers
from larkspur.streaming.apply import serve

FITS = []


@dataclass(frozen=True)
class Add(P.Transformer):
    n: float

    def transform(self, df):
        return df.withColumn("x", F.col("x") + self.n)


@dataclass(frozen=True)
class AddMean(P.Estimator):
    tag: str = ""

    def fit(self, df):
        FITS.append(self.tag)
        return Add(df.agg(F.avg("x")).first()[0])


@dataclass(frozen=True)
class Either(P.Optimizable, AddMean):
    def choose(self, sample):
        return AddMean("chosen" if sample.count() else "empty")


@pytest.fixture
def env():
    FITS.clear()
    P.ENV.reset()
    return P.ENV


def xs(df):
    return [r.x for r in df.orderBy("k").collect()]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(0, 1.0), (1, 3.0)], "k int, x double")


def test_fit_once(data, env):
    pipe = Add(1).and_then(AddMean(), data).and_then(Add(10))
    assert FITS == []
    r = pipe(data)
    assert xs(r.get()) == [15, 17] and r.get() is r.get() and FITS == [""]
    assert xs(pipe(data).get()) == [15, 17] and FITS == [""]
    fitted = pipe.fit()
    assert FITS == [""] and xs(fitted.transform(data)) == [15, 17]


def test_save_and_load(data, env, tmp_path):
    fitted = Add(1).and_then(AddMean(), data).fit()
    fitted.save(str(tmp_path / "m"))
    assert xs(P.Fitted.load(str(tmp_path / "m")).transform(data)) == [5, 7]


def test_gather_merge_and_unused(data, env):
    g = P.Pipeline.gather("k", a=Add(1), b=Add(1).and_then(Add(1)))
    r = g(data)
    assert [(q.a_x, q.b_x) for q in r.get().orderBy("k").collect()] == [(2, 3), (4, 5)]
    merged = P.merge_equal(r.graph, env)
    assert len(r.graph.operators) - len(merged.operators) == 1
    lone, _ = merged.add_node(Add(9), (node(0),))
    assert P.unused_branches(lone, env).operators == merged.operators
    assert "digraph" in merged.to_dot()


def test_choice_by_sample(data, env):
    assert xs(P.Identity().and_then(Either(), data)(data).get()) == [3, 5] and FITS == ["chosen"]


def test_caches(data, env):
    g = P.Pipeline.gather("k", a=Add(2), b=Add(3))
    shared = Add(1).pipeline().and_then(g)(data).graph
    cached = P.cache_shared(shared, env)
    assert sum(isinstance(o, P.Cacher) for o in cached.operators.values()) >= 1
    slow = {i: P.Profile(10.0 if isinstance(o, Add) and o.n == 1 else 1.0, 5.0) for i, o in shared.operators.items()}
    base = P.run_time(shared, slow, set())
    chosen = P.cache_greedy(shared, slow, 5.0)
    assert len(chosen) == 1 and P.run_time(shared, slow, chosen) < base and P.cache_greedy(shared, slow, 1.0) == set()
    p = P.scale_profile([(2, P.Profile(20, 4)), (4, P.Profile(40, 8))], 100)
    assert (round(p.ns), round(p.memory)) == (1000, 200)


def test_graph_surgery():
    g, s = Graph().add_source()
    g, a = g.add_node("a", (s,))
    g, b = g.add_node("b", (a,))
    g, t = g.add_sink(b)
    assert g.ancestors(t) == {s, a, b} and g.descendants(s) == {a, b, t} and g.order() == [s, a, b, t]
    with pytest.raises(ValueError):
        g.remove_node(a)
    h, u = Graph().add_source()
    h, c = h.add_node("c", (u,))
    h, v = h.add_sink(c)
    swapped = g.replace_nodes({a}, h, {u: s}, {a: v})
    assert sorted(swapped.operators.values()) == ["b", "c"] and swapped.inputs[b] == (node(2),)
    with pytest.raises(ValueError):
        g.add_node("d", (node(9),))


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2.5\n-3,4e1\n")
    assert [r.features for r in readers.dense_csv(spark, str(tmp_path / "m.csv")).collect()] == [[1, 2.5], [-3, 40]]
    (tmp_path / "r.json").write_text('{"overall": 4.0, "reviewText": "good"}\n{"overall": 2, "reviewText": "bad"}\n')
    assert sorted(map(tuple, readers.reviews(spark, str(tmp_path / "r.json"), 3.5).collect())) == [(0, "bad"), (1, "good")]
    for c in ("sci.med", "rec.autos"):
        (tmp_path / "news" / c).mkdir(parents=True)
        (tmp_path / "news" / c / "1").write_text(c + "\nbody")
    assert sorted((r.label, r.text[:3]) for r in readers.class_folders(spark, str(tmp_path / "news"), ["rec.autos", "sci.med"]).collect()) == [(0, "rec"), (1, "sci")]
    record = bytes([7]) + bytes(range(12))
    (tmp_path / "b.bin").write_bytes(record * 2)
    r = readers.binary_records(spark, str(tmp_path / "b.bin"), 2, 3, 2).collect()
    assert len(r) == 2 and r[0].label == 7 and r[0].image.data[:4] == [0, 6, 3, 9]
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for name in ("n1/a.jpg", "n2/b.jpg", "skip/c"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.tar").write_bytes(buffer.getvalue())
    members = readers.tar_members(spark, str(tmp_path / "t"), "n")
    labels = spark.createDataFrame([("n1 12",), ("n2 3",)], "value string")
    assert sorted((q.name, q.label) for q in readers.class_labelled(members, labels).collect()) == [("n1/a.jpg", 12), ("n2/b.jpg", 3)]
    many = spark.createDataFrame([("h,h,h,h,h",), ('0,3,0,0,"a.jpg"',), ('0,1,0,0,"a.jpg"',)], "value string")
    assert [(q.name, q.labels) for q in readers.multi_labelled(members, many).collect()] == [("n1/a.jpg", [0, 2])]
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row_id long, features array<double>")
    assert [q.label for q in readers.row_labelled(rows, spark.createDataFrame([("1 5",), ("2 9",)], "value string")).orderBy("row_id").collect()] == [4, 8]
    np.savetxt(tmp_path / "w.csv", np.eye(2), delimiter=",")
    assert readers.matrix_csv(str(tmp_path / "w.csv")).shape == (2, 2) and readers.files(spark, str(tmp_path / "t")).count() == 1


def test_fitted_pipeline_on_a_stream(spark, data, env, tmp_path):
    data.write.parquet(str(tmp_path / "in"))
    fitted = Add(1).and_then(AddMean(), data).fit()
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    serve(stream, fitted.transform, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert xs(spark.read.parquet(str(tmp_path / "out"))) == [5, 7]
    with pytest.raises(ValueError):
        AddMean().with_data(stream)(data).get()


SF = "/root/testdata/sf0.001"


def same(x):
    return "nan" if x != x else f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_catalogue_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(catalogue.SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(tuple(same(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(same(r[c]) for c in cols) for r in df.collect()) == want
