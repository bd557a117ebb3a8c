"""The pipeline's stages against brute force, on planted documents."""

import random

import pytest

import corpus_pipeline
from larkspur.llm import mixing, packing, quality, simhash
from tests.llm.test_operators import SCHEMA, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    clean = ["\n".join(prose(rng, 40).capitalize() + "." for _ in range(4)) for _ in range(60)]
    near = []
    for t in clean[:10]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    bad = ["\n".join(" | ".join(prose(rng, 1) for _ in range(9)) for _ in range(4)) for _ in range(8)]
    texts = clean + clean[:15] + near + bad + [None, ""]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path, rows, len(clean)


def test_stages(spark, folder):
    path, rows, n = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{path}/out{k}")
            docs = spark.read.parquet(f"{path}/out{k}")
            kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        else:
            placed = {r.doc_id for r in out.collect()}
    judged = {r.doc_id for r in quality.judge_lines(spark.createDataFrame(rows, SCHEMA)).where("keep").collect()}
    assert set(kept[0]) == judged == set(range(n + 25))  # clean, copies and near copies; neither bad, null nor empty
    assert kept[1] == sorted({t: i for i, t, *_ in reversed(rows[: n + 25])}.values())
    assert kept[2] == list(range(n))
    assert set(kept[3]) <= set(kept[2]) and placed == set(kept[3])


def test_run_equals_stages(spark, folder):
    path, _, n = folder
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} <= set(range(n)) and len(out) > n / 2
    assert simhash.MAX_BITS < 31 * simhash.BLOCKS


def test_mix_reaches_the_shards(spark, tmp_path):
    rng = random.Random(10)
    docs = spark.createDataFrame([(i, prose(rng, 2000), "en", f"s{rng.randrange(3)}", 0, "kept") for i in range(60)], SCHEMA + ", slot string")
    out = corpus_pipeline.source_mixing(spark, docs, "")
    assert out.columns == docs.columns
    out.write.parquet(f"{tmp_path}/mixed")
    slot = {r.doc_id: r["_slot"] for r in mixing.mix(docs).collect()}
    packed = packing.pack(spark.read.parquet(f"{tmp_path}/mixed"), shard_tokens=50_000, in_order=True).collect()
    shard = {r.doc_id: r.shard for r in packed}
    assert set(shard) == set(range(60)) and max(shard.values()) > 5
    along = [shard[i] for i in sorted(shard, key=lambda i: (slot[i], i))]
    assert along == sorted(along)
