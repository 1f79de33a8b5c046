"""The pipeline's stages: what each keeps, against brute force."""

import random

import pytest
from brute import near_duplicates
from pyspark.sql import functions as F

import corpus_pipeline
from dqspark.llm.bloom import without


def natural(rng, n):
    syllables = "the an tion re in ou er st nd ha ly ble ing sh wh ea on at es of".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [natural(rng, rng.choice([80, 150, 300])) for _ in range(120)]
    item = natural(rng, 30)
    docs = list(enumerate(texts))
    docs += [(200 + k, texts[k] + " extra") for k in range(10)] + [(300, texts[0]), (301, None), (302, ""), (303, "word " * 200)]
    docs += [(400, natural(rng, 60) + " " + item + " " + natural(rng, 60)), (500, natural(rng, 20))]
    docs += [(600 + k, " ".join(w + "###" for w in natural(rng, 100).split(" "))) for k in range(40)]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string"
    spark.createDataFrame(docs, schema).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "kept": F.lit("clash"), "_own": F.lit("o"), "_text": F.lit("t"), "score": F.lit(-1.0), "predicted": F.lit(0), "_tied": F.lit(None).cast("string")}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(600 + k, 0, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(docs)


def test_stages(spark, folder):
    path, docs = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    now, kept = table, set(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, path)
        assert out.columns == table.columns, name
        left = {r["doc_id"] for r in out.collect()}
        if name == "quality rules":
            assert kept - left >= {301, 302, 303, 500} and min(kept - left - {301, 302, 303, 500}, default=600) >= 600
        if name == "quality classifier":
            assert kept - left == {i for i in kept if i >= 600}
        if name == "near duplicates":
            rows = near_duplicates([(i, docs[i]) for i in sorted(kept)], 5, 80, 100)
            assert left == {i for i, _, c in rows if i == c} and kept - left >= {300, *range(200, 210)}
        if name == "decontamination":
            assert kept - left == {400}
        now, kept = spark.createDataFrame(out.collect(), table.schema), left
    last = corpus_pipeline.STAGES[-1][1](spark, now, path).collect()
    assert {r["doc_id"] for r in last} == kept and all(r["round_trip"] for r in last)


def test_rows_of_one_id_go_together_and_rows_without_stay(spark, folder):
    path, docs = folder
    rng = random.Random(12)
    text, other, item = natural(rng, 100), natural(rng, 100), docs[400]
    rows = [(1, text), (2, text), (2, other), (None, text), (None, item), (3, item), (3, other), (4, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted(corpus_pipeline.near_duplicates(spark, table, path).collect(), key=repr)
    # a row of 2 is a copy of 1, one of 3 a copy of the other row of 2: all rows of such an id go, nameless ones stay
    assert [r["doc_id"] for r in near if r["doc_id"] is not None] == [1, 4] and sum(r["doc_id"] is None for r in near) == 2
    clean = [r["doc_id"] for r in corpus_pipeline.decontamination(spark, table, path).collect()]
    assert sorted(clean, key=repr) == sorted([1, 2, 2, None, None, 4], key=repr)


def test_run_and_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 100
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_without(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
    assert sorted(r["v"] for r in without(rows, rows.where("k = 2"), "k").collect()) == ["a", "d"]
    assert without(rows, rows.where("false"), "k").count() == 4
