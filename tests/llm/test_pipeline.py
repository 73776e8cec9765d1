"""The pipeline, stage by stage against brute force on what the stage before kept."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import decontam, pii, quality, simhash

from . import test_decontam, test_jaccard, test_packing, test_pii, test_quality
from .fixtures import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    planted = [
        (900_001, f"contact the team of {k} at person{k}@mail.example.org or by +1 (663) 555-68{k:02} about the {' '.join(f'topic{k}{i}' for i in range(20))}", "en", "planted", None)
        for k in range(5)
    ]
    planted = [(x[0] + i, *x[1:]) for i, x in enumerate(planted)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema)).union(docs.limit(20))
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{home}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS
    return out


def rows(part):
    return sorted((tuple(r) for r in part), key=str)


def test_quality_stage(spark, stages):
    kept = rows(stages[1])
    scored = quality.score(spark.createDataFrame(stages[0], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS)))
    good = {r["doc_id"] for r in scored.where("kept").collect()}
    assert kept == rows(r for r in stages[0] if r["doc_id"] in good)
    assert not any(test_quality.brute(r["text"])[5] for r in stages[1])


def test_near_dedup_stage(stages):
    ordered = sorted(stages[1], key=lambda r: r["doc_id"])
    want = [ordered[i] for i in test_jaccard.kept([(i, r["text"]) for i, r in enumerate(ordered)])]
    assert rows(stages[2]) == rows(want)


def test_decontamination_stage(spark, stages):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = {r[0]: r for r in test_decontam.brute([(r["doc_id"], r["text"]) for r in stages[2]], bench)}
    kept = {r["doc_id"]: r for r in stages[3]}
    assert set(kept) == {k for k, r in judged.items() if not r[5]}
    for r in stages[2]:
        if r["doc_id"] in kept:
            hits = judged[r["doc_id"]][2]
            if not hits:
                assert tuple(kept[r["doc_id"]]) == tuple(r)
            else:
                assert len(decontam.words_of(kept[r["doc_id"]]["text"].encode())) == judged[r["doc_id"]][1] - hits


def test_personal_data_stage(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert len(stages[4]) == len(stages[3]) and any("[EMAIL]" in r["text"] for r in stages[4])
    for r in stages[4]:
        old = before[r["doc_id"]]["text"]
        assert not any(test_pii.brute(r["text"]).values())
        if not any(test_pii.brute(old).values()) and not any(f"[{k.upper()}]" in r["text"] for k in pii.KINDS):
            assert r["text"] == old
        assert r["n_chars"] == (before[r["doc_id"]]["n_chars"] if r["text"] == old else len(r["text"]))


def test_packing_stage(stages):
    test_packing.check([(r["doc_id"], r["text"]) for r in stages[4]], stages[5])


def test_two_runs_are_equal(spark):
    one, two = (rows(corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert len(one) > 100 and one == two


def test_columns_of_any_name_stay(spark):
    names = ["__text", "__row", "__fp", "__words", "__ranges", "__items", "__new", "own", "row", "words", "cut_", "new_", "set_", "n_", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = {r["doc_id"] for r in docs.collect()}
    for stage in [f for _, f in corpus_pipeline.STAGES[:4]] + [lambda spark, d, sf: simhash.keep_one(d)]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[k] == f"{i}-{r['doc_id']}" for r in got for i, k in enumerate(names)) and {r["doc_id"] for r in got} <= ids


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if k < 4 else None
