import random

import pytest
from test_native import base
from test_search import distance, linked, normal
from util import documents, odd_rows, prose

import corpus_pipeline
import __spark_entry__

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(k, prose(rng, 30)) for k in range(5)]
    rows = [r for r in odd_rows() if r[0] != 5]
    rows += [(100 + k, prose(rng, 150, lines=True), "en", rng.choice("abc")) for k in range(80)]
    rows += [(200 + k, rows[30 + k][1] + " one more", "en", "a") for k in range(10)]
    rows += [(300 + k, prose(rng, 60) + " " + items[k][1] + " " + prose(rng, 60), "en", "b") for k in range(5)]
    documents(spark, rows, clash=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(100 + k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    quality, near, clean, mixing, sharding = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, path)
    assert kept.columns == DOCUMENTS
    got = kept.collect()
    good = [r for r in rows if not base(r[1])[5]]
    assert {r["doc_id"] for r in got if r["doc_id"] and r["doc_id"] >= 100} == {r[0] for r in good if r[0] and r[0] >= 100}
    one = near(spark, spark.createDataFrame(got, kept.schema), path)
    assert one.columns == DOCUMENTS
    kept_one = one.collect()
    keyed = [(k, r["text"]) for k, r in enumerate(got)]
    groups = linked(keyed, 5, 80)
    of = {k: c for k, _, c, _ in groups}
    classes = {of[next(k for k, t in keyed if t == r["text"])] for r in kept_one}
    assert len(kept_one) == len(classes) == len(set(of.values()))
    free = clean(spark, spark.createDataFrame(kept_one, kept.schema), path)
    dirty = {r["text"] for r in kept_one if any(distance(normal(x), normal(r["text"])) <= int(0.08 * len(normal(x))) for _, x in items)}
    assert sorted(r["text"] for r in free.collect()) == sorted(r["text"] for r in kept_one if r["text"] not in dirty) and dirty
    mixed = mixing(spark, free, path)
    assert mixed.columns == DOCUMENTS and mixed.count() > 0
    assert sharding(spark, mixed, path).count() == mixed.count()


def test_run_and_registration(spark, folder):
    path, _, _ = folder
    out = corpus_pipeline.run(spark, path).collect()
    assert out and {r["shard"] for r in out} <= set(range(40))
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names


def test_empty_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_rows_that_look_alike_are_told_apart(spark, tmp_path):
    """Nulls in different columns, equal texts of two sources, ties, a very long text and clashing names."""
    rng = random.Random(41)
    text, path = prose(rng, 120), str(tmp_path)
    long_ = prose(rng, 60_000, lines=True)
    rows = [(None, text, "en", "a"), (1, text, None, "a"), (1, text, "en", None), (1, text, "en", None), (1, prose(rng, 120), "en", "b"), (2, long_, "en", "b"), (None, None, None, None), (3, "", "en", "b"), (4, prose(rng, 200), "xx", None)]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(9, long_[5000:5400])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    quality, near, clean, mixing, sharding = (f for _, f in corpus_pipeline.STAGES)
    as_rows = lambda df: sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)
    kept = quality(spark, docs, path)
    assert as_rows(kept) == sorted((r for r in rows if r[1]), key=str)  # all four equal texts, with their own columns
    one = as_rows(near(spark, docs, path))
    assert len(one) == 6 and sum(r[1] == text for r in one) == 1 and (None, None, None, None) in one
    free = as_rows(clean(spark, docs, path))
    assert free == sorted((r for r in rows if r[1] != long_), key=str)
    mixed = mixing(spark, docs, path)
    assert as_rows(mixed) == as_rows(mixing(spark, docs.repartition(5), path)) and {r[1] for r in as_rows(mixed)} <= {r[1] for r in rows if r[1]}
    assert sharding(spark, docs, path).count() == len(rows)
