from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratabranch.llm import common, decontam, mixing, quality, simhash
from stratabranch.llm.common import stored


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf_dir))
        seen[name] = (before, docs)
        if name != "pack":
            assert docs.columns == columns
    first, good = seen["quality"]
    kept = {r.doc_id for r in quality.report(first, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    before, single = seen["near_dedup"]
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in simhash.report(before).collect()})
    before, clean = seen["decontaminate"]
    hit = decontam.report(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in hit.where("NOT contaminated AND longest < 8").collect()}
    assert 0 < clean.count() < before.count()
    before, mixed = seen["mix"]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in mixing.report(before).where("copies > 0").collect()})
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in before.collect()}
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    packed = {d for r in docs.collect() for d in r.doc_ids}
    assert packed == {r.doc_id for r in mixed.collect()}


@pytest.mark.parametrize("n", [0, 1])
def test_stages_take_small_tables(spark, sf_dir, n):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(n)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    assert docs.count() <= n


def test_odd_rows_and_clashing_names(spark, sf_dir):
    """Null ids and texts, empty and very long ones, rows that repeat, and columns named like ours."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame(
        [(None, "a text without an id, and with some words", None, None, None), (None, None, "en", "s", 0), (900, None, "en", "s", 0), (901, "", "en", None, 0), (902, "the same words again and again " * 20_000, "en", "s", 1), (903, "twice", "en", "s", 5), (903, "twice", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    names = "fp kept odds host quality found bytes_ size_ u_ copies copy_ keep_id repeats part row".split()
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(odd).select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if name != "pack":
            assert docs.columns == columns, name
    assert docs.count() > 0


def test_run_leaves_its_last_folder_only(spark, sf_dir):
    before = common.stored_folders()
    docs = corpus_pipeline.run(spark, sf_dir)
    left = common.stored_folders() - before
    assert len(left) == 1 and docs.count() > 0
    root = Path(common.shared_folder(spark).removeprefix("file:"))
    assert {x.name for x in root.glob("stored-*")} >= {next(iter(left)).rsplit("/", 1)[1]}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
