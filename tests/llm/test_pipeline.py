"""The pipeline's stages on small data: each stage's decisions take effect and clean documents stay."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .data import CLASHES, empty_documents, odd_documents, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        out.append((name, docs))
    return out


def test_stages(spark, kept):
    from talentrank.llm import decontamination, ngram_join, quality

    source = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [source, *(d for _, d in kept)]
    assert [n for n, _ in kept] == [n for n, _ in corpus_pipeline.STAGES] and len(kept) == 5
    for before, after in zip(frames[:4], frames[1:5], strict=True):
        assert after.columns == source.columns and after.join(before, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= before.count()
    verdict = quality.judge_quality(source).where("kept").select("doc_id")
    assert sorted(r.doc_id for r in verdict.collect()) == sorted(r.doc_id for r in frames[1].select("doc_id").collect())
    again = ngram_join.jaccard_components(frames[3])
    assert again.where("doc_id <> component_id").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.benchmark_matches(frames[4], bench).count() == 0
    pieces = frames[5]
    assert pieces.select("doc_id").distinct().count() == frames[4].count()
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).where("n <> m").count() == 0


def test_near_copies_and_clean_documents(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = spark.read.parquet(f"{SF}/documents.parquet").join(kept[0][1], "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.where("quality = 1 and doc_id is not null").count() <= 0.1 * labels.where("quality = 1").count()


def test_near_duplicates_link_at_five_words_and_four_fifths(spark):
    rnd = random.Random(12)
    rows = [(k, words(rnd, rnd.randint(60, 200), 3000)) for k in range(12)]
    for k in range(60):  # each edited word is in up to five shingles
        w = rows[k % 12][1].split()
        for at in rnd.sample(range(len(w)), rnd.choice([1, 1, 2, 3, 4])):
            w[at] = f"new{k}"
        rows.append((12 + k, " ".join(w)))

    def left(n, percent):
        sets = [set(zip(*(t.split()[k:] for k in range(n)), strict=False)) for _, t in rows]
        root = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = [new if r == old else r for r in root]
        return sorted(set(root))

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == left(5, 80) and len(got) < len(left(3, 90))


def test_stages_take_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns; then no rows at all."""
    rnd = random.Random(13)
    odd = odd_documents(spark, long_words=12_000)
    plain = [(500 + k, words(rnd, 120, 4000), "en", "a", *["x"] * len(CLASHES)) for k in range(30)]
    docs = odd.unionByName(spark.createDataFrame([*plain, plain[0], plain[0]], odd.schema)).cache()
    empty = empty_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), "odd-stage")
        assert after.columns == docs.columns, name
        assert after.exceptAll(docs).count() == 0 and after.where("doc_id >= 500").select("doc_id").distinct().count() == 30, name
        assert stage(spark, empty, SF).count() == 0, name
        if name == "quality rules":
            assert after.where("text is null or trim(text) = ''").count() == 0
        if name == "n-gram Jaccard join":
            assert after.where("doc_id = 500").count() == 1
    pieces = corpus_pipeline.packed(spark, docs, SF)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert corpus_pipeline.packed(spark, empty, SF).count() == 0
