import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ridgeline.llm import secrets  # noqa: E402
from tests.llm.test_llm import brute_components, brute_hits, clashing, frame  # noqa: E402


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(900_001, None, "en", "src0", 0), (900_002, "12 34", "en", "src0", 5), (None, "only the und of la que est", None, None, 26), (900_003, "only the und of la que est", None, None, 26), (3, docs.where("doc_id = 3").first().text, "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3)
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    rows = [r for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, frame):
        stages[name](spark, frame, sf).write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        return spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")

    one = step("language ID", docs)
    assert one.columns == docs.columns
    assert {r.doc_id for r in rows} - {r.doc_id for r in one.collect()} == {900_001, 900_002} and one.count() == len(rows) - 2

    two = step("n-gram Jaccard join", one)
    kept = one.collect()
    expected, _ = brute_components([r.text for r in kept], [r.doc_id if r.doc_id is not None else 1 << 62 for r in kept])
    assert sorted(r.doc_id for r in two.collect()) == sorted({i for i, _, c in expected if i == c})

    three = step("benchmark decontamination", two)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = two.collect()
    bad = {r.doc_id for r, h in zip(before, brute_hits([r.text for r in before], items), strict=True) if h[4]}
    assert bad and {r.doc_id for r in three.collect()} == {r.doc_id for r in before} - bad

    four = step("secret scans", three)
    ranks = secrets.fit_words(three)
    assert {r.doc_id: r.text for r in four.collect()} == {r.doc_id: secrets.redacted(r.text, ranks=ranks) for r in three.collect()}
    assert four.where(F.col("n_chars") != F.length("text")).count() == 0 and four.columns == docs.columns

    five = step("mixing sources to target weights", four)
    assert set(r.doc_id for r in five.collect()) <= {r.doc_id for r in four.collect()}
    assert five.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    words = F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    taken, every = five.agg(F.sum(words)).first()[0], four.agg(F.sum(words)).first()[0]
    assert abs(taken - 1.5 * every) < 0.05 * every


def test_copies_of_lists_of_two_go(spark, sf):
    """A text between two that aren't alike takes both with it; each shares a shingle with it in a list of two only."""
    texts = []
    for k in range(40):
        w = [f"w{k}x{j}" for j in range(8)]
        texts += [" ".join(w), " ".join(w[:7]), " ".join(w[1:])]
    kept = corpus_pipeline.deduplicate(spark, frame(spark, texts), sf)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, len(texts), 3))


def test_chains_leave_one_text(spark, sf):
    """Texts that are alike only from one to the next: the first id of each chain stays, however long the chain."""
    w = [f"w{j}" for j in range(200)]
    order = list(range(60))
    random.Random(4).shuffle(order)
    texts = [" ".join(w[2 * k : 2 * k + 40]) for k in order] + ["a text that is like no other one here"]
    kept = corpus_pipeline.deduplicate(spark, frame(spark, texts), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 60]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_with_clashing_columns(spark, sf, tmp_path):
    """Documents may have columns of the names that stages use inside; nulls and repeated rows go through every stage."""
    texts = ["password: xQvRt7LmWpZk and so on", "some more words here", "some more words here", None, "", "12 34"] + [f"text number {i} of a few words" for i in range(20)]
    docs = clashing(spark, frame(spark, texts, [1, 2, 2, None, None, 6, *range(10, 30)], sources=[None, *["a"] * 25]))
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[: len(names)] == names and docs.count() > 0
    assert docs.columns == [*names, "copy_no_"]
