import numpy as np

from lexmill.llm import toxicity


def test_labelled_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    # learn from even ids, test on odd ones
    model = toxicity.train(big, labels.filter("doc_id % 2 = 0"))
    assert [link.name for link in model.links] == ["low_quality", "toxic"]
    got = toxicity.score(big, model).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").collect()
    hits = sum(r.toxic and r.truth for r in got)
    assert hits >= 0.85 * sum(r.truth for r in got)
    assert sum(r.toxic and not r.truth for r in got) <= 0.01 * len(got)
    assert all(0 <= r.p_toxic <= 1 for r in got)


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    y1 = rng.random(400) < 0.5
    y2 = y1 ^ (rng.random(400) < 0.05)
    rows = [np.array(sorted({1 if a else 2, int(rng.integers(10, 40))}), np.uint64) for a in y1]
    chain = toxicity.train_chain(rows, np.stack((y1, y2), 1).astype(int), ["a", "b"])
    p = chain.predict(rows)
    assert ((p[:, 0] >= 0.5) == y1).all() and ((p[:, 1] >= 0.5) == y1).mean() > 0.98
    assert len(chain.links[1].weights) == len(chain.links[1].columns) + 1


def test_long_text_and_exact_features(spark):
    """A text of a million words is scored as a whole: one word at its end can decide."""
    rows = [np.array(sorted({1 if k % 2 else 2, 10 + k % 7}), np.uint64) for k in range(200)]
    chain = toxicity.train_chain(rows, np.array([[k % 2] for k in range(200)]), ["a"])
    assert set(chain.links[0].columns.tolist()) == {1, 2}
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(k, "plain words here " + ("vile" if k % 2 else "kind")) for k in range(60)], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    long = spark.createDataFrame([(1, "other " * 1_000_000 + "vile"), (2, "other " * 1_000_000 + "kind")], "doc_id long, text string")
    assert {r.doc_id: r.toxic for r in toxicity.score(long, model).collect()} == {1: True, 2: False}


def test_odd_rows(spark, odd, none, sf):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == odd.count()
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    nothing = toxicity.score(odd, toxicity.train(odd, labels.limit(0)))
    assert nothing.filter("toxic").isEmpty()
