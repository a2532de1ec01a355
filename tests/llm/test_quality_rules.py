import math

import pytest

from quillon.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, cutoff int, symbols string, stratum string"
LABELS = "doc_id long, quality int, toxic int, lang string"


def exact_cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("n,alpha,level", [(50, 0.1, 0.05), (500, 0.02, 1e-4), (2000, 0.02, 1e-4), (10, 0.02, 0.01), (0, 0.1, 0.1)])
def test_most_false_is_the_exact_binomial_bound(n, alpha, level):
    k = q.most_false(n, alpha, level)
    assert k == -1 or exact_cdf(k, n, alpha) <= level
    assert n == 0 or exact_cdf(k + 1, n, alpha) > level
    if k >= 0:
        assert abs(q.binomial_cdf(k, n, alpha) - exact_cdf(k, n, alpha)) < 1e-9


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, lang, 1, "x", None) for i, t, lang in docs], SCHEMA), spark.createDataFrame([(i, y, 0, None) for i, y in labels], LABELS)


def test_cutoffs_are_proven_and_bad_texts_go(spark):
    good = [(k, f"Plain words number {'abcdefghij'[k % 10]} in a quiet line", "en") for k in range(900)]
    bad = [(1000 + k, "BUY!!! NOW$$$ &&& ### !!!", "en") for k in range(50)]
    rare = [(2000 + k, "BUY!!! NOW$$$ &&& ### !!!", "xx") for k in range(5)]
    docs, labels = frames(spark, good + bad + rare, [(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(2000, 1)])
    cut = q.thresholds(docs, labels).collect()
    assert {r.stratum for r in cut} == {"en"} and all(r.n_false <= q.most_false(r.n_good, 0.02, 0.05 / (2 * 5 * 19)) for r in cut)
    out = {r.doc_id: r.kept for r in q.judged(docs, labels).collect()}
    assert all(out[i] for i, *_ in good) and not any(out[i] for i, *_ in bad)
    assert all(out[i] for i, *_ in rare)  # nothing is proven in so small a stratum
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in out.items() if k}


def test_false_rejections_stay_within_alpha_on_new_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    out = q.judged(docs, half).join(labels.where("doc_id % 2 = 1 AND quality = 1"), "doc_id").groupBy("stratum").agg({"*": "count", "kept": "sum"} if False else {"*": "count"}).collect()
    kept = {r.stratum: r["count(1)"] for r in q.judged(docs, half).where("kept").join(labels.where("doc_id % 2 = 1 AND quality = 1"), "doc_id").groupBy("stratum").count().withColumnRenamed("count", "count(1)").collect()}
    for r in out:
        assert kept[r.stratum] >= (1 - q.Params().alpha) * r["count(1)"]


def test_odd_rows(spark):
    docs, labels = frames(spark, [(1, None, "en"), (2, "", None), (3, " ", "en"), (4, "Fine words.", None), (4, "Fine words.", None), (None, "x y", "en"), (5, "word " * 50_000, "en")], [(4, 1), (4, None), (None, 1), (5, 1), (5, 0)])
    out = sorted((r.doc_id, r.kept, r.rejected_by) for r in q.judged(docs, labels).collect())
    assert out == [(1, False, "empty"), (2, False, "empty"), (3, False, "empty"), (4, True, ""), (4, True, ""), (5, True, "")]
    assert sorted(r.doc_id for r in q.accepted(docs, labels).collect()) == [4, 4, 5]


def test_empty_tables(spark):
    docs, labels = frames(spark, [], [])
    assert q.judged(docs, labels).count() == 0 and q.accepted(docs, labels).count() == 0
    some, _ = frames(spark, [(1, "words", "en")], [])
    assert q.judged(some, labels).first().kept
