import random
import re

import numpy as np

from quillon.llm import latent

D = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, item_id long, lcs string, terms string"
ITEMS = "item_id long, text string, doc_id long, answer string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k], row[k + 1])
    return row[-1]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def test_bit_parallel_subsequence_is_the_longest():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert latent.common_subsequence(latent._masks(np.array(a)), len(a), b) == lcs(a, b)


def test_sums_of_segments():
    rng = np.random.default_rng(0)
    source = rng.random((50, 7)).astype(np.float32)
    sizes = np.array([1, 3, 500, 64, 65, 1, 2])
    index, starts = rng.integers(0, 50, sizes.sum()), np.cumsum(sizes) - sizes
    want = [source[index[a : a + n]].sum(axis=0) for a, n in zip(starts, sizes)]
    assert np.allclose(latent.sums(source, index, starts), want, rtol=1e-4)


def test_latent_space_is_that_of_the_whole_matrix(spark):
    """Against numpy's decomposition of the same TF-IDF rows, made whole on the driver."""
    p = latent.Params(rank=4, oversample=8, iterations=6)
    rng = random.Random(5)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(4)]
    texts = [" ".join(rng.choice(topics[i % 4]) for _ in range(50)) for i in range(60)]
    items = latent.Items.of([(k, " ".join(t)) for k, t in enumerate(topics)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = latent.coded(docs, items.vocabulary, p)
    idf = np.ones(len(items.vocabulary), np.float32)
    got = latent.latent_space(table.df, items, idf, p)
    rows = []
    for part in [w[k : k + p.width] for w in map(words, texts) for k in range(0, len(w), p.width)] + [words(" ".join(t)) for t in topics]:
        v = np.zeros(len(idf))
        for w in part:
            v[items.vocabulary[w]] += 1
        rows.append(v / np.sqrt(len(part)))
    _, s, vt = np.linalg.svd(np.array(rows))
    overlap = np.linalg.svd(vt[:4] @ np.linalg.qr(got.astype(float))[0])[1]
    assert overlap.min() > 0.999
    power = s[:4] ** 2
    assert np.allclose(np.sort(1 / np.linalg.norm(got, axis=0))[::-1] ** 2, power + power.mean(), rtol=0.01)


def test_recall_against_brute_force(spark):
    docs, bench = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    p, items = latent.Params(), {r.item_id: words(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in latent.leaks(docs, bench).collect()}
    verdict = latent.Items.of([(r.item_id, r.text) for r in bench.collect()])
    names = {k: w for w, k in verdict.vocabulary.items()}
    answers = {i: [names[k] for k in a.tolist()] for i, a in zip(verdict.ids, verdict.answers)}
    want = set()
    for r in docs.collect():
        w = words(r.text)
        there = set(w)
        for i, item in items.items():
            if sum(x in there for x in item) < p.lcs * len(item):
                continue
            for at in latent._starts(len(w), p):
                part = w[max(0, at - len(item)) : at + p.width + len(item)]
                if lcs(item, part) >= p.lcs * len(item) and lcs(answers[i], part) >= p.answer * len(answers[i]):
                    want.add((r.doc_id, i))
                    break
    assert len(want) >= 20 and got == want


def fill(rng, n):
    return " ".join(f"f{rng.randrange(3000)}" for _ in range(n))


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(2)
    item = "Which river runs through the old town of Bern and joins the Rhine near Koblenz in the north? The river Aare does."
    other = "A train leaves at nine and covers sixty miles each hour until noon when it stops. It has gone one hundred eighty miles."
    loose = item.replace("old", "ancient").replace("joins", "later meets").replace("near", "close to")
    rows = [(k, fill(rng, 200)) for k in range(40)]
    rows += [(100, fill(rng, 100) + " " + item + " " + fill(rng, 50)), (101, fill(rng, 70) + " " + loose), (102, other), (102, other), (103, None), (104, ""), (105, "!!"), (None, item), (106, fill(rng, 30_000) + " " + item)]
    docs = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], DOCS)
    bench = spark.createDataFrame([(1, item, 5, "z"), (2, other, 5, "z"), (2, other, 5, "z"), (3, other, 5, "z"), (4, None, 5, "z"), (5, "", 5, "z"), (None, item, 5, "z")], ITEMS)
    got = sorted((r.doc_id, r.item_id) for r in latent.leaks(docs, bench).collect())
    assert got == [(100, 1), (101, 1), (102, 2), (102, 3), (106, 1)]
    kept = latent.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(40)) | {103, 104, 105}


def test_blocks_of_items_change_nothing(spark):
    docs, bench = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    rows = lambda **p: sorted(tuple(r) for r in latent.leaks(docs, bench, latent.Params(**p)).collect())
    one, size = rows(), sum(len(r.text or "") for r in bench.collect())
    assert len(one) > 10 and rows(block_chars=size // 2 - 1) == one == rows(block_chars=size // 7)


def test_paraphrases_of_short_items_against_brute_force(spark):
    big, rng = "/root/testdata/sf0.1", random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{big}/documents.parquet").collect() if r.text]
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{big}/benchmark.parquet").collect()]
    vocabulary = [w for t in rng.sample(texts, 300) for w in words(t)]
    verdict = latent.Items.of(rows)
    names, planted, want = {k: w for w, k in verdict.vocabulary.items()}, [], []
    for i, item, answer in [x for x in zip(verdict.ids, verdict.words, verdict.answers) if len(x[1]) <= 24] * 3:
        item, answer = [names[k] for k in item.tolist()], [names[k] for k in answer.tolist()]
        said = list(item)
        for k in rng.sample(range(len(item)), int(0.35 * len(item))):
            said[k] = rng.choice(vocabulary)
        host = rng.choice(texts).split()
        at = rng.randrange(len(host) + 1)
        planted.append((10**9 + len(planted), " ".join(host[:at] + said + host[at:])))
        if lcs(item, said) >= 0.6 * len(item) and lcs(answer, said) >= 0.5 * len(answer):
            want.append((planted[-1][0], i))
    docs = spark.createDataFrame(list(enumerate(texts)) + planted, "doc_id long, text string").repartition(8)
    got = {(r.doc_id, r.item_id) for r in latent.leaks(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert len(want) > 80 and sum(x in got for x in want) >= 0.9 * len(want)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "some words here", 7, "x", "y")], DOCS), spark.createDataFrame([(1, "a question of words", 1, "z")], ITEMS)
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0)), (docs.limit(0), bench.limit(0))):
        assert latent.leaks(d, b).count() == 0 and latent.without_leaks(d, b).count() == d.count()
