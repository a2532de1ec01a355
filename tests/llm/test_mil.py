import numpy as np

from quillon.llm import mil


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = mil.Params(hidden=5, gate=3)
    m = mil.Model(7, p, 1)
    for n in m.NAMES:
        setattr(m, n, getattr(m, n).astype(float))
    sizes = np.array([1, 4, 2])
    starts, x, y = np.array([0, 1, 5]), rng.standard_normal((7, 7)), np.array([1.0, 0.0, 1.0])

    def loss():
        out = m.forward(x, starts, sizes)[-1]
        return -np.mean(y * np.log(out) + (1 - y) * np.log(1 - out))

    grads, _ = m.gradients(x, starts, sizes, y)
    for n in m.NAMES:
        a = getattr(m, n)
        for at in list(np.ndindex(a.shape))[:12]:
            keep = a[at]
            a[at] = keep + 1e-5
            up = loss()
            a[at] = keep - 1e-5
            down = loss()
            a[at] = keep
            assert abs((up - down) / 2e-5 - grads[n][at]) < 1e-6


def test_forward_pass_against_loops():
    """Passage by passage and bag by bag, with the formulas written out."""
    import math

    rng = np.random.default_rng(3)
    m = mil.Model(6, mil.Params(hidden=4, gate=3), 2)
    bags = [rng.standard_normal((n, 6)).astype(np.float32) for n in (1, 5, 2)]
    sizes = np.array([len(b) for b in bags])
    *_, a, z, y = m.forward(np.concatenate(bags), np.cumsum(sizes) - sizes, sizes)
    at = 0
    for k, bag in enumerate(bags):
        hs, ss = [], []
        for x in bag:
            h = [math.tanh(sum(float(x[i]) * float(m.W[i, j]) for i in range(6)) + float(m.b[j])) for j in range(4)]
            gate = [math.tanh(sum(h[i] * float(m.V[i, j]) for i in range(4))) / (1 + math.exp(-sum(h[i] * float(m.U[i, j]) for i in range(4)))) for j in range(3)]
            hs.append(h)
            ss.append(math.exp(sum(g * float(w) for g, w in zip(gate, m.w))))
        weights = [s / sum(ss) for s in ss]
        whole = [sum(w * h[j] for w, h in zip(weights, hs)) for j in range(4)]
        assert np.allclose(a[at : at + len(bag)], weights, atol=1e-5) and np.allclose(z[k], whole, atol=1e-5)
        assert abs(y[k] - 1 / (1 + math.exp(-sum(c * float(v) for c, v in zip(whole, m.c)) - float(m.d[0])))) < 1e-5
        at += len(bag)


def test_equal_passages_attend_to_the_first():
    m = mil.Model(mil.SURFACE, mil.Params(), 1)
    m.w = m.w * 0  # all passages weigh the same
    learned = {"words": {}, "heads": {"quality": 1.0, "toxic": {n: getattr(m, n) for n in m.NAMES}}}
    _, _, at = mil.Scorer(learned, mil.Params()).score(["same words here now " * 12 * 4, "x"])
    assert at.tolist() == [0, 0]


def test_held_out_accuracy(spark):
    """Groups of near copies are held out whole."""
    from pyspark.sql import functions as F

    from quillon.llm import neardup

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    groups = neardup.near_duplicates(docs.join(labels, "doc_id", "left_semi")).select("doc_id", "group_id")
    labels = labels.join(groups, "doc_id", "left").withColumn("fold", F.coalesce("group_id", "doc_id") % 5).drop("group_id")
    out = mil.scored(docs, labels.where("fold <> 0")).join(labels.where("fold = 0").withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t"), "doc_id").toPandas()
    assert len(out) > 500
    assert ((out.quality >= 0.5) == (out.q == 1)).mean() > 0.97
    assert ((out.toxic >= 0.5) == (out.t == 1)).mean() > 0.95
    clean = out[(out.q == 1) & (out.t == 0)]
    assert clean.kept.mean() > 0.97 and out[out.t == 1].kept.mean() < 0.2


def test_attention_finds_the_passage():
    plain = "calm words go on and on in even lines of text here now " * 12
    rows = [plain + ("vile " * 3 if k % 2 else "") + plain for k in range(200)]
    y = np.array([k % 2 for k in range(200)], np.float32)
    learned = mil.fit_sample(rows, {"quality": 1 - y, "toxic": y})
    sizes, out, at = mil.Scorer(learned, mil.Params()).score(rows[:2])
    assert out["toxic"][0] < 0.5 < out["toxic"][1]
    assert at[1] in range(len(plain.split()) // 48 - 1, len(plain.split()) // 48 + 2)


SCHEMA = "doc_id long, text string, quality string, attended string"


def test_odd_rows(spark):
    rows = [(k, "good calm words " * 9 if k % 2 else "BAD!!! ### $$$ " * 9, "q", "a") for k in range(60)]
    rows += [(100, None, "q", "a"), (101, "", "q", "a"), (102, " \n ", "q", "a"), (103, "good calm words " * 30_000, "q", "a"), (1, rows[1][1], "q", "a"), (None, "x", "q", "a")]
    labels = [(k, k % 2, 0, "t") for k in range(60)] + [(None, 1, 1, "t"), (7, None, 0, "t"), (9, 1, 0, "t"), (11, 0, 0, "t")]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    out = mil.scored(docs, labels).collect()
    assert len(out) == 65 and sum(r.doc_id == 1 for r in out) == 2
    by = {r.doc_id: r for r in out}
    assert by[1].quality > 0.5 > by[0].quality and by[103].kept and by[103].n_passages == 1875
    assert by[100].n_passages == by[101].n_passages == by[102].n_passages == 1
    assert all(r.toxic == 0 for r in out)  # one class only: its share
    again = {r.doc_id: r.quality for r in mil.scored(docs, labels).collect()}
    assert all(again[r.doc_id] == r.quality for r in out)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "words", "q", "a")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mil.scored(docs.limit(0), labels).count() == 0
    r = mil.scored(docs, labels).first()
    assert (r.quality, r.toxic, r.kept) == (1.0, 0.0, True)
