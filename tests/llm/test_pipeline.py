import random

import corpus_pipeline as cp
from quillon.llm import bpe, latent, neardup, quality_rules, secrets
from tests.llm.test_latent import lcs, words
from tests.llm.test_neardup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "minhash near-dedup", "benchmark decontamination", "secret scan", "bpe"]


def fixture(spark, tmp_path, empty=False):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n)).replace("0", "o").replace("1", "l").translate(str.maketrans("23456789", "abcdefgh"))
    docs = [(k, say(120), "en", "s", 0) for k in range(600)]
    item = say(40)
    docs += [(700 + k, "BUY$$$ NOW### &&& !!! %%%" * 3, "en", "s", 0) for k in range(5)]
    docs += [(800, docs[3][1], "en", "s", 0), (801, docs[4][1] + " tail", "en", "s", 0), (802, f"{say(50)} {item} {say(30)}", "en", "s", 0), (803, say(80) + ' token = "0123456789abcdef0123"', "en", None, None)]
    docs += [(804, None, "en", "s", 0), (None, say(50), "en", "s", 0), (805, say(60), None, None, None), (5, docs[5][1], "en", "s", 0)]
    docs = [(i, t, a, b, len(t) if t and c == 0 else c) for i, t, a, b, c in docs]
    tables = {"documents": (docs, SCHEMA), "labels": ([(k, 1, 0) for k in range(600)] + [(700, 0, 0)], "doc_id long, quality int, toxic int"), "benchmark": ([(1, item)], "item_id long, text string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame([] if empty else rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return docs, item


def test_against_brute_force(spark, tmp_path):
    docs, item = fixture(spark, tmp_path)
    got = {r.doc_id: list(r.tokens) for r in cp.run(spark, str(tmp_path)).collect()}
    p, labels = latent.Params(), spark.read.parquet(f"{tmp_path}/labels.parquet")
    fine = quality_rules.judged(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels).where("kept").select("doc_id").collect()
    kept = {i: t for i, t, *_ in docs if i in {r.doc_id for r in fine}}
    assert 804 not in kept and not any(700 <= i < 705 for i in kept) and set(range(600)) <= set(kept)
    _, label = brute(kept, neardup.Params())
    kept = {i: t for i, t in kept.items() if label[i] == i}
    own = words(item)
    kept = {i: t for i, t in kept.items() if lcs(own, words(t)) < p.lcs * len(own)}
    assert 802 not in kept and 800 not in kept and 801 not in kept
    codec, scan = bpe.Codec(bpe.read_vocabulary()), secrets.Scanner()
    want = {}
    for i, t in kept.items():
        for start, end, name, *_ in reversed(scan.find(t)):
            t = f"{t[:start]}[{name}]{t[end:]}"
        want[i] = codec.encode(t)
    assert got == want and "[assigned_token]" in codec.decode(got[803])


def test_each_stage_keeps_the_columns(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_empty_tables(spark, tmp_path):
    fixture(spark, tmp_path, empty=True)
    assert cp.run(spark, str(tmp_path)).count() == 0
