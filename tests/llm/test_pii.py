import random

import pytest

from quillon.llm import pii

SCHEMA = "doc_id long, text string, value string, pattern string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "v", "p", "k") for i, t in rows], SCHEMA)


@pytest.mark.parametrize(
    "value,kind",
    [("ann.b@mail.example.com", "email"), ("a@b", None), ("4111111111111111", "card"), ("4111111111111112", None), ("10.0.0.255", "ipv4"), ("10.0.0.256", None), ("10.0.00.1", None), ("+1 (743) 555-3824", "phone"), ("12345", None), ("4111 1111 1111 1111", "card"), ("4111-1111-1111-1111", "card"), ("4111 1111-1111 1111", None), ("3782 822463 10005", "card"), ("8.8.8.8", "ipv4")],
)
def test_seeds(value, kind):
    assert pii.seed_kind(value) == kind


def test_mentions_are_found_in_any_surrounding():
    text = 'Call +1 (743) 555-3824*** or ann.54@mail3.example.com### at 233.233.171.252!! card 4785380592391139$$$ version 3, Version 2.0. (id: AB123456) @ x@ 4.0'
    assert [v for _, _, v in pii.mentions(text, 5)] == ["+1 (743) 555-3824", "ann.54@mail3.example.com", "233.233.171.252", "4785380592391139", "AB123456"]
    assert all(text[a:b] == v for a, b, v in pii.mentions(text, 5))


def test_noise_between_the_groups_of_a_number(spark):
    noisy = "of&&& +1*** (743)$$$ 555-3824### the&&& at!! +1!! (212)!! 555-0000!!"
    assert [v for _, _, v in pii.mentions(noisy, 5)] == ["+1*** (743)$$$ 555-3824", "+1!! (212)!! 555-0000"]
    assert sorted((r.kind, r.start) for r in pii.identifiers(frame(spark, [(1, noisy)])).collect()) == [("phone", 6), ("phone", 45)]


def test_seed_forms_are_mentioned_whole():
    text = "at 192.168.1.20 and 161.17.88.1, +1 (826) 555-4081 190.137.22.5 or 10.0.0.1. 4111111111111111 10.20.30.40"
    assert [v for _, _, v in pii.mentions(text, 5)] == ["192.168.1.20", "161.17.88.1", "+1 (826) 555-4081", "190.137.22.5", "10.0.0.1", "4111111111111111", "10.20.30.40"]


def test_no_seed_form_of_real_texts_is_lost():
    """An independent scan of the raw texts for what stands between spaces, quotes, brackets and noise."""
    import re

    import duckdb

    forms = re.compile(r"(?<![\w.+@-])(?:\+1 ?\(\d{3}\) ?\d{3}-\d{4}|\d{1,3}(?:\.\d{1,3}){3}|\d{13,19}|[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![\w@-]|\.\w)")
    n = 0
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where text is not null").fetchall():
        want = {(m.start(), m.end()) for m in forms.finditer(text) if pii.seed_kind(m.group())}
        n += len(want)
        if want:
            assert want <= {(a, b) for a, b, _ in pii.mentions(text, 5)}
    assert n > 500


def brute(found, p):
    """The same rounds over dictionaries."""
    graph = {(v, x) for v, _, ps in found for x in ps}
    seeds = {v: k for v, k, _ in found if k}
    degree = {}
    for _, x in graph:
        degree[x] = degree.get(x, 0) + 1
    known = {v: (k, 1.0) for v, k in seeds.items()}
    while True:
        mass = {}
        for v, x in graph:
            if v in known:
                mass.setdefault((x, known[v][0]), []).append(known[v][1])
        sure = {k: round(sum(m) / (degree[k[0]] + p.smoothing), 6) for k, m in mass.items() if len(m) >= p.support}
        sure = {k: c for k, c in sure.items() if c >= p.pattern_confidence}
        left = {}
        for v, x in graph:
            for (y, kind), c in sure.items():
                if x == y:
                    left.setdefault(v, {}).setdefault(kind, []).append(1 - c)
        changed = False
        for v, kinds in left.items():
            best = max((round(1 - __import__("math").prod(m), 4), k) for k, m in kinds.items())
            if best[0] >= p.instance_confidence and best[0] > known.get(v, ("", 0))[1]:
                known[v], changed = (best[1], best[0]), True
        if not changed:
            return known


def corpus(rng):
    rows = []
    for k in range(40):
        host = f"{rng.randrange(10, 250)}.{rng.randrange(10, 250)}.{rng.randrange(10, 250)}.{rng.randrange(10, 250)}"
        rows.append((k, f"the user logged from address {host} at noon"))
    rows.append((50, "the user logged from address 999.10.10.10 at noon"))  # no seed: 999 is no byte
    rows += [(60 + k, f"order {rng.randrange(10**7, 10**8)} was sent") for k in range(10)]
    return rows


def test_confident_patterns_discover_what_no_rule_covers(spark):
    rows = corpus(random.Random(4))
    out = pii.identifiers(frame(spark, rows)).collect()
    by = {r.doc_id: r for r in out}
    assert by[50].discovered and by[50].kind == "ipv4" and by[50].confidence >= 0.7
    assert set(by) == {*range(40), 50}  # order numbers stay
    found = [(v, pii.seed_kind(v), pii.patterns(pii.Words(t), a, b, v)) for _, t in rows for a, b, v in pii.mentions(t, pii.Params().digits)]
    want = brute(found, pii.Params())
    got = pii.bootstrapped(spark.createDataFrame(found, "value string, seed string, patterns array<string>")).df.collect()
    assert {r.value: r.kind for r in got} == {v: k for v, (k, _) in want.items()}
    assert all(abs(r.confidence - want[r.value][1]) < 1e-3 for r in got)


def test_real_documents_keep_clean_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = pii.identifiers(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    seeds = {(i, a) for i, t in texts.items() for a, _, v in pii.mentions(t, 5) if pii.seed_kind(v)}
    assert len(seeds) > 50 and seeds <= {(r.doc_id, r.start) for r in out}
    assert not {r.doc_id for r in out} & {i for i, t in texts.items() if not any(c.isdigit() or c == "@" for c in t)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail ann@x.example.com"), (3, "mail ann@x.example.com"), (None, "mail bob@x.example.com"), (4, "word " * 40_000 + "ip 10.1.2.3"), (5, "@@@ 1@ @1 ...12345... (((9")]
    out = sorted((r.doc_id, r.kind, r.start) for r in pii.identifiers(frame(spark, rows)).collect())
    assert out == [(3, "email", 5), (3, "email", 5), (4, "ipv4", 200_003)]
    assert pii.identifiers(frame(spark, [])).count() == 0


def test_short_and_grouped_identifiers(spark):
    text = "dns 8.8.8.8, card 4111 1111 1111 1111 or 4111-1111-1111-1111; 378282246310005 and 3782 822463 10005."
    got = [(pii.seed_kind(v), v) for _, _, v in pii.mentions(text, 5)]
    assert got == [("ipv4", "8.8.8.8"), ("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1111"), ("card", "378282246310005"), ("card", "3782 822463 10005")]
    assert [r.kind for r in pii.identifiers(frame(spark, [(1, text)])).orderBy("start").collect()] == ["ipv4", "card", "card", "card", "card"]


def test_context_words_are_whole_however_far_away():
    far = "alpha" + " " * 300 + "b" * 200 + " " * 90 + "10.1.2.3" + " " * 90 + "omega" * 30
    at = far.index("10.1")
    assert pii.patterns(pii.Words(far), at, at + 8, "10.1.2.3")[1:] == [f"after {'b' * 200} 9.9.9.9", f"after alpha {'b' * 200} 9.9.9.9", f"before {'omega' * 30} 9.9.9.9"]


def test_a_chain_of_discoveries_longer_than_any_fixed_number_of_rounds(spark):
    """Seeds make the first pattern sure; the instances it finds make the next one sure, six times over."""
    found, p = [], pii.Params(smoothing=0.0, support=1, pattern_confidence=0.001, instance_confidence=0.001)
    found += [(f"s{k}", "email", ["p0"]) for k in range(6)]
    for j in range(6):
        found += [(f"v{j}-{k}", None, [f"p{j}", f"p{j + 1}"]) for k in range(3)]
    want = brute(found, p)
    got = pii.bootstrapped(spark.createDataFrame(found, "value string, seed string, patterns array<string>"), p).df.collect()
    assert {r.value: r.kind for r in got} == {v: k for v, (k, _) in want.items()} and any(v.startswith("v5") for v in want)
    assert all(abs(r.confidence - want[r.value][1]) < 1e-3 for r in got)


def test_equally_sure_kinds(spark):
    found = [(f"a{k}", "email", ["p"]) for k in range(5)] + [(f"b{k}", "phone", ["q"]) for k in range(5)] + [("x", None, ["p", "q"])]
    p = pii.Params(smoothing=0.0)
    got = {r.value: (r.kind, r.confidence, r.seed) for r in pii.bootstrapped(spark.createDataFrame(found, "value string, seed string, patterns array<string>"), p).df.collect()}
    assert got["x"][0] == "phone" and not got["x"][2] and got["a0"] == ("email", 1.0, True)
