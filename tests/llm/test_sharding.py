import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from quillon.llm import sharding

SCHEMA = "doc_id long, text string, shard int, link string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 99, "l", "s") for i, t in rows], SCHEMA)


def clusters(n, each, rng):
    rows = []
    for k in range(n):
        line = f"a line of cluster number {k} that all of its documents share"
        rows += [(k * each + j, f"{line}\nown text {rng.random()} of one document and no other one") for j in range(each)]
    return rows


def brute_cut(rows, shard, p):
    lines = {}
    for i, t in rows:
        for x in {x.strip().lower() for x in t.split("\n") if x.strip()}:
            lines.setdefault(x, set()).add(i)
    total = cut = 0.0
    for docs in lines.values():
        for a, b in itertools.combinations(docs, 2):
            total += 1 / (len(docs) - 1)
            cut += (shard[a] != shard[b]) / (len(docs) - 1)
    return cut, total


def test_linked_documents_come_together_and_sizes_stay_even(spark):
    rows, p = clusters(160, 12, random.Random(0)), sharding.Params(shards=4)
    df = frame(spark, rows)
    out = {r.doc_id: r.shard for r in sharding.shards(df, p).collect()}
    before = {r.doc_id: r.s for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("s")).collect()}
    was, total = brute_cut(rows, before, p)
    now, _ = brute_cut(rows, out, p)
    assert now < 0.35 * was
    sizes = Counter()
    for i, t in rows:
        sizes[out[i]] += len(t)
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 4 + 1
    docs, edges = sharding.linked(df, p)
    state = spark.createDataFrame(list(out.items()), "doc_id long, shard int")
    r = sharding.cut(edges.df, state).first()
    assert abs(r.cut - now) < 1e-3 and abs(r.total - total) < 1e-3


def test_quota_is_never_broken():
    rng = random.Random(1)
    for _ in range(200):
        k = rng.randrange(2, 6)
        sizes = [rng.randrange(50, 100) for _ in range(k)]
        whole, cap = sum(sizes), max(max(sizes), 95)
        wishes = [(a, b, rng.randrange(30), n, rng.randrange(1, 20)) for n in range(20) for a, b in [rng.sample(range(k), 2)]]
        moves = sharding.accepted(list(wishes), sizes, cap)
        assert max(sizes) <= cap and sum(sizes) == whole and len(set(moves)) == len(moves)
        left = [w for w in wishes if w[:4] not in set(moves)]
        assert all(sizes[b] + n > cap for _, b, _, _, n in left)  # nothing that fits is left


def test_odd_rows(spark):
    line = "the very same line in several documents of this table"
    rows = [(1, line), (2, line), (2, line), (3, None), (4, ""), (None, line), (5, "x" * 300_000), (6, line + "\n" + line), (7, "short")]
    out = sharding.shards(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.size) for r in out) == [(1, len(line)), (2, len(line)), (3, 1), (4, 1), (5, 300_000), (6, 2 * len(line) + 1), (7, 5)]
    assert all(0 <= r.shard < 8 for r in out)
    assert sharding.shards(frame(spark, [])).count() == 0
    assert [tuple(r) for r in sharding.shards(frame(spark, rows)).orderBy("doc_id").collect()] == sorted(map(tuple, out))


def twin(rows, p):
    """The same rounds in plain Python: ids are hashed as Spark hashes them, the rest is dictionaries."""
    import math
    import struct

    import xxhash

    def hashed(i, k=None):
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        h = h if k is None else xxhash.xxh64_intdigest(struct.pack("<i", k), h)
        return h - (1 << 64 if h >> 63 else 0)

    lines, size = {}, {}
    for i, t in rows:
        size[i] = max(size.get(i, 1), len(t))
        for x in {x.strip(" ").lower() for x in t.split("\n")} - {""}:
            lines.setdefault(x, set()).add(i)
    lines = {x: ds for x, ds in lines.items() if len(ds) > 1}
    weight = {x: sharding.UNIT // (len(ds) - 1) for x, ds in lines.items()}
    of = {}
    for x, ds in lines.items():
        for i in ds:
            of.setdefault(i, []).append(x)
    state = {i: hashed(i) % p.shards for i in size}
    sizes = [sum(n for i, n in size.items() if state[i] == s) for s in range(p.shards)]
    cap = max(int((1 + p.slack) * sum(sizes) / p.shards) + 1, max(sizes))
    total = sum(len(ds) * (len(ds) - 1) * weight[x] for x, ds in lines.items())
    best, top, stale, k = state, -1, 0, 0
    while total and stale < 2:
        counts = {x: Counter(state[i] for i in ds) for x, ds in lines.items()}
        within, wishes = 0, {}
        for i, xs in of.items():
            pull = Counter()
            for x in xs:
                for s, n in counts[x].items():
                    pull[s] += weight[x] * (n - (s == state[i]))
            home = pull[state[i]]
            within += home
            away, to = max((v, -s) for s, v in pull.items())
            if -to != state[i] and away > home and hashed(i, k) % 2 == 0:
                wishes.setdefault((state[i], -to, math.floor(math.log2(away - home)), hashed(i, -k - 1) % p.parts), []).append(i)
        stale = 0 if within > top + (p.settled * total if top >= 0 else 0) else stale + 1
        if within > top:
            best, top = state, within
        if stale < 2:
            state = dict(state)
            for key in sharding.accepted([(*w, sum(size[i] for i in ds)) for w, ds in wishes.items()], sizes, cap):
                for i in wishes[key]:
                    state[i] = key[1]
        k += 1
    return best


def test_rounds_against_a_twin_in_plain_python(spark):
    rng = random.Random(5)
    rows = clusters(12, 8, rng) + [(1000 + k, "\n".join(rng.sample(["a", "b line", " C ", "d line of text", "", "e"], 3))) for k in range(60)]
    for p in (sharding.Params(shards=3), sharding.Params(shards=4, parts=2)):
        assert {r.doc_id: r.shard for r in sharding.shards(frame(spark, rows), p).collect()} == twin(rows, p)
