import random

from quillon.llm import reply_trees as rt

NODES = "tree long, node long, parent long, role string, text string, score string, path string"


def brute(rows, best):
    own = {(t, n): (p, r, x) for t, n, p, r, x in rows}
    kids = {}
    for (t, n), (p, _, _) in own.items():
        kids.setdefault((t, p) if p is not None and (t, p) in own else (t, "root"), []).append(n)
    out = []

    def walk(t, n, path, score, said):
        _, role, text = own[t, n]
        path, said = [*path, n], said + f"<|{role}|>\n{text}<|end|>\n"
        score += len(text) if role == "assistant" else 0
        if (t, n) not in kids:
            out.append((t, n, score, len(path), ">".join(map(str, path)), said))
        for k in kids.get((t, n), ()):
            walk(t, k, path, score, said)

    for (t, p), ns in kids.items():
        if p == "root":
            for n in ns:
                walk(t, n, [], 0, "")
    ranked = []
    for t in {o[0] for o in out}:
        for k, o in enumerate(sorted((o for o in out if o[0] == t), key=lambda o: (-o[2], o[1]))[:best]):
            ranked.append((o[0], o[1], k + 1, *o[2:]))
    return sorted(ranked)


def test_random_trees_against_a_walk(spark):
    rng = random.Random(6)
    rows = []
    for t in range(12):
        for n in range(rng.randrange(1, 25)):
            parent = rng.choice([None, *range(n), 900]) if n else None
            rows.append((t, n, parent, rng.choice(["user", "assistant"]), "x" * rng.randrange(5)))
    df = spark.createDataFrame([(*r, "s", "p") for r in rows], NODES)
    got = sorted((r.tree, r.leaf, r["rank"], r.score, r.turns, r.path, r.conversation) for r in rt.branches(df).collect())
    assert got == brute(rows, 3) and len(got) > 20


def test_cycles_are_on_no_path(spark):
    df = spark.createDataFrame([(1, 1, None, "user", "a", "", ""), (1, 2, 3, "user", "b", "", ""), (1, 3, 2, "user", "c", "", ""), (1, 4, 4, "user", "d", "", "")], NODES)
    assert [r.path for r in rt.branches(df).collect()] == ["1"]


def test_turns_of_one_role_are_alternatives(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "bb"), (1, 3, "user", "more"), (2, 0, "user", "x"), (2, 1, "user", "y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, parent int")
    assert sorted((r.tree, r.node, r.parent) for r in rt.replies(df).collect()) == [(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 2), (2, 0, None), (2, 1, None)]
    assert sorted((r.tree, r["rank"], r.path) for r in rt.branches(rt.replies(df)).collect()) == [(1, 1, "0>2>3"), (1, 2, "0>1"), (2, 1, "0"), (2, 2, "1")]


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "q"), (1, 1, "assistant", None), (None, 0, "user", "x"), (1, None, "user", "x"), (2, 5, "assistant", "w" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.tree: r for r in rt.branches(rt.replies(df)).collect()}
    assert out[1].conversation == "<||>\n<|end|>\n<|assistant|>\n<|end|>\n" and out[2].score == 300_000
    assert rt.branches(rt.replies(df.limit(0))).count() == 0


def test_nodes_may_bring_their_own_points(spark):
    rows = [(1, 0, None, "user", "q", 1), (1, 1, 0, "assistant", "a long answer", None), (1, 2, 0, "assistant", "b", 7), (1, 3, 2, "user", "c", -2)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, points int")
    assert [(r.path, r.score) for r in rt.branches(df).orderBy("rank").collect()] == [("0>2>3", 6), ("0>1", 1)]
