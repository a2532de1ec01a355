"""Balanced label propagation: linked documents move towards each other's shard, sizes stay even.

Documents are linked where they have a line in common. A line shared by c documents links each pair
of them with weight 1/(c - 1), so a line pulls every document with the same total, however common it
is; the pairs are never made: counts of a line's documents by shard hold all that is needed.
In each round a document finds the shard that pulls it most. Who moves is decided from a histogram
of the wishes by (from, to, gain), whose size depends on the number of shards alone: the greatest
gains first, as long as the target keeps within its capacity. The rounds end when they have settled, and
the best state that they went through is the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, id_text

UNIT = 1_000_000_000  #: weight 1 as an integer: sums don't depend on their order


@dataclass(frozen=True)
class Params:
    shards: int = 8
    slack: float = 0.05  #: a shard holds at most (1 + slack) of an even share of the characters
    settled: float = 0.002  #: rounds go on until two in a row add less than this share of all links to those within shards
    parts: int = 16  #: of the wishes of one (from, to, gain)


def linked(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> tuple[Written, Written]:
    """Written tables (doc_id, size) of all documents and (doc_id, link, weight, members) of their shared lines."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(x)))
    links = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))
    made = Written(id_text(df, id_col, text_col).select("doc_id", F.greatest(F.length("text"), F.lit(1)).cast("long").alias("size"), F.array_distinct(links).alias("links")), "lines")
    docs = Written(made.df.groupBy("doc_id").agg(F.max("size").alias("size")), "sizes")
    each = made.df.select("doc_id", F.explode("links").alias("link")).distinct()
    shared = each.groupBy("link").agg(F.count("*").alias("members")).where("members > 1")
    edges = Written(each.join(shared, "link").select("doc_id", "link", F.floor(UNIT / (F.col("members") - 1)).alias("weight"), "members"), "links")
    made.drop()
    return docs, edges


def accepted(wishes: list[tuple[int, int, int, int, int]], sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Of wishes (from, to, gain, part, size) those that move, greatest gain first, no shard over its capacity at the end.

    Sweeps go on while one lets another in: what leaves a shard makes room for others.
    """
    left, out = sorted(wishes, key=lambda w: (-w[2], w[3], w[0], w[1])), []
    while True:
        waiting = []
        for w in left:
            a, b, gain, part, size = w
            if sizes[b] + size <= capacity:
                sizes[b] += size
                sizes[a] -= size
                out.append((a, b, gain, part))
            else:
                waiting.append(w)
        if len(waiting) == len(left):
            return out
        left = waiting


def cut(edges: DataFrame, state: DataFrame) -> DataFrame:
    """One row (cut, total): links between documents in different shards, and all links, of weight 1/(c - 1) a pair."""
    by = edges.join(state, "doc_id").groupBy("link", "weight", "members", "shard").agg(F.count("*").alias("n"))
    line = by.groupBy("link", "weight", "members").agg(F.sum(F.col("n") * F.col("n")).alias("same"))
    whole = F.col("members") * F.col("members")
    return line.agg(F.coalesce(F.sum((whole - F.col("same")) / 2 * F.col("weight") / UNIT), F.lit(0.0)).alias("cut"), F.coalesce(F.sum((whole - F.col("members")) / 2 * F.col("weight") / UNIT), F.lit(0.0)).alias("total"))


def propagated(docs: DataFrame, edges: DataFrame, p: Params = Params()) -> Written:
    """A written table (doc_id, size, shard); it begins with the hash of the id.

    The capacity is (1 + p.slack) of an even share, or the largest shard of the beginning if a
    table is so small or its texts so uneven that this is larger. Each round knows from its pulls
    how much of the links lies within shards; a round counts as progress if that exceeds the best so
    far by p.settled of all links, so the rounds come to an end.
    """
    state = Written(docs.select("doc_id", "size", F.pmod(F.xxhash64("doc_id"), F.lit(p.shards)).cast("int").alias("shard")), "state")
    sizes = [0] * p.shards
    for r in state.df.groupBy("shard").agg(F.sum("size").alias("n")).collect():
        sizes[r["shard"]] = r["n"]
    capacity = max(int((1 + p.slack) * sum(sizes) / p.shards) + 1, max(sizes))
    total = edges.agg(F.sum((F.col("members") - 1) * F.col("weight"))).first()[0] or 0
    best_of, top, stale, k = state, -1, 0, 0
    while total and stale < 2:
        placed = edges.join(state.df.select("doc_id", "shard"), "doc_id")
        counts = placed.groupBy("link", "shard").agg(F.count("*").alias("n"))
        pull = edges.join(counts, "link").groupBy("doc_id", "shard").agg(F.sum(F.col("weight") * F.col("n")).alias("pull"), F.sum("weight").alias("itself"))
        #: every shared line counts the document itself at home
        pulls = pull.withColumnRenamed("shard", "to").join(state.df, "doc_id").withColumn("pull", F.col("pull") - F.when(F.col("to") == F.col("shard"), F.col("itself")).otherwise(0))
        best = pulls.groupBy("doc_id", "size", "shard").agg(
            F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("pull"))), F.lit(0)).alias("home"), F.max_by("to", F.struct("pull", -F.col("to"))).alias("to"), F.max("pull").alias("away")
        )
        #: half of the documents, another half each round, so that two that want to meet don't swap
        wants = (F.col("to") != F.col("shard")) & (F.col("away") > F.col("home")) & (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(2)) == 0)
        best = Written(best.select("doc_id", "size", F.col("shard").alias("from"), "to", "home", F.when(wants, F.floor(F.log2(F.col("away") - F.col("home"))).cast("int")).alias("gain"), F.pmod(F.xxhash64("doc_id", F.lit(-k - 1)), F.lit(p.parts)).cast("int").alias("part")), "pulls")
        within = best.df.agg(F.sum("home")).first()[0] or 0
        if within > top + (p.settled * total if top >= 0 else 0):
            stale = 0
        else:
            stale += 1
        if within > top:
            if best_of is not state:
                best_of.drop()
            best_of, top = state, within
        wish = best.df.where("gain IS NOT NULL")
        moves = accepted([tuple(r) for r in wish.groupBy("from", "to", "gain", "part").agg(F.sum("size")).collect()], sizes, capacity) if stale < 2 else []
        if moves:
            moving = wish.join(F.broadcast(docs.sparkSession.createDataFrame(moves, "from int, to int, gain int, part int")), ["from", "to", "gain", "part"]).select("doc_id", "to")
            after = Written(state.df.join(moving, "doc_id", "left").select("doc_id", "size", F.coalesce("to", "shard").alias("shard")), "state")
            if state is not best_of:
                state.drop()
            state = after
        best.drop()
        k += 1
    if state is not best_of:
        state.drop()
    return best_of


def shards(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's shard: (doc_id, size, shard), size its number of characters, 1 at least.

    Every line that isn't blank links, whatever its length. Null and empty texts link to nothing and stay where the hash of the id puts them; rows without
    an id are left out; rows that repeat an id are one document, with the lines of all and the size
    of the longest. Equal pulls go to the smaller shard number. An empty table gives no rows.
    """
    docs, edges = linked(df, p, id_col, text_col)
    out = propagated(docs.df, edges.df, p)
    docs.drop()
    edges.drop()
    return out.df
