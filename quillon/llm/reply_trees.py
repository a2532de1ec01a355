"""Reply trees: root-to-leaf paths by doubling self-joins, ranked, each written as one conversation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Written


@dataclass(frozen=True)
class Params:
    best: int = 3  #: branches of a tree that are chosen
    opening: str = "<|"
    closing: str = "|>"
    end: str = "<|end|>\n"


def replies(conversations: DataFrame) -> DataFrame:
    """Turns as nodes (tree, node, parent, role, text): a turn replies to the last earlier turn of another role.

    So turns of one role in succession are alternatives, and branch. Rows without a conversation or
    a turn are left out; of rows that repeat a turn the one of least (role, text) counts; a null
    role or text is ''.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("node"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    own = own.where("tree IS NOT NULL AND node IS NOT NULL")
    #: turns are put in order without their texts, however many a conversation has
    roles = own.groupBy("tree", "node").agg(F.min("role").alias("role"))
    turns = Window.partitionBy("tree").orderBy("node")
    before = F.when(F.col("role") != F.lag("role").over(turns), F.lag("node").over(turns))
    parents = roles.withColumn("__before", before).select("tree", "node", F.last("__before", ignorenulls=True).over(turns).alias("parent"))
    said = own.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("m"))
    return said.join(parents, ["tree", "node"]).select("tree", "node", "parent", "m.role", "m.text")


def branches(nodes: DataFrame, p: Params = Params()) -> DataFrame:
    """The best branches of every tree: (tree, leaf, rank, score, turns, path, conversation).

    nodes: (tree, node, parent, role, text), a node once. A node without a parent, or whose parent
    isn't there, is a root; nodes that only a cycle leads to are on no path. A branch's score is the
    sum of its nodes' points, a column that nodes may have (null counts 0), else the number of
    characters of assistant messages; ties go to the smaller leaf. An empty table
    gives no rows. All paths are scored; only p.best of each tree are written out.

    The self-joins double: round k joins every node's ancestor at a distance of 2^k with that one's
    own, adding up scores, so a tree of depth d takes log d rounds; a node that has reached its root
    asks no more. The chosen leaves' paths are
    laid out by the same tables of ancestors, again in log d rounds; only then are texts joined.
    """
    points = F.coalesce(F.col("points").cast("long"), F.lit(0)) if "points" in nodes.columns else F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    own = Written(nodes.select("tree", "node", "parent", "role", "text", points.cast("long").alias("score")), "nodes")
    there = own.df.select("tree", F.col("node").alias("parent"), F.lit(True).alias("__there"))
    now = Written(own.df.select("tree", "node", "parent", "score").join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("__there"), F.col("parent")).alias("above"), "score", F.lit(1).alias("turns")), "ancestors")
    largest = own.df.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ancestors = []
    inner = Written(now.df.where("above IS NOT NULL").select("tree", F.col("above").alias("node")).distinct(), "inner")
    #: after as many doublings as that, what still has an ancestor goes round in a cycle
    for _ in range(max(0, largest - 1).bit_length()):
        asking = Written(now.df.where("above IS NOT NULL"), "asking")
        if not asking.df.limit(1).count():
            asking.drop()
            break
        ancestors.append(asking)
        far = now.df.select("tree", F.col("node").alias("above"), F.col("above").alias("__above"), F.col("score").alias("__score"), F.col("turns").alias("__turns"))
        step = asking.df.join(far, ["tree", "above"]).select("tree", "node", F.col("__above").alias("above"), (F.col("score") + F.col("__score")).alias("score"), (F.col("turns") + F.col("__turns")).alias("turns"))
        after = Written(now.df.where("above IS NULL").unionByName(step), "ancestors")
        now.drop()
        now = after
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    ends = now.df.where("above IS NULL").join(inner.df, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.best)
    chosen = Written(ends.select("tree", F.col("node").alias("leaf"), "rank", "score", "turns"), "chosen")
    on = Written(chosen.df.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back")), "on-paths")
    for k, a in enumerate(ancestors):
        more = on.df.join(a.df.select("tree", "node", "above"), ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), F.col("back") + (1 << k))
        longer = Written(on.df.union(more), "on-paths")
        on.drop()
        on = longer
    said = F.concat(F.lit(p.opening), F.col("role"), F.lit(p.closing + "\n"), F.col("text"), F.lit(p.end))
    spoken = on.df.join(own.df.select("tree", "node", said.alias("said")), ["tree", "node"])
    laid = spoken.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "node", "said"))).alias("m"))
    out = laid.join(chosen.df, ["tree", "leaf"]).select("tree", "leaf", "rank", "score", "turns", F.array_join(F.col("m.node").cast("array<string>"), ">").alias("path"), F.array_join("m.said", "").alias("conversation"))
    out = Written(out, "branches")
    for t in (own, now, inner, chosen, on, *ancestors):
        t.drop()
    return out.df


ORACLE = """
WITH RECURSIVE own AS (SELECT conv_id AS tree, turn AS node, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS m
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
a AS (SELECT tree, node, m.role AS role, m.text AS text, lag(m.role) OVER w AS was, lag(node) OVER w AS prior FROM own WINDOW w AS (PARTITION BY tree ORDER BY node)),
n AS (SELECT tree, node, role, text, last_value(CASE WHEN role <> was THEN prior END IGNORE NULLS) OVER (PARTITION BY tree ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent,
  CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS points FROM a),
paths AS (SELECT tree, node, points AS score, 1 AS turns, CAST(node AS VARCHAR) AS path, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS conversation FROM n WHERE parent IS NULL
  UNION ALL SELECT n.tree, n.node, p.score + n.points, p.turns + 1, p.path || '>' || n.node, p.conversation || '<|' || n.role || '|>' || chr(10) || n.text || '<|end|>' || chr(10)
  FROM paths p JOIN n ON n.tree = p.tree AND n.parent = p.node),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY score DESC, node) AS rank FROM paths p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tree = p.tree AND n.parent = p.node))
SELECT tree, node AS leaf, CAST(rank AS INT) AS rank, score, turns, path, conversation FROM ranked WHERE rank <= 3
"""
