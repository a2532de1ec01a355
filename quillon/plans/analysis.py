"""Questions to a corpus as a whole: phrase families, controls, distributions, completeness, coverage."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from quillon.operators.search import matching_lines


def sweep(manifest: DataFrame, texts: DataFrame, families: dict[str, str], in_force_only: bool = False) -> DataFrame:
    """(family, item's keys, line_no, line) for each line and each of the named patterns it holds, in one scan of the texts.

    Texts go to Python a hundred at a time; only hits meet the manifest.
    """
    items = manifest.where(F.col("validity") == "in-force") if in_force_only else manifest
    hits = matching_lines(texts, families, "item_id", in_python=True).join(items.select("item_id", "authority_tier", "authority_rank", "validity"), "item_id")
    return hits.select("item_id", "authority_tier", "authority_rank", "validity", "line_no", F.col("raw").alias("line"), F.explode("found").alias("family"))


def counted(hits: DataFrame, families: dict[str, str], *by: str) -> DataFrame:
    """(family, by..., hits, items): pointers to what to read. A family without hits is a row of zeros unless `by` is given."""
    n = hits.groupBy("family", *by).agg(F.count("*").alias("hits"), F.countDistinct("item_id").alias("items"))
    if by:
        return n
    every = hits.sparkSession.createDataFrame([(f,) for f in families], "family string")
    return every.join(n, "family", "left").na.fill(0, ["hits", "items"])


def controlled(counts: DataFrame, control: str) -> DataFrame:
    """A zero is a finding only if the control pattern hits: adds status found, absent or unproven."""
    works = counts.where(F.col("family") == control).agg((F.coalesce(F.sum("hits"), F.lit(0)) > 0).alias("__works"))
    status = F.when(F.col("hits") > 0, "found").when(F.col("__works"), "absent").otherwise("unproven")
    return counts.crossJoin(F.broadcast(works)).select(*counts.columns, status.alias("status"))


def designs(hits: DataFrame, first: str, second: str) -> DataFrame:
    """One row (first, second): the counts of two competing families."""
    count = lambda f: F.count_if(F.col("family") == f)
    return hits.agg(count(first).alias("first"), count(second).alias("second"))


def clusters(hits: DataFrame) -> DataFrame:
    """(authority_tier, item_id, hits, level) by item, by tier and in all: where the hits lie."""
    return hits.rollup("authority_tier", "item_id").agg(F.count("*").alias("hits"), F.grouping_id().cast("int").alias("level"))


def candidates_verified(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """(item_id, phrase, status): whether the title of what was found holds the phrase it was found for."""
    status = F.when(F.col("title").isNull(), "missing").when(F.contains(F.lower("title"), F.lower("phrase")), "confirmed").otherwise("other")
    return candidates.join(manifest.select("item_id", "title"), "item_id", "left").select("item_id", "phrase", status.alias("status"))


def completeness(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, problem): what is missing and what is unexpected; empty if the list is complete."""
    a, b = found.select(key).distinct(), expected.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("problem", F.lit("unexpected")))


def shapes(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """(item_id, n, expected, ok): numbers of parts against those that are known."""
    n = parts.groupBy("item_id").agg(F.count("*").alias("n"))
    return expected.join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("ok"))


def together(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several corpora as one, with their names in the column corpus."""
    return reduce(DataFrame.unionByName, [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()])


def coverage(hits: DataFrame, question: str, corpora: list[str]) -> DataFrame:
    """Questions by corpora: hits of each, zero where there is none."""
    return hits.groupBy(question).pivot("corpus", corpora).count().na.fill(0)


def labelled(provisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Provisions with the duty and the direction that a side table gives them; both null where it has none."""
    return provisions.join(labels.select("item_id", "duty", "direction"), "item_id", "left")


def contained(texts: DataFrame, phrases: DataFrame, text_id: str, phrase_id: str, text: str = "text", phrase: str = "phrase", block_chars: int = 8_000_000) -> DataFrame:
    """Pairs (text_id, phrase_id) whose text holds the phrase, letter for letter; a phrase that is null is in none, an empty one in all.

    A phrase's inner words, those with something on either side, are whole words of any text that
    holds it: its longest one is its key, and a text tries only the phrases whose key it has. Phrases
    without such a word are tried everywhere. Phrases are sent out in blocks of bounded size.
    """
    own = phrases.select(F.col(phrase_id).alias("__id"), F.col(phrase).cast("string").alias("__phrase")).where("__phrase IS NOT NULL")
    blocks = max(1, -(-(own.agg(F.sum(F.length("__phrase"))).first()[0] or 0) // block_chars))
    kinds = T.StructType([T.StructField(text_id, texts.schema[text_id].dataType), T.StructField(phrase_id, phrases.schema[phrase_id].dataType)])
    out = []
    for k in range(blocks):
        rows = [tuple(r) for r in own.where(F.pmod(F.xxhash64("__phrase"), F.lit(blocks)) == k).collect()]
        out.append(texts.select(F.col(text_id), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(_containing(rows, kinds), kinds))
    return reduce(DataFrame.unionByName, out)


def _containing(phrases: list[tuple], kinds: T.StructType):
    def batches(it):
        keyed: dict[str, list[int]] = {}
        everywhere = []
        for k, (_, p) in enumerate(phrases):
            inner = [m.group() for m in re.finditer(r"\w+", p) if m.start() and m.end() < len(p)]
            if inner:
                keyed.setdefault(max(inner, key=len), []).append(k)
            else:
                everywhere.append(k)
        ids, schema = pa.array([i for i, _ in phrases], to_arrow_type(kinds[1].dataType)), to_arrow_schema(kinds)
        for batch in it:
            at, which = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for k in chain(everywhere, *map(keyed.__getitem__, keyed.keys() & set(re.findall(r"\w+", text)))):
                    if phrases[k][1] in text:
                        at.append(row)
                        which.append(k)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(schema.field(0).type), ids.take(pa.array(which))], schema=schema)

    return batches
