"""From fetched documents to a store and a manifest; what isn't fit for them is given back with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.textexpr import sha256, strip, text, utf8_size
from quillon.operators import markup, validate
from quillon.sources import store


def rendered(fetched: DataFrame) -> DataFrame:
    """(celex, text, error): body and annexes rendered, one after the other, in order; a part that can't be parsed fails the whole."""
    parts = fetched.select("celex", F.col("error.message").alias("failed"), F.concat(F.array("body"), F.coalesce("annex_bodies", F.array().cast("array<binary>"))).alias("parts"))
    each = parts.select("celex", "failed", F.posexplode_outer("parts").alias("k", "part"))
    drawn = each.select("celex", "failed", "k", markup.formex(F.when(F.col("failed").isNull(), F.col("part"))).alias("f")).select("celex", "failed", "k", F.col("f.text").alias("t"), F.col("f.error").alias("e"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("t", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    joined = drawn.groupBy("celex").agg(F.coalesce(F.max("failed"), F.max("e")).alias("error"), whole.alias("text"))
    blank = F.when(F.col("error").isNull() & (strip(F.col("text")) == ""), F.lit("the document has no text"))
    return joined.select("celex", F.when(F.col("error").isNull() & blank.isNull(), F.col("text")).alias("text"), F.coalesce("error", blank).alias("error"))


def manifest_rows(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """The manifest's rows, validated: texts (item_id, text) joined with facts, which hold all columns but bytes and sha256.

    A text without facts, and a fact without a text, is a row too, __text or __facts null.
    """
    sized = texts.select("item_id", utf8_size(F.col("text")).alias("bytes"), sha256(F.col("text")).alias("sha256"), F.lit(True).alias("__text"))
    return validate.validated(facts.drop("bytes", "sha256").withColumn("__facts", F.lit(True)).join(sized, "item_id", "full_outer"))


def ingest(texts: DataFrame, facts: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, refused, receipts): only texts whose manifest row breaks no rule, and that aren't blank, are stored.

    Every text and every fact is in the manifest or refused with its reasons: a blank text, a text
    that nobody stated facts of, facts whose text isn't there, an id that stands on more than one
    text or fact. receipts is the write: nothing is stored until it runs.
    """
    blank = strip(text(F.col("text"))) == ""
    twice = texts.groupBy("item_id").count().unionByName(facts.groupBy("item_id").count()).where("count > 1").select("item_id").distinct().withColumn("__twice", F.lit(True))
    checked = manifest_rows(texts.where(~blank), facts).join(texts.where(blank).select("item_id").distinct().withColumn("__blank", F.lit(True)), "item_id", "left").join(twice, "item_id", "left")
    own = F.when(F.col("__facts").isNull(), F.array(F.lit("nobody stated facts of this text"))).when(F.col("__text").isNull(), F.array(F.lit("there is no text"))).otherwise(F.transform("errors", lambda e: e["message"]))
    reasons = F.when(F.col("__twice"), F.concat(F.array(F.lit("the item_id is not unique")), own)).otherwise(own)
    #: a blank text is refused as such, its facts aren't refused again
    told = checked.where("__blank IS NULL OR __text").select("*", reasons.alias("reasons")).drop("__facts", "__text", "__twice", "__blank")
    good = told.where(F.size("reasons") == 0).drop("errors", "reasons")
    refused = told.where(F.size("reasons") > 0).select("item_id", "reasons").unionByName(texts.where(blank).select("item_id", F.array(F.lit("the text is blank")).alias("reasons")))
    full = texts.where(~blank)
    return good, refused, store.write_texts(full.join(good.select("item_id"), "item_id", "left_semi").select("item_id", "text"), root)
