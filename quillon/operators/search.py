"""Looking up, quoting and searching a corpus: a manifest joined with its texts."""

from __future__ import annotations

import re
from pathlib import Path

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import CorpusError, ManifestError, QuillonError
from quillon.functions import vocab
from quillon.functions.textexpr import by_row, java_regex, split_lines, strip, text
from quillon.operators.validate import COLUMNS
from quillon.sources import manifest as manifests
from quillon.sources import shared
from quillon.sources import store as stores


def checked_pattern(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern, re.IGNORECASE)
    except re.error as e:
        raise CorpusError(f"'{str(pattern)[:40]}' is not a valid regular expression: {e}.") from e


def java_form(pattern: str) -> str | None:
    """The pattern as rlike takes it; None where Java's expressions have nothing like it, or refuse it."""
    form, spark = java_regex(pattern), SparkSession.getActiveSession()
    if form is not None and spark is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(form)
        except Py4JJavaError:
            return None
    return form


def matches(line: Column, pattern: str) -> Column:
    """Whether a line holds the pattern, in Python's dialect, without regard to case; what Java lacks runs in Python, by Arrow batches."""
    compiled, form = checked_pattern(pattern), java_form(pattern)
    if form is not None:
        return line.rlike(form)

    @F.pandas_udf("boolean")
    def found(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: x is not None and compiled.search(x) is not None)

    return found(line)


def matching_lines(texts: DataFrame, patterns: dict[str, str], *keep: str, in_python: bool = False) -> DataFrame:
    """(keep..., line_no from 1, raw, found): the lines that hold any of the named patterns, and which.

    Lines are tried inside their text, and only hits become rows. Patterns that Java lacks run in
    Python, and so do all of them if asked: several at once are then several times as fast.
    """
    tried = [(name, checked_pattern(p).search) for name, p in patterns.items()]
    forms = None if in_python else {name: java_form(p) for name, p in patterns.items()}
    if forms is None or None in forms.values():

        def found(whole: str | None) -> list[tuple]:
            lines = ((k + 1, line, [name for name, search in tried if search(line)]) for k, line in enumerate(whole.splitlines() if whole else ()))
            return [hit for hit in lines if hit[2]]

        hits = texts.select(*keep, by_row(found, "array<struct<line_no:int,raw:string,found:array<string>>>")(F.col("text")).alias("__hits"))
    else:
        split = texts.select(*keep, split_lines(F.col("text")).alias("__lines"))
        names = lambda x: F.array_compact(F.array(*[F.when(x.rlike(f), F.lit(name)) for name, f in forms.items()]))
        tried_lines = F.transform("__lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("raw"), names(x).alias("found")))
        hits = split.select(*keep, F.filter(tried_lines, lambda s: F.size(s["found"]) > 0).alias("__hits"))
    return hits.select(*keep, F.explode("__hits").alias("__hit")).select(*keep, "__hit.*")


def lines_of(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line_no from 1, raw): the lines of each text."""
    return texts.select(*keep, F.posexplode(split_lines(F.col("text"))).alias("__at", "raw")).select(*keep, (F.col("__at") + 1).alias("line_no"), "raw")


def grep(manifest: DataFrame, texts: DataFrame, pattern: str, in_force_only: bool = False, verify: bool = False, ordered: bool = True) -> DataFrame:
    """Lines that hold the pattern: the item's columns, line_no, line (stripped) and the banner.

    Texts are split and searched where they are read; only hits meet the manifest, which the validity
    filter has thinned before. Items without a text are skipped; with verify, so are texts whose hash
    isn't the manifest's. Hits go round by item once, so that ordering them, by authority, item and
    line, samples them and not the texts.
    """
    items = manifest.where(F.col("validity") == "in-force") if in_force_only else manifest
    found = matching_lines(texts, {"": pattern}, "item_id", *(["sha256"] if verify else [])).drop("found").repartition("item_id")
    if verify:
        found = found.withColumnRenamed("sha256", "__is")
    hits = items.join(found, "item_id")
    if verify:
        hits = hits.where(F.col("__is") == F.col("sha256"))
    keep = [c for c in (*COLUMNS, "authority_rank") if c in items.columns]
    hits = hits.select(*keep, "line_no", strip(F.col("raw")).alias("line"), vocab.banner(F.col("validity"), F.col("validity_note")).alias("banner"))
    return hits.orderBy("authority_rank", "item_id", "line_no") if ordered else hits


def printed(hits: DataFrame) -> DataFrame:
    """The column printed: a hit as the command line shows it, the banner only where the text isn't in force."""
    flag = F.when(F.col("validity") == "in-force", F.lit("")).otherwise(F.concat(F.lit(" "), "banner"))
    return hits.withColumn("printed", F.concat("item_id", F.lit(":"), "line_no", F.lit(":"), flag, F.lit(" "), "line"))


def known_ids(manifest: DataFrame, n: int = 8) -> DataFrame:
    """The first ids in order: what an error names to show what there is."""
    return manifest.select("item_id").orderBy("item_id").limit(n)


def resolved(manifest: DataFrame, ref: str) -> DataFrame:
    """At most one row: the exact item_id, else the citation without regard to case; the first in file order."""
    wanted = strip(F.lit(ref or ""))
    by_id = F.col("item_id") == wanted
    order = ["file_pos"] if "file_pos" in manifest.columns else ["item_id", "sha256"]
    return manifest.where(by_id | (F.lower("citation") == F.lower(wanted))).orderBy((~by_id).cast("int"), *order).limit(1)


def resolved_all(manifest: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, item_id) of many references at once; item_id is null where nothing matches."""
    wanted = refs.select("ref", strip(text(F.col("ref"))).alias("__w")).distinct()
    order = F.col("file_pos") if "file_pos" in manifest.columns else F.col("item_id")
    keys = manifest.select(F.col("item_id").alias("__k"), F.lit(0).alias("__p"), "item_id", order.alias("__o")).unionByName(manifest.select(F.lower("citation").alias("__k"), F.lit(1).alias("__p"), "item_id", order.alias("__o")))
    asked = wanted.select("ref", F.col("__w").alias("__k"), F.lit(0).alias("__p")).unionByName(wanted.select("ref", F.lower("__w").alias("__k"), F.lit(1).alias("__p")))
    hit = asked.join(keys, ["__k", "__p"])
    best = hit.groupBy("ref").agg(F.min_by("item_id", F.struct("__p", "__o")).alias("item_id"))
    return refs.select("ref").distinct().join(best, "ref", "left")


def header() -> Column:
    """What stands above a quoted text; the text follows the last line end directly."""
    version = F.when(F.col("version_id") != "", F.concat(F.lit("   version: "), F.col("version_id"))).otherwise(F.lit(""))
    return F.concat_ws(
        "\n",
        vocab.banner(F.col("validity"), F.col("validity_note")),
        F.concat_ws(" — ", "citation", "title"),
        F.concat(F.lit("  authority: "), F.col("authority_tier"), version),
        F.concat(F.lit("  retrieved "), F.col("retrieved"), F.lit(" from "), F.col("source_url")),
        F.lit(""),
    )


def quotes(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, status, quote) of every item; the quote is null unless the text is there and has its hash."""
    body = texts.select("item_id", "text", F.sha2("text", 256).alias("__is"))
    status = F.when(F.col("__is").isNull(), "missing").when(F.col("__is") != F.col("sha256"), "mismatch").otherwise("ok")
    return manifest.join(body, "item_id", "left").select("item_id", status.alias("status"), F.when(status == "ok", F.concat(header(), F.col("text"))).alias("quote"))


class Corpus:
    """A directory with a manifest and a store, opened on a session; the manifest is read, checked and kept distributed.

    The first row that breaks a rule is an error; its line counts rows, the header being line 1.
    """

    def __init__(self, spark: SparkSession, root, manifest: str = "MANIFEST.tsv"):
        self.spark, self.root, self.store = spark, Path(root), stores.Store(root)
        path = self.root / manifest
        if not path.exists():
            raise CorpusError(f"there is no manifest at {path}.")
        try:
            rows = shared.written(manifests.read(spark, str(path)).withColumn("file_pos", F.monotonically_increasing_id()), "corpus")
        except ManifestError as e:
            raise CorpusError(e.message) from e
        bad = rows.where(F.size("errors") > 0).orderBy("file_pos").limit(1).collect()
        if bad:
            raise CorpusError(f"{path} line {bad[0]['file_pos'] + 2}: {bad[0]['errors'][0]['message']}")
        self.manifest = rows.drop("errors", "retrieved_date")

    def __len__(self) -> int:
        return self.manifest.count()

    def __iter__(self):
        """The items in file order, a few at a time."""
        return iter(self.manifest.orderBy("file_pos").toLocalIterator())

    @property
    def texts(self) -> DataFrame:
        return stores.texts(self.spark, str(self.root))

    def register(self) -> None:
        """Temporary views manifest, texts and lines, for Spark SQL."""
        self.manifest.createOrReplaceTempView("manifest")
        self.texts.createOrReplaceTempView("texts")
        lines_of(self.texts, "item_id").createOrReplaceTempView("lines")

    def resolve(self, ref):
        found = resolved(self.manifest, "" if ref is None else str(ref)).collect()
        if not found:
            known = ", ".join(r[0] for r in known_ids(self.manifest).collect()) or "(the corpus is empty)"
            raise CorpusError(f"nothing matches '{str(ref).strip()[:60]}'; known item_ids include: {known}.")
        return found[0]

    def text(self, ref) -> str:
        item = self.resolve(ref)
        try:
            if not self.store.verify(item["item_id"], item["sha256"]):
                raise CorpusError(f"the stored text of '{item['item_id']}' has another sha256 than the manifest; fetch it again.")
            return self.store.read(item["item_id"])
        except QuillonError as e:
            raise e if isinstance(e, CorpusError) else CorpusError(e.message) from e

    def quote(self, ref) -> str:
        item = self.resolve(ref)
        body = self.text(item["item_id"])
        top = self.manifest.where((F.col("item_id") == item["item_id"]) & (F.col("file_pos") == item["file_pos"])).select(header()).first()[0]
        return top + body

    def grep(self, pattern: str, in_force_only: bool = False, verify: bool = False) -> DataFrame:
        return grep(self.manifest, self.texts, pattern, in_force_only, verify)
