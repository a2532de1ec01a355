"""Manifests: tab-separated files in and out, lookup, order, equality, difference."""

from __future__ import annotations

import csv
import io
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import ManifestError
from quillon.functions.textexpr import text
from quillon.operators import validate
from quillon.operators.validate import COLUMNS, Item
from quillon.sources import shared


def read_items(path) -> list[Item]:
    """A small manifest on the driver, every row checked; an error names the file and the row (the header is line 1)."""
    path = Path(path)
    if not path.exists():
        raise ManifestError(f"there is no manifest at {path}.")
    out = []
    with path.open(encoding="utf-8", newline="") as f:
        for k, row in enumerate(csv.DictReader(f, delimiter="\t")):
            try:
                out.append(Item.from_row(row))
            except ManifestError as e:
                raise ManifestError(f"{path} line {k + 2}: {e.message}") from e
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file of any size as text columns, the header's names checked; _corrupt is set for rows of another width."""
    header = spark.read.text(path).limit(1).collect()
    if not header:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*COLUMNS, "_corrupt")))
    names = next(csv.reader(io.StringIO(header[0][0]), delimiter="\t"))
    validate.check_columns(names)  # of a folder, every part has the header that the first one has
    schema = ", ".join(f"`{n}` string" for n in names) + ", _corrupt string"
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote='"', escape='"', multiLine=True, columnNameOfCorruptRecord="_corrupt", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select(*[text(F.col(c)).alias(c) for c in COLUMNS], "_corrupt")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as a checked DataFrame; too long rows are an error too."""
    return width_checked(validate.validated(scan(spark, path)))


def width_checked(checked: DataFrame) -> DataFrame:
    """The errors of validated rows, and one more where _corrupt holds a row with more fields than the header; _corrupt goes."""
    width = F.array(F.struct(F.lit(ManifestError.code), F.lit("row"), F.lit("the row has more or fewer fields than the header"), F.lit(False))).cast(validate.ERRORS)
    long = F.col("_corrupt").isNotNull() & (F.size(F.split("_corrupt", "\t")) > len(COLUMNS))
    return checked.withColumn("errors", F.when(long, F.concat("errors", width)).otherwise(F.col("errors"))).drop("_corrupt")


def write(df: DataFrame, path) -> int:
    """One sorted, exactly quoted file at a path or a URI; ids must be unique. Returns the rows.

    The executors sort and quote the rows and write them in parts, whose bytes are then put one after
    the other, a few MB at a time: no row is sent to the driver.
    """
    spark = df.sparkSession
    at = shared.scratch_path(spark, "manifest-parts")
    own = df.select(*COLUMNS)
    own.write.parquet(f"{at}/rows")
    own = spark.read.schema(own.schema).parquet(f"{at}/rows")
    try:
        twice = validate.duplicate_ids(own).orderBy("item_id").limit(1).collect()
        if twice:
            raise ManifestError(f"item_id '{twice[0][0]}' is on {twice[0][1]} rows.")
        own.orderBy("item_id").mapInArrow(_quoted, "value string").write.text(f"{at}/lines", compression="none", lineSep="\n")
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{at}/lines")
        parts = [i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(base)) if i.base_name.startswith("part-")]
        with _created(path) as f:
            f.write(("\t".join(COLUMNS) + "\n").encode())
            for part in sorted(parts, key=lambda p: int(p.rsplit("/part-", 1)[1].split("-")[0])):
                with fs.open_input_stream(part, compression=None) as lines:
                    while chunk := lines.read(4_000_000):
                        f.write(chunk)
        return own.count()
    finally:
        shared.drop_path(spark, at)


def _quoted(batches):
    """Rows as lines of the file, without their ends."""
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            line = io.StringIO()
            csv.writer(line, delimiter="\t", lineterminator="").writerow(row)
            out.append(line.getvalue())
        yield pa.record_batch([pa.array(out, pa.string())], names=["value"])


def _created(path):
    if "://" in str(path):
        fs, at = pyarrow.fs.FileSystem.from_uri(str(path))
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(at, compression=None)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return Path(path).open("wb")


def write_parts(df: DataFrame, path: str) -> None:
    """The same rows as a folder of files, each with the header, written by the executors; scan() and read() take the folder."""
    own = df.select(*[text(F.col(c)).alias(c) for c in COLUMNS])
    own.write.csv(path, sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def frame(spark: SparkSession, items: list[Item]) -> DataFrame:
    """Items in file order, with that order as file_pos."""
    rows = [(*[getattr(getattr(i, c), "value", getattr(i, c)) for c in COLUMNS], i.authority_tier.rank, k) for k, i in enumerate(items)]
    return spark.createDataFrame(rows, validate.SCHEMA + ", authority_rank int, file_pos long")


def by_authority(df: DataFrame) -> DataFrame:
    return df.orderBy("authority_rank", "item_id")


def get(df: DataFrame, item_id: str):
    """The row of that exact id, the first in file order if file_pos is there."""
    order = ["file_pos"] if "file_pos" in df.columns else COLUMNS
    found = df.where(F.col("item_id") == item_id).orderBy(*order).limit(1).collect()
    if not found:
        known = ", ".join(r[0] for r in df.select("item_id").orderBy("item_id").limit(8).collect()) or "none"
        raise ManifestError(f"no item '{item_id}'; known ids begin: {known}.")
    return found[0]


def get_all(df: DataFrame, ids: DataFrame) -> DataFrame:
    """(ids' columns, the row's columns but item_id, known) of many exact ids at once; the first in file order of each."""
    order = ["file_pos"] if "file_pos" in df.columns else list(COLUMNS)
    first = df.groupBy("item_id").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != "item_id"]), F.struct(*order)).alias("row"))
    return ids.join(first, "item_id", "left").select(*ids.columns, "row.*", F.col("row").isNotNull().alias("known"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows as often, in any order."""
    a, b = a.select(*COLUMNS), b.select(*COLUMNS)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(item_id, change): added, removed, changed or same, by sha256."""
    a, b = old.select("item_id", F.col("sha256").alias("was")), new.select("item_id", F.col("sha256").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return a.join(b, "item_id", "full_outer").select("item_id", change.alias("change"))
