"""The manifest's rules as one projection, and the same for single rows on the driver."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import ManifestError, ValidityError
from quillon.functions import vocab
from quillon.functions.textexpr import strip, text

COLUMNS = tuple("item_id citation title authority_tier validity validity_note version_id lang source_url retrieved media_type bytes sha256".split())
SCHEMA = ", ".join(f"{c} {'long' if c == 'bytes' else 'string'}" for c in COLUMNS)
ERRORS = "array<struct<code:string,field:string,message:string,transient:boolean>>"
_LANG, _DAY, _SHA = r"^[a-z]{3}$", r"^\d{4}-\d{2}-\d{2}$", r"^[0-9a-f]{64}$"


@dataclass(frozen=True)
class Item:
    """One row, normalised and checked when made; the first rule broken is the error."""

    item_id: str
    citation: str
    title: str
    authority_tier: vocab.AuthorityTier
    validity: vocab.Validity
    validity_note: str
    version_id: str
    lang: str
    source_url: str
    retrieved: str
    media_type: str
    bytes: int
    sha256: str

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        for name in ("validity_note", "version_id", "media_type"):
            value = getattr(self, name)
            put(name, "" if value is None else str(value).strip())
        for name in ("item_id", "citation", "title", "source_url"):
            put(name, self._needed(name))
        try:
            put("validity", vocab.parse_validity(self.validity))
            put("authority_tier", vocab.parse_authority_tier(self.authority_tier))
        except ValidityError as e:
            raise ManifestError(e.message) from e
        if self.validity is not vocab.Validity.IN_FORCE and not self.validity_note:
            raise ManifestError(f"'{self.item_id}' is {self.validity.value} but has no validity_note: name what changed it.")
        put("lang", self._shaped("lang", self._needed("lang").lower(), _LANG, "a three-letter language code"))
        put("retrieved", self._shaped("retrieved", self._needed("retrieved"), _DAY, "a date YYYY-MM-DD"))
        try:
            put("bytes", int(str(self.bytes).strip()))
        except ValueError:
            raise ManifestError(f"bytes '{str(self.bytes)[:20]}' is no whole number.") from None
        if not 0 <= self.bytes < 1 << 63:
            raise ManifestError(f"bytes {self.bytes} is negative or too large.")
        put("sha256", self._shaped("sha256", self._needed("sha256").lower(), _SHA, "64 hexadecimal digits"))

    def _needed(self, name: str) -> str:
        value = getattr(self, name)
        value = "" if value is None else str(value).strip()
        if not value:
            raise ManifestError(f"{name} is empty; every row needs one.")
        return value

    def _shaped(self, name: str, value: str, pattern: str, what: str) -> str:
        if not re.fullmatch(pattern, value, re.ASCII if name != "retrieved" else 0):
            raise ManifestError(f"{name} '{value[:20]}' is not {what}.")
        return value

    @classmethod
    def from_row(cls, row: dict) -> Item:
        check_columns([c for c in row if c is not None] + ["(fields beyond the header)"] * (None in row))
        return cls(**row)

    def to_row(self) -> dict[str, str]:
        return {k: str(getattr(v, "value", v)) for k, v in asdict(self).items()}

    def banner(self) -> str:
        return self.validity.banner(self.validity_note)


def check_columns(names: list[str]) -> None:
    """The schema is closed: unknown columns are named first, then missing ones."""
    unknown = sorted(set(names) - set(COLUMNS))
    if unknown:
        raise ManifestError(f"unknown column(s): {', '.join(unknown)}. A manifest has: {', '.join(COLUMNS)}.")
    missing = [c for c in COLUMNS if c not in names]
    if missing:
        raise ManifestError(f"missing column(s): {', '.join(missing)}.")


def header_error(names: Column) -> Column:
    """check_columns() for many headers at once: what is wrong with an array of names, null if nothing is."""
    legal = F.array(*map(F.lit, COLUMNS))
    unknown, missing = F.array_sort(F.array_except(names, legal)), F.array_except(legal, names)
    said = lambda what, which: F.concat(F.lit(what + " column(s): "), F.array_join(which, ", "))
    return F.when(F.size(unknown) > 0, said("unknown", unknown)).when(F.size(missing) > 0, said("missing", missing))


def error_text(e: Column) -> Column:
    """An error as the exceptions say it: its code, what is wrong, and whether trying again can help."""
    advice = F.when(e["transient"], "Retrying may succeed.").otherwise("Retrying will not change this; change the input instead.")
    return F.concat(F.lit("["), e["code"], F.lit("] "), e["message"], F.lit(" "), advice)


def _bytes(c: Column) -> tuple[Column, Column]:
    """(value or null, is it shaped like a whole number): signs and single underscores between digits are allowed."""
    raw = strip(text(c))
    shaped = raw.rlike(r"^[+-]?\d+(_\d+)*$")
    return F.when(shaped, F.replace(raw, F.lit("_"), F.lit("")).try_cast("long")), shaped


def validated(df: DataFrame) -> DataFrame:
    """The rows normalised, with authority_rank, retrieved_date (null if impossible) and errors, in the order of the rules.

    Columns beside the manifest's are kept. A row without errors has an empty array. Nothing is
    filled in: an unknown validity or tier stays as it was written, stripped and in lower case.
    """
    clean = {c: strip(text(F.col(c))) for c in COLUMNS if c != "bytes"}
    for c in ("authority_tier", "validity", "lang", "sha256"):
        clean[c] = F.lower(clean[c])
    size, shaped = _bytes(F.col("bytes"))

    def error(field: str, bad: Column, message: str | Column) -> Column:
        said = F.lit(message) if isinstance(message, str) else message
        code, stays = F.lit(ManifestError.code).alias("code"), F.lit(False).alias("transient")
        return F.when(bad, F.struct(code, F.lit(field).alias("field"), said.alias("message"), stays))

    def vocabulary(field: str, legal: tuple[str, ...]) -> Column:
        value = clean[field]
        said = F.when(value == "", F.lit(f"{field} is empty and has no default")).otherwise(F.concat(F.lit(f"{field} '"), F.substring(value, 1, 60), F.lit("' is unknown")))
        return error(field, ~value.isin(*legal), said)

    rules = [error(f, clean[f] == "", f"{f} is empty") for f in ("item_id", "citation", "title", "source_url")]
    rules += [vocabulary("validity", vocab.VALIDITIES), vocabulary("authority_tier", vocab.TIERS)]
    known = clean["validity"].isin(*vocab.VALIDITIES)
    rules.append(error("validity_note", known & (clean["validity"] != "in-force") & (clean["validity_note"] == ""), "validity_note must name what changed the text"))
    for field, pattern in (("lang", _LANG), ("retrieved", _DAY)):
        rules.append(error(field, ~clean[field].rlike("(?U)" + pattern if field == "retrieved" else pattern), F.when(clean[field] == "", F.lit(f"{field} is empty")).otherwise(F.lit(f"{field} has not the form"))))
    rules.append(error("bytes", ~shaped | size.isNull() | (size < 0), F.when(~shaped, F.lit("bytes is no whole number")).otherwise(F.lit("bytes is negative or too large"))))
    rules.append(error("sha256", ~clean["sha256"].rlike(_SHA), F.when(clean["sha256"] == "", F.lit("sha256 is empty")).otherwise(F.lit("sha256 has not the form"))))
    own = [(size if c == "bytes" else clean[c]).alias(c) for c in COLUMNS]
    extra = [F.col(c) for c in df.columns if c not in COLUMNS]
    return df.select(
        *own,
        *extra,
        vocab.rank(clean["authority_tier"]).alias("authority_rank"),
        clean["retrieved"].try_cast("date").alias("retrieved_date"),
        F.array_compact(F.array(*rules)).cast(ERRORS).alias("errors"),
    )


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lenient mode: (good rows without errors, quarantined rows with them)."""
    checked = validated(df)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def strict(df: DataFrame) -> DataFrame:
    """Strict mode: the job fails with the first rule that the first bad row it meets breaks."""
    checked = validated(df)
    first = F.element_at("errors", 1)
    guard = F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit(f"[{ManifestError.code}] "), F.col("item_id"), F.lit(": "), first["message"])).cast("string")).otherwise(F.col("item_id"))
    return checked.withColumn("item_id", guard).drop("errors")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """(item_id, n) of ids on more than one row."""
    return df.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1")
