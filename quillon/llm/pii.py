"""Personal identifiers by bootstrapped contextual extraction.

Strict, checkable identifiers are the seeds. Every mention of something identifier-like has lexical
patterns: its shape, and the words around it together with its coarse shape. Over the graph of
distinct instances and patterns Spark computes, round after round, what share of a pattern's
instances is known to be of a kind, and from the confident patterns how sure an instance is; so
seeds lift patterns, and confident patterns lift instances that no seed rule covers.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, id_text


@dataclass(frozen=True)
class Params:
    support: int = 3  #: distinct known instances that a pattern needs
    pattern_confidence: float = 0.7
    instance_confidence: float = 0.7
    smoothing: float = 1.0  #: added to the instances that a pattern is divided by
    digits: int = 1  #: an instance has an @, a form that proves itself, or this many digits


_WORD = re.compile(r"\w+")
_HIT = re.compile(r"[@\d]")
_GROUPED = re.compile(r"\+?\d{1,4}[ .-]?\(?\d{2,4}\)?(?:[ .-]\d{2,4}){1,4}(?!\w|\.\d)|\(\d{2,4}\) ?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w|\.\d)")
#: the same with noise between its groups
_NOISY = re.compile(r"\+\d{1,3}[#$%&*!]* ?\(?\d{2,4}\)?[#$%&*!]*(?: ?\d{2,4}(?:-\d{2,4})?[#$%&*!]*){1,3}(?!\w)")
_NOISE = re.compile(r"[#$%&*!]+")
_PLAIN = re.compile(r"[^\s\"'<>|#$%&*!?;,=()\[\]{}]+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\w)")
_PHONE = re.compile(r"\+1 ?\(\d{3}\) ?\d{3}-\d{4}")
#: the same, and cards, where they end in a text
_PHONE_END = re.compile(_PHONE.pattern + r"(?!\w)")
_CARD = re.compile(r"(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,4}(?:(?P=gap)[0-9]{1,3})?|3[0-9]{3}(?P<g>[ -])[0-9]{6}(?P=g)[0-9]{5})(?![\w-]|\.\d)")
_CARD_GAP = re.compile(r"(?<=\d)[ -](?=\d)")
_EMAIL_END = re.compile(_EMAIL.pattern + r"(?![\w@-]|\.\w)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def seed_kind(value: str) -> str | None:
    """The kind of an identifier that its own form proves."""
    if "@" in value:
        return "email" if _EMAIL.fullmatch(value) else None
    if value.isascii() and value[:1].isdigit() and value.find(".") < 0 and _CARD.fullmatch(value):
        number = _CARD_GAP.sub("", value)
        return "card" if 13 <= len(number) <= 19 and number[0] in "3456" and luhn(number) else None
    if value.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 and str(int(p)) == p for p in value.split(".")):
        return "ipv4"
    return "phone" if _PHONE.fullmatch(value) else None


def shapes(value: str) -> tuple[str, str]:
    """(fine, coarse): digits as 9 (grouped digits keep their numbers), letters as a or A; runs of letters shrink, in coarse ones all runs."""
    fine = re.sub(r"\d", "9", value)
    fine = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a", fine)
    coarse = re.sub(r"9+", "9", fine)
    return (coarse if "@" in value or value.count(".") == 3 else fine), coarse


def _seed(text: str, start: int) -> re.Match | None:
    """The identifier that begins at a place and whose own form proves it, if it ends there too."""
    for form in (_IPV4, _PHONE_END, _CARD, _EMAIL_END):
        m = form.match(text, start)
        if m and seed_kind(m.group()):
            return m
    return None


def mentions(text: str, least_digits: int) -> list[tuple[int, int, str]]:
    """(start, end, value) of what is identifier-like; each place once, what its own form proves first, then the longest form."""
    out, done = [], 0
    for hit in _HIT.finditer(text):
        k = hit.start()
        if k < done:
            continue
        start = k
        while start > done and not text[start - 1].isspace() and text[start - 1] not in "\"'<>|#$%&*!?;,=()[]{}":
            start -= 1
        if start > done and text[start - 1] == "(" and (start - 2 < 0 or text[start - 2].isspace()):
            start -= 1
        m = _seed(text, start) or _GROUPED.match(text, start) or _NOISY.match(text, start) or _PLAIN.match(text, start)
        if not m:
            done = k + 1
            continue
        value = m.group().rstrip(".:-/_#$%&*!")
        done = max(m.end(), k + 1)
        if ("@" in value and not value.startswith("@") and not value.endswith("@")) or sum(map(str.isdigit, value)) >= least_digits or seed_kind(value):
            out.append((start, start + len(value), value))
    return out


class Words:
    """Where a text's words begin and end, found once, and only if they are asked for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """The last two words that end before a place and the first that begins after it, whole, however far away or long."""
        if self.starts is None:
            spans = [m.span() for m in _WORD.finditer(self.text)]
            self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        i, j = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        word = lambda k: self.text[self.starts[k] : self.ends[k]].lower()
        return [word(k) for k in range(max(0, i - 2), i)], [word(k) for k in range(j, min(j + 1, len(self.starts)))]


def patterns(words: Words, start: int, end: int, value: str) -> list[str]:
    fine, coarse = shapes(value)
    before, after = words.around(start, end)
    out = ["shape " + fine]
    if before:
        out.append(f"after {before[-1]} {coarse}")
    if len(before) == 2:
        out.append(f"after {before[0]} {before[1]} {coarse}")
    if after:
        out.append(f"before {after[0]} {coarse}")
    return out


def _mentioned(docs: DataFrame, p: Params) -> Written:
    def batches(it):
        for batch in it:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = Words(text)
                for start, end, raw in mentions(text, p.digits):
                    value = _NOISE.sub("", raw)
                    rows.append((i, start, end, value, seed_kind(value), patterns(words, start, end, value)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "end", "value", "seed", "patterns"])

    return Written(docs.mapInArrow(batches, "doc_id long, start int, end int, value string, seed string, patterns array<string>"), "mentions")


def bootstrapped(found: DataFrame, p: Params = Params()) -> Written:
    """A written table (value, kind, confidence, seed): the instances that are seeds, or sure enough.

    found: (value, seed, patterns). In each round
      pattern(kind)  = sum of its distinct instances' confidence in the kind / (all its distinct instances + smoothing)
      instance(kind) = 1 - product over its confident patterns of (1 - pattern(kind));  seeds stay at 1.
    A pattern is confident at p.pattern_confidence and with p.support known instances. An instance
    keeps what made it surest: a round changes it only if it becomes surer. So the rounds, which go
    on until no value, kind or confidence changes, come to an end. Of kinds that are equally sure in
    one round the last by name counts.
    """
    graph = Written(found.select("value", F.explode("patterns").alias("pattern")).distinct(), "graph")
    seeds = found.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind")).distinct().withColumn("confidence", F.lit(1.0)).withColumn("seed", F.lit(True))
    seeds, degree = Written(seeds, "seeds"), Written(graph.df.groupBy("pattern").agg(F.count("*").alias("degree")), "degree")
    known = Written(seeds.df, "known")
    while True:
        lifted = graph.df.join(known.df, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"), F.count("*").alias("members"))
        sure = (
            lifted.where(F.col("members") >= p.support)
            .join(degree.df, "pattern")
            .select("pattern", "kind", F.round(F.col("mass") / (F.col("degree") + p.smoothing), 6).alias("of"))
            .where(F.col("of") >= p.pattern_confidence)
        )
        each = graph.df.join(sure, "pattern").groupBy("value", "kind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("of")))), 4).alias("confidence"))
        best = each.groupBy("value").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind")).alias("x")).select("value", "x.kind", "x.confidence")
        best = best.where(F.col("confidence") >= p.instance_confidence).select("value", F.struct("confidence", F.lit(0).alias("old"), "kind", F.lit(False).alias("seed")).alias("x"))
        had = known.df.select("value", F.struct("confidence", F.lit(1).alias("old"), "kind", "seed").alias("x"))
        after = Written(had.unionByName(best).groupBy("value").agg(F.max("x").alias("x")).select("value", "x.kind", "x.confidence", "x.seed", (F.col("x.old") == 0).alias("changed")), "known")
        known.drop()
        known = after
        if not after.df.where("changed").limit(1).count():
            break
    known.df = known.df.drop("changed")
    for t in (graph, seeds, degree):
        t.drop()
    return known


def identifiers(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal identifiers: (doc_id, start, end, kind, confidence, discovered, shape, sha256), a row a mention.

    discovered: found by confident patterns, not by a seed rule. The value itself isn't given, but
    its shape and its hash. start and end count characters of the whole text. Null and empty texts
    have none; rows without an id are left out; repeated rows are reported each, but a value counts
    once in every statistic. Of kinds that are equally sure the last by name is given. An empty
    table gives no rows.
    """
    found = _mentioned(id_text(df, id_col, text_col), p)
    known = bootstrapped(found.df, p)
    shape = F.regexp_replace(F.regexp_replace("value", r"\d", "9"), r"\p{L}", "a")
    return (
        found.df.drop("seed", "patterns")
        .join(known.df, "value")
        .select("doc_id", "start", "end", "kind", "confidence", (~F.col("seed")).alias("discovered"), shape.alias("shape"), F.sha2("value", 256).alias("sha256"))
    )
