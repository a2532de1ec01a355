"""Quality rules with risk-controlled thresholds.

Each rule is a measure of the text, written so that more is worse, and a grid of cutoffs. In every
stratum (language) a cutoff is used only if the labelled holdout proves, by an exact binomial bound,
that rejecting beyond it takes at most a share alpha of the good documents: the Clopper-Pearson
upper bound of the rate of false rejections, at level delta shared out (Bonferroni) over all cutoffs
of all rules in all strata, lies at or below alpha. The lowest proven cutoff is used; where none is
proven the rule rejects nothing in that stratum. alpha is shared out over the rules, so that all rules
together wrongly reject at most alpha of a stratum's good documents, with probability 1 - delta.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, sized

#: name -> (share of the text, in per mille, whose excess is bad; cutoffs)
GRID = tuple(range(50, 1000, 50))
RULES = ("symbols", "capitals", "bars", "one_line_repeats", "scarce_letters")


@dataclass(frozen=True)
class Params:
    alpha: float = 0.10  #: of the good documents of a stratum, at most this share may be rejected
    delta: float = 0.05
    grid: tuple[int, ...] = GRID


def _per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("int")


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measures(text: Column) -> dict[str, Column]:
    """Integer per mille each, whole text, all in JVM expressions; 0 for an empty text."""
    size = F.length(text)
    lines = F.split(text, "\n")
    return {
        "symbols": _per_mille(_without(text, "[#$%&*!]"), size),
        "capitals": _per_mille(_without(text, r"\p{Lu}"), size),
        "bars": _per_mille(_without(text, r"\|"), size),
        "one_line_repeats": _per_mille(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "scarce_letters": F.when(size > 0, 1000 - _per_mille(_without(text, r"[\p{L} ]"), size)).otherwise(0).cast("int"),
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials at p, summed term by term in logarithms."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return math.fsum(math.exp(log(i)) for i in range(k + 1))


def most_false(n: int, alpha: float, level: float) -> int:
    """The most false rejections among n good documents that still prove a rate of at most alpha; -1 if even none don't.

    The upper Clopper-Pearson bound at that level is <= alpha exactly if P(X <= k | n, alpha) <= level.
    """
    total, k = 0.0, -1
    for i in range(n):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha))
        if total > level:
            break
        k = i
    return k


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"))


def thresholds(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_false): the cutoffs in use; a measure above its cutoff rejects.

    The holdout is every labelled good document. Its rejections are counted in Spark over the grid;
    only counts by stratum, rule and cutoff come to the driver. A document with labels that disagree
    is not good; repeated rows of one document count once.
    """
    good = _good(labels)
    if good.df.count() <= 2_000_000:
        held = _measured(_prepared(docs).join(F.broadcast(good.df), "doc_id", "left_semi"))
    else:  # texts are measured where they are, and only numbers shuffled
        held = Written(_measured(_prepared(docs)), "measured").df.join(good.df, "doc_id", "left_semi")
    out = _proven(held, p)
    good.drop()
    return out


def _good(labels: DataFrame) -> Written:
    own = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    return Written(own.where("q = 1").select("doc_id"), "good")


def _measured(prepared: DataFrame) -> DataFrame:
    of = measures(F.col("text"))
    return prepared.select("doc_id", "stratum", (F.trim("text") == "").alias("__empty"), *[of[r].alias(r) for r in RULES])


def _proven(held: DataFrame, p: Params) -> DataFrame:
    held = held.groupBy("doc_id", "stratum").agg(*[F.max(r).alias(r) for r in RULES])
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{c}") for r in RULES for c in p.grid]).collect()
    tests = max(1, len(counts)) * len(RULES) * len(p.grid)
    rows = []
    for row in sorted(counts, key=lambda r: r["stratum"]):
        most = most_false(row["n"], p.alpha / len(RULES), p.delta / tests)
        for r in RULES:
            proven = [c for c in p.grid if row[f"{r}_{c}"] <= most]
            if proven:
                rows.append((row["stratum"], r, proven[0], row["n"], row[f"{r}_{proven[0]}"]))
    return held.sparkSession.createDataFrame(rows, "stratum string, rule string, cutoff int, n_good long, n_false long")


def _verdict(cutoffs: DataFrame, of: dict[str, Column], stratum: Column) -> Column:
    """Names of the rules that reject; the cutoffs (strata x rules, a small table) become literals."""
    fails = [F.when((stratum == F.lit(r["stratum"])) & (of[r["rule"]] > r["cutoff"]), F.lit(r["rule"])) for r in cutoffs.orderBy("rule", "stratum").collect()]
    fails.insert(0, F.when(F.col("__empty"), F.lit("empty")))
    return F.array_compact(F.array(*fails))


def judged(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Each document with its measures and verdict: (doc_id, stratum, the measures, rejected_by, kept).

    A null or blank text is rejected as 'empty'; a null language is the stratum ''. Rows without
    an id are left out; repeated rows are judged each. With no labels no cutoff is proven, and only
    empty texts are rejected. An empty table gives no rows.
    """
    #: texts are read once; cutoffs and verdicts need the numbers only
    measured = Written(_measured(_prepared(docs).where(F.col("doc_id").isNotNull())), "measured").df
    good = _good(labels)
    cutoffs = _proven(measured.join(sized(good.df), "doc_id", "left_semi"), p)
    good.drop()
    by = _verdict(cutoffs, {r: F.col(r) for r in RULES}, F.col("stratum"))
    return measured.select("doc_id", "stratum", *RULES, F.array_join(by, ",").alias("rejected_by"), (F.size(by) == 0).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that no rule rejects, columns as they were; rows without an id go.

    Nulls, blank texts, repeats and empty tables as in judged().
    """
    cutoffs = thresholds(docs, labels, p).collect()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of, stratum = measures(text), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    keep = F.col("doc_id").isNotNull() & (F.trim(text) != "")
    for rule in RULES:
        here = [r for r in cutoffs if r["rule"] == rule]
        if here:
            cutoff = F.coalesce(*[F.when(stratum == F.lit(r["stratum"]), F.lit(r["cutoff"])) for r in here], F.lit(1000))
            keep = keep & (of[rule] <= cutoff)
    return docs.where(keep)


ORACLE = """
WITH good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
m AS (SELECT doc_id, stratum, trim(t) = '' AS blank,
  CAST(CASE WHEN length(t) > 0 THEN floor((length(t) - length(regexp_replace(t, '[#$%&*!]', '', 'g'))) * 1000 / length(t)) ELSE 0 END AS INT) AS symbols,
  CAST(CASE WHEN length(t) > 0 THEN floor((length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g'))) * 1000 / length(t)) ELSE 0 END AS INT) AS capitals,
  CAST(CASE WHEN length(t) > 0 THEN floor((length(t) - length(regexp_replace(t, '\\|', '', 'g'))) * 1000 / length(t)) ELSE 0 END AS INT) AS bars,
  CAST(floor((len(string_split(t, chr(10))) - len(list_distinct(string_split(t, chr(10))))) * 1000 / len(string_split(t, chr(10)))) AS INT) AS one_line_repeats,
  CAST(CASE WHEN length(t) > 0 THEN 1000 - floor((length(t) - length(regexp_replace(t, '[\\p{L} ]', '', 'g'))) * 1000 / length(t)) ELSE 0 END AS INT) AS scarce_letters
  FROM d),
held AS (SELECT doc_id, stratum, max(symbols) AS symbols, max(capitals) AS capitals, max(bars) AS bars, max(one_line_repeats) AS one_line_repeats, max(scarce_letters) AS scarce_letters
  FROM m WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY doc_id, stratum),
long AS (UNPIVOT held ON symbols, capitals, bars, one_line_repeats, scarce_letters INTO NAME rule VALUE v),
grid AS (SELECT CAST(range AS INT) AS c FROM range(50, 1000, 50)),
seen AS (SELECT stratum, rule, c, count(*) AS n, count(*) FILTER (v > c) AS k FROM long, grid GROUP BY stratum, rule, c),
size AS (SELECT count(DISTINCT stratum) * 5 * 19 AS tests FROM held),
tail AS (SELECT s.stratum, s.rule, s.c, s.n, s.k,
  (SELECT sum(exp(lgamma(s.n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN s.n = i THEN 0 ELSE lgamma(s.n - i + 1) END + i * ln(0.1 / 5) + (s.n - i) * ln(1 - 0.1 / 5))) FROM range(0, s.k + 1) r(i)) AS cdf FROM seen s),
cut AS (SELECT stratum, rule, min(c) AS c FROM tail, size WHERE k < n AND cdf <= 0.05 / tests GROUP BY stratum, rule),
wide AS (SELECT stratum, max(c) FILTER (rule = 'symbols') AS c1, max(c) FILTER (rule = 'capitals') AS c2, max(c) FILTER (rule = 'bars') AS c3, max(c) FILTER (rule = 'one_line_repeats') AS c4, max(c) FILTER (rule = 'scarce_letters') AS c5 FROM cut GROUP BY stratum),
v AS (SELECT m.*, concat_ws(',', CASE WHEN blank THEN 'empty' END, CASE WHEN bars > c3 THEN 'bars' END, CASE WHEN capitals > c2 THEN 'capitals' END, CASE WHEN one_line_repeats > c4 THEN 'one_line_repeats' END, CASE WHEN scarce_letters > c5 THEN 'scarce_letters' END, CASE WHEN symbols > c1 THEN 'symbols' END) AS rejected_by
  FROM m LEFT JOIN wide USING (stratum))
SELECT doc_id, stratum, symbols, capitals, bars, one_line_repeats, scarce_letters, rejected_by, rejected_by = '' AS kept FROM v
"""
