"""MinHash near-duplicates with a circulant pair of permutations.

One permutation scatters the shingle universe; a second, shifted circularly by k, gives coordinate k
of the signature, so two permutations stand for all of them: the values of one shingle in all K
coordinates are K neighbouring cells of the second permutation. Bands of rows give candidate pairs;
every candidate pair that could still change a group is verified by the exact Jaccard similarity of
the shingle sets. No bucket is cut: a bucket first compares its members with its smallest one, and
only pairs that are still in different groups are compared after that, all of them, in blocks of
bounded size. Before any text is read a pair has to agree in size (a bound without exceptions) and in
as many coordinates, two bits of each, as all but one in 100,000 pairs at the threshold do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHash, Written, connected, id_text, sized


@dataclass(frozen=True)
class Params:
    shingle: int = 3  #: words a shingle
    threshold: float = 0.5  #: least Jaccard similarity of near copies
    bands: int = 48  #: with 4 rows a pair at the threshold shares a bucket with probability 0.955
    rows: int = 4
    block: int = 2000  #: members of a bucket that meet all its others in one task
    universe_bits: int = 20
    seed: int = 7


_MULS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for k in range(n):
            out += hashes[k : len(hashes) - n + 1 + k] * _MULS[k % len(_MULS)] + np.uint64(k)
            out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


class Circulant:
    """Signatures by two permutations of the universe, made anew from the seed in each worker."""

    def __init__(self, p: Params):
        rng = np.random.default_rng(p.seed)
        self.p, d, self.k = p, 1 << p.universe_bits, p.bands * p.rows
        self.first = rng.permutation(d).astype(np.int32)
        second = rng.permutation(d).astype(np.int32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: self.k]]), self.k)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.first[(shingles >> np.uint64(64 - self.p.universe_bits)).astype(np.int32)]
        out = self.shifted[at[:2048]].min(axis=0)
        for k in range(2048, len(at), 2048):
            np.minimum(out, self.shifted[at[k : k + 2048]].min(axis=0), out=out)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, with the band's number in it, of each row of signatures."""
        v = signatures.astype(np.uint64).reshape(len(signatures), self.p.bands, self.p.rows)
        with np.errstate(over="ignore"):
            out = np.broadcast_to((np.arange(self.p.bands, dtype=np.uint64) + np.uint64(1)) * _MULS[0], v.shape[:2]).copy()
            for r in range(self.p.rows):
                out = (out ^ v[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
                out ^= out >> np.uint64(31)
        return out.view(np.int64)


SKETCH = "sketch struct<shingles:int,bits:array<long>>"


def least_agreement(p: Params) -> int:
    """Coordinates whose two bits agree in all but one of 100,000 pairs at the threshold; two bits of different values agree by chance in a quarter."""
    k = p.bands * p.rows
    q, total = p.threshold + (1 - p.threshold) / 4, 0.0
    for i in range(k + 1):
        total += math.exp(math.lgamma(k + 1) - math.lgamma(i + 1) - math.lgamma(k - i + 1) + i * math.log(q) + (k - i) * math.log1p(-q))
        if total > 1e-5:
            return i
    return k


def packed_bits(signatures: np.ndarray) -> np.ndarray:
    """The two lowest bits of each coordinate of each row, as 64-bit numbers: those of the lowest bits, then those of the next."""
    n, k = signatures.shape
    out = np.zeros((n, 2, -(-k // 64) * 64), np.uint8)
    out[:, 0, :k], out[:, 1, :k] = signatures & 1, signatures >> 1 & 1
    return np.packbits(out, axis=2).view(np.int64).reshape(n, -1)


def alike(p: Params, x: str, y: str) -> Column:
    """Whether the sketches in two columns, structs of shingles and bits, leave it open that their documents are near copies."""
    a, b, words = F.col(x), F.col(y), -(-p.bands * p.rows // 64)
    bit = lambda k: a["bits"][k].bitwiseXOR(b["bits"][k])
    differ = sum((F.bit_count(bit(k).bitwiseOR(bit(k + words))) for k in range(1, words)), F.bit_count(bit(0).bitwiseOR(bit(words))))
    close = F.least(a["shingles"], b["shingles"]) >= F.greatest(a["shingles"], b["shingles"]) * F.lit(p.threshold - 1e-9)
    return close & (differ <= p.bands * p.rows - least_agreement(p))


def signatures(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, norm, sketch, keys): digest of the word sequence, number of shingles and two bits a coordinate, band keys; texts without words are left out."""

    def batches(it):
        made, cache = Circulant(p), WordHash()
        for batch in it:
            ids, norms, ns, sigs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = WORD.findall(text.as_py().lower())
                if not words:
                    continue
                hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                ids.append(i)
                norms.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                shingles = np.unique(shingle_hashes(hashes, p.shingle))
                ns.append(len(shingles))
                sigs.append(made.signature(shingles))
            if ids:
                sigs = np.stack(sigs)
                keys, bits = made.keys(sigs), packed_bits(sigs)
                lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), a.reshape(-1))
                sketch = pa.StructArray.from_arrays([pa.array(ns, pa.int32()), lists(bits)], names=["shingles", "bits"])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(norms, pa.binary()), sketch, lists(keys)], names=["doc_id", "norm", "sketch", "keys"])

    return docs.mapInArrow(batches, f"doc_id long, norm binary, {SKETCH}, keys array<long>")


def shingle_set(text: str, n: int) -> set:
    words = WORD.findall(text.lower())
    n = min(n, len(words))
    return set(zip(*(words[k:] for k in range(n)))) if words else set()


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0


def verified(pairs: DataFrame, docs: DataFrame, p: Params) -> Written:
    """Of pairs (a, b) those whose texts' exact Jaccard similarity reaches the threshold."""
    wanted = Written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    texts = Written(docs.join(sized(wanted.df), "doc_id", "left_semi"), "texts")
    wanted.drop()
    left, right = (texts.df.select(F.col("doc_id").alias(x), F.col("text").alias(y)) for x, y in (("a", "left"), ("b", "right")))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")

    def batches(it):
        last, of_last = None, set()
        for batch in it:
            a, b, left, right = batch.columns
            out = []
            for k in range(batch.num_rows):
                text = left[k].as_py()
                if text != last:
                    last, of_last = text, shingle_set(text, p.shingle)
                out.append(jaccard(of_last, shingle_set(right[k].as_py(), p.shingle)))
            yield pa.record_batch([a, b, pa.array(out, pa.float64())], names=["a", "b", "jaccard"])

    found = Written(joined.mapInArrow(batches, "a long, b long, jaccard double").where(F.col("jaccard") >= p.threshold).select("a", "b").distinct(), "verified")
    texts.drop()
    return found


def near_duplicates(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near copies: (doc_id, group_id, kept, exact), a row for each document in a group of two or more.

    group_id is the smallest doc_id of the group, and that document is the one kept. exact: another
    document has the same words in the same order. Groups are the connected components of all
    verified pairs. Null, empty and wordless texts are in no group; rows without an id are left out;
    rows that repeat an id are one document (with texts of both, if they differ). An empty table
    gives no rows. Texts are read whole, whatever their length.
    """
    docs = id_text(df, id_col, text_col)
    signed = Written(signatures(docs, p), "signed")
    #: one document stands for all that have the same words; it is the one with the smallest id
    reps = signed.df.groupBy("norm").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep <> most").select("norm", "rep")
    exact = Written(signed.df.select("doc_id", "norm").distinct().join(reps, "norm").where("doc_id <> rep"), "exact")
    standing = signed.df.join(exact.df.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti")
    cells = standing.select("doc_id", F.explode("keys").alias("key"))
    centres = cells.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("most")).where("centre <> most").select("key", "centre")
    shared = Written(cells.join(centres, "key"), "shared")
    #: rows that repeat an id have one sketch each, the largest is taken; such ids are rare
    sketches = Written(standing.join(shared.df.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("sketch").alias("sketch")), "sketches")
    of = lambda x, y: sketches.df.select(F.col("doc_id").alias(x), F.col("sketch").alias(y))

    stars = shared.df.where("centre <> doc_id").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = Written(stars.join(of("b", "of_b"), "b").join(of("a", "of_a"), "a").where(alike(p, "of_a", "of_b")).select("a", "b"), "stars")
    first = verified(stars.df, docs, p)
    groups = connected(first.df, "first-groups")
    label = groups.df.select(F.col("node").alias("doc_id"), "label")
    placed = shared.df.select("key", "doc_id").join(label, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    #: what a bucket still holds apart: all pairs across groups, from the smaller groups' members to all others
    by_key = placed.groupBy("key", "label").agg(F.count("*").alias("size"))
    main = by_key.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1").select("key", "main", F.ceil(F.col("size") / p.block).cast("int").alias("blocks"))
    apart = Written(placed.join(main, "key").join(sketches.df, "doc_id"), "apart")
    #: each of the few is in one block of its bucket, and all members come to each block
    few = apart.df.where("label <> main").select("key", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), F.col("doc_id").alias("x"), F.col("label").alias("x_label"), F.col("sketch").alias("x_sketch"))
    every = apart.df.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc_id", "label", "sketch")
    rest = (
        few.join(every, (few["key"] == every["key"]) & (few["block"] == every["block"]) & (F.col("x_label") != F.col("label")) & alike(p, "x_sketch", "sketch"))
        .select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b"))
        .distinct()
        .join(stars.df, ["a", "b"], "left_anti")
    )
    rest = Written(rest, "rest")
    second = verified(rest.df, docs, p)
    edges = first.df.union(second.df).union(exact.df.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    whole = connected(edges, "groups")
    copies = exact.df.select("doc_id").union(exact.df.select("rep")).distinct().withColumn("exact", F.lit(True))
    out = Written(
        whole.df.select(F.col("node").alias("doc_id"), F.col("label").alias("group_id"))
        .join(copies, "doc_id", "left")
        .select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"), F.coalesce("exact", F.lit(False)).alias("exact")),
        "near",
    )
    for t in (signed, exact, shared, sketches, stars, first, groups, apart, rest, second, whole):
        t.drop()
    return out.df


def one_of_each(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without all but one document of each group of near copies, columns as they were.

    Rows without an id go. Of rows that repeat an id one stays, the one with the smallest text.
    """
    near = near_duplicates(df, p, id_col, text_col)
    gone = sized(near.where(~F.col("kept")).select(F.col("doc_id")))
    some = df.where(F.col(id_col).isNotNull())
    left = some.join(gone, some[id_col].cast("long") == gone["doc_id"], "left_anti")
    repeated = Written(left.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("id")), "repeated")
    if not repeated.df.limit(1).count():
        repeated.drop()
        return left
    once = left.join(repeated.df, left[id_col] == repeated.df["id"], "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    row = F.col("row")
    least = once.groupBy(row[id_col]).agg(F.min_by(row, F.struct(row[text_col], F.to_json(row))).alias("row")).select("row.*")
    return left.join(repeated.df, left[id_col] == repeated.df["id"], "left_anti").unionByName(least)
