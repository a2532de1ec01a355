"""Benchmark decontamination by latent semantic retrieval.

Documents are read once into term numbers of the benchmark's vocabulary (words outside it can match
nothing). Their TF-IDF passages, and the benchmark's own, form a matrix whose leading right singular
vectors come from a randomised subspace iteration: tasks add up A'(AQ) over their passages, and only
the sum, terms by rank, reaches the driver. Every overlapping passage of every document is a query
against all benchmark passages by cosine in the evened latent space; what comes near is verified
by the longest common subsequence of words with the item, and by its answer's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Written, id_text, sized


@dataclass(frozen=True)
class Params:
    width: int = 32  #: words a passage
    stride: int = 16  #: divides the width
    rank: int = 64
    oversample: int = 8
    iterations: int = 2  #: passes of A'A
    cosine: float = 0.2
    lcs: float = 0.6  #: of the item's words, in order
    answer: float = 0.5  #: of the answer's words, in order
    block_chars: int = 4_000_000  #: characters of benchmark text whose items are searched for in one pass
    seed: int = 5


@dataclass
class Items:
    """The benchmark on the driver: words as term numbers, and which of them answer."""

    ids: list[int]
    vocabulary: dict[str, int] = field(default_factory=dict)
    words: list[np.ndarray] = field(default_factory=list)
    answers: list[np.ndarray] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  #: characters

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        out = Items([])
        for i, text in sorted(set(rows)):
            number = lambda s: np.array([out.vocabulary.setdefault(w, len(out.vocabulary)) for w in WORD.findall(s.lower())], np.int32)
            words = number(text)
            if not len(words):
                continue
            parts = [n for s in re.split(r"[.?!\n]+", text) if len(n := number(s))]
            #: the answer: the last sentence of three words or more, else the last third
            answer = parts[-1] if len(parts) > 1 and len(parts[-1]) >= 3 else words[-max(1, len(words) // 3) :]
            out.ids.append(i)
            out.words.append(words)
            out.answers.append(answer)
            out.sizes.append(len(text))
        return out

    def blocks(self, p: Params) -> list[Items]:
        """Parts of about p.block_chars characters, with the vocabulary of all."""
        out, held = [], p.block_chars
        for i, words, answer, size in zip(self.ids, self.words, self.answers, self.sizes):
            if held >= p.block_chars:
                out.append(Items([]))
                held = 0
            out[-1].ids.append(i)
            out[-1].words.append(words)
            out[-1].answers.append(answer)
            held += size
        return out


def _starts(n: int, p: Params) -> np.ndarray:
    """Where the overlapping passages of n words begin, a stride apart; the last one reaches the end."""
    return p.stride * np.arange(1 + max(0, -(-(n - p.width) // p.stride)))


def sums(source: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of source[index[starts[i]:starts[i + 1]]] for each i, none of them empty.

    Segments are summed a place at a time, the longest first, so that each step adds whole rows;
    long ones are cut up, and their parts summed in turn.
    """
    sizes = np.diff(np.append(starts, len(index)))
    if not len(sizes):
        return np.zeros((0, source.shape[1]), np.float32)
    if sizes.max() > 64:
        parts = -(-sizes // 32)
        first = np.cumsum(parts) - parts
        at = np.repeat(starts - 32 * first, parts) + 32 * np.arange(parts.sum())
        return sums(sums(source, index, at), np.arange(len(at)), first)
    order = np.argsort(-sizes, kind="stable")
    at, count = starts[order], np.bincount(sizes, minlength=sizes.max() + 1)
    out, n = source.take(index[at], axis=0), len(sizes)
    for k in range(1, sizes.max()):
        n -= count[k]
        out[:n] += source.take(index[at[:n] + k], axis=0)
    back = np.empty_like(out)
    back[order] = out
    return back


class Sparse:
    """Rows of TF-IDF, each divided by the square root of its words' summed idf squared, as arrays sorted by row."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, idf: np.ndarray):
        live = idf[terms] > 0
        self.row, self.term, self.idf = rows[live], terms[live], idf
        self.named, self.start = np.unique(self.row, return_index=True)
        if len(self.row):
            self.norm = np.sqrt(np.add.reduceat(np.square(idf)[self.term], self.start))[:, None]

    def times(self, q: np.ndarray) -> np.ndarray:
        """A Q, of the rows that aren't empty."""
        return sums(q * self.idf[:, None], self.term, self.start) / self.norm

    def add_transposed(self, y: np.ndarray, out: np.ndarray) -> None:
        """out += A' Y."""
        order = np.argsort(self.term.astype(np.uint16) if len(self.idf) < 65536 else self.term, kind="stable")
        term, at = np.unique(self.term[order], return_index=True)
        local = np.repeat(np.arange(len(self.named)), np.diff(np.append(self.start, len(self.row))))
        out[term] += sums(y / self.norm, local[order], at) * self.idf[term, None]


def _tiles(coded, width: int, most: int = 120_000):
    """Of (id, terms) arrays: passages side by side, as (rows, terms) of about `most` hits at a time."""
    rows, terms, base, n = [], [], 0, 0
    for ids in coded:
        for at in range(0, len(ids), width * 2048):
            part = ids[at : at + width * 2048]
            hit = np.flatnonzero(part >= 0)
            rows.append(base + hit // width)
            terms.append(part[hit])
            base += -(-len(part) // width)
            n += len(hit)
            if n >= most:
                yield np.concatenate(rows), np.concatenate(terms)
                rows, terms, base, n = [], [], 0, 0
    if n:
        yield np.concatenate(rows), np.concatenate(terms)


def _arrays(column: pa.ListArray):
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for a, b in zip(offsets, offsets[1:]):
        yield flat[a:b]


def coded(docs: DataFrame, vocabulary: dict[str, int], p: Params) -> Written:
    """A written table: (doc_id, terms) with -1 for words outside the vocabulary, and, doc_id null, passages by term a task.

    The last place of a task's counts is its number of passages. Texts with no word of the
    vocabulary are left out, but their passages count.
    """
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batches(it):
        number, v = words.value.get, len(words.value)
        seen = np.zeros(v + 1, np.int64)
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                ids, all_terms = [], []
                part = batch.slice(at, 1024)
                for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                    found = WORD.findall(text.as_py().lower())
                    terms = np.fromiter(map(number, found, repeat(-1)), np.int32, len(found))
                    seen[v] += -(-len(terms) // p.width)
                    if len(terms) and terms.max() >= 0:
                        ids.append(i)
                        all_terms.append(terms)
                for rows, terms in _tiles(all_terms, p.width, 1 << 20):
                    seen[:v] += np.bincount(np.unique(rows * v + terms) % v, minlength=v)
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(t) for t in all_terms])]).astype(np.int32)
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(all_terms)), pa.nulls(len(ids), pa.list_(pa.int64()))], names=["doc_id", "terms", "seen"])
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([[]], pa.list_(pa.int32())), pa.array([seen], pa.list_(pa.int64()))], names=["doc_id", "terms", "seen"])

    return Written(docs.mapInArrow(batches, "doc_id long, terms array<int>, seen array<long>"), "coded")


def gram_times(table: DataFrame, idf: np.ndarray, q: np.ndarray, p: Params) -> np.ndarray:
    """A'(A Q) over all passages; tasks' sums are added up by blocks of terms before they come to the driver.

    They are added in two steps, so that no group holds more than a share of the tasks' arrays.
    """
    sent = table.sparkSession.sparkContext.broadcast((idf, q))
    block = 512

    def batches(it):
        idf, q = sent.value
        out = np.zeros(q.shape, np.float32)
        for batch in it:
            for rows, terms in _tiles(_arrays(batch.column(0)), p.width):
                a = Sparse(rows, terms, idf)
                if len(a.row):
                    a.add_transposed(a.times(q), out)
        salt = TaskContext.get().partitionId() % 256
        for k in range(0, len(out), block):
            yield pa.record_batch([pa.array([k // block], pa.int32()), pa.array([salt], pa.int32()), pa.array([out[k : k + block].tobytes()], pa.binary())], names=["block", "salt", "part"])

    def add(kind):
        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, kind).astype(np.float64) for x in pdf["part"])
            return pd.DataFrame({"block": pdf["block"][:1], "part": [total.tobytes()]})

        return added

    each = table.where("doc_id IS NOT NULL").select("terms").mapInArrow(batches, "block int, salt int, part binary")
    salted = each.groupBy("block", "salt").applyInPandas(add(np.float32), "block int, part binary")
    parts = salted.groupBy("block").applyInPandas(add(np.float64), "block int, part binary").collect()
    out = np.zeros(q.shape)
    for r in parts:
        got = np.frombuffer(r["part"]).reshape(-1, q.shape[1])
        out[r["block"] * block : r["block"] * block + len(got)] = got
    return out


def item_passages(items: Items, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms) of the items' overlapping passages, and the item that each passage belongs to."""
    rows, terms, owner = [], [], []
    for k, w in enumerate(items.words):
        for at in _starts(len(w), p):
            part = w[at : at + p.width]
            rows.append(np.full(len(part), len(owner)))
            terms.append(part)
            owner.append(k)
    return np.concatenate(rows), np.concatenate(terms), np.array(owner)


def latent_space(table: DataFrame, items: Items, idf: np.ndarray, p: Params) -> np.ndarray:
    """Terms by rank: right singular vectors, each divided by its singular value, softened.

    The mean of their squares is added to each square, so that directions that hardly occur aren't blown up.
    """
    rows, terms, _ = item_passages(items, p)
    own = Sparse(rows, terms, idf)

    def gram(q):
        out = gram_times(table, idf, q.astype(np.float32), p)
        if len(own.row):
            mine = np.zeros(q.shape, np.float32)
            own.add_transposed(own.times(q.astype(np.float32)), mine)
            out += mine
        return out

    r = min(p.rank + p.oversample, len(idf))
    q, _ = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((len(idf), r)))
    for _ in range(p.iterations - 1):
        q, _ = np.linalg.qr(gram(q))
    small = q.T @ gram(q)
    power, u = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(power)[::-1][: p.rank]
    best = best[power[best] > 1e-6 * max(power[best[0]], 1e-12)]
    return (q @ u[:, best] / np.sqrt(power[best] + power[best].mean())).astype(np.float32)


def common_subsequence(masks: dict[int, int], size: int, words) -> int:
    """Length of the longest common subsequence, all of the item's places at once in the bits of one number."""
    full = v = (1 << size) - 1
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def signature(rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    """512 bits a row, by the terms in it: a term that is there has its bit set."""
    out = np.zeros((n, 512), bool)
    out[rows, terms * 167 % 512] = True
    return np.packbits(out, axis=1).view(np.uint64)


def folded(signatures: np.ndarray) -> np.ndarray:
    """The eight words of each row made two, a bit set that is set in one of four."""
    return np.bitwise_or.reduce(signatures.reshape(len(signatures), 4, 2), axis=1)


def neighbourhood(rows: np.ndarray, terms: np.ndarray, n: int, span: tuple[int, int]) -> np.ndarray:
    """signature() of each block together with span[0] blocks before and span[1] - 1 after it."""
    own = signature(rows, terms, n)
    out = own.copy()
    for k in range(1, min(span[0], n - 1) + 1):
        out[k:] |= own[:-k]
    for k in range(1, min(span[1] - 1, n - 1) + 1):
        out[:-k] |= own[k:]
    return out


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _found(table: DataFrame, items: Items, idf: np.ndarray, space: np.ndarray, p: Params) -> DataFrame:
    sent = table.sparkSession.sparkContext.broadcast((items, idf, space))

    def batches(it):
        items, idf, space = sent.value
        rows, terms, owner = item_passages(items, p)
        a = Sparse(rows, terms, idf)
        if not len(a.row):
            return
        target = a.times(space)
        target /= np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-9)
        owner, target = owner[a.named], np.ascontiguousarray(target.T)
        weighted, per = space * idf[:, None], p.width // p.stride
        masks = [(_masks(w), len(w), _masks(x), len(x)) for w, x in zip(items.words, items.answers)]
        wide = 4 * p.stride
        #: of an item's bits, all but one for each word it may lack must be set near a passage
        bits = np.concatenate([signature(np.zeros(len(w), np.int64), w, 1) for w in items.words])
        need = np.bitwise_count(bits).sum(axis=1) - np.array([len(w) - int(np.ceil(p.lcs * len(w) - 1e-9)) for w in items.words])
        #: how far round a passage an item's words may lie, in blocks: its own size, rounded up to a power of two
        reaches, reach = np.unique([1 << (-(-len(w) // p.stride) - 1).bit_length() for w in items.words], return_inverse=True)
        #: the same by a quarter of the bits first, which rejects most at less cost
        few_bits = np.ascontiguousarray(folded(bits).T)
        few_need = np.bitwise_count(few_bits).sum(axis=0) - (np.bitwise_count(bits).sum(axis=1) - need)

        def search(ids, docs):
            rows, terms, at, whose, first, hits = [], [], [], [], [], []
            n = m = 0
            for k, words in enumerate(docs):
                hit = np.flatnonzero(words >= 0)
                starts = _starts(len(words), p)
                blocks = len(starts) + per - 1
                rows.append(n + np.minimum(hit // p.stride, blocks - 1))
                terms.append(words[hit])
                hits.append(hit)
                at.append(starts)
                whose.append(np.full(len(starts), k))
                first.append(n + np.arange(len(starts)))
                n += blocks
                m += len(starts)
            terms_of, rows_all, terms_all = terms, np.concatenate(rows), np.concatenate(terms)
            live = idf[terms_all] > 0
            rows, terms = rows_all[live], terms_all[live]
            if not len(rows):
                return []
            named, start = np.unique(rows, return_index=True)
            block = np.zeros((n, space.shape[1]), np.float32)
            block[named] = sums(weighted, terms, start)
            at, whose, first, best = np.concatenate(at), np.concatenate(whose), np.concatenate(first), {}
            #: a passage is `per` blocks of a stride each; a last one that is shorter has empty ones
            y = block[first]
            for k in range(1, per):
                y += block[first + k]
            norm = np.linalg.norm(y, axis=1)
            some = np.flatnonzero(norm > 0)
            y, at, whose = y[some] / norm[some, None], at[some], whose[some]
            around = np.concatenate([neighbourhood(rows_all, terms_all, n, (int(r), per + int(r)))[first[some]] for r in reaches])
            few_around, of_reach = np.ascontiguousarray(folded(around).T), reach * len(some)
            for k in range(0, len(y), 4096):
                near = y[k : k + 4096] @ target
                row, col = np.divmod(np.flatnonzero(near.ravel() >= p.cosine), near.shape[1])
                item = owner[col]
                there = of_reach[item] + k + row
                few = np.bitwise_count(few_around[0][there] & few_bits[0][item]) + np.bitwise_count(few_around[1][there] & few_bits[1][item])
                left = np.flatnonzero(few >= few_need[item])
                left = left[np.bitwise_count(around[there[left]] & bits[item[left]]).sum(axis=1) >= need[item[left]]]
                row, item, col = row[left], item[left], col[left]
                #: passages of a run that an item is near are tried together first: what all their words don't hold, none does
                run = at[k + row] // wide
                _, group, many = np.unique((whose[k + row] << 32 | run) * len(masks) + item, return_inverse=True, return_counts=True)
                held = [None if m > 1 else True for m in many.tolist()]
                for row, item, cosine, run, group in zip(row, item, near[row, col].tolist(), run.tolist(), group.tolist()):
                    passage = k + row
                    doc, start = whose[passage], int(at[passage])
                    whole, size, answer, answer_size = masks[item]
                    if held[group] is None:
                        lo, hi = np.searchsorted(hits[doc], (wide * run - size, wide * (run + 1) - p.stride + p.width + size))
                        held[group] = common_subsequence(whole, size, terms_of[doc][lo:hi].tolist()) / size >= p.lcs
                    if not held[group]:
                        continue
                    #: words outside the vocabulary match nothing
                    lo, hi = np.searchsorted(hits[doc], (start - size, start + p.width + size))
                    part = terms_of[doc][lo:hi].tolist()
                    lcs = common_subsequence(whole, size, part) / size
                    if lcs < p.lcs:
                        continue
                    said = common_subsequence(answer, answer_size, part) / answer_size
                    if said < p.answer:
                        continue
                    key, value = (ids[doc], items.ids[item]), (lcs, said, cosine, -start)
                    if value > best.get(key, (0,)):
                        best[key] = value
            return [(*k, *v[:3], -v[3]) for k, v in best.items()]

        for batch in it:
            ids, docs, n = [], [], 0
            out = []
            for i, words in zip(batch.column(0).to_pylist(), _arrays(batch.column(1))):
                ids.append(i)
                docs.append(words)
                n += len(words)
                if n > 100_000:
                    out += search(ids, docs)
                    ids, docs, n = [], [], 0
            if ids:
                out += search(ids, docs)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "item_id", "lcs", "answer", "cosine", "at_word"])

    return table.where("doc_id IS NOT NULL").select("doc_id", "terms").mapInArrow(batches, "doc_id long, item_id long, lcs double, answer double, cosine double, at_word int")


SCHEMA = "doc_id long, item_id long, lcs double, answer double, at_word int"


def leaks(df: DataFrame, benchmark: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Benchmark items found in documents: (doc_id, item_id, lcs, answer, at_word), a row for each pair, at its best place.

    lcs and answer are shares of the item's and its answer's words found in order near that place,
    a word number of the document. Null, empty and wordless texts, of documents or items, match
    nothing; rows without an id are left out; rows that repeat an id are one. Items with the same
    words are found each. Vocabulary, weights and latent space are those of the whole benchmark, which
    the driver holds; its items are searched for in blocks of p.block_chars, so that what a task
    holds of them stays bounded, and the blocks don't change what is found. An empty benchmark gives
    no rows. Of equally good places the first counts.
    """
    spark, docs = df.sparkSession, id_text(df, id_col, text_col)
    own = id_text(benchmark, "item_id", "text").withColumnRenamed("doc_id", "item_id").distinct()
    items = Items.of([tuple(r) for r in own.toLocalIterator()])
    if not items.ids:
        return spark.createDataFrame([], SCHEMA)
    table = coded(docs, items.vocabulary, p)
    seen = np.zeros(len(items.vocabulary) + 1)
    for r in table.df.where("doc_id IS NULL").select(F.posexplode("seen")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        seen[r["pos"]] = r["n"]
    n = seen[-1] + len(items.ids)
    idf = np.log((n + 1) / (seen[:-1] + 1)).clip(0).astype(np.float32)
    space = latent_space(table.df, items, idf, p)
    best = F.max_by(F.struct("lcs", "answer", "at_word"), F.struct("lcs", "answer", -F.col("at_word"))).alias("best")
    found = [Written(_found(table.df, part, idf, space, p).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*"), "leaks").df for part in items.blocks(p)]
    table.drop()
    return reduce(DataFrame.unionByName, found)


def without_leaks(df: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of df in which no benchmark item is found, columns as they were; rows without an id go.

    Of rows that repeat an id all go if an item is in one of them. Null and empty texts stay.
    """
    gone = Written(leaks(df, benchmark, p).select("doc_id").distinct(), "leaking")
    left, right = df.where(F.col("doc_id").isNotNull()), sized(gone.df)
    return left.join(right, left["doc_id"].cast("long") == right["doc_id"], "left_anti")
