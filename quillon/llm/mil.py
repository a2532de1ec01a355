"""Attention-based multiple-instance classifier of document quality and toxicity.

A document is a bag of passages. Every passage is encoded (surface measures and the words that the
labelled sample shows to be telling), gated attention weighs the passages, and the weighted passage
representation is scored. Encoder, attention and scorer are learned together from document labels.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

HEADS = ("quality", "toxic")
_PUNCT = ".,;:!?\"'()[]{}<>|#$%&*-–—…«»„“”"
_LUT = np.zeros(1024, np.uint8)
for _k, _cs in enumerate(("0123456789", "#$%&*", "|", "!", ".,;:?"), 2):
    _LUT[[ord(c) for c in _cs]] = _k
_LUT[[c for c in range(1024) if chr(c).isupper()]] = 1
_CLASSES = 7
SURFACE = _CLASSES + 3


@dataclass(frozen=True)
class Params:
    passage: int = 48  #: words a passage
    max_labelled: int = 8000  #: labelled documents to learn from at most: those of least id hash
    hidden: int = 16
    gate: int = 8
    epochs: int = 24
    batch: int = 64
    rate: float = 0.01
    seed: int = 11
    cutoff: float = 0.5


class Encoder:
    """Text -> features of its passages."""

    def __init__(self, words: dict[str, int], passage: int):
        self.words, self.passage, self.width = words, passage, SURFACE + len(words)

    @staticmethod
    def tokens(text: str) -> list[str]:
        return list(map(str.strip, text.lower().split(), repeat(_PUNCT)))

    def features(self, text: str) -> np.ndarray:
        """(passages, width); a text without words is one passage of zeros."""
        raw = text.split()
        if not raw:
            return np.zeros((1, self.width), np.float32)
        low = list(map(str.strip, map(str.lower, raw), repeat(_PUNCT)))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.zeros(len(raw), np.int64)
        np.cumsum(size[:-1] + 1, out=start[1:])
        at = start[:: self.passage]
        code = np.frombuffer(" ".join(raw).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _LUT[np.minimum(code, 1023)]
        chars = np.diff(np.append(at, len(code))).astype(np.float32)
        out = np.zeros((len(at), self.width), np.float32)
        for k in range(1, _CLASSES):
            out[:, k - 1] = np.add.reduceat(kind == k, at, dtype=np.int32) / chars * 10
        n = np.diff(np.append(np.arange(0, len(raw), self.passage), len(raw)))
        out[:, _CLASSES - 1] = chars / n / 8
        ids = np.fromiter(map(self.words.get, low, repeat(-1)), np.int32, len(low))
        for k in range(len(at)):
            out[k, _CLASSES] = len(set(low[k * self.passage : (k + 1) * self.passage])) / n[k]
        out[:, _CLASSES + 1] = np.log1p(n) / 4
        out[:, _CLASSES + 2] = np.log1p(len(raw)) / 8
        hit = np.flatnonzero(ids >= 0)
        out[hit // self.passage, SURFACE + ids[hit]] = 1
        return out


def telling_words(texts: list[str], labels: np.ndarray, least_chi2: float = 32.0) -> list[str]:
    """All words whose presence parts the labels by a chi-square of at least 32 (chance, over any number of words, seldom reaches it).

    Their number isn't capped; the sample that they come from is bounded.
    """
    total, ones = Counter(), Counter()
    for text, y in zip(texts, labels):
        seen = set(Encoder.tokens(text))
        total.update(seen)
        if y:
            ones.update(seen)
    n, pos = len(texts), float(labels.sum())
    if not 0 < pos < n:
        return []
    scored = []
    for w, t in total.items():
        if t < 5 or t > 0.9 * n or not w:
            continue
        want = t * pos / n
        score = (ones[w] - want) ** 2 * (1 / want + 1 / (t - want)) * n / (n - t)
        if score > least_chi2:
            scored.append((-score, w))
    return [w for _, w in sorted(scored)]


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


class Model:
    """h = tanh(Wx + b); weight ~ exp(w . (tanh(Vh) * sigmoid(Uh))); score = sigmoid(c . sum(weight h) + d)."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, width: int, p: Params, seed: int):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.W, self.b = make(width, p.hidden), np.zeros(p.hidden, np.float32)
        self.V, self.U, self.w = make(p.hidden, p.gate), make(p.hidden, p.gate), make(p.gate)
        self.c, self.d = make(p.hidden), np.zeros(1, np.float32)

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        h = np.tanh(x @ self.W + self.b)
        t, g = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        s = (t * g) @ self.w
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = e / np.repeat(_sums(e, starts), sizes)
        z = _sums(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return h, t, g, a, z, y

    def gradients(self, x, starts, sizes, target):
        h, t, g, a, z, y = self.forward(x, starts, sizes)
        dy = (y - target) / len(target)
        dz = np.repeat(dy[:, None] * self.c, sizes, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(_sums(a * da, starts), sizes))
        du = ds[:, None] * self.w
        dt, dg = du * g * (1 - t * t), du * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ self.V.T + dg @ self.U.T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dy, "d": dy.sum(keepdims=True)}, y

    def fit(self, bags: list[np.ndarray], target: np.ndarray, p: Params, seed: int) -> None:
        rng = np.random.default_rng(seed)
        state = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in self.NAMES}
        step = 0
        for _ in range(p.epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), p.batch):
                some = order[k : k + p.batch]
                sizes = np.array([len(bags[i]) for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                grads, _ = self.gradients(np.concatenate([bags[i] for i in some]), starts, sizes, target[some])
                step += 1
                for name, g in grads.items():
                    m, v = state[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    move = p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, (getattr(self, name) * (1 - 1e-4 * (name == "W")) - move).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> dict:
    """Learn both heads from at most p.max_labelled labelled documents; they are chosen by hash, so the same every time.

    Only this bounded sample comes to the driver. A null label, or labels of one document that
    disagree, are left out. A head whose sample has one class only always says that class's share.
    """
    own = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = [F.when(F.min(h) == F.max(h), F.min(h).cast("int")).alias(h) for h in HEADS]
    chosen = own.agg(*one).where(" AND ".join(f"{h} IS NOT NULL" for h in HEADS)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)
    sample = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *[F.min(h).alias(h) for h in HEADS]).toPandas().sort_values("doc_id")
    return fit_sample(sample["text"].tolist(), {h: sample[h].to_numpy(np.float32) for h in HEADS}, p)


def fit_sample(texts: list[str], labels: dict[str, np.ndarray], p: Params = Params()) -> dict:
    words = sorted({w for h in HEADS for w in telling_words(texts, labels[h])})
    encoder = Encoder({w: k for k, w in enumerate(words)}, p.passage)
    bags = [encoder.features(t) for t in texts]
    heads = {}
    for k, h in enumerate(HEADS):
        y = labels[h]
        if len(y) and 0 < y.sum() < len(y):
            model = Model(encoder.width, p, p.seed + k)
            model.fit(bags, y, p, p.seed + 10 + k)
            heads[h] = {n: getattr(model, n) for n in Model.NAMES}
        else:
            heads[h] = float(y.mean()) if len(y) else 1.0 - k
    return {"words": encoder.words, "heads": heads}


class Scorer:
    def __init__(self, learned: dict, p: Params):
        self.encoder, self.heads = Encoder(learned["words"], p.passage), {}
        for h, arrays in learned["heads"].items():
            if isinstance(arrays, float):
                self.heads[h] = arrays
            else:
                self.heads[h] = Model.__new__(Model)
                self.heads[h].__dict__.update(arrays)

    def score(self, texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Passages of each text, score of each head, index of the passage that toxicity attends to most."""
        bags = [self.encoder.features(t) for t in texts]
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x, out, most = np.concatenate(bags), {}, np.zeros(len(texts), np.int32)
        for h, model in self.heads.items():
            if isinstance(model, float):
                out[h] = np.full(len(texts), model)
                continue
            *_, a, _, y = model.forward(x, starts, sizes)
            out[h] = y.astype(float)
            if h == "toxic":
                top = np.repeat(np.maximum.reduceat(a, starts), sizes) == a
                first = np.flatnonzero(top)
                owner = np.repeat(np.arange(len(texts)), sizes)[first]
                _, k = np.unique(owner, return_index=True)
                most = (first[k] - starts).astype(np.int32)
        return sizes, out, most


def scored(df: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Every document's scores: (doc_id, n_passages, quality, toxic, attended, kept).

    quality and toxic are probabilities to four places; attended is the passage (from 0) that the
    toxicity head weighs most, of equal ones the first; kept: quality at least, and toxic under, the
    cutoff (a score equal to it is good for quality, and too much for toxicity). Null, empty and
    blank texts have one empty passage. Rows without an id are left out; repeated rows are scored
    each. Without labels quality is 1 and toxic 0. An empty table gives no rows. All passages of a text count, whatever its length.
    """
    learned = df.sparkSession.sparkContext.broadcast(fit(df, labels, p))

    def batches(it):
        scorer = Scorer(learned.value, p)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, out, most = scorer.score(part.column(1).to_pylist())
                quality, toxic = (np.round(out[h], 4) for h in HEADS)
                yield pa.record_batch(
                    [part.column(0), pa.array(sizes.astype(np.int32)), pa.array(quality), pa.array(toxic), pa.array(most), pa.array((quality >= p.cutoff) & (toxic < p.cutoff))],
                    names=["doc_id", "n_passages", "quality", "toxic", "attended", "kept"],
                )

    return id_text(df).mapInArrow(batches, "doc_id long, n_passages int, quality double, toxic double, attended int, kept boolean")
