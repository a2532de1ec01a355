"""Byte-level BPE with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be inside one token of an
encoding, and every merge makes a token: no merge crosses such a place. It is a certain cut. Texts
are split by the tokenizer's own pattern, pieces at the certain cuts, the fragments are encoded
independently, and what they give is concatenated.
"""

from __future__ import annotations

import base64
import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: the same for texts of code points under 256, where the classes can be written out
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"  # re's own white space has U+001C to U+001F too
_NARROW = re.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+""")
_WIDE = regex.compile(PATTERN)


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines() if path else [])}


def pieces(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WIDE.findall(text)
    return _NARROW.findall(text)


class Codec(dict):
    """piece -> its token ids, remembered until LIMIT are known (frequent ones come early); pieces longer than LONG aren't kept."""

    LIMIT, LONG = 700_000, 64

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        self.joined = bytearray(65536)  #: 1 where some token has the two bytes side by side
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for a, b in zip(token, token[1:]):
                self.joined[a << 8 | b] = 1
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:8]}")

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece split at its certain cuts."""
        joined, out, last = self.joined, [], 0
        for k in range(1, len(piece)):
            if not joined[piece[k - 1] << 8 | piece[k]]:
                out.append(piece[last:k])
                last = k
        out.append(piece[last:])
        return out

    def merged(self, fragment: bytes) -> list[int]:
        """BPE of one fragment: the pair of least rank, leftmost first, is merged until none is left.

        Long fragments use a heap over a linked list, so that their cost stays near n log n.
        """
        ranks = self.ranks
        whole = ranks.get(fragment)
        if whole is not None:
            return [whole]
        parts = [fragment[k : k + 1] for k in range(len(fragment))]
        if len(parts) > 48:
            return self._long(parts)
        near = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            least, at = None, -1
            for k, r in enumerate(near):
                if r is not None and (least is None or r < least):
                    least, at = r, k
            if least is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at < len(near):
                near[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                near[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _long(self, parts: list) -> list[int]:
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if parts[k] is not None else n
            if j >= n or parts[k] is not a and parts[k] != a or parts[j] != b:
                continue
            parts[k], parts[j] = a + b, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
            if before[k] >= 0 and (r := ranks.get(parts[before[k]] + parts[k])) is not None:
                heapq.heappush(heap, (r, before[k], parts[before[k]], parts[k]))
        return [ranks[p] for p in parts if p is not None]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(chain.from_iterable(map(self.merged, self.fragments(raw))))
        if len(piece) <= self.LONG and len(self) < self.LIMIT:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pieces(text))))

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def _shared(spark, path: str):
    """The vocabulary, of fixed size, read once and sent to each executor once."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(df: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts: (doc_id, tokens ARRAY<INT>, n_tokens, n_bytes).

    Null and empty texts give an empty array; rows without an id are left out; repeated rows are
    encoded each. Strings of special tokens are ordinary text.
    """
    ranks = _shared(df.sparkSession, path)

    def batches(it):
        codec = Codec(ranks.value)
        for batch in it:
            texts = batch.column(1).to_pylist()
            coded = [codec.encode(t) for t in texts]
            sizes = np.fromiter(map(len, coded), np.int32, len(coded))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(coded), np.int32, int(offsets[-1]))
            yield pa.record_batch(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(sizes), pa.array([len(t.encode()) for t in texts], pa.int64())],
                names=["doc_id", "tokens", "n_tokens", "n_bytes"],
            )

    return id_text(df, id_col, text_col).mapInArrow(batches, "doc_id long, tokens array<int>, n_tokens int, n_bytes long")


def decode(df: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Texts of token ids: (doc_id, text). Null arrays, and null or unknown ids in one, give a null text."""
    ranks = _shared(df.sparkSession, path)

    def batches(it):
        tokens = Codec(ranks.value).tokens
        for batch in it:
            out = []
            for ids in batch.column(1):
                ids = ids.as_py()
                good = ids is not None and all(x is not None and 0 <= x < len(tokens) for x in ids)
                out.append(b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") if good else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens")).where(F.col("doc_id").isNotNull())
    return own.mapInArrow(batches, "doc_id long, text string")


def encoded_and_decoded(df: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), with each text decoded again from its tokens and compared in the same pass.

    (doc_id, tokens, n_tokens, n_bytes, round_trip): round_trip is true where decoding gives the text
    back, byte for byte. Nulls, empty texts and repeats as in encode().
    """
    ranks = _shared(df.sparkSession, path)

    def batches(it):
        codec = Codec(ranks.value)
        part = codec.tokens.__getitem__
        for batch in it:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 512):
                raw = [t.encode() for t in batch.column(1).slice(at, 512).to_pylist()]
                coded = [codec.encode(t.decode()) for t in raw]
                back = [b"".join(map(part, c)) == r for c, r in zip(coded, raw)]
                sizes = np.fromiter(map(len, coded), np.int32, len(coded))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(coded), np.int32, int(offsets[-1]))
                yield pa.record_batch(
                    [ids.slice(at, 512), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(sizes), pa.array([len(r) for r in raw], pa.int64()), pa.array(back)],
                    names=["doc_id", "tokens", "n_tokens", "n_bytes", "round_trip"],
                )

    return id_text(df, id_col, text_col).mapInArrow(batches, "doc_id long, tokens array<int>, n_tokens int, n_bytes long, round_trip boolean")
