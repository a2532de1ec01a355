"""Secret scans: Aho-Corasick keywords first, anchored expressions near hits only, then embedded checksums.

One automaton of all rules' keywords passes once over each whole text. Where a keyword ends, the
rules it belongs to try one expression, anchored at the keyword's start; nothing else of the text
meets an expression. Rules whose secrets carry a checksum then verify it.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import zlib
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(6, "0")


def crc_tail(secret: str) -> bool:
    """The last six characters are the CRC-32, in base 62, of what lies between the prefix and them."""
    body = secret.split("_", 1)[1]
    return _base62(zlib.crc32(body[:-6].encode())) == body[-6:]


def _der(raw: bytes) -> bool:
    """One DER sequence, as long as its header says."""
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 0x7F
    return len(raw) == 2 + n + int.from_bytes(raw[2 : 2 + n], "big")


def _openssh(raw: bytes) -> bool:
    """The fields of an OpenSSH key file, each as long as it says, up to the end: cipher, kdf, its options, public keys, private part."""
    at, keys = len(_OPENSSH), 1
    fields = ["cipher", "kdf", "options", "count", "public", "private"]
    while fields:
        name = fields.pop(0)
        size = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if name == "count":
            keys = size
        elif name == "public":
            for _ in range(keys):
                at += size
                size = int.from_bytes(raw[at : at + 4], "big")
                at += 4
                if at > len(raw):
                    return False
            at += size  # what follows the last public key is the private part
            break
        else:
            at += size
    return at == len(raw)


_OPENSSH = b"openssh-key-v1\0"
_HEADER_LINE = re.compile(r"\s*([A-Za-z-]+): *([^\r\n]*)\r?\n")


def pem(block: str) -> bool | None:
    """The body is base64 of what its kind demands: a DER sequence, or the fields of an OpenSSH key.

    A key whose header lines say it's encrypted holds whole blocks of 8 bytes. None: the body is
    base64 of something that can't be verified, as in a PGP key, whose own check is another one.
    """
    body, fields = re.sub(r"\\r?\\n|\\n", "\n", block).split("-----")[2], {}
    while m := _HEADER_LINE.match(body):
        fields[m[1].lower()] = m[2]
        body = body[m.end() :]
    try:
        raw = base64.b64decode("".join(x for x in body.split() if not (x[0] == "=" and len(x) == 5)), validate=True)
    except (binascii.Error, ValueError):
        return False
    if "ENCRYPTED" in fields.get("proc-type", ""):
        return bool(raw) and len(raw) % 8 == 0
    if raw.startswith(_OPENSSH):
        return _openssh(raw)
    return (None if raw else False) if "PGP" in block[:40] else _der(raw)


def jwt(token: str) -> bool:
    """The first two parts are base64 of JSON objects, the first of which names an algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in token.split(".")[:2])
    except (ValueError, UnicodeDecodeError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and "alg" in head


@dataclass(frozen=True)
class Rule:
    name: str
    keywords: tuple[str, ...]  #: in lower case; found in any case
    pattern: str  #: anchored at the keyword; group 1, or all of it, is the secret
    check: object = None  #: verifies what the secret has of a checksum: true, false, or None where it has none to verify


_ASSIGN = r"""(?i:{word})["']?\s*(?:=|:=|:|=>)\s*["']?([A-Za-z0-9+/_\-.~!@#$%^]{{{least},}}?={{0,2}})(?=["'\s,;)]|[&%$#*!]{{2}}|$)"""

RULES = (
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", crc_tail),
    Rule("npm_token", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", crc_tail),
    Rule("jwt", ("eyj",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", jwt),
    Rule("private_key", ("-----begin ",), r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\s*[A-Za-z-]+:[^\r\n]*\r?\n)*(?:[A-Za-z0-9+/=\s]|\\[rn])+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", pem),
    Rule("github_fine_token", ("github_pat_",), r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}(?![A-Za-z0-9])"),
    Rule("sk_key", ("sk-",), r"(?<![A-Za-z0-9])sk-(?:[a-z0-9]+-){0,3}(?=[A-Za-z0-9_]*\d)[A-Za-z0-9_]{20,}(?:-[A-Za-z0-9_]+)*(?![A-Za-z0-9])"),
    Rule("aws_access_key_id", ("akia", "asia"), r"A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxs-"), r"xox[bpas]-[A-Za-z0-9-]{20,}"),
    Rule("stripe_key", ("sk_live_", "rk_live_"), r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google_api_key", ("aiza",), r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    Rule("assigned_password", ("password", "passwd"), _ASSIGN.format(word="password|passwd", least=6)),
    Rule("assigned_token", ("token", "secret", "api_key", "apikey", "access_key"), _ASSIGN.format(word="token|secret|api_?key|access_key", least=12)),
)


def _lower(text: str) -> str:
    """Lower case, place for place: a few letters' lower case is longer, and those stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern)) for r in rules]
        self.words = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            for w in r.keywords:
                by.setdefault(w, []).append(k)
        for w, ks in by.items():
            self.words.add_word(w, (len(w), tuple(ks)))
        self.words.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, str, str]]:
        """(start, end, rule, secret, checksum), in order, none within another of a rule with a lower number."""
        found = []
        for end, (size, ks) in self.words.iter(_lower(text)):
            for k in ks:
                rule, pattern = self.rules[k]
                m = pattern.match(text, end + 1 - size)
                if not m:
                    continue
                g = 1 if pattern.groups else 0
                good = rule.check(m.group(g)) if rule.check else None
                state = "none" if good is None else "valid" if good else "invalid"
                if state != "invalid":
                    found.append((m.start(g), m.end(g), k, rule.name, m.group(g), state))
        out, starts, ends = [], [], []  # what is taken, apart and in order
        for start, end, _, name, secret, state in sorted(found, key=lambda x: (x[2], x[0])):
            k = bisect.bisect_right(starts, start)
            if (not k or ends[k - 1] <= start) and (k == len(starts) or end <= starts[k]):
                starts.insert(k, start)
                ends.insert(k, end)
                out.append((start, end, name, secret, state))
        return sorted(out)


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets: (doc_id, start, end, rule, checksum, shown, sha256), a row for each place.

    start and end count characters of the whole text. checksum: 'valid', or 'none' where the kind
    has none that can be verified; a wrong checksum means no secret. shown: the first four characters; the secret itself
    isn't given. Null and empty texts have none; rows without an id are left out; repeated rows
    are reported each. Where two rules match one place the earlier rule has it.
    """

    def batches(it):
        scan = Scanner(rules)
        for batch in it:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(i, *x) for x in scan.find(text.as_py())]
            if rows:
                i, start, end, rule, secret, state = zip(*rows)
                yield pa.record_batch(
                    [pa.array(i, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(rule), pa.array(state), pa.array([x[:4] for x in secret]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in secret])],
                    names=["doc_id", "start", "end", "rule", "checksum", "shown", "sha256"],
                )

    return id_text(df, id_col, text_col).mapInArrow(batches, "doc_id long, start int, end int, rule string, checksum string, shown string, sha256 string")


def redacted(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of df with each secret in the text replaced by [rule]; n_chars, if there is one, follows.

    Null texts stay null, and a row without secrets stays as it was, its n_chars too; so do rows
    without an id. Rows that repeat are redacted each, texts of any length whole; an empty table
    stays empty.
    """

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        scan = Scanner(rules)
        out = []
        for text in texts:
            if text:
                for start, end, name, _, _ in reversed(scan.find(text)):
                    text = f"{text[:start]}[{name}]{text[end:]}"
            out.append(text)
        return pd.Series(out, dtype=object)

    own = "__clean"
    while own.lower() in map(str.lower, df.columns):
        own += "_"
    clean = df.withColumn(own, redact(F.col(text_col).cast("string")))
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(F.col(own).alias(c))
        elif c == "n_chars":
            kind = df.schema[c].dataType
            columns.append(F.when(F.col(own) == F.col(text_col), F.col(c)).otherwise(F.length(own).cast(kind)).alias(c))
        else:
            columns.append(F.col(c))
    return clean.select(*columns)
