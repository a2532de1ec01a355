"""Column expressions for text, with the whitespace and line rules of Python's str.

Spark's trim knows the blank only and Java's \\s is ASCII, so both sets are written out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: all of what str.isspace() accepts, and what str.splitlines() splits at
PYWS = r"[\u0009-\u000d\u001c- \u0085   -     　]"
LINES = r"\r\n|[\u000a-\u000d\u001c-\u001e\u0085  ]"
#: layout-only characters and what they become, place for place; the last is deleted
LAYOUT, LAYOUT_TO = "   ‑­", "   -"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PYWS}+|{PYWS}+\\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{PYWS}+\\z", "")


def squeeze(c: Column) -> Column:
    """Every run of whitespace as one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{PYWS}+", " "))


def typography(c: Column) -> Column:
    return F.translate(c, LAYOUT, LAYOUT_TO)


def split_lines(c: Column) -> Column:
    """Lines without their ends; a line end at the end of the text opens no further line."""
    body = F.regexp_replace(c, f"(?:{LINES})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINES, -1))


def collapse(c: Column) -> Column:
    """Runs of blanks and tabs as one blank; more than one empty line as one."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def finished(c: Column) -> Column:
    return F.concat(strip(c), F.lit("\n"))


def clean_markup(raw: Column) -> Column:
    """Text taken from XML: layout characters, indentation and line breaks within sentences go."""
    one = typography(F.regexp_replace(raw, "\r\n", "\n"))
    one = F.regexp_replace(one, r"[ \t]*\n[ \t]*", "\n")
    one = F.regexp_replace(one, r"(?<![.:;)\]])\n(?=[a-z(])", " ")
    return finished(collapse(one))


def by_row(f, kind: str):
    """A function of values as a column's. Python gets a hundred rows at a time, not an Arrow batch of ten thousand, so that long texts don't fill the workers.

    It counts as not deterministic, else a filter that Spark infers from explode() runs it once more.
    """
    return F.udf(f, kind, useArrow=False).asNondeterministic()


_WRAPPED, _BLANKS, _EMPTY = re.compile(r"\n(?<![.:;)\]]\n)(?=[a-z(])"), re.compile(r"[ \t]{2,}"), re.compile(r"\n{3,}")


def py_typography(s: str) -> str:
    """typography() of a str; a few replacements are faster than a table."""
    for a, b in zip(LAYOUT, [*LAYOUT_TO, ""]):
        s = s.replace(a, b)
    return s


def py_finished(s: str) -> str:
    """finished(collapse()) of a str."""
    return _EMPTY.sub("\n\n", _BLANKS.sub(" ", s)).strip() + "\n"


def py_clean_markup(raw: str) -> str:
    """clean_markup() of a str, at a tenth of the time: Java's classes of all white space are slow."""
    one = py_typography(raw.replace("\r\n", "\n"))
    return py_finished(_WRAPPED.sub(" ", "\n".join(x.strip(" \t") for x in one.split("\n"))))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def utf8_size(c: Column) -> Column:
    return F.octet_length(c).cast("long")


#: Python's \w, \d and \s as members of a Java class
_WORD, _DIGIT, _SPACE = r"\p{L}\p{N}_", r"\p{Nd}", PYWS[1:-1]
_CLASS = {"w": _WORD, "d": _DIGIT, "s": _SPACE}
_PLAIN = {"a": r"\x07", "v": r"\x0b", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t"}


def java_regex(pattern: str) -> str | None:
    """A valid Python pattern in Java's dialect, for rlike, without regard to case; None where Java has nothing like it.

    Classes and word boundaries are written out, because Java's own hold other characters; braces
    that open no quantifier, and brackets and ampersands in classes, are quoted.
    """
    out, k, n = ["(?iu)"], 0, len(pattern)
    inside = opened = False
    while k < n:
        c = pattern[k]
        if c == "\\":
            e = pattern[k + 1]
            hexes = {"x": 2, "u": 4, "U": 8}.get(e)
            k += 2
            if hexes:
                out.append(f"\\x{{{int(pattern[k : k + hexes], 16):x}}}")
                k += hexes
            elif e in "wds":
                out.append(_CLASS[e] if inside else f"[{_CLASS[e]}]")
            elif e in "WDS" and not inside:
                out.append(f"[^{_CLASS[e.lower()]}]")
            elif e == "b" and inside:
                out.append(r"\x08")
            elif e in "bB" and not inside:
                before, at = f"(?<=[{_WORD}])", f"(?=[{_WORD}])"
                edge, non = (f"{before}(?![{_WORD}])|(?<![{_WORD}]){at}", f"{before}{at}|(?<![{_WORD}])(?![{_WORD}])")
                out.append(f"(?:{edge if e == 'b' else non})")
            elif e in "AZ" and not inside:
                out.append(r"\A" if e == "A" else r"\z")
            elif e in _PLAIN:
                out.append(_PLAIN[e])
            elif e == "0" or (e.isdigit() and (inside or re.match(r"[0-3][0-7][0-7]", pattern[k - 1 : k + 2]))):
                m = re.match(r"[0-7]{1,3}", pattern[k - 1 :])
                if not m:
                    return None
                out.append(f"\\x{{{int(m[0], 8):x}}}")
                k += len(m[0]) - 1
            elif e.isdigit():
                if pattern[k : k + 1].isdigit():
                    return None
                out.append("\\" + e)
            elif e.isalnum():
                return None
            else:
                out.append("\\" + e if ord(e) < 128 else e)
            opened = False
            continue
        if inside:
            if c == "]" and not opened:
                inside = False
                out.append("]")
            elif c == "^" and opened and pattern[k - 1] == "[":
                out.append("^")
                k += 1
                continue  # a bracket is still an ordinary first member
            else:
                out.append("\\" + c if c in "[]&^" else c)
            opened = False
        elif c == "[":
            inside = opened = True
            out.append("[")
        elif c == "(" and pattern[k + 1 : k + 2] == "?":
            head = re.match(r"\(\?(?:[:=!>]|<[=!]|P<\w+>|#[^)]*\)|[imsu]*(?:-[ims]+)?[:)])", pattern[k:])
            if not head:
                return None
            out.append("(" if head[0].startswith("(?P<") else "" if head[0].startswith("(?#") else head[0])
            k += len(head[0])
            continue
        elif c == "{":
            m = re.match(r"\{(\d*)(,\d*)?\}", pattern[k:])
            if m and (m[1] or (m[2] or "") not in ("", ",")):
                out.append("{" + (m[1] or "0") + (m[2] or "") + "}")
                k += len(m[0])
                continue
            if m and m[2]:
                return None
            out.append(r"\{")
        else:
            out.append(r"\}" if c == "}" else c)
        k += 1
    return "".join(out)
