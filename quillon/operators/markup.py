"""Formex and CAML markup to text: mixed content, so a parser in Python, which returns only what is asked for, cleaned.

The parser refuses entity declarations, so nothing expands. Executors never fail for data: a document
that can't be parsed has its reason in `error`.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import CamlError, FormexError, QuillonError
from quillon.functions.textexpr import LAYOUT, LAYOUT_TO, by_row, py_clean_markup

BLOCK = frozenset("ALINEA ARTICLE CONSID DIVISION ITEM LIST NOTE NP P PARAG STI STI.ART TI TI.ART TITLE VISA".split())
SPACED = frozenset(("NO.P", "NO.PARAG"))
BROKEN = frozenset("NO.PARAG P STI.ART TI.ART TXT".split())
_TABLE = {ord(a): b for a, b in zip(LAYOUT, [*LAYOUT_TO, ""])}


def parse(source, error: type[QuillonError]) -> ElementTree.Element:
    """The root of a document; bytes are UTF-8, bad ones replaced. Anything wrong with it is one error."""
    if isinstance(source, (bytes, bytearray)):
        source = bytes(source).decode("utf-8", "replace")
    if not source or not source.strip():
        raise error("the document is empty: a failed retrieval, not a document without content.")
    built = ElementTree.TreeBuilder()
    reader = expat.ParserCreate(namespace_separator="}")

    def name(raw: str) -> str:
        return "{" + raw if "}" in raw else raw

    def refuse(*_):
        raise error("the document declares entities, which are not expanded.")

    reader.buffer_text = True
    reader.StartElementHandler = lambda tag, attributes: built.start(name(tag), {name(k): v for k, v in attributes.items()})
    reader.EndElementHandler = lambda tag: built.end(name(tag))
    reader.CharacterDataHandler = built.data
    reader.EntityDeclHandler = reader.UnparsedEntityDeclHandler = reader.ExternalEntityRefHandler = refuse
    try:
        reader.Parse(re.sub(r"\A\s*<\?xml[^>]*\?>", "", source).encode("utf-8", "replace"), True)
        return built.close()
    except error:
        raise
    except Exception as e:
        raise error(f"the document isn't well-formed XML: {e}.") from e


def raw_text(node: ElementTree.Element) -> str:
    """An element's text, with line ends where its elements begin and end lines, and its own tail; not yet cleaned.

    A stack of its own, not recursion: nesting is as deep as the document makes it.
    """
    out: list[str] = []
    todo: list = [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        tag, tail = at.tag, at.tail or ""
        if tag in ("QUOT.START", "QUOT.END"):
            try:
                out.append(chr(int(at.get("CODE") or "", 16)))
            except (ValueError, OverflowError):
                pass
            out.append(tail)
            continue
        out.append("\n" if tag in BLOCK else "")
        out.append(at.text or "")
        todo.append((" " if tag in SPACED else "") + ("\n" if tag in BROKEN else "") + tail)
        todo.extend(reversed(at))
    return "".join(out)


def _direct(node: ElementTree.Element, tag: str) -> str:
    found = node.find(tag)
    return "" if found is None else "".join(found.itertext())


_NUMBER, _LABEL = re.compile(r"\d+[a-z]?"), re.compile(r"\((\d+)\)")
HEAD = "identifier:string,number:string,heading:string"
CAML = "struct<paragraphs:array<string>,error:string>"


def article_number(title: str, identifier: str) -> str:
    """The first number in the title, with a small letter, else the identifier without leading zeros."""
    number = _NUMBER.search(title)
    return number[0] if number else identifier.lstrip("0") or identifier


def _numbered(root: ElementTree.Element):
    """Every article in document order, nested ones too, with its identifier and number."""
    for a in root.iter("ARTICLE"):
        identifier = a.get("IDENTIFIER", "")
        yield a, identifier, article_number(_direct(a, "TI.ART"), identifier)


def _heads(source) -> list[tuple]:
    return [(identifier, number, " ".join(_direct(a, "STI.ART").split())) for a, identifier, number in _numbered(parse(source, FormexError))]


def _articles(source) -> list[tuple]:
    return [(identifier, number, " ".join(_direct(a, "STI.ART").split()), py_clean_markup(raw_text(a))) for a, identifier, number in _numbered(parse(source, FormexError))]


def _recitals(source) -> list[tuple]:
    out = []
    for r in parse(source, FormexError).iter("CONSID"):
        label = _LABEL.search("".join(r.itertext()))
        out.append((label[1] if label else "", py_clean_markup(raw_text(r))))
    return out


def _guarded(source, read, width: int) -> tuple:
    try:
        return (*read(source), None)
    except QuillonError as e:
        return (*[None] * width, f"[{e.code}] {e.message}")


def _parts(read):
    """The same without the error: a document that can't be parsed has no parts."""

    def parts(source):
        return _guarded(source, lambda x: (read(x),), 1)[0]

    return parts


def formex(source: Column) -> Column:
    """A struct (text, error) of one document, rendered and cleaned; text is null if there is an error."""
    return by_row(lambda s: _guarded(s, lambda x: (py_clean_markup(raw_text(parse(x, FormexError))),), 1), "struct<text:string,error:string>")(source)


def paragraphs_of(source, separators: bool = False) -> list[str]:
    """Paragraphs of any namespace: their text and, a blank before each, their direct children's text and tail.

    With separators, the blank of a child that nothing follows is kept: a label without a text stays a label.
    """
    out = []
    for p in parse(source, CamlError).iter():
        if p.tag == "p" or p.tag.endswith("}p"):
            said = (p.text or "") + "".join(" " + (c.text or "") + (c.tail or "") for c in p)
            said = " ".join(said.translate(_TABLE).split())
            if said:
                last = p[-1] if separators and len(p) else None
                out.append(said + " " if last is not None and not ((last.text or "") + (last.tail or "")).translate(_TABLE).strip() else said)
    return out


def caml(source: Column, separators: bool = False) -> Column:
    """A struct (CAML) of one document."""
    return by_row(lambda s: _guarded(s, lambda x: (paragraphs_of(x, separators),), 1), CAML)(source)


def formex_texts(docs: DataFrame, source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., text, error): each document rendered and cleaned."""
    return docs.select(*keep, formex(F.col(source)).alias("f")).select(*keep, "f.text", "f.error")


def article_heads(docs: DataFrame, source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., ordinal, identifier, number, heading): formex_articles() without the texts, which aren't rendered."""
    heads = by_row(_parts(_heads), f"array<struct<{HEAD}>>")
    return docs.select(*keep, heads(F.col(source)).alias("f")).select(*keep, F.posexplode("f").alias("ordinal", "a")).select(*keep, "ordinal", "a.*")


def formex_articles(docs: DataFrame, source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., ordinal, identifier, number, heading, text): every article in document order, nested ones too."""
    articles = by_row(_parts(_articles), f"array<struct<{HEAD},text:string>>")
    return docs.select(*keep, articles(F.col(source)).alias("f")).select(*keep, F.posexplode("f").alias("ordinal", "a")).select(*keep, "ordinal", "a.*")


def formex_recitals(docs: DataFrame, source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., ordinal, number, text): every recital in document order."""
    recitals = by_row(_parts(_recitals), "array<struct<number:string,text:string>>")
    return docs.select(*keep, recitals(F.col(source)).alias("f")).select(*keep, F.posexplode("f").alias("ordinal", "r")).select(*keep, "ordinal", "r.*")


def article_text(docs: DataFrame, number, source: str = "source") -> DataFrame:
    """(doc_id, text, available): of each document the first article of that number; without one, up to twelve numbers there are.

    Each document is answered where it is read: only the article asked for is rendered, and nothing is shuffled.
    """
    wanted = str(number).strip().lower()

    def answer(xml) -> tuple:
        numbers = []
        try:
            for a, _, n in _numbered(parse(xml, FormexError)):
                if n.lower() == wanted:
                    return py_clean_markup(raw_text(a)), None
                numbers += [n] if len(numbers) < 12 else []
        except FormexError:
            pass
        return None, ", ".join(numbers) if numbers else "(none)"

    return docs.select("doc_id", by_row(answer, "struct<text:string,available:string>")(F.col(source)).alias("f")).select("doc_id", "f.*")


def heading(paragraphs: Column) -> Column:
    """The first paragraph, unless it reads as operative text."""
    first = F.coalesce(F.get(paragraphs, F.lit(0)), F.lit(""))
    return F.when(first.rlike(r"(?U)^\(\w+\)") | first.endswith(".") | (F.length(first) > 120), F.lit("")).otherwise(first)


def caml_texts(docs: DataFrame, source: str = "source", keep: tuple[str, ...] = ("doc_id",), separators: bool = False) -> DataFrame:
    """(keep..., heading, text, error); separators as in paragraphs_of()."""
    rows = docs.select(*keep, caml(F.col(source), separators).alias("c"))
    body = F.concat(F.array_join("c.paragraphs", "\n\n"), F.lit("\n"))
    return rows.select(*keep, F.when(F.col("c.error").isNull(), heading(F.col("c.paragraphs"))).alias("heading"), body.alias("text"), F.col("c.error").alias("error"))
