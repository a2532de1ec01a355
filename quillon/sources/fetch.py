"""Fetching documents and work-lists over HTTP: on the driver one at a time, on executors by work-list."""

from __future__ import annotations

import io
import json
import re
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import FetchError
from quillon.functions.celex import parse_celex

RESOURCES = "http://publications.europa.eu/resource/celex/"
SPARQL = "http://publications.europa.eu/webapi/rdf/sparql"
NOTICE = "application/xml;notice=branch"
NOTICE_OBJECT = "application/xml;notice=object"
FORMEX_ZIP = "application/zip;mtype=fmx4"
AGENT = "quillon/0.1"

Transport = Callable[..., tuple[int, bytes, str]]


def urllib_transport(url: str, headers: dict, timeout: float) -> tuple[int, bytes, str]:
    """(status, body, content type); an HTTP error is a status, not an exception."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return answer.status, answer.read(), answer.headers.get("Content-Type", "")
    except urllib.error.HTTPError as e:
        return e.code, e.read(), e.headers.get("Content-Type", "") if e.headers else ""


@dataclass(frozen=True)
class Document:
    celex: str
    url: str
    body: bytes
    media_type: str
    annex_bodies: tuple[bytes, ...] = ()


def members(archive: bytes) -> list[tuple[str, bytes]]:
    """(name, body) of a zip's members, in the archive's order."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            return [(n, z.read(n)) for n in z.namelist()]
    except Exception as e:
        raise FetchError(f"the answer is no zip archive ({e}); it begins: {archive[:120].decode('utf-8', 'replace')}") from e


_DESCRIPTOR = r"(?i)\.(toc|doc)(\.fmx)?\.xml$"


def bodies(named: list[tuple[str, bytes]]) -> list[bytes]:
    """The XML members by name, without descriptor and contents: the act first, then its annexes."""
    return [b for n, b in sorted(named) if n.lower().endswith(".xml") and not re.search(_DESCRIPTOR, n)]


@dataclass
class Fetcher:
    transport: Transport = urllib_transport
    timeout: float = 60.0

    def request(self, url: str, accept: str, **headers: str) -> tuple[bytes, str]:
        sent = {"Accept": accept, "User-Agent": AGENT} | {k.replace("_", "-"): v for k, v in headers.items()}
        try:
            status, body, kind = self.transport(url, headers=sent, timeout=self.timeout)
        except FetchError:
            raise
        except Exception as e:
            raise FetchError(f"the request to {url} failed on the way: {e}.", transient=True) from e
        if status == 429:
            raise FetchError(f"429 for {url}: too many requests; slow down.", transient=True)
        if status >= 500:
            raise FetchError(f"{status} for {url}: the service is failing.", transient=True)
        if status != 200:
            raise FetchError(f"{status} for {url}: check the number and the Accept header; HTML isn't served here.")
        return body, kind

    def fetch(self, celex, accept: str = NOTICE) -> Document:
        number = parse_celex(celex)
        body, kind = self.request(RESOURCES + number, accept, Accept_Language="eng")
        if not body:
            raise FetchError(f"200 with an empty body for {number}: a failed retrieval.")
        return Document(number, RESOURCES + number, body, kind)

    def fetch_formex(self, celex) -> Document:
        answer = self.fetch(celex, FORMEX_ZIP)
        named = members(answer.body)
        found = bodies(named)
        if not found:
            raise FetchError(f"the archive of {answer.celex} holds no document body; its members: {', '.join(n for n, _ in named)}.")
        return Document(answer.celex, answer.url, found[0], "application/xml;type=fmx4", tuple(found[1:]))

    def sparql(self, query: str) -> list[dict]:
        body, _ = self.request(SPARQL + "?" + urllib.parse.urlencode({"query": query, "format": "json"}), "application/sparql-results+json")
        try:
            rows = json.loads(body.decode("utf-8", "replace"))["results"]["bindings"]
            return [{k: cell.get("value") for k, cell in row.items()} for row in rows]
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise FetchError(f"the endpoint's answer is no SPARQL result ({e!r}); check the query.") from e


FETCHED = "celex string, url string, body binary, media_type string, annex_bodies array<binary>, error struct<code:string,message:string,transient:boolean>"


def fetched(worklist: DataFrame, transport: Transport = urllib_transport, timeout: float = 60.0, formex: bool = True, at_once: int = 4) -> DataFrame:
    """Each CELEX of a work-list fetched on the executors: FETCHED, a row each; failures have an error, and may be transient.

    at_once bounds the tasks, and so the requests under way. Null numbers are errors too.
    """

    def run(it):
        fetcher = Fetcher(transport, timeout)
        for pdf in it:
            rows = []
            for celex in pdf["celex"]:
                try:
                    d = fetcher.fetch_formex(celex) if formex else fetcher.fetch(celex)
                    rows.append((d.celex, d.url, d.body, d.media_type, list(d.annex_bodies), None))
                except FetchError as e:
                    rows.append((celex, None, None, None, None, {"code": e.code, "message": e.message, "transient": e.transient}))
            yield pd.DataFrame(rows, columns=["celex", "url", "body", "media_type", "annex_bodies", "error"])

    return worklist.select(F.col("celex").cast("string").alias("celex")).repartition(at_once).mapInPandas(run, FETCHED)


def unzipped(archive: Column) -> Column:
    """A struct (members ARRAY<STRUCT<name, body>>, error) of a zip archive; a null archive has neither."""

    def read(archives: pd.Series) -> pd.DataFrame:
        rows = []
        for a in archives:
            try:
                rows.append(([{"name": n, "body": b} for n, b in members(bytes(a))] if a is not None else None, None))
            except FetchError as e:
                rows.append((None, e.message))
        return pd.DataFrame(rows, columns=["members", "error"])

    return F.pandas_udf(read, "struct<members:array<struct<name:string,body:binary>>,error:string>")(archive)


def ordered_bodies(named: Column) -> Column:
    """bodies() of an array of members, in Catalyst."""
    kept = F.filter(named, lambda m: F.lower(m["name"]).endswith(".xml") & ~m["name"].rlike(_DESCRIPTOR))
    return F.transform(F.array_sort(kept, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)), lambda m: m["body"])


def bindings_of(answers: DataFrame, answer: str = "answer", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., row MAP<STRING, STRING>): the rows of SPARQL answers; an answer that is none has no rows."""
    schema = "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>"
    parsed = answers.select(*keep, F.from_json(answer, schema).alias("__a"))
    return parsed.select(*keep, F.explode("__a.results.bindings").alias("__b")).select(*keep, F.transform_values("__b", lambda _, v: v["value"]).alias("row"))


def bindings(spark: SparkSession, answer: str) -> DataFrame:
    """One SPARQL answer as a DataFrame of flat maps."""
    return bindings_of(spark.createDataFrame([(answer,)], "answer string"))
