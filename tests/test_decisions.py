"""Behaviours that were decided on purpose, one test each: kept as found, or fixed."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillon import errors
from quillon.operators import markup, pdfclean, search, validate
from quillon.sources import manifest, store
from tests.test_reference import GOOD, docs, items, raw_frame


def test_k7_kept_short_rows_lack_required_fields_but_not_optional_ones(spark, tmp_path):
    names = list(validate.COLUMNS)
    order = [c for c in names if c not in ("media_type", "version_id")] + ["version_id", "media_type"]
    path = tmp_path / "m.tsv"
    path.write_text("\t".join(order) + "\n" + "\t".join(GOOD[c] for c in order[:-2]) + "\n")
    assert manifest.read_items(path)[0].media_type == "" and manifest.read(spark, str(path)).first().errors == []


def test_k8_kept_blank_lines_dont_count(tmp_path):
    path = tmp_path / "m.tsv"
    row = "\t".join(GOOD[c] for c in validate.COLUMNS)
    path.write_text("\t".join(validate.COLUMNS) + f"\n\n{row}\n\n{row.replace('eng', 'xx')}\n")
    with pytest.raises(errors.ManifestError, match="line 3"):
        manifest.read_items(path)


def test_k9_kept_reads_take_the_first_of_duplicates(spark):
    m = items(spark, dict(item_id="a", title="first"), dict(item_id="a", title="second"))
    assert manifest.get(m, "a").title == "first" and search.resolved(m, "a").first().title == "first"
    assert [tuple(r) for r in validate.duplicate_ids(m).collect()] == [("a", 2)]


def test_k10_fixed_ids_match_whole_stems(spark, tmp_path):
    s = store.Store(tmp_path)
    s.write("a.b", "longer id")
    for name in ("[x]", "a b+ü%20"):
        s.write(name, "odd name")
    assert not s.exists("a") and s.read("[x]") == "odd name" and not s.exists("x")
    assert {r.item_id for r in store.texts(spark, str(tmp_path)).collect()} == {"a.b", "[x]", "a b+ü%20"}


def test_k11_kept_search_doesnt_verify_but_can(spark):
    m, t = items(spark, dict(item_id="a")), spark.createDataFrame([("a", "word", hashlib.sha256(b"other").hexdigest())], "item_id string, text string, sha256 string")
    assert search.grep(m, t, "word").count() == 1 and search.grep(m, t, "word", verify=True).count() == 0


def test_k12_kept_bad_bytes_never_verify(tmp_path):
    raw = b"bad \xff"
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(raw))
    assert not store.Store(tmp_path).verify("a", hashlib.sha256(raw).hexdigest())


def test_k13_kept_the_raw_line_is_searched_the_stripped_one_shown(spark):
    m, t = items(spark, dict(item_id="a")), spark.createDataFrame([("a", "  indented  ")], "item_id string, text string")
    assert search.grep(m, t, "^ +in").first().line == "indented"


def test_k15_kept_an_articles_tail_is_its_own(spark):
    rows = markup.formex_articles(docs(spark, "<A><ARTICLE>x</ARTICLE>tail<ARTICLE>y</ARTICLE></A>")).orderBy("ordinal").collect()
    assert [r.text for r in rows] == ["xtail\n", "y\n"]


def test_k18_kept_headings_collapse_but_keep_other_layout(spark):
    row = markup.formex_articles(docs(spark, "<A><ARTICLE><STI.ART>Soft­hyphen  x</STI.ART></ARTICLE></A>")).first()
    assert row.heading == "Soft­hyphen x"


def test_k21_kept_caml_spacing(spark):
    row = markup.caml_texts(docs(spark, "<x><p>outer <p>inner</p></p></x>")).first()
    assert row.text == "outer inner\n\ninner\n"


def test_k24_kept_a_trailing_empty_page_counts(spark):
    one = spark.createDataFrame([("d", 0, "3\nbody")], "doc_id string, page_no int, text string")
    two = one.union(spark.createDataFrame([("d", 1, "")], one.schema))
    assert pdfclean.without_furniture(one).first().text == "3\nbody"
    assert pdfclean.without_furniture(two).where("page_no = 0").first().text == "body"


def test_k25_kept_votes_skip_blank_lines_removal_doesnt(spark):
    page = "\n\n\nHead\nmiddle one\nmiddle two\nmiddle three\nFoot"
    df = spark.createDataFrame([("d", k, page + str(k)) for k in range(3)], "doc_id string, page_no int, text string")
    assert {r.line for r in pdfclean.furniture(df).collect()} >= {"Head"}
    assert all("Head" in r.text for r in pdfclean.without_furniture(df).collect())


def test_k26_kept_the_threshold_is_rounded_down(spark):
    pages = lambda d, n, having: [(d, k, ("run\n" if k < having else f"own{k}\n") + f"text {k}") for k in range(n)]
    df = spark.createDataFrame(pages("four", 4, 2) + pages("seven", 7, 4) + pages("seven3", 7, 3), "doc_id string, page_no int, text string")
    assert {r.doc_id for r in pdfclean.furniture(df).where("line = 'run'").collect()} == {"four", "seven"}


def test_k31_fixed_sizes_are_longs(spark):
    row = validate.validated(raw_frame(spark, [GOOD | dict(bytes=str(2**63))])).first()
    assert [e.field for e in row.errors] == ["bytes"]
    with pytest.raises(errors.ManifestError):
        validate.Item.from_row(GOOD | dict(bytes=str(2**63)))


def test_k32_sizes_are_audited(spark):
    m = items(spark, dict(item_id="a", bytes="5", sha256=hashlib.sha256(b"word").hexdigest()))
    there = spark.createDataFrame([("a", "word")], "item_id string, text string").select("item_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    assert tuple(store.audit(m, there).first()) == ("a", "ok", "mismatch")
