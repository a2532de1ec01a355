"""What a worker, the driver or a shuffle holds: steps that once grew with the corpus, and blank texts."""

import csv
from collections import Counter

import duckdb
import pytest

from quillon.functions import textexpr
from quillon.operators import markup, pdfclean, search, validate
from quillon.plans import catalogue
from quillon.sources import manifest, store
from tests.test_reference import clean_twin, docs, items, odd_texts


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ACT = '<ACT><CONSID><NP><NO.P>(7)</NO.P><TXT>r</TXT></NP></CONSID><ARTICLE IDENTIFIER="001"><TI.ART>Article 12a</TI.ART><P>one</P></ARTICLE><ARTICLE IDENTIFIER="002"><P>two</P></ARTICLE></ACT>'


def test_cleaning_in_python_is_the_expressions(spark):
    texts = odd_texts(seed=3) + ["x\n\n(a) y", "\n\nb", "cut\nin two", "cut:\nin two", "  a \t\n\t b  "]
    assert [textexpr.py_clean_markup(t) for t in texts] == [clean_twin(t) for t in texts]


def test_markup_goes_to_python_in_small_batches(spark):
    df = docs(spark, ACT)
    for out in (markup.formex_texts(df), markup.formex_articles(df), markup.article_heads(df), markup.formex_recitals(df), markup.article_text(df, 2), markup.caml_texts(df)):
        assert plan(out).count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan(out)


def test_an_article_is_answered_where_its_document_is_read(spark):
    df = docs(spark, ACT, "<ACT/>", "<broken", ACT.replace("002", "2X"))
    assert "Exchange" not in plan(markup.article_text(df, 2)) and "Join" not in plan(markup.article_text(df, 2))
    got = [(r.text, r.available) for r in markup.article_text(df, " 2x ").orderBy("doc_id").collect()]
    assert got == [(None, "12a, 2"), (None, "(none)"), (None, "(none)"), ("two\n", None)]


def test_heads_are_the_articles_without_texts(spark):
    df = docs(spark, ACT, "<broken")
    assert markup.article_heads(df).collect() == markup.formex_articles(df).drop("text").collect()


@pytest.fixture(scope="module")
def blanks(spark, tmp_path_factory):
    """A folder of documents, whose texts are empty, blank or short."""
    at = str(tmp_path_factory.mktemp("blanks"))
    rows = [(k, ("", " ", "\n \n", f"text {k}\nand  more\n", f"Text {k}.")[k % 5], "en", f"src{k % 3}", 0) for k in range(105)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["caml_sections", "ingest_refused", "store_located", "stored_texts"])
def test_blank_texts_are_as_the_sql_has_them(spark, blanks, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{blanks}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, blanks)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_a_label_without_a_text_loses_its_blank_unless_asked(spark):
    df = docs(spark, '<x><p/><p>(a)<s/></p><p><s/></p><p>(b)<s/>y</p></x>')
    assert markup.caml_texts(df).first().text == "(a)\n\n(b) y\n"
    assert markup.caml_texts(df, separators=True).first().text == "(a) \n\n(b) y\n"


def test_empty_texts_are_stored_only_when_asked(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "item_id string, text string")
    kept = lambda at, **how: {r.item_id for r in store.write_texts(df, str(tmp_path / at), **how).collect() if r.error is None}
    assert kept("no") == {"c"} and kept("yes", empty=True) == {"a", "c"}
    assert {(r.item_id, r.text) for r in store.texts(spark, str(tmp_path / "yes")).collect()} == {("a", ""), ("c", "x")}


def test_rejoining_is_done_in_python_where_a_text_is_read(spark):
    df = spark.createDataFrame([(1, "one\ntwo.\nThree "), (2, ""), (3, None)], "doc_id int, text string")
    out = pdfclean.rejoined_blocks(df, df["text"])
    assert "BatchEvalPython" in plan(out) and "Exchange" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "one two."), (1, 2, "Three ")]


def test_a_documents_pages_come_together_once(spark):
    rows = [("a", 2, "Head\nmore\nPage\u00a02"), ("a", 1, "Head\none\n1"), ("b", 1, None), ("b", 2, " \n"), ("c", 1, "3\nalone")]
    out = pdfclean.clean_pages(spark.createDataFrame(rows, "doc_id string, page_no int, text string"))
    assert plan(out).count("Exchange hashpartitioning") == 1 and "Join" not in plan(out)
    got = {r.doc_id: (r.text, r.error and r.error.code) for r in out.collect()}
    assert got == {"a": ("one more\n", None), "b": (None, "BK_PDF_EXTRACT"), "c": ("3 alone\n", None)}


def test_lines_are_searched_in_python_where_a_text_is_read(spark):
    df = spark.createDataFrame([("a", "x\u2028A licence\r\nthe\n"), ("b", None), ("c", "")], "item_id string, text string")
    out = search.matching_lines(df, {"l": "licen[cs]e", "a": "^a|^t"}, "item_id", in_python=True)
    assert "BatchEvalPython" in plan(out) and "Exchange" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [("a", 2, "A licence", ["l", "a"]), ("a", 3, "the", ["a"])]


def test_clusters_look_for_their_own_family_only(spark, blanks):
    seen = []
    one = catalogue.analysis.sweep
    catalogue.analysis.sweep = lambda m, t, families: seen.append(families) or one(m, t, families)
    try:
        assert "BatchEvalPython" in plan(catalogue.QUERIES["hit_clusters"](spark, blanks))
    finally:
        catalogue.analysis.sweep = one
    assert seen == [{"licence": catalogue.FAMILIES["licence"]}]


def test_a_sorted_manifest_isnt_sent_to_the_driver(spark, tmp_path, monkeypatch):
    odd = [dict(item_id=k, title=t) for k, t in (("b", 'say "x"'), ("a", "tab\there"), ("é", "two\nlines\r"), ("c", "c"), ("10", " x"), ("9", "'"))]
    df = items(spark, *odd).repartition(3)
    rows = [tuple(r) for r in df.select(*validate.COLUMNS).orderBy("item_id").collect()]
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    assert manifest.write(df, tmp_path / "m" / "M.tsv") == 6 and manifest.write(df, f"file://{tmp_path}/u/M.tsv") == 6
    with open(tmp_path / "want.tsv", "w", encoding="utf-8", newline="") as f:
        csv.writer(f, delimiter="\t", lineterminator="\n").writerows([validate.COLUMNS, *rows])
    assert (tmp_path / "m" / "M.tsv").read_bytes() == (tmp_path / "want.tsv").read_bytes() == (tmp_path / "u" / "M.tsv").read_bytes()
