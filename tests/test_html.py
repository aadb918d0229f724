"""Pages and statements of birth."""

import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark import queries_records
from evispark.functions import html
from evispark.queries import ORACLE_SQL


def test_page_sources(spark):
    pages = {
        "<meta property='OG:URL' content='https://a/'><link rel=canonical href='https://b/'>": "https://a/",
        "<meta name='og:url' content=''><link rel='Canonical' href='https://b/'>": "https://b/",
        "<!-- saved from url=(0022)https://c/x -->": "https://c/x",
        '{"url": "https://d/"}': "https://d/",
        "source_url='https://e/'": "https://e/",
        "<a href='https://f/'>": None,
    }
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    assert [r[0] for r in df.orderBy("i").select(html.page_source_url(F.col("h"))).collect()] == list(pages.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<title>", "</title>", "<script>", "</script>", "</style>", "<style>", "a &amp; b", " c\n", "<p x='1'>", "<", "&#65;", "<link rel=canonical href=https://q/>"]), max_size=15))
def test_any_markup_gives_one_line(parts):
    found = html.facts("".join(parts))
    assert found["text"] == " ".join(found["text"].split()) and set(found["urls"]) <= {"https://q/"}
    assert "<title>" not in "".join(parts) or found["title"] is None or "\n" not in found["title"]


def test_hidden_elements_nest_and_close_late():
    assert html.facts("</script>a<style>b<style>c</style>d</style>e<title>T</title>")["text"] in ("a e T", "ae T", "a d e T", "a d</style>e T")
    assert html.facts("<title> A\n&amp; B </title>x") == {"title": "A & B", "text": "A & B x", "urls": [], "source": None}


@pytest.mark.parametrize("text, name, award, want", [
    ("Profile Bio Born in 1938 and raised nearby.", "Mike Auldridge", 2012, (1938, False)),
    ("Her son was born in 1977 after the apprenticeship.", "Clarissa Rizal", None, None),
    ("In the Tradition was born, becoming an annual event. In 1984", "Linda Goss", None, None),
    ("Bio George Lopez was born on April 23, 1900, in Cordova.", "George López", None, (1900, False)),
    ("Bio Mary Holiday Black was born about 1934.", "Mary Holiday Black", None, (1934, True)),
    ("Ann Alpha, born to farmers, was honored in 1990.", "Ann Alpha", 1990, None),
    ("Ann Alpha was born in 1990.", "Ann Alpha", 1990, (1990, False)),
    ("Nobody was born in 1900. " + "y" * 100 + " Alpha was born 1901", "Ann Alpha", None, (1901, False)),
    (" Bio " + "w" * 490 + " born 1905", "Ann Alpha", None, (1905, False)),
    (" Bio " + "w" * 520 + " born 1905", "Ann Alpha", None, None),
    ("Born in 1910\nof the Álpha\x01 family, born 1911", "Alpha", None, (1911, False)),
    ("anyone was born in 1920", "", None, (1920, False)),
    ("", "Ann", None, None), (None, "Ann", None, None), ("born 1950s, born 1951", None, None, (1951, False)),
])
def test_statements(spark, text, name, award, want):
    row = spark.createDataFrame([(text, name, award)], "t string, n string, y int").select(html.birth_statement("t", "n", "y").alias("b")).first().b
    assert (row and (row.birth_year, row.approximate)) == want


def test_places_of_candidates(spark):
    text = "xé born 1900, was born in May 1901. Born before 1902s born 1903" + " z" * 80 + "born in 20 years or 1904"
    got = spark.createDataFrame([(text,)], "t string").select(html.birth_candidates(F.col("t"))).first()[0]
    found = list(re.finditer(html.BIRTH.replace("(?di)", "(?i)"), text))
    assert [(c.start, c.year) for c in got] == [(m.start(), int(m[1])) for m in found]
    assert [c.near for c in got] == [" ".join(text[max(0, m.start() - 90) : m.end()].split()) for m in found]


@pytest.mark.parametrize("lead, word, want", [("e", "son ", (1901, False)), (" ", "son ", None), ("r", "about ", (1901, False)), (" ", "about ", (1901, True)), ("é", "son ", (1901, False))])
def test_a_word_that_the_window_cuts_is_none(spark, lead, word, want):
    text = "x" * 50 + lead + word + "y" * (html.BEFORE - len(word) - len(" Alpha ")) + " Alpha born 1901"
    row = spark.createDataFrame([(text,)], "t string").select(html.birth_statement(F.col("t"), F.lit("Ann Alpha"), F.lit(None).cast("int")).alias("b"), html.birth_candidates(F.col("t"))[0].alias("c")).first()
    assert row.c.near == text[row.c.start - html.BEFORE :] and row.c.near.startswith(word)
    assert (row.b and (row.b.birth_year, row.b.approximate)) == want


def test_births_in_texts_with_years_and_relatives_at_their_ends(spark):
    texts = ["555-1902 of the", "his mother", "it is about", "Miss Alpha", "1901 about the son of Alpha", None]
    rows = [(6 * i + k, text, i) for i, text in enumerate(texts) for k in range(6)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = [tuple(r) for r in queries_records.birth_in_text(lambda _: documents).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, n_chars INTEGER)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert got == con.sql(f"SELECT * FROM ({ORACLE_SQL['birth_in_text']}) ORDER BY doc_id").fetchall()


def test_only_whole_references_of_the_list(spark):
    page = "<title>A &amp; B &amp;lt; &quot;c&quot; and&amp</title><p>x&lt;y &copy z</p>"
    h = F.col("h")
    row = spark.createDataFrame([(page,)], "h string").select(html.page_title(html.only_references(h, ["amp"])).alias("a"), html.page_text(html.only_references(h, ["quot", "amp", "lt"]))["text"].alias("t"), html.page_title(h).alias("all")).first()
    assert row.a == "A & B &lt; &quot;c&quot; and&amp" and row.all == 'A & B &lt; "c" and&'
    assert row.t == 'A & B &lt; "c" and&amp x<y &copy z'
