"""HTML pages and statements of birth.

A page is parsed once, into a flat stream of events; title, text and addresses are read off it.
Statements of birth are found with column functions; Python only folds accents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Meta names of a page's source, and further marks of it in order.
SOURCE_META = ("og:url", "twitter:url", "original-url", "source-url")
SOURCE_MARKS = [r"(?i)<!--\s*saved from url=\(\d+\)(https?://[^ ]+)\s*-->", r'(?i)"url"\s*:\s*"(https?://[^"]+)"', r"""(?i)source_url\s*[:=]\s*["'](https?://[^"']+)["']"""]
#: A statement of birth, words of relatives and of approximate dates, the mark of a
#: biography, and how far each reaches, in characters.
BIRTH = r"(?di)\b(?:was born|born)\b(?:(?!\b(?:18|19|20)\d\d\b).){0,60}((?:18|19|20)\d\d)\b(?!s)"
RELATIVES = r"(?i)\b(son|daughter|mother|father|grandmother|grandfather)\b"
APPROXIMATE = r"(?i)\b(about|around|probably|circa)\b"
LEAD_MARK, LEAD, BEFORE, EXCERPT = " Bio ", 500, 90, 140

OPEN, CLOSE, TEXT = range(3)
Event = tuple[int, str, "dict[str, str] | str | None"]


class _Stream(HTMLParser):
    """Events of a page: (OPEN, tag, attributes), (CLOSE, tag, None) and (TEXT, '', text)."""

    def reset(self) -> None:
        super().reset()
        self.events: list[Event] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append((OPEN, tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        self.events.append((CLOSE, tag, None))

    def handle_data(self, data: str) -> None:
        self.events.append((TEXT, "", data))


def events(html: str) -> list[Event]:
    stream = _Stream()
    stream.feed(html)
    stream.close()
    return stream.events


def inside(stream: Iterable[Event], tags: tuple[str, ...], wanted: bool) -> Iterator[str]:
    """Texts that stand inside (or outside) elements of the given tags."""
    depth = 0
    for kind, tag, value in stream:
        if kind == TEXT:
            if (depth > 0) == wanted:
                yield value
        elif tag in tags:
            depth = max(depth + (1 if kind == OPEN else -1), 0)


def squeezed(parts: Iterable[str]) -> str:
    return " ".join(" ".join(parts).split())


def facts(html: str) -> dict:
    """Title, visible text with it, the distinct canonical and og:url addresses, and the first source
    that the page's head names."""
    stream = events(html)
    heads = [(tag, a) for kind, tag, a in stream if kind == OPEN and tag in ("link", "meta")]
    declared = [a.get("href") or a.get("content", "") for tag, a in heads if (a.get("rel") == "canonical" if tag == "link" else a.get("property") == "og:url")]
    named = [a.get("href") if tag == "link" else a.get("content") for tag, a in heads if (a.get("rel", "").lower() == "canonical" if tag == "link" else (a.get("property") or a.get("name", "")).lower() in SOURCE_META)]
    return {
        "title": squeezed(inside(stream, ("title",), True)) or None,
        "text": squeezed(inside(stream, ("script", "style"), False)),
        "urls": sorted({u for u in declared if u.startswith(("http://", "https://"))}),
        "source": next((u for u in named if u), None),
    }


_FACTS = pa.struct([("title", pa.string()), ("text", pa.string()), ("urls", pa.list_(pa.string())), ("source", pa.string())])


@F.arrow_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "text")] + [T.StructField("urls", T.ArrayType(T.StringType())), T.StructField("source", T.StringType())]))
def page_facts(html: pa.Array) -> pa.Array:
    """struct(title, text, urls, source) of a page, from one parse; null for null."""
    return pa.array([None if h is None else facts(h) for h in html.to_pylist()], _FACTS)


def only_references(html: Column, names: Sequence[str]) -> Column:
    """The page with every ampersand as text that begins none of the named references, semicolon
    included: a parse then resolves these alone, not ``&amp`` at the end of a cut title."""
    return F.regexp_replace(html, f"&(?!(?:{'|'.join(names)});)", "&amp;")


def page_title(html: Column) -> Column:
    """Title with white space collapsed; null if there is none."""
    return page_facts(html)["title"]


def page_text(html: Column) -> Column:
    """struct(text, urls): visible text, title included, and the page's own addresses, sorted."""
    found = page_facts(html)
    return F.when(found.isNotNull(), F.struct(found["text"].alias("text"), found["urls"].alias("urls")))


def page_source_url(html: Column) -> Column:
    """Source that the head names, else the first mark of a saved page; null if there is none."""
    marks = [F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")) for pattern in SOURCE_MARKS]
    return F.coalesce(page_facts(html)["source"], *marks)


def fold(text: str) -> str:
    """Lower-case text without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@F.arrow_udf(T.StringType())
def fold_accents(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fold(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def fold_all(texts: pa.Array) -> pa.Array:
    return pa.array([None if row is None else [fold(t) for t in row] for row in texts.to_pylist()], pa.list_(pa.string()))


def birth_candidates(text: Column) -> Column:
    """array<struct(start, near, whole, year)>: statements of a birth year in order, with the place of
    the first character and the statement with up to BEFORE characters ahead of it; ``whole`` is the
    same without the rest of a word that the window's start cuts."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    plain = F.translate(text, "\x01\x02", "  ")
    split = F.struct(plain.alias("plain"), F.split(F.regexp_replace(plain, BIRTH, "\x01$0\x02"), "\x01").alias("pieces"))

    def candidate(s: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(s["sizes"], 1, i), F.lit(0), lambda a, n: a + n)
        said = F.substring_index(F.get(s["pieces"], i), "\x02", 1)
        first = F.greatest(start - BEFORE, F.lit(0))
        near = F.substring(s["plain"], first + 1, start - first + F.length(said))
        cut = (first > 0) & F.substring(s["plain"], first, F.lit(2)).rlike(r"^[\p{L}\p{N}_]{2}")  # the window begins inside a word
        whole = F.when(cut, F.regexp_replace(near, r"^[\p{L}\p{N}_]+", "")).otherwise(near)
        return F.struct(start.alias("start"), squeeze(near).alias("near"), squeeze(whole).alias("whole"), F.right(said, F.lit(4)).cast("int").alias("year"))

    def candidates(s: Column) -> Column:
        sizes = F.transform(s["pieces"], lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
        sized = F.struct(s["plain"].alias("plain"), s["pieces"].alias("pieces"), sizes.alias("sizes"))
        return _once(sized, lambda z: F.transform(F.sequence(F.lit(1), F.size(z["pieces"]) - 1), lambda i: candidate(z, i)))

    none = F.when(text.isNotNull(), F.array().cast("array<struct<start:int,near:string,whole:string,year:int>>"))
    return F.when(text.rlike(BIRTH), _once(split, candidates)).otherwise(none)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def birth_statement(text: Column | str, name: Column | str, award_year: Column | str) -> Column:
    """struct(birth_year, approximate, excerpt): the first statement of the subject's birth year; null
    if there is none.

    A statement is the subject's if no relative is named before it in its window (a word that the
    window cuts names none) and the surname stands in the window or the statement in the biography's lead. The award year counts only where
    the text says "born in" it; decades do not count.
    """
    text, name, award = (F.col(c) if isinstance(c, str) else c for c in (text, name, award_year))
    found = birth_candidates(text)
    surname = F.regexp_extract(fold_accents(F.coalesce(name, F.lit(""))), "([a-z]+)[^a-z]*$", 1)
    ahead_of = F.regexp_extract_all(text, F.lit(r"(?di)\b(?=was born|born)(?<=(\A[\s\S]{0,%d}|[\s\S]{%d}))" % (BEFORE - 1, BEFORE) + BIRTH.removeprefix("(?di)")), F.lit(1))
    folded = fold_all(F.zip_with(ahead_of, F.regexp_extract_all(text, F.lit(BIRTH), F.lit(0)), lambda a, m: F.concat(a, m)))  # no lambda in a lambda: Python takes none
    lead = F.instr(text, LEAD_MARK) - 1

    def own(c: Column) -> Column:
        near, start = c["c"]["near"], c["c"]["start"]
        ahead = F.regexp_extract(c["c"]["whole"], "(?is)^(.*)born", 1)
        in_lead = (lead >= 0) & start.between(lead, lead + LEAD)
        awarded = (c["c"]["year"] == award) & ~F.contains(F.lower(near), F.concat(F.lit("born in "), award.cast("string")))
        return ~ahead.rlike(RELATIVES) & ((c["surname"] == "") | in_lead | F.contains(c["folded"], c["surname"])) & ~F.coalesce(awarded, F.lit(False))

    rows = F.arrays_zip(found.alias("c"), folded.alias("folded"), F.array_repeat(surname, F.size(found)).alias("surname"))  # lambdas hold no Python
    first = F.get(F.filter(rows, own), F.lit(0))["c"]
    value = F.struct(first["year"].alias("birth_year"), first["whole"].rlike(APPROXIMATE).alias("approximate"), F.right(first["near"], F.lit(EXCERPT)).alias("excerpt"))
    return F.when(first.isNotNull(), value)
