"""String, path, name and id scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b"


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def name_token(text: Column) -> Column:
    """Alphabetically first token, empty if there is none."""
    return F.coalesce(F.array_min(tokens(text)), F.lit(""))


def years(text: Column) -> Column:
    """Years 1500 to 2099 in a text, as an array of int."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def path_key(path: Column) -> Column:
    """Comparable form of a path: slashes forward, lower case, no leading ``./`` or ``/``."""
    return F.regexp_replace(F.lower(F.replace(F.trim(path), F.lit("\\"), F.lit("/"))), r"^(\./|/)+", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stable_id(prefix: str, key: Column) -> Column:
    """``prefix-`` and the first 20 hex digits of the key's SHA-256."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(key, 256), 1, 20))


def text_sha256(content: Column) -> Column:
    """SHA-256 of a text with its line ends made LF."""
    return F.sha2(F.replace(content, F.lit("\r\n"), F.lit("\n")), 256)


def artifact_id(filename: Column) -> Column:
    """First upper-case hyphenated token with three parts or more; underscores are hyphens."""
    return blank_to_null(F.regexp_extract(F.replace(filename, F.lit("_"), F.lit("-")), r"[A-Z][A-Z0-9]*(?:-[A-Z0-9]+){2,}", 0))


def extension(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".warc.gz"), F.lit(".warc.gz")).otherwise(F.regexp_extract(low, r"(\.[a-z0-9]+)$", 1))


#: File extensions of each category.
EXTENSIONS = {
    "image": [".jpg", ".jpeg", ".png", ".tiff", ".webp"],
    "document": [".pdf", ".txt", ".md", ".doc", ".docx"],
    "web_snapshot": [".html", ".htm"],
    "archive": [".warc", ".warc.gz", ".wacz", ".zip"],
    "genealogy": [".ged"],
    "sidecar": [".json", ".yaml", ".yml", ".csv"],
}
CATEGORIES = {ext: name for name, exts in EXTENSIONS.items() for ext in exts}


def category(ext: Column) -> Column:
    table = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, ext), F.lit("unknown"))


def parse_name(name: Column) -> Column:
    """struct(given, surname, display) of ``Given /Surname/``; display is Unknown if blank."""
    surname = blank_to_null(F.regexp_extract(name, "/([^/]*)/", 1))
    given = blank_to_null(F.split(name, "/")[0])
    display = F.coalesce(blank_to_null(F.regexp_replace(F.replace(name, F.lit("/"), F.lit(" ")), r"\s+", " ")), F.lit("Unknown"))
    return F.struct(given.alias("given"), surname.alias("surname"), display.alias("display"))


def strip_pointer(value: Column) -> Column:
    return F.regexp_replace(value, "^@(.*)@$", "$1")


#: Fillers that stand in for an answer.
PLACEHOLDERS = ["", "tbd", "todo", "n/a", "na", "?", "-"]


def is_placeholder(text: Column) -> Column:
    """Null, blank or one of the fixed fillers."""
    return text.isNull() | F.lower(F.trim(text)).isin(PLACEHOLDERS)


def unsafe_cell(text: Column) -> Column:
    """Whether a spreadsheet would run the text as a formula."""
    return F.coalesce(F.ltrim(text).rlike(r"^[=+\-@]"), F.lit(False))


def first_valid(default: str, allowed: list[str], *candidates: Column) -> Column:
    """First candidate in the vocabulary, else the default of the same vocabulary."""
    return F.coalesce(*[F.when(c.isin(allowed), c) for c in candidates], F.lit(default))


def last_truthy(default: str, allowed: list[str], *candidates: Column) -> Column:
    """First candidate in the vocabulary, else the last that is not empty even if it is in no
    vocabulary, else the default."""
    valid = [F.when(c.isin(allowed), c) for c in candidates]
    return F.coalesce(*valid, *[F.nullif(c, F.lit("")) for c in reversed(candidates)], F.lit(default))


def notes_list(value: Column) -> Column:
    """Notes as a list: JSON lists without their blank entries, any other text that is not blank as one
    note, nothing as an empty list."""
    listed = F.filter(F.from_json(value, "array<string>"), lambda n: F.trim(n) != "")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.array().cast("array<string>")).when(F.ltrim(value).startswith("["), F.coalesce(listed, F.array(value))).otherwise(F.array(value))


def zip_key(path: Column) -> Column:
    """Comparable form of a path in a ZIP: slashes forward, lower case, one slash at its end; a blank
    path stays blank."""
    bare = F.regexp_replace(F.lower(F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))), "^/+|/+$", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit("/")))


#: MIME types by extension, for extensions of the archive.
MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tiff": "image/tiff", ".webp": "image/webp",
    ".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".html": "text/html", ".htm": "text/html", ".zip": "application/zip", ".json": "application/json", ".csv": "text/csv",
}


def mime_guess(path: Column) -> Column:
    """MIME type by the extension of a filename, null if it is not known."""
    table = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1))


def fact(date: Column, place: Column) -> Column:
    return F.nullif(F.concat_ws(", ", blank_to_null(date), blank_to_null(place)), F.lit(""))


def canonical_sha256(*columns: Column) -> Column:
    """Fingerprint of values joined by a separator that none of them holds; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
