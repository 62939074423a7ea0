"""Column functions over text: normalisers, tokenisers, section headers, file types."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark import values as V



@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks; Spark has no built-in for it."""
    drop = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    return text.map(lambda t: t if t is None or t.isascii() else drop(t))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def squeeze(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_title(title: Column) -> Column:
    """Accents and signs dropped, lower case, dashes and underscores as spaces."""
    plain = F.regexp_replace(F.lower(strip_accents(title)), r"(?U)[^\w\s-]", "")
    return squeeze(F.regexp_replace(plain, "[-_]+", " "))


def search_title(title: Column) -> Column:
    """The lighter key of search results: lower case, signs dropped, accents kept."""
    return squeeze(F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", ""))


def normalize_author(name: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(nfkc(name)), r"(?U)[^\w\s]", ""))


def normalize_doi(doi: Column) -> Column:
    """Without resolver prefix, lower case; null for null and empty."""
    bare = F.regexp_replace(F.trim(doi), r"^(https?://(dx\.)?doi\.org/|doi:|DOI:)", "")
    return F.when(F.length(doi) > 0, F.trim(F.lower(bare)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sparse_tokens(text: Column) -> Column:
    """Terms of the sparse index: ASCII letters, digits and one inner dash, without stop words and short ones."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+-?[a-z0-9]*)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(V.STOPWORDS))


def white_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))


def token_count(text: Column) -> Column:
    """The estimate of one token for four characters."""
    return F.floor(F.length(text) / 4).cast("long")


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space; blank parts dropped."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def overlap_tail(text: Column, tokens: int) -> Column:
    """The last `tokens` words and a space; the text itself where it has no more."""
    words = white_tokens(text)
    return F.when(F.size(words) <= tokens, text).otherwise(F.concat(F.array_join(F.slice(words, -tokens, tokens), " "), F.lit(" ")))


_NUMBERED, _ROMAN = f"(?i){V.NUMBERED_HEADER}", f"(?i){V.ROMAN_HEADER}"


def header_title(line: Column, strict_caps: bool = False) -> Column:
    """Title of a section header, null where the trimmed line is none.

    Letter-only lines count as headers in any case unless strict_caps asks for capitals.
    """
    capitals = V.CAPITALS_HEADER if strict_caps else f"(?i){V.CAPITALS_HEADER}"
    upper = (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) > 3)
    title = (
        F.when(line.rlike(_NUMBERED), F.regexp_extract(line, _NUMBERED, 2))
        .when(line.rlike(_ROMAN), F.regexp_extract(line, _ROMAN, 2))
        .when(line.rlike(capitals), line)
        .when(upper, line)
    )
    return F.when((F.length(line) > 0) & (F.length(line) <= 100), title)


def section_type(title: Column, keywords=V.SECTION_KEYWORDS) -> Column:
    """The first section kind one of whose keywords the title contains; other if none does."""
    low, out = F.lower(title), None
    for kind, words in keywords:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def file_type(name: Column, content: Column | None = None) -> Column:
    """By extension, else by the first bytes, else pdf."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in V.FILE_TYPES.items() for x in pair])
    by_name = known[ext]
    if content is None:
        return F.coalesce(by_name, F.lit("pdf"))
    head = F.hex(F.substring(content, 1, 8))
    magic = (
        F.when(head.startswith("25504446"), "pdf")
        .when(head == "89504E470D0A1A0A", "image")
        .when(head.startswith("FFD8"), "image")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image")
        .when(head.startswith("504B0304"), "docx")
    )
    return F.coalesce(by_name, magic, F.lit("pdf"))


def safe_filename(name: Column) -> Column:
    return F.translate(name, "/\\\x00", "__")


def reference_doi(raw: Column) -> Column:
    found = F.rtrim(F.regexp_extract(raw, V.REFERENCE_DOI, 1), F.lit("."))
    return F.when(F.length(found) > 0, found)


def reference_year(raw: Column) -> Column:
    found = F.regexp_extract(raw, V.REFERENCE_YEAR, 1)
    return F.when(F.length(found) > 0, found.cast("int"))


def reference_arxiv(raw: Column) -> Column:
    found = F.regexp_extract(raw, f"(?i){V.REFERENCE_ARXIV}", 1)
    return F.when(F.length(found) > 0, found)


def split_name(name: Column, style: str) -> tuple[Column, Column]:
    """(given, family) of a name written as last_token, first_token or comma (family first)."""
    if style == "comma":
        has = F.contains(name, F.lit(","))
        return F.when(has, F.trim(F.regexp_replace(name, "^[^,]*,", ""))), F.trim(F.substring_index(name, ",", 1))
    parts = F.split(F.trim(name), r"\s+")
    one = F.size(parts) < 2
    if style == "last_token":
        return F.when(~one, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")), F.element_at(parts, -1)
    if style == "first_token":
        return F.when(~one, parts[0]), F.when(one, parts[0]).otherwise(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " "))
    raise ValueError(f"unknown name style {style}")
