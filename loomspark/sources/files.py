"""Files as rows: object reads, type detection, PDF checks, HTML and TEI parsing, layout items."""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark import values as V
from loomspark.functions.text import file_type, section_type


def objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modified, size, content) of every file under a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def object_metadata(files: DataFrame) -> DataFrame:
    """path, size, content type by extension and MD5 etag."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext == "pdf", "application/pdf").when(ext == "json", "application/json").when(ext == "txt", "text/plain").otherwise("application/octet-stream")
    return files.select("path", "size", kind.alias("content_type"), F.md5("content").alias("etag"))


def classify_files(files: DataFrame) -> DataFrame:
    return files.withColumn("file_type", file_type(F.col("path"), F.col("content")))


def pdf_errors(content: Column, pages: Column | None = None) -> Column:
    """The first thing wrong with a PDF's bytes, null if nothing is: too large, no header, encrypted, too many pages."""
    head = F.substring(content, 1, 5).cast("string")
    out = F.when(F.length(content) > V.PDF_MAX_BYTES, "too_large").when(~head.startswith("%PDF"), "not_pdf")
    out = out.when(F.contains(F.decode(content, "ISO-8859-1"), F.lit("/Encrypt")), "encrypted")
    return out if pages is None else out.when(pages > V.PDF_MAX_PAGES, "too_many_pages")


def pdf_pages(content: Column) -> Column:
    """Page objects in an uncompressed PDF; a stand-in where no PDF library is at hand."""
    return F.size(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"(/Type\s*/Page(?![a-zA-Z]))"), F.lit(1)))


def parser_route(kind: Column, tei_healthy: bool, layout_ready: bool, prefer_tei: bool = True) -> Column:
    """Which parser takes a file: tei or layout; null where none can."""
    for_pdf = "tei" if tei_healthy and prefer_tei else "layout" if layout_ready else "tei" if tei_healthy else None
    return F.when(kind == "pdf", F.lit(for_pdf)).otherwise(F.lit("layout" if layout_ready else None))


def storage_key(document_id: Column, content: Column) -> Column:
    """Content-addressed place of a document's file."""
    return F.concat(F.lit("documents/"), document_id.cast("string"), F.lit("/"), F.sha2(content, 256), F.lit(".pdf"))


def existing_object(listing: DataFrame, hashes: DataFrame) -> DataFrame:
    """hashes(content_hash) with the first listed path under documents/ that holds each one."""
    own = listing.where(F.contains("path", F.lit("documents/"))).withColumn("content_hash", F.explode(F.regexp_extract_all("path", F.lit("([0-9a-f]{64})"), F.lit(1))))
    return hashes.join(own.groupBy("content_hash").agg(F.min("path").alias("path")), "content_hash", "left")


# --- HTML ---

_DROP = r"(?is)<(script|style|nav|head|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
#: The named references that texts use most.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    out = text
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def plain(html: Column) -> Column:
    """Text of a fragment: tags become spaces, references are resolved, white space is squeezed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def html_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.length(found) > 0, plain(found))


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, head and comments."""
    return plain(F.regexp_replace(html, _DROP, " "))


def html_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, section_no, title, section_type, text): a section from each h1..h6 to the next, section 0 before the first."""
    body = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), _DROP, " ")
    parts = F.split(F.regexp_replace(body, r"(?is)<h[1-6][^>]*>", "\x01"), "\x01")
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("section_no", "part"))
    title = F.when(F.col("section_no") > 0, plain(F.regexp_extract("part", r"(?is)^(.*?)</h[1-6]\s*>", 1)))
    rest = F.when(F.col("section_no") > 0, F.regexp_replace("part", r"(?is)^.*?</h[1-6]\s*>", "")).otherwise(F.col("part"))
    rows = rows.select("id", "section_no", title.alias("title"), plain(rest).alias("text"))
    kind = F.when(F.length("title") > 0, section_type(F.col("title"))).otherwise("other")
    return rows.where((F.length("text") > 0) | (F.length("title") > 0)).select("id", "section_no", "title", kind.alias("section_type"), "text")


# --- TEI ---

_TEI = {"t": "http://www.tei-c.org/ns/1.0"}
_SECTION = T.StructType([T.StructField(n, k) for n, k in (("title", T.StringType()), ("text", T.StringType()), ("char_offset_start", T.IntegerType()), ("char_offset_end", T.IntegerType()), ("given_type", T.StringType()))])
_REFERENCE = T.StructType([T.StructField(n, k) for n, k in (("reference_number", T.IntegerType()), ("raw_text", T.StringType()), ("title", T.StringType()), ("authors", T.ArrayType(T.StringType())), ("year", T.IntegerType()), ("journal", T.StringType()), ("doi", T.StringType()), ("arxiv_id", T.StringType()))])
_PARSED = T.StructType([T.StructField("full_text", T.StringType()), T.StructField("sections", T.ArrayType(_SECTION)), T.StructField("references", T.ArrayType(_REFERENCE)), T.StructField("page_count", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("error", T.StringType())])


def _told(node: ElementTree.Element | None) -> str:
    return "" if node is None else " ".join(x.strip() for x in node.itertext() if x.strip())


def _text_of(root: ElementTree.Element, *paths: str) -> str | None:
    for p in paths:
        if (found := root.find(p, _TEI)) is not None:
            return found.text or None
    return None


def _reference(node: ElementTree.Element, n: int) -> dict:
    people = []
    for person in node.iterfind(".//t:author/t:persName", _TEI):
        parts = [x for x in (_text_of(person, "t:forename"), _text_of(person, "t:surname")) if x]
        people += [" ".join(parts)] if parts else []
    when = node.find(".//t:date", _TEI)
    year = re.match(r"\d{4}", when.get("when") or "") if when is not None else None
    return {
        "reference_number": n, "raw_text": _told(node), "title": _text_of(node, ".//t:title[@level='a']", ".//t:title"), "authors": people, "year": int(year[0]) if year else None,
        "journal": _text_of(node, ".//t:title[@level='j']"), "doi": _text_of(node, ".//t:idno[@type='DOI']"), "arxiv_id": _text_of(node, ".//t:idno[@type='arXiv']"),
    }


def parse_tei_text(tei: str | None) -> dict:
    """Abstract, body divisions and reference list of a TEI document, two characters apart; an error instead of a crash."""
    empty = {"full_text": "", "sections": [], "references": [], "page_count": 1, "title": None, "error": None}
    try:
        root = ElementTree.fromstring(tei or "")
    except ElementTree.ParseError as e:
        return empty | {"error": str(e)}
    named = [("Abstract", _told(root.find(".//t:abstract", _TEI)), "abstract")]
    for div in root.iterfind(".//t:body//t:div", _TEI):
        head = div.find("t:head", _TEI)
        named.append(((head.text.strip() or None) if head is not None and head.text else None, _told(div), None))
    named.append(("References", _told(root.find(".//t:back//t:div[@type='references']", _TEI)), "references"))
    sections, at = [], 0
    for title, text, kind in named:
        if text:
            sections.append({"title": title, "text": text, "char_offset_start": at, "char_offset_end": at + len(text), "given_type": kind})
            at += len(text) + 2
    found = [_reference(x, n) for n, x in enumerate(root.iterfind(".//t:listBibl/t:biblStruct", _TEI), 1)]
    return {"full_text": "\n\n".join(s["text"] for s in sections), "sections": sections, "references": found, "page_count": len(root.findall(".//{*}pb")) or 1, "title": _text_of(root, ".//t:titleStmt/t:title"), "error": None}


@F.pandas_udf(_PARSED)
def _parse(tei: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_tei_text(x) for x in tei], columns=[f.name for f in _PARSED])


def parse_tei(docs: DataFrame, id_col: str, tei_col: str) -> DataFrame:
    """(id, full_text, sections, references, page_count, title, error). XML trees need a parser, so one Arrow pass reads
    them; section types are told from titles by built-ins."""
    rows = docs.select(F.col(id_col).alias("id"), _parse(F.col(tei_col)).alias("p")).select("id", "p.*")
    typed = F.transform(
        "sections",
        lambda s: F.struct(
            F.coalesce(s["given_type"], F.when(F.length(s["title"]) > 0, section_type(s["title"], V.TEI_SECTION_KEYWORDS)), F.lit("other")).alias("section_type"),
            *(s[c].alias(c) for c in ("title", "text", "char_offset_start", "char_offset_end")),
        ),
    )
    return rows.withColumn("sections", typed)


def layout_sections(items: DataFrame) -> DataFrame:
    """items(id, no, label, text) of a layout model -> (id, section_no, section_type, title, text, offsets).

    Headers open sections; text, list items and captions follow, footnotes marked; page headers and footers go.
    """
    live = items.where((F.length(F.trim("text")) > 0) & ~F.coalesce(F.col("label"), F.lit("")).isin("page_header", "page_footer", "group")).withColumn("text", F.trim("text"))
    w = Window.partitionBy("id").orderBy("no")
    live = live.withColumn("section", F.count(F.when(F.col("label") == "section_header", 1)).over(w))
    line = F.when(F.col("label").isin("text", "list_item", "caption"), F.col("text")).when(F.col("label") == "footnote", F.concat(F.lit("[footnote] "), "text"))
    parts = live.groupBy("id", "section").agg(
        F.max(F.when(F.col("label") == "section_header", F.col("text"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("no", line.alias("t"))))), lambda x: x["t"]), "\n").alias("text"),
    )
    parts = parts.where((F.length("text") > 0) | F.col("title").isNotNull())
    order = Window.partitionBy("id").orderBy("section")
    start = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    kind = F.when(F.col("title").isNull(), "other").otherwise(section_type(F.col("title"), V.LAYOUT_SECTION_KEYWORDS))
    return parts.select("id", F.row_number().over(order).alias("section_no"), kind.alias("section_type"), "title", "text", start.alias("char_offset_start"), (start + F.length("text")).alias("char_offset_end"))


def constant_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Supported formats and known sources."""
    return spark.createDataFrame([(f,) for f in V.SUPPORTED_FORMATS], "format string"), spark.createDataFrame([(s,) for s in V.SEARCH_SOURCES], "source string")


# --- text of PDFs, and what is left where parsing fails ---


def simple_pdf(content: bytes) -> dict:
    """Text shown by uncompressed content streams, page by page, and the plain entries of the information dictionary."""
    raw = content.decode("latin-1")
    pages = [" ".join(m[1] for m in re.finditer(r"\(((?:[^()\\]|\\.)*)\)\s*Tj", part)) for part in re.split(r"/Type\s*/Page(?![a-zA-Z])", raw)[1:]]
    told = {k.lower(): v for k, v in re.findall(r"/(Title|Author|Subject|Keywords|Creator)\s*\(((?:[^()\\]|\\.)*)\)", raw) if v.strip()}
    return {"pages": pages, "metadata": told}


_EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("first_page", T.StringType()), T.StructField("page_count", T.IntegerType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])


def pdf_extract(files: DataFrame, extract: Callable[[bytes], dict] = simple_pdf) -> DataFrame:
    """files(path, content) -> (path, text, first_page, page_count, metadata, error).

    extract turns bytes into pages and metadata; a PDF library's reader takes its place where there is one. Pages are
    joined by a blank line, metadata without value is dropped, a file that can't be read gets its error and no text.
    """

    @F.pandas_udf(_EXTRACTED)
    def read(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            try:
                made = extract(bytes(content))
                pages = list(made["pages"])
                rows.append(("\n\n".join(pages), pages[0] if pages else "", len(pages), {k: v for k, v in made["metadata"].items() if v}, None))
            except Exception as e:  # noqa: BLE001  whatever a reader raises belongs to its file
                rows.append((None, None, 0, {}, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=[f.name for f in _EXTRACTED])

    return files.select("path", read("content").alias("p")).select("path", "p.*")


def whole_text_fallback(parsed: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """parsed(id, full_text, sections, error) where a document without sections gets its whole text as one section of
    type other; without text it stays empty and keeps its error."""
    own = parsed.join(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), "id", "left")
    bare = (F.size("sections") == 0) & (F.length("__text") > 0)
    one = F.array(F.struct(F.lit("other").alias("section_type"), F.lit(None).cast("string").alias("title"), F.col("__text").alias("text"), F.lit(0).alias("char_offset_start"), F.length("__text").alias("char_offset_end")))
    return own.select("id", F.when(bare, F.col("__text")).otherwise(F.col("full_text")).alias("full_text"), F.when(bare, one.cast(parsed.schema["sections"].dataType)).otherwise(F.col("sections")).alias("sections"), "error", bare.alias("fallback"))
