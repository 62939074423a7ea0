"""Segmentation of texts into sections, and chunking of sections."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark import values as V
from loomspark.functions.text import header_title, section_type
from loomspark.functions.vectors import cosine

_SECTION = "array<struct<section_type:string,title:string,text:string,char_offset_start:int,char_offset_end:int>>"


def segment_text(docs: DataFrame, id_col: str, text_col: str, strict_caps: bool = False) -> DataFrame:
    """(id, section_no, section_type, title, text, char_offset_start, char_offset_end) by header lines.

    A header opens a section; sections without body lines vanish, a text without any gives one of type other. Lines
    never leave their row: they are marked in an array, the running header count and offset are folded over it, and
    only sections are grouped.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("id", "t", F.posexplode(F.split("t", "\n")).alias("no", "line"))
    body = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    lines = lines.withColumn("body", body).withColumn("header", header_title(F.col("body"), strict_caps))
    w = Window.partitionBy("id").orderBy("no")
    lines = lines.withColumn("section", F.count("header").over(w)).withColumn("offset", F.sum(F.length("line") + 1).over(w) - F.length("line") - 1)
    text_lines = F.when(F.col("header").isNull() & (F.length("body") > 0), F.struct("no", "body"))
    parts = lines.groupBy("id", "section").agg(
        F.max("header").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(text_lines)), lambda x: x["body"]), "\n").alias("text"),
        F.max(F.col("offset") + F.length("line") + 1).alias("end"),
    )
    parts = parts.where(F.length("text") > 0)
    kind = F.when(F.col("section") == 0, "other").otherwise(section_type(F.col("title")))
    parts = parts.select("id", "section", kind.alias("section_type"), "text", "end").withColumn("title", F.when(F.col("section") > 0, F.col("section_type")))
    numbered = parts.withColumn("section_no", F.row_number().over(Window.partitionBy("id").orderBy("section")))
    found = numbered.select("id", "section_no", "section_type", "title", "text", (F.col("end") - F.length("text") - 1).cast("int").alias("char_offset_start"), (F.col("end") - 1).cast("int").alias("char_offset_end"))
    bare = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(found.select("id"), "id", "left_anti")
    one = bare.select("id", F.lit(1).alias("section_no"), F.lit("other").alias("section_type"), F.lit(None).cast("string").alias("title"), "text", F.lit(0).alias("char_offset_start"), F.length("text").alias("char_offset_end"))
    return found.union(one)


def enhance(sections: Column) -> Column:
    """Sections of type other with a title get the type that the title tells."""
    return F.transform(sections, lambda s: s.withField("section_type", F.when((s["section_type"] == "other") & (F.length(s["title"]) > 0), section_type(s["title"])).otherwise(s["section_type"])))


def merge_short(sections: Column, min_length: int = 100) -> Column:
    """Left fold over an array of sections: one shorter than min_length joins the next, which gives the type."""
    first = F.slice(sections, 1, 1)

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            s["section_type"].alias("section_type"),
            F.coalesce(F.when(F.length(s["title"]) > 0, s["title"]), last["title"]).alias("title"),
            F.concat(last["text"], F.lit("\n\n"), s["text"]).alias("text"),
            last["char_offset_start"].alias("char_offset_start"),
            s["char_offset_end"].alias("char_offset_end"),
        )
        short = F.length(last["text"]) < min_length
        return F.when(short, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.slice(sections, 2, F.greatest(F.size(sections), F.lit(1))), first.cast(_SECTION), step)


def section_at(sections: DataFrame, points: DataFrame) -> DataFrame:
    """points(id, offset) with the first section whose range holds the offset; null without one."""
    s = sections.select("id", "section_no", "section_type", "char_offset_start", "char_offset_end")
    hit = points.join(s, "id").where((F.col("offset") >= F.col("char_offset_start")) & (F.col("offset") < F.col("char_offset_end")))
    first = hit.groupBy("id", "offset").agg(F.min_by("section_type", "section_no").alias("section_type"))
    return points.join(first, ["id", "offset"], "left")


def structure_map(sections: DataFrame) -> DataFrame:
    """(id, structure): JSON of section types, their number and their distinct kinds."""
    listed = F.array_sort(F.collect_list(F.struct("section_no", "section_type", "char_offset_start", "char_offset_end")))
    kinds = F.array_sort(F.collect_set("section_type"))
    return sections.groupBy("id").agg(F.to_json(F.struct(listed.alias("sections"), F.count("*").alias("total_sections"), kinds.alias("section_types"))).alias("structure"))


# --- chunks ---

_TOKEN, _SENTENCE = re.compile(r"\S+"), re.compile(r"(?<=[.!?])\s+")


class Packer:
    """Packs a section's sentences into chunks of at most `most` words, repeating the last `overlap` words."""

    def __init__(self, most: int = V.CHUNK_MAX, overlap: int = V.CHUNK_OVERLAP, least: int = V.CHUNK_MIN, joiner: str = "") -> None:
        self.most, self.overlap, self.least, self.joiner = most, overlap, least, joiner

    @staticmethod
    def count(text: str) -> int:
        return len(_TOKEN.findall(text))

    def tail(self, text: str) -> str:
        words = _TOKEN.findall(text)
        return text if len(words) <= self.overlap else " ".join(words[len(words) - self.overlap :]) + " "

    def pack(self, text: str, start: int, end: int) -> list[tuple[str, int, int, int]]:
        """(text, start, end, tokens) of each chunk.

        Sentences are glued with `joiner`; the count of a chunk is the sum over its sentences until an overlap starts
        a new one. Starts of later chunks are counted back from the section's end. A chunk under `least` words is
        not written but carried on; a sentence longer than `most` makes a longer chunk.
        """
        n = self.count(text)
        if n <= self.most:
            return [(text, start, end, n)]
        chunks, held, size, begin = [], "", 0, start
        for sentence in filter(str.strip, _SENTENCE.split(text)):
            words = self.count(sentence)
            if size + words <= self.most:
                held, size = held + (self.joiner if held else "") + sentence, size + words
                continue
            if held and size >= self.least:
                chunks.append((held.strip(), begin, begin + len(held), size))
            held = self.tail(held) + sentence
            size, begin = self.count(held), end - len(held)
        if held and size >= self.least:
            chunks.append((held.strip(), begin, end, size))
        return chunks


_CHUNKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))


def chunk_sections(sections: DataFrame, packer: Packer = Packer(), id_col: str = "id") -> DataFrame:
    """(id, sequence, section_type, text, char_start, char_end, tokens) of all but blank and reference sections.

    The fold over sentences carries text from one to the next, so each section goes through an Arrow function as one
    value; numbering the chunks of a document is a window by id.
    """

    @F.pandas_udf(_CHUNKS)
    def pack(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "char_start": a, "char_end": b, "tokens": n} for t, a, b, n in packer.pack(x, s, e)] for x, s, e in zip(text, start, end, strict=True)], dtype=object)

    live = sections.where((F.col("section_type") != "references") & (F.length(F.regexp_replace("text", r"(?U)\s+", "")) > 0))
    made = live.select(F.col(id_col).alias("id"), "section_no", "section_type", F.posexplode(pack("text", "char_offset_start", "char_offset_end")).alias("n", "c"))
    w = Window.partitionBy("id").orderBy("section_no", "n")
    return made.select("id", (F.row_number().over(w) - 1).alias("sequence"), "section_type", "c.text", "c.char_start", "c.char_end", "c.tokens")


def estimated_chunks(sections: DataFrame, most: int = V.CHUNK_MAX, overlap: int = V.CHUNK_OVERLAP, id_col: str = "id") -> DataFrame:
    """(id, n): words of all but reference sections over the net chunk size, at least 1."""
    words = F.sum(F.when(F.col("section_type") != "references", F.size(F.regexp_extract_all("text", F.lit(r"(?U)(\S+)"), F.lit(1)))).otherwise(0))
    return sections.groupBy(F.col(id_col).alias("id")).agg(F.greatest(F.lit(1), F.floor(words / (most - overlap))).cast("long").alias("n"))


def dispatch(parsed: DataFrame, id_col: str = "id") -> DataFrame:
    """parsed(id, full_text, sections array) -> sections as segment_text() has them.

    Documents that were parsed into more than one section keep these, their types told anew from titles; others are
    segmented by the header lines of their full text.
    """
    many = F.size(F.coalesce("sections", F.array().cast(_SECTION))) > 1
    listed = parsed.where(many).select(F.col(id_col).alias("id"), F.posexplode(enhance(F.col("sections"))).alias("n", "s"))
    kept = listed.select("id", (F.col("n") + 1).alias("section_no"), *(F.col("s")[c].alias(c) for c in ("section_type", "title", "text", "char_offset_start", "char_offset_end")))
    return kept.unionByName(segment_text(parsed.where(~many), id_col, "full_text"))


def semantic_chunks(sentences: DataFrame, threshold: float = 0.8, most: int = V.CHUNK_MAX, id_col: str = "id") -> DataFrame:
    """sentences(id, no, text, tokens, embedding) -> (id, sequence, text, tokens, first_no, last_no).

    A sentence less alike than threshold to the one before it begins a new group; a group is cut wherever the tokens
    before a sentence pass a multiple of `most`. The original declares this chunker and leaves it open.
    """
    w = Window.partitionBy(id_col).orderBy("no")
    alike = cosine(F.lag("embedding").over(w), F.col("embedding"))
    marked = sentences.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).when(alike >= threshold, 0).otherwise(1))
    grouped = marked.withColumn("__group", F.sum("__new").over(w))
    inside = Window.partitionBy(id_col, "__group").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("tokens").over(inside), F.lit(0)) / most)
    chunks = grouped.withColumn("__part", part).groupBy(F.col(id_col).alias("id"), "__group", "__part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.sum("tokens").alias("tokens"), F.min("no").alias("first_no"), F.max("no").alias("last_no"),
    )
    number = F.row_number().over(Window.partitionBy("id").orderBy("first_no")) - 1
    return chunks.select("id", number.alias("sequence"), "text", "tokens", "first_no", "last_no")
