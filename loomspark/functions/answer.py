"""Column functions over answers and prompts: citations, confidence, sanitising, prompt parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark import values as V


def citations(answer: Column) -> Column:
    """Sorted distinct numbers in square brackets."""
    found = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def split_citations(found: Column, available: Column) -> tuple[Column, Column]:
    """Those that exist and those that don't."""
    return F.array_intersect(found, available), F.array_except(found, available)


def highlight(answer: Column, style: str = "markdown") -> Column:
    forms = {"markdown": r"**[$1]**", "html": r'<span class="citation">[$1]</span>'}
    return F.regexp_replace(answer, r"\[(\d+)\]", forms[style])


def confidence(answer: Column, n_citations: Column, local: bool = False) -> Column:
    """Rises with citations, falls once for a hedging phrase."""
    base, most, top, hedges = (0.4, 0.35, 0.9, V.HEDGES[:4]) if local else (0.5, 0.3, 0.95, V.HEDGES)
    hedged = F.lit(False)
    for phrase in hedges:
        hedged = hedged | F.contains(F.lower(answer), F.lit(phrase))
    score = F.lit(base) + F.least(F.lit(most), n_citations * 0.1) - F.when(hedged, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(top), score))


def sanitize(text: Column) -> Column:
    """Known injection phrases masked and control tokens broken up."""
    out = text
    for pattern in V.INJECTION_PATTERNS:
        out = F.regexp_replace(out, f"(?i){pattern}", "[FILTERED]")
    return F.replace(F.replace(out, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def chunk_block(n: Column, title: Column, year: Column, section: Column, text: Column) -> Column:
    """`[n]`, what is known of the source on one line, and the text, one below the other."""
    known = F.concat_ws(
        " ",
        F.when(F.length(title) > 0, F.concat(F.lit("Source: "), title)),
        F.when(year != 0, F.concat(F.lit("("), year.cast("string"), F.lit(")"))),
        F.when(F.length(section) > 0, F.concat(F.lit("Section: "), section)),
    )
    return F.concat_ws("\n", F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.when(F.length(known) > 0, known), text)


def graph_block(paths: Column, most: int = 5) -> Column:
    """A heading and up to `most` paths of two or more names; empty without paths."""
    taken = F.filter(F.slice(paths, 1, most), lambda p: F.size(p) >= 2)
    lines = F.transform(taken, lambda p: F.concat(F.lit("- "), F.array_join(p, " -> ")))
    return F.when(F.size(paths) > 0, F.concat_ws("\n", F.lit("Related concepts from knowledge graph:"), lines)).otherwise(F.lit(""))


def snippet(text: Column, chars: int = 200) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def source_line(n: Column, title: Column, authors: Column, year: Column) -> Column:
    """A numbered source with up to three authors."""
    names = F.when(F.size(authors) > 0, F.concat(F.lit("by "), F.array_join(F.slice(authors, 1, 3), ", ")))
    more = F.when(F.size(authors) > 3, F.lit("et al."))
    when = F.when(year.isNotNull(), F.concat(F.lit("("), year.cast("string"), F.lit(")")))
    return F.concat_ws(" ", F.concat(F.lit("["), n.cast("string"), F.lit("]")), title, names, more, when)


def truncate_context(context: Column, system: Column, question: Column, user_prompt: Column, most: int = V.PROMPT_CHARS, spare: int = 500) -> Column:
    """The context, cut where the whole prompt is longer than `most` characters and something would be left of it."""
    room = F.lit(most) - F.length(system) - F.length(question) - spare
    over = F.length(system) + F.length(user_prompt) > most
    return F.when(over & (room > 0), F.concat(F.substring(context, F.lit(1), room.cast("int")), F.lit("\n[Context truncated...]"))).otherwise(context)


#: Fixed value: what a summary says where a chunk has nothing to tell.
NOTHING_RELEVANT = "NO_RELEVANT_INFO"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def irrelevant(summary: Column) -> Column:
    return F.contains(F.upper(summary), F.lit(NOTHING_RELEVANT))


def batch_summaries(response: Column, chunks: Column) -> Column:
    """array<struct<chunk int, text, summarized boolean>> of the chunks (an array of texts) that a batch reply keeps.

    A chunk's summary is what follows the first colon of the first line that holds `[Chunk i]`, the whole line without a
    colon. A chunk without such a line keeps its text; one whose summary is empty or says that nothing is relevant goes.
    A null reply stands for a failed call and keeps all texts.
    """
    lines = F.split(response, "\n")

    def told(text: Column, i: Column) -> Column:
        marker = F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("]"))
        line = F.get(F.filter(lines, lambda x: F.contains(x, marker)), F.lit(0))
        at = F.instr(line, ":")
        summary = stripped(F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise(line))
        kept = summary.isNull() | ((summary != "") & ~irrelevant(summary))
        return F.struct((i + 1).cast("int").alias("chunk"), F.coalesce(summary, text).alias("text"), summary.isNotNull().alias("summarized"), kept.alias("kept"))

    rows = F.filter(F.transform(chunks, told), lambda x: x["kept"])
    return F.transform(rows, lambda x: F.struct(x["chunk"].alias("chunk"), x["text"].alias("text"), x["summarized"].alias("summarized")))
