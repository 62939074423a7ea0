"""Column functions over questions: intent, constraints, entities, keywords, rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark import values as V


def intent(question: Column) -> Column:
    """The first intent with a pattern that occurs anywhere in the lower-cased question."""
    low, out = F.lower(question), None
    for name, patterns in V.INTENTS:
        hit = low.rlike("|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(V.DEFAULT_INTENT)


def _year(question: Column, group: int) -> Column:
    found = F.regexp_extract(question, V.YEARS, group)
    return F.when(F.length(found) > 0, found.cast("int"))


def year_range(question: Column) -> tuple[Column, Column]:
    """First and last year asked for; a single year is both."""
    exact = _year(question, 4)
    return F.coalesce(_year(question, 1), exact), F.coalesce(_year(question, 2), _year(question, 3), exact)


def author(question: Column) -> Column:
    found = F.regexp_extract(question, V.AUTHOR, 1)
    return F.when(F.length(found) > 0, found)


def spotted(question: Column, patterns: tuple[str, ...] = V.QUERY_ENTITIES) -> Column:
    """Sorted distinct mentions, as written, of the patterns in any case; white space is that of Unicode."""
    hits = [F.regexp_extract_all(question, F.lit(f"(?iU)({p})"), F.lit(1)) for p in patterns]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*hits))))


def keywords(question: Column) -> Column:
    """Words of three or more ASCII letters without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\b([a-zA-Z]{3,})\b"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(V.KEYWORD_STOPWORDS))


def rewrite(question: Column) -> Column:
    """With the expansions of its acronyms and, where that changes it, the form without question words."""
    out = question
    for short, long in V.ACRONYM_EXPANSIONS:
        out = F.concat(out, F.when(question.rlike(rf"(?i)\b{short}\b"), F.lit(f" {long}")).otherwise(F.lit("")))
    low = F.lower(out)
    bare = low
    for prefix in V.QUESTION_PREFIXES:
        bare = F.regexp_replace(bare, f"(?i){prefix}", "")
    return F.when(bare != low, F.concat(out, F.lit(" "), bare)).otherwise(out)


def variations(question: Column) -> Column:
    """Distinct forms to search with: as asked, lower case, without question words, halves around a single and."""
    low = F.lower(question)
    bare = F.trim(F.regexp_replace(low, f"(?i){V.QUESTION_STRIP}", ""))
    halves = F.split(low, " and ")
    both = (F.size(halves) == 2) & (F.length(halves[0]) > 5) & (F.length(F.get(halves, F.lit(1))) > 5)
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.array(question, low),
            F.when((F.length(bare) > 10) & (bare != low), F.array(bare)).otherwise(none),
            F.when(both, halves).otherwise(none),
        )
    )


def synonym_variations(question: Column, synonyms=V.SYNONYMS) -> Column:
    """The question and, for each known term in it, one form for each synonym."""
    forms = [F.array(question)]
    for term, others in synonyms:
        has = F.contains(F.lower(question), F.lit(term.lower()))
        made = F.array(*[F.regexp_replace(question, rf"(?i)\b{term}\b", o) for o in others])
        forms.append(F.when(has, made).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*forms))
