"""Entity mentions, canonical names, co-occurrence relations and their normalisation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark import values as V

#: (pattern, entity type, confidence); patterns match in any case and inside words unless word_boundary asks otherwise.
DEFAULT_LEXICON = [(p, "scientific_concept", V.CONCEPT_CONFIDENCE) for p in V.CONCEPT_PATTERNS] + [(p, "mission", V.MISSION_CONFIDENCE) for p in V.MISSION_PATTERNS]

_HIT = T.ArrayType(T.StructType([T.StructField("pattern_idx", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]))


def mentions(chunks: DataFrame, lexicon: list[tuple[str, str, float]] = DEFAULT_LEXICON, chunk_id: str = "chunk_id", text: str = "text", min_chars: int = 0, word_boundary: bool = False) -> DataFrame:
    """(chunk_id, pattern_idx, name, char_start, char_end, entity_type, confidence), one row a match.

    Offsets of every match need a scan that built-ins lack, so an Arrow function returns the matches of a text as one
    array. Texts shorter than min_chars are skipped.
    """
    joined = [rf"\b(?:{p})\b" if word_boundary else p for p, _, _ in lexicon]

    @F.pandas_udf(_HIT)
    def find(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(p, re.IGNORECASE) for p in joined]
        return texts.map(lambda t: [{"pattern_idx": i, "name": m.group(), "char_start": m.start(), "char_end": m.end()} for i, c in enumerate(compiled) for m in c.finditer(t or "")])

    kinds = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.lit(float(c)).alias("confidence")) for _, t, c in lexicon])
    rows = chunks.where(F.length(text) >= min_chars).select(F.col(chunk_id).alias("chunk_id"), F.explode(find(text)).alias("m"))
    return rows.select("chunk_id", "m.*", kinds[F.col("m.pattern_idx")].alias("k")).select("chunk_id", "pattern_idx", "name", "char_start", "char_end", "k.*")


def canonical(name: Column, forms: dict[str, str] = V.CANONICAL_FORMS) -> Column:
    """Lower-cased trimmed name, an acronym by its long form."""
    low = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return F.coalesce(table[low], low)


def normal_type(label: Column, table: dict[str, str] = V.ENTITY_TYPE_SYNONYMS) -> Column:
    """The listed type of a label; null for unknown ones."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(label)]


def graph_labels(node: Column, edge: Column) -> tuple[Column, Column]:
    """Types of graph-transformer labels; null for unknown ones."""
    return normal_type(F.replace(node, F.lit(" "), F.lit("")), V.GRAPH_NODE_TYPES), normal_type(F.replace(edge, F.lit(" "), F.lit("_")), V.GRAPH_EDGE_TYPES)


def entity_records(found: DataFrame, min_confidence: float = V.ENTITY_MIN_CONFIDENCE, per_chunk: int = V.ENTITIES_PER_CHUNK) -> DataFrame:
    """found with canonical_name and arrival, without weak or untyped ones; the first per_chunk of a chunk stay."""
    rows = found.where((F.col("confidence") >= min_confidence) & F.col("entity_type").isNotNull())
    w = Window.partitionBy("chunk_id").orderBy("pattern_idx", "char_start")
    return rows.withColumn("arrival", F.row_number().over(w)).where(F.col("arrival") <= per_chunk).withColumn("canonical_name", canonical(F.col("name")))


def merge_entities(records: DataFrame, order: list[str] = ["chunk_id", "arrival"]) -> DataFrame:
    """One row for each (canonical_name, entity_type): first name, number of mentions, other spellings, best confidence."""
    key = F.struct(*order)
    names = F.array_sort(F.array_distinct(F.collect_set("name")))
    return records.groupBy("canonical_name", "entity_type").agg(
        F.min_by("name", key).alias("name"), F.count("*").alias("n_mentions"), names.alias("aliases"), F.max("confidence").alias("confidence")
    )


def co_occurrences(records: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", within: int = V.COOCCURRENCE_CHARS, per_chunk: int = V.RELATIONS_PER_CHUNK) -> DataFrame:
    """Ordered pairs of different entities, the second starting 0..within characters after the first ends.

    Mentions a chunk are capped by entity_records(), so the interval join stays small within a chunk. A chunk keeps
    its first per_chunk pairs by position. Type and snippet come from the text between and around the two.
    """
    side = lambda p: records.select("chunk_id", *(F.col(c).alias(f"{p}_{c}") for c in ("name", "canonical_name", "entity_type", "char_start", "char_end", "arrival")))
    gap = F.col("b_char_start") - F.col("a_char_end")
    pairs = side("a").join(side("b"), "chunk_id").where((gap >= 0) & (gap <= within) & (F.col("a_canonical_name") != F.col("b_canonical_name")))
    w = Window.partitionBy("chunk_id").orderBy("a_char_start", "a_arrival", "b_char_start", "b_arrival")
    pairs = pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_chunk)
    rows = pairs.join(chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(text).alias("__text")), "chunk_id")
    between = F.lower(F.substring("__text", F.col("a_char_end") + 1, gap))
    start = F.greatest(F.lit(0), F.col("a_char_start") - V.SNIPPET_MARGIN)
    snippet = F.substring("__text", start + 1, F.col("b_char_end") + V.SNIPPET_MARGIN - start)
    kind = relation_type(between, F.col("a_entity_type"), F.col("b_entity_type"))
    return rows.select("chunk_id", F.col("a_name").alias("source"), F.col("b_name").alias("target"), kind.alias("relationship_type"), F.lit(V.COOCCURRENCE_CONFIDENCE).alias("confidence"), F.col("a_char_start").alias("char_start"), F.col("b_char_end").alias("char_end"), snippet.alias("snippet"))


def relation_type(between: Column, first: Column, second: Column) -> Column:
    """By the words between two mentions, else by their types, else mentions."""
    out = F
    for words, only, kind in V.RELATION_CUES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(between, F.lit(w))
        out = out.when(hit if only is None else hit & (second == only), kind)
    return (
        out.when((first == "mission") & (second == "instrument"), "part_of")
        .when((first == "phenomenon") & (second == "phenomenon"), "related_to")
        .when(second == "author", "authored_by")
        .otherwise("mentions")
    )


def normal_relations(rows: DataFrame, min_confidence: float = V.RELATION_MIN_CONFIDENCE, snippet_chars: int = 500) -> DataFrame:
    """rows(label, confidence, snippet) with relationship_type; unknown labels and weak rows go, snippets are cut."""
    kind = normal_type(F.col("label"), V.RELATION_SYNONYMS)
    return rows.withColumn("relationship_type", kind).where(F.col("relationship_type").isNotNull() & (F.col("confidence") >= min_confidence)).withColumn("snippet", F.substring("snippet", 1, snippet_chars))


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations(source, target) with the ids of entities(name, entity_id) of the same lower-cased names; others go."""
    names = entities.select(F.lower("name").alias("k"), "entity_id").groupBy("k").agg(F.min("entity_id").alias("entity_id"))
    out = relations.join(names.select(F.col("k").alias("__s"), F.col("entity_id").alias("source_id")), F.lower("source") == F.col("__s"))
    return out.join(names.select(F.col("k").alias("__t"), F.col("entity_id").alias("target_id")), F.lower("target") == F.col("__t")).drop("__s", "__t")


def evidence_snippet(text: Column, source: Column, target: Column, before: int = 50, after: int = 100) -> Column:
    """The stretch around the first places of both names; null unless both occur."""
    low = F.lower(text)
    a, b = F.instr(low, F.lower(source)), F.instr(low, F.lower(target))
    start = F.greatest(F.lit(0), F.least(a, b) - 1 - before)
    end = F.least(F.length(text), F.greatest(a, b) - 1 + after)
    return F.when((a > 0) & (b > 0), F.trim(F.substring(text, start + 1, end - start)))


# --- answers of language models ---


def _items(reply: Column, field: str, schema: str) -> Column:
    """The array of items in a reply: an object's field, or a list; in other text what stands between its outer brackets."""
    items = f"array<{schema}>"
    found = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    whole = F.when(F.ltrim(reply).startswith("{"), F.from_json(F.get_json_object(reply, f"$.{field}"), items)).otherwise(F.from_json(reply, items))
    return F.when(F.try_parse_json(reply).isNotNull(), whole).otherwise(F.from_json(F.when(F.try_parse_json(found).isNotNull(), found), items))


def model_entities(replies: DataFrame, chunk_id: str = "chunk_id", reply: str = "reply", min_confidence: float = V.ENTITY_MIN_CONFIDENCE, per_chunk: int = V.ENTITIES_PER_CHUNK) -> DataFrame:
    """(chunk_id, arrival, name, canonical_name, entity_type, confidence, char_start, char_end) told by a model's replies.

    Unreadable replies give no rows; items of unknown type, weak ones and those whose numbers are none go. What an
    item lacks is filled in: confidence 0.8, offsets 0, the name as canonical name. The first per_chunk of a chunk stay.
    """
    schema = "struct<name:string,canonical_name:string,entity_type:string,confidence:string,char_start:string,char_end:string>"
    rows = replies.select(F.col(chunk_id).alias("chunk_id"), F.posexplode(_items(F.col(reply), "entities", schema)).alias("pos", "e")).select("chunk_id", "pos", "e.*")
    number = lambda c, kind, default: F.when(F.col(c).isNull(), F.lit(default)).otherwise(F.col(c).try_cast(kind)).cast(kind)
    name = F.coalesce("name", F.lit(""))
    typed = rows.select("chunk_id", "pos", name.alias("name"), F.lower(F.coalesce("canonical_name", name)).alias("canonical_name"), normal_type(F.coalesce("entity_type", F.lit(""))).alias("entity_type"), number("confidence", "double", 0.8).alias("confidence"), number("char_start", "int", 0).alias("char_start"), number("char_end", "int", 0).alias("char_end"))
    good = typed.where((F.col("confidence") >= min_confidence) & F.col("entity_type").isNotNull() & F.col("char_start").isNotNull() & F.col("char_end").isNotNull())
    w = Window.partitionBy("chunk_id").orderBy("pos")
    return good.withColumn("arrival", F.row_number().over(w)).where(F.col("arrival") <= per_chunk).select("chunk_id", "arrival", "name", "canonical_name", "entity_type", "confidence", "char_start", "char_end")


def model_relations(replies: DataFrame, chunk_id: str = "chunk_id", reply: str = "reply", per_chunk: int = V.RELATIONS_PER_CHUNK) -> DataFrame:
    """(chunk_id, source, target, relationship_type, confidence, snippet) told by a model's replies, as normal_relations() has them."""
    schema = "struct<source_entity:string,target_entity:string,relationship_type:string,confidence:string,evidence_snippet:string>"
    rows = replies.select(F.col(chunk_id).alias("chunk_id"), F.posexplode(_items(F.col(reply), "relationships", schema)).alias("pos", "e")).select("chunk_id", "pos", "e.*")
    confidence = F.when(F.col("confidence").isNull(), F.lit(0.7)).otherwise(F.col("confidence").try_cast("double"))
    told = rows.select("chunk_id", "pos", F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), F.col("relationship_type").alias("label"), confidence.alias("confidence"), F.coalesce("evidence_snippet", F.lit("")).alias("snippet"))
    good = normal_relations(told.where("source is not null and target is not null"))
    w = Window.partitionBy("chunk_id").orderBy("pos")
    return good.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_chunk).select("chunk_id", "source", "target", "relationship_type", "confidence", "snippet")


def chosen_chunks(chunks: DataFrame, asked: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """The chunks that a job names; all where it names none."""
    return chunks if asked.isEmpty() else chunks.join(asked.select(chunk_id).distinct(), chunk_id, "left_semi")


def extraction_job(chunks: DataFrame, lexicon: list[tuple[str, str, float]] = DEFAULT_LEXICON, document_id: str = "document_id", min_chars: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity records, relations, outcomes) of chunks(chunk_id, document_id, text).

    outcomes has one row a document: completed with its counts, failed where no chunk could be read. A chunk without
    text is counted as an error and spoils no other.
    """
    records = entity_records(mentions(chunks, lexicon, min_chars=min_chars))
    relations = co_occurrences(records, chunks)
    counts = lambda rows, name: rows.groupBy("chunk_id").agg(F.count("*").alias(name))
    each = chunks.select("chunk_id", document_id, F.col("text").isNull().alias("bad")).join(counts(records, "e"), "chunk_id", "left").join(counts(relations, "r"), "chunk_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = each.groupBy(document_id).agg(F.count("*").alias("n_chunks"), F.count_if("bad").alias("n_errors"), total("e").alias("n_entities"), total("r").alias("n_relations"))
    return records, relations, out.withColumn("status", F.when(F.col("n_errors") == F.col("n_chunks"), "failed").otherwise("completed"))
