"""The property graph as node, edge and mention tables: merging, traversal, search, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark import values as V
from loomspark.operators.term_index import LABELS, TermIndex
from loomspark.scratch import materialize


# --- merging ---


def _first_rows(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key by arrival; each task hands on no more than that."""
    w = Window.partitionBy(*keys).orderBy("arrival")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def merge_mentions(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows(document_id, entity, chunk_id, confidence, arrival) -> one edge each: chunk ids in order, best confidence.

    most bounds the rows whose chunk ids an edge names, the first ones; its confidence is that of all.
    """
    keys = ["document_id", "entity"]
    best = rows.groupBy(*keys).agg(F.max("confidence").alias("confidence"))
    chunks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "chunk_id"))), lambda x: x["chunk_id"]))
    if most is None:
        return rows.groupBy(*keys).agg(chunks.alias("chunk_ids"), F.max("confidence").alias("confidence"))
    kept = _first_rows(rows, keys, most).groupBy(*keys).agg(chunks.alias("chunk_ids"))
    same = [kept[c].eqNullSafe(best[c]) for c in keys]
    return kept.join(best, same).select(*(kept[c] for c in keys), kept["chunk_ids"], best["confidence"])


def merge_edges(rows: DataFrame, dedup_evidence: bool = False, most: int | None = None) -> DataFrame:
    """rows(source_id, target_id, relationship_type, confidence, evidence array, arrival) -> best confidence, all evidence.

    most bounds the rows whose evidence an edge keeps, the first ones; its confidence is that of all.
    """
    keys = ["source_id", "target_id", "relationship_type"]
    best = rows.groupBy(*keys).agg(F.max("confidence").alias("confidence"))
    evidence = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "evidence"))), lambda x: x["evidence"]))
    evidence = F.array_distinct(evidence) if dedup_evidence else evidence
    if most is None:
        return rows.groupBy(*keys).agg(F.max("confidence").alias("confidence"), evidence.alias("evidence"))
    kept = _first_rows(rows, keys, most).groupBy(*keys).agg(evidence.alias("evidence"))
    same = [kept[c].eqNullSafe(best[c]) for c in keys]
    return kept.join(best, same).select(*(kept[c] for c in keys), best["confidence"], kept["evidence"])


def merge_entity_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables(canonical_name, entity_type, entity_id, name, aliases) by key: the first id and name stay, new aliases go last."""
    keys = ["canonical_name", "entity_type"]
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("entity_id", "name", "aliases")))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in ("entity_id", "name", "aliases")))
    none = F.array().cast("array<string>")
    was, now = F.coalesce("o_aliases", none), F.coalesce("n_aliases", none)
    return o.join(n, keys, "full").select(*keys, F.coalesce("o_entity_id", "n_entity_id").alias("entity_id"), F.coalesce("o_name", "n_name").alias("name"), F.concat(F.array_except(was, now), now).alias("aliases"))


# --- traversal ---


def subgraph(edges: DataFrame, centers: DataFrame, depth: int = 2, min_confidence: float = 0.5, max_nodes: int = 100, edge_types: list[str] | None = None, nodes: DataFrame | None = None, node_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Undirected neighbourhoods of many centres at once: (center, node, hop) and (center, source, target, type, confidence).

    A breadth-first search by `depth` joins, each against the nodes found before; all edges are walked, but only those
    without confidence or with enough of it, and of edge_types where given, are returned, between returned nodes. The
    first max_nodes by (hop, node) of a centre stay, the centre among them; node_types keeps other nodes out of the
    result but lets paths run through them.

    As nodes count by hop, a centre that has max_nodes is done, and of a node's neighbours the 2 * max_nodes smallest
    are enough: at most max_nodes of them were found before. So a hub neither grows a hop nor has to be walked whole,
    unless node_types is given, where paths may run through any neighbour. Every hop is written to the shared folder.
    """
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edges.select("target_id", "source_id")).distinct()
    typed = node_types and nodes is not None
    if not typed:
        nearest = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        both = both.withColumn("r", nearest).where(F.col("r") <= 2 * max_nodes).select("a", "b")
    start = centers.select(F.col("center"), F.col("center").alias("node")).distinct()
    seen, front = start.withColumn("hop", F.lit(0)), start
    for hop in range(1, depth + 1):
        step = front.join(both, F.col("node") == F.col("a")).select("center", F.col("b").alias("node")).distinct()
        fresh = step.join(seen.select("center", "node"), ["center", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if not typed:
            held = seen.groupBy("center").agg(F.count("*").alias("n"))
            place = F.row_number().over(Window.partitionBy("center").orderBy("node"))
            fresh = fresh.withColumn("r", place).where(F.col("r") < max_nodes).join(held, "center").where(F.col("n") + F.col("r") <= max_nodes).select("center", "node", "hop")
        fresh = materialize(fresh, "hop")
        seen, front = seen.union(fresh), fresh.select("center", "node")
    if typed:
        listed = nodes.where(F.col("node_type").isin(list(node_types))).select(F.col("node_id").alias("node"))
        seen = seen.where("hop = 0").union(seen.where("hop > 0").join(listed, "node", "left_semi").select("center", "node", "hop"))
        w = Window.partitionBy("center").orderBy("hop", "node")
        seen = seen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_nodes).drop("n")
    strong = edges.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    if edge_types:
        strong = strong.where(F.col("relationship_type").isin(list(edge_types)))
    return seen, _edges_within(strong.select("source_id", "target_id", "relationship_type", "confidence"), seen, max_nodes)


def _edges_within(edges: DataFrame, kept: DataFrame, max_nodes: int) -> DataFrame:
    """(center, source_id, target_id, relationship_type, confidence) of the edges between kept(center, node) of a centre.

    Edges of nodes with few of them are joined with the nodes; those of hubs with the pairs of a hub and each other
    node of its centre, at most max_nodes of them, so no hub's edges are joined with all its centres.
    """
    hubs = edges.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") > max_nodes).select("source_id")
    ends, others = kept.select("center", F.col("node").alias("source_id")), kept.select("center", F.col("node").alias("target_id"))
    columns = ["center", "source_id", "target_id", "relationship_type", "confidence"]
    few = edges.join(hubs, "source_id", "left_anti").join(ends, "source_id").join(others, ["center", "target_id"]).select(*columns)
    many = ends.join(hubs, "source_id", "left_semi").join(others, "center").join(edges, ["source_id", "target_id"]).select(*columns)
    return few.union(many)


def shared_entities(mentions: DataFrame, seeds: DataFrame, min_shared: int = 2, limit: int | None = 20, exclude_seeds: bool = False, salts: int = 16) -> DataFrame:
    """mentions(document_id, entity) x seeds(seed) -> (seed, document_id, n_shared, entities): others sharing entities.

    Only the stated seeds' entities are joined with all mentions. exclude_seeds leaves out every seed document, else
    just the seed itself. The `limit` with most shared entities stay, ties by document.

    Documents that share min_shared entities share one besides the seed's min_shared - 1 most frequent ones, so these
    find no candidates; they are only looked up for documents found by the others. A frequent entity's documents are
    spread over `salts` keys. Names are gathered for the documents that stay.
    """
    pairs = mentions.select("document_id", "entity").distinct()
    asked = seeds.select("seed").distinct()
    own = pairs.join(asked, F.col("document_id") == F.col("seed"), "inner").select("seed", "entity")
    frequency = pairs.join(own.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("df"))
    ranked = own.join(frequency, "entity").withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("df"), "entity"))).select("seed", "entity", "r")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("document_id"), F.lit(salts)).cast("int"))
    rare = ranked.where(F.col("r") >= min_shared).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = rare.join(salted, ["entity", "salt"]).where(F.col("document_id") != F.col("seed"))
    if exclude_seeds:
        found = found.join(asked.select(F.col("seed").alias("document_id")), "document_id", "left_anti")
    counts = found.groupBy("seed", "document_id").agg(F.count("*").alias("n"))
    if min_shared > 1:
        usual = counts.join(ranked.where(F.col("r") < min_shared), "seed").join(pairs, ["document_id", "entity"], "left_semi")
        more = usual.groupBy("seed", "document_id").agg(F.count("*").alias("m"))
        counts = counts.join(more, ["seed", "document_id"], "left").select("seed", "document_id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
    counts = counts.where(F.col("n") >= min_shared)
    if limit is not None:
        w = Window.partitionBy("seed").orderBy(F.desc("n"), "document_id")
        counts = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")
    named = counts.join(own, "seed").join(pairs, ["document_id", "entity"], "left_semi")
    return named.groupBy("seed", "document_id").agg(F.max("n").alias("n_shared"), F.array_sort(F.collect_list("entity")).alias("entities"))


def similar_documents(mentions: DataFrame, seeds: DataFrame, limit: int = 10) -> DataFrame:
    """(seed, document_id, score, reason): a tenth a shared entity, the first three named."""
    found = shared_entities(mentions, seeds, 1, limit)
    reason = F.concat(F.lit("Shared entities: "), F.array_join(F.slice("entities", 1, 3), ", "))
    return found.select("seed", "document_id", (F.col("n_shared") / 10.0).alias("score"), reason.alias("reason"))


def expand_documents(mentions: DataFrame, seeds: DataFrame, entities: list[str] = (), most: int = 75, per_entity: int = 5) -> DataFrame:
    """(document_id, how): seeds, documents sharing two or more entities with them, and some that mention the given ones."""
    asked = seeds.select(F.col("seed").alias("document_id")).distinct()
    pairs = mentions.select("document_id", "entity").distinct()
    own = pairs.join(asked, "document_id", "left_semi")
    others = pairs.join(asked, "document_id", "left_anti")
    near = others.join(own.groupBy("entity").agg(F.count("*").alias("w")), "entity").groupBy("document_id").agg(F.sum("w").alias("n")).where("n >= 2")
    out = asked.withColumn("how", F.lit("seed")).union(near.orderBy(F.col("n").desc(), "document_id").limit(most).select("document_id", F.lit("shared")))
    for name in list(entities)[:3]:
        told = pairs.where(F.col("entity").rlike(f"(?i).*{name}.*")).select("document_id").distinct()
        out = out.union(told.join(out.select("document_id"), "document_id", "left_anti").orderBy("document_id").limit(per_entity).select("document_id", F.lit(f"entity:{name}")))
    return out


def entity_paths(mentions: DataFrame, edges: DataFrame, names: list[str], per_entity: int = 10, min_confidence: float = 0.5) -> DataFrame:
    """(asked, nodes, edge, confidence): one-step paths from mentioned entities whose name matches, strong edges only."""
    both = edges.select("source_id", "target_id", "relationship_type", "confidence").union(edges.select("target_id", "source_id", "relationship_type", "confidence"))
    both = both.where(F.col("confidence").isNull() | (F.col("confidence") > min_confidence))
    known = mentions.select("entity").distinct()
    out = None
    for name in names:
        hit = known.where(F.col("entity").rlike(f"(?i).*{name}.*"))
        found = hit.join(both, F.col("entity") == F.col("source_id")).select(F.lit(name).alias("asked"), F.array("entity", "target_id").alias("nodes"), F.col("relationship_type").alias("edge"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
        found = found.orderBy("nodes", "edge").limit(per_entity)
        out = found if out is None else out.union(found)
    return out


def citing(edges: DataFrame, documents: DataFrame, cited: DataFrame, limit: int = 20) -> DataFrame:
    """(cited, document_id, title, year): documents with a CITES edge to each cited one, newest first."""
    hits = edges.where("upper(relationship_type) = 'CITES'").join(cited.select("cited").distinct(), F.col("target_id") == F.col("cited")).select("cited", F.col("source_id").alias("document_id")).distinct()
    w = Window.partitionBy("cited").orderBy(F.col("year").desc_nulls_last(), "document_id")
    return hits.join(documents, "document_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("cited", "document_id", "title", "year")


# --- search and projections ---


def node_search(nodes: DataFrame, question: str, limit: int = 20, least: float = 0.1) -> DataFrame:
    """(node_id, label, score): share of the question's words that a label has, above `least`, best first."""
    words = sorted(set(question.lower().split()))
    own = F.split(F.lower("label"), r"[^\p{L}\p{N}]+")
    score = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words]))) / F.lit(float(max(1, len(words))))
    return nodes.select("node_id", "label", F.round(score, 6).alias("score")).where(F.col("score") > least).orderBy(F.col("score").desc(), "node_id").limit(limit)


def node_index(nodes: DataFrame, path: str) -> TermIndex:
    """A stored full-text index over nodes(node_id long, label, node_type); path must be new. More nodes are added by its add()."""
    return TermIndex(nodes.sparkSession, path, LABELS, "node_id", "label", ("label", "node_type")).add(nodes)


def indexed_node_search(index: TermIndex, questions: DataFrame, limit: int = 20, node_type: str | None = None, least: float = V.NODE_MIN) -> DataFrame:
    """(qid, node_id, label, score, rank) for questions(qid, text), as many as there are: the nodes of a type, where given, whose labels score above `least`.

    Scores are BM25 over the labels' words; a word counts as often as the question has it.
    """
    found = index.search(questions, limit, "qid", "text", None if node_type is None else F.col("node_type") == node_type, least)
    labels = index.documents().select(F.col("id").alias("node_id"), "label")
    return found.withColumnRenamed("id", "node_id").join(labels, "node_id").select("qid", "node_id", "label", "score", "rank")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): counts of nodes and edges by label, and both totals under the label all."""
    counted = lambda rows, kind, col: rows.rollup(col).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.coalesce(col, F.lit("all")).alias("label"), "n")
    return counted(nodes, "node", "node_type").union(counted(edges, "edge", "relationship_type"))


def project_nodes(nodes: DataFrame) -> DataFrame:
    """node_id, node_type and a label: name, else title, else the id's first eight characters."""
    key = F.coalesce("entity_id", "document_id")
    return nodes.select(key.alias("node_id"), F.when(F.col("document_id").isNotNull(), "article").otherwise("entity").alias("node_type"), F.coalesce("name", "title", F.substring(key, 1, 8)).alias("label"))


def project_edges(edges: DataFrame) -> DataFrame:
    """An id `source-TYPE-target` and a confidence, 1.0 where it is missing."""
    return edges.select(F.concat_ws("-", "source_id", F.upper("relationship_type"), "target_id").alias("edge_id"), "source_id", "target_id", "relationship_type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


EVIDENCE = "struct<chunk_id:string,document_id:string,char_start:int,char_end:int,snippet:string>"


def edge_evidence(edges: DataFrame, source: Column, target: Column, kind: Column) -> DataFrame:
    """Evidence items of one edge, read from JSON strings; items that don't parse or lack a chunk id go."""
    hit = edges.where((F.col("source_id") == source) & (F.col("target_id") == target) & (F.upper("relationship_type") == F.upper(kind)))
    items = hit.select(F.posexplode("evidence").alias("pos", "item")).select("pos", F.from_json("item", EVIDENCE).alias("e"))
    return items.where("e.chunk_id is not null").select("pos", "e.*")


def document_entities(entities: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Entities that the given documents mention, once each."""
    told = mentions.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return entities.join(told, "entity_id", "left_semi")


def client_filter(nodes: DataFrame, edges: DataFrame, entity_types: list[str], relation_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a viewer with these types switched on sees: articles, entities of a listed or no type, edges between them."""
    kind = F.col("entity_type")
    shown = nodes.where((F.col("node_type") == "article") | kind.isNull() | (kind == "") | kind.isin(list(entity_types)))
    shown = shown.where(F.length("node_id") > 0)
    ids = shown.select("node_id")
    lines = edges.where(F.lower("relationship_type").isin(list(relation_types)))
    lines = lines.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return shown, lines


def related_entities(edges: DataFrame, entities: DataFrame, min_confidence: float = 0.5, limit: int = 50, relationship_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The subgraph of depth 1 around each of entities(center): all neighbours, `limit` nodes with the centre, and the edges
    among them that are sure enough and of relationship_types, where given; columns as those of subgraph()."""
    return subgraph(edges, entities, 1, min_confidence, limit, relationship_types)
