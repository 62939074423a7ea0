"""Queries over extraction, graph, segmentation and source-parsing operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark import values as V
from loomspark.functions import text as X
from loomspark.operators import extract as E
from loomspark.operators import graph as G
from loomspark.operators import segment as S
from loomspark.plans.retrieval import read
from loomspark.scratch import fresh_path
from loomspark.sources import files

#: A lexicon that fits the synthetic corpus.
LEXICON = [("nttion", "phenomenon", 0.85), ("thintion", "phenomenon", 0.85), ("ingor", "mission", 0.9), ("outre", "instrument", 0.9), ("enlich", "method", 0.9), ("queque", "dataset", 0.65), ("sdo", "mission", 0.9)]
_s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))


def _chunks(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")


def entity_mentions(spark, d):
    return E.mentions(_chunks(spark, d), LEXICON, min_chars=50)


#: Every name of the default lexicon, and spaces that part its words.
NAMES = (
    "solar wind", "magnetic reconnection", "coronal mass ejection", "geomagnetic storm", "Solar Flare", "magnetosphere", "ionosphere", "heliosphere", "plasma sheet", "bow shock",
    "Parker Solar Probe", "Solar Orbiter", "SDO", "STEREO", "ace", "Wind spacecraft", "Voyager 2", "mms", "Van Allen Probes", "radiation belt",
)
GAPS = (" ", "  ", "\n", "\t\n ")


def default_mentions(spark, d):
    """Matches of the default lexicon in turns that hold every name of it, its words parted by each of GAPS."""
    pick = lambda k, items: F.element_at(F.array(*[F.lit(x) for x in items]), (k % len(items) + 1).cast("int"))
    k = F.col("conv_id") + 7 * F.col("turn")
    told = F.concat(pick(k, NAMES), F.lit(" and "), pick(F.col("conv_id"), NAMES), F.lit(" and "))
    rows = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.concat(F.replace(told, F.lit(" "), pick(F.col("conv_id"), GAPS)), "text").alias("text"))
    return E.mentions(rows)


def _records(spark, d):
    return E.entity_records(E.mentions(_chunks(spark, d), LEXICON, min_chars=50))


def entity_merge(spark, d):
    made = E.merge_entities(_records(spark, d))
    return made.select("canonical_name", "entity_type", "name", "n_mentions", F.array_join("aliases", "|").alias("aliases"), "confidence")


def entity_types(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("Concept", "technique", "DATA", "Satellite", "planet", "nonsense", "Person")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    node, edge = E.graph_labels(F.element_at(F.array(*[F.lit(x) for x in ("Celestial Body", "Sensor", "Moon", "Thing")]), (F.col("p_partkey") % 4 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in ("leads to", "Orbits", "uses", "likes")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    forms = F.element_at(F.array(*[F.lit(x) for x in (" CME ", "PSP", "kp", "Solar Wind")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", E.normal_type(label).alias("entity_type"), node.alias("node_type"), edge.alias("edge_type"), E.canonical(forms).alias("canonical"))


def cooccurrence_relations(spark, d):
    made = E.co_occurrences(_records(spark, d), _chunks(spark, d))
    return made.select("chunk_id", "source", "target", "relationship_type", "char_start", "char_end", F.md5("snippet").alias("snippet_md5"))


def relation_normalize(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("Cites", "leads_to", "MEASURES", "component_of", "hates")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), (F.col("l_quantity") / 50).alias("confidence"), F.repeat(F.col("l_returnflag"), 600).alias("snippet"))
    return E.normal_relations(rows).select("l_orderkey", "l_linenumber", "relationship_type", "confidence", F.length("snippet").alias("n"))


def relation_endpoints(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.upper("c_name").alias("source"), F.concat(F.lit("supplier#"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0")).alias("target"))
    names = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), _s("c", "c_custkey").alias("entity_id"))
    names = names.union(read(spark, d, "supplier").select("s_name", _s("s", "s_suppkey")))
    return E.resolve_endpoints(rows, names).select("c_custkey", "source_id", "target_id")


def evidence_snippets(spark, d):
    made = E.evidence_snippet(F.col("text"), F.lit("THE"), F.lit("tion"))
    return read(spark, d, "documents").select("doc_id", F.md5(made).alias("snippet_md5"))


def mention_merge(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("entity"), F.concat("l_linestatus", F.col("l_suppkey").cast("string")).alias("chunk_id"), F.col("l_discount").alias("confidence"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("arrival"))
    rows = rows.groupBy("document_id", "entity", "arrival").agg(F.min("chunk_id").alias("chunk_id"), F.max("confidence").alias("confidence"))
    return G.merge_mentions(rows).select("document_id", "entity", F.array_join("chunk_ids", ",").alias("chunk_ids"), "confidence")


def edge_merge(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relationship_type"), F.col("l_discount").alias("confidence"), F.array(F.col("l_orderkey")).alias("evidence"), F.struct("l_orderkey", "l_linenumber").alias("arrival"))
    return G.merge_edges(rows).select("source_id", "target_id", "relationship_type", "confidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


def entity_upsert(spark, d):
    part = read(spark, d, "part")
    old = part.where("p_partkey % 2 = 0").groupBy("p_name", "p_type").agg(F.min(_s("e", "p_partkey")).alias("entity_id"), F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    new = part.where("p_partkey % 3 = 0").groupBy("p_name", "p_type").agg(F.min(_s("n", "p_partkey")).alias("entity_id"), F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    shape = lambda t: t.select(F.col("p_name").alias("canonical_name"), F.col("p_type").alias("entity_type"), "entity_id", F.upper("p_name").alias("name"), "aliases")
    return G.merge_entity_tables(shape(old), shape(new)).withColumn("aliases", F.array_join("aliases", ","))


def _graph(spark, d):
    c, n, o, r = (read(spark, d, t) for t in ("customer", "nation", "orders", "region"))
    nodes = c.select(_s("c", "c_custkey").alias("node_id"), F.lit("customer").alias("node_type")).union(n.select(_s("n", "n_nationkey"), F.lit("nation"))).union(r.select(_s("r", "r_regionkey"), F.lit("region"))).union(o.select(_s("o", "o_orderkey"), F.lit("order")))
    none = F.lit(None).cast("double")
    edges = c.select(_s("c", "c_custkey").alias("source_id"), _s("n", "c_nationkey").alias("target_id"), F.lit("located_in").alias("relationship_type"), none.alias("confidence"))
    edges = edges.union(n.select(_s("n", "n_nationkey"), _s("r", "n_regionkey"), F.lit("part_of"), F.lit(0.9)))
    return nodes, edges.union(o.select(_s("o", "o_orderkey"), _s("c", "o_custkey"), F.lit("placed_by"), (F.col("o_orderkey") % 10) / 10.0))


def _sub(spark, d):
    nodes, edges = _graph(spark, d)
    centers = read(spark, d, "customer").where("c_custkey % 100 = 0").select(_s("c", "c_custkey").alias("center"))
    return G.subgraph(edges, centers, 2, 0.5, 100)


def khop_nodes(spark, d):
    return _sub(spark, d)[0]


def khop_edges(spark, d):
    return _sub(spark, d)[1]


def graph_stats(spark, d):
    return G.statistics(*_graph(spark, d))


def graph_projection(spark, d):
    nodes, edges = _graph(spark, d)
    shown, lines = G.client_filter(nodes.select("node_id", F.when(F.col("node_type") == "order", "article").otherwise("entity").alias("node_type"), F.when(F.col("node_type") != "order", F.col("node_type")).alias("entity_type")), edges, ["customer", "nation"], ["placed_by", "located_in", "part_of"])
    ends = G.project_edges(lines)
    return ends.groupBy("relationship_type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"), F.min("edge_id").alias("first_edge")).crossJoin(shown.agg(F.count("*").alias("n_nodes")))


def node_projection(spark, d):
    part = read(spark, d, "part")
    rows = part.select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("entity-"), F.md5(F.col("p_partkey").cast("string")))).alias("entity_id"), F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("doc-"), F.md5(F.col("p_partkey").cast("string")))).alias("document_id"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_type")).alias("title"),
    )
    return G.project_nodes(rows)


def node_search(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("label"))
    return G.node_search(nodes, "Small red widget", 50)


def node_index_search(spark, d):
    """Names of every hundredth part, asked of the names of all; and of one maker's."""
    part = read(spark, d, "part")
    index = G.node_index(part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("label"), F.col("p_brand").alias("node_type")), fresh_path(spark, "node-index"))
    asked = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text"))
    made = lambda name, kind: G.indexed_node_search(index, asked, 20, kind).withColumn("kind", F.lit(name))
    return made("any", None).union(made("one", "Brand#13"))


def edge_evidence(spark, d):
    item = F.to_json(F.struct(F.when(F.col("l_linenumber") < 6, _s("k", "l_orderkey")).alias("chunk_id"), _s("d", "l_partkey").alias("document_id"), F.col("l_linenumber").alias("char_start"), (F.col("l_linenumber") + 5).alias("char_end"), F.col("l_returnflag").alias("snippet")))
    rows = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("target_id")).agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    edges = rows.select(F.lit("all").alias("source_id"), "target_id", F.lit("cites").alias("relationship_type"), F.concat("evidence", F.array(F.lit("{broken"))).alias("evidence"))
    return G.edge_evidence(edges, F.lit("all"), F.lit(1), F.lit("CITES")).select("chunk_id", "document_id", "char_start", "char_end", "snippet")


def _mentions(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("entity"))


def _seeds(spark, d):
    return read(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("seed"))


def shared_entities(spark, d):
    made = G.shared_entities(_mentions(spark, d), _seeds(spark, d), 2, 20)
    return made.select("seed", "document_id", "n_shared", F.array_join(F.transform("entities", lambda x: x.cast("string")), ",").alias("entities"))


def similar_docs(spark, d):
    m = _mentions(spark, d).withColumn("entity", F.col("entity").cast("string"))
    return G.similar_documents(m, _seeds(spark, d))


def document_expansion(spark, d):
    m = _mentions(spark, d).withColumn("entity", _s("part-", "entity"))
    return G.expand_documents(m, _seeds(spark, d), ["part-7", "part-19"])


def entity_paths(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("m"))
    edges = rows.select(_s("p", "l_partkey").alias("source_id"), _s("s", "l_suppkey").alias("target_id"), F.lit("supplied_by").alias("relationship_type"), F.when(F.col("l_suppkey") % 5 > 0, F.col("m") * 10).alias("confidence"))
    made = G.entity_paths(rows.select(_s("p", "l_partkey").alias("entity")), edges, ["p77", "p19"])
    return made.select("asked", F.array_join("nodes", ">").alias("path"), "edge", F.round("confidence", 6).alias("confidence"))


def citing_docs(spark, d):
    o = read(spark, d, "orders")
    edges = o.select(_s("o", "o_orderkey").alias("source_id"), _s("c", "o_custkey").alias("target_id"), F.lit("CITES").alias("relationship_type"))
    papers = o.select(_s("o", "o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"))
    return G.citing(edges, papers, read(spark, d, "customer").select(_s("c", "c_custkey").alias("cited")))


def _sections(spark, d):
    return S.segment_text(read(spark, d, "documents"), "doc_id", "text")


def section_segment(spark, d):
    return _sections(spark, d).select(F.col("id").alias("doc_id"), "section_no", "section_type", "title", F.md5("text").alias("text_md5"), "char_offset_start", "char_offset_end")


def structure_map(spark, d):
    made = S.structure_map(_sections(spark, d))
    return made.select(F.col("id").alias("doc_id"), F.get_json_object("structure", "$.total_sections").cast("long").alias("n"), F.get_json_object("structure", "$.section_types").alias("kinds"))


def section_lookup(spark, d):
    points = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("n_chars") / 2).cast("int").alias("offset"))
    return S.section_at(_sections(spark, d), points).select(F.col("id").alias("doc_id"), "offset", "section_type")


def chunk_estimate(spark, d):
    return S.estimated_chunks(_sections(spark, d)).select(F.col("id").alias("doc_id"), "n")


def chunk_documents(spark, d):
    return S.chunk_sections(_sections(spark, d)).withColumnRenamed("id", "doc_id")


def merged_sections(spark, d):
    rows = _sections(spark, d)
    listed = F.array_sort(F.collect_list(F.struct("section_no", "section_type", "title", "text", "char_offset_start", "char_offset_end")))
    arrays = rows.groupBy("id").agg(F.transform(listed, lambda s: F.struct(*(s[c].alias(c) for c in ("section_type", "title", "text", "char_offset_start", "char_offset_end")))).alias("s"))
    return arrays.select(F.col("id").alias("doc_id"), F.posexplode(S.merge_short(S.enhance(F.col("s")))).alias("n", "m")).select("doc_id", "n", "m.section_type", "m.title", F.md5("m.text").alias("text_md5"), "m.char_offset_start", "m.char_offset_end")


def sentence_split(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"), F.size(X.white_tokens(F.col("text"))).alias("n_tokens"), F.md5(X.overlap_tail(F.col("text"), V.CHUNK_OVERLAP)).alias("tail_md5"), X.token_count(F.col("text")).alias("tokens"))


def html_extract(spark, d):
    return read(spark, d, "pages").select("page_id", files.html_title(F.col("html")).alias("title"), F.md5(files.html_text(F.col("html"))).alias("text_md5"))


def html_sections(spark, d):
    return files.html_sections(read(spark, d, "pages")).select(F.col("id").alias("page_id"), "section_no", "title", "section_type", F.md5("text").alias("text_md5"))


def layout_sections(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("text", "section_header", "list_item", "footnote", "page_footer")]), (F.col("turn") % 5 + 1).cast("int"))
    items = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("no"), label.alias("label"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return files.layout_sections(items).select(F.col("id").alias("conv_id"), "section_no", "section_type", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"), "char_offset_start", "char_offset_end")


def tei_parse(spark, d):
    e = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tei = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>'), F.col("source"), F.lit("</title></titleStmt><abstract>"), e(F.col("lang")), F.lit("</abstract></teiHeader><text><body><div><head>Methods</head><p>"),
        e(F.col("source")), F.lit("</p></div></body><back><div type='references'><listBibl><biblStruct><analytic><title level='a'>T</title><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author></analytic><date when='2020-01'/></biblStruct></listBibl></div></back></text>"), F.when(F.col("doc_id") % 10 > 0, F.lit("</TEI>")).otherwise(F.lit("")),
    )
    made = files.parse_tei(read(spark, d, "documents").select("doc_id", tei.alias("tei")), "doc_id", "tei")
    first = F.element_at("references", 1)
    return made.select(F.col("id").alias("doc_id"), "full_text", F.array_join(F.transform("sections", lambda s: s["section_type"]), ",").alias("kinds"), "title", F.when(F.size("references") > 0, first["year"]).alias("year"), F.when(F.size("references") > 0, F.array_join(first["authors"], ";")).alias("authors"), F.col("error").isNotNull().alias("broken"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_mentions, default_mentions, entity_merge, entity_types, cooccurrence_relations, relation_normalize, relation_endpoints, evidence_snippets, mention_merge, edge_merge, entity_upsert, khop_nodes, khop_edges, graph_stats, graph_projection,
        node_projection, node_search, node_index_search, edge_evidence, shared_entities, similar_docs, document_expansion, entity_paths, citing_docs, section_segment, structure_map, section_lookup, chunk_estimate, chunk_documents, merged_sections,
        sentence_split, html_extract, html_sections, layout_sections, tei_parse,
    )
}

_LEX = ", ".join(f"({i}, '{p}', '{t}', {c}::DOUBLE)" for i, (p, t, c) in enumerate(LEXICON))
_FOUND = f"""lex(pattern_idx, pat, entity_type, confidence) AS (VALUES {_LEX}),
parts AS (SELECT doc_id, text, lex.*, string_split(lower(text), pat) AS p FROM documents, lex WHERE length(text) >= 50 AND contains(lower(text), pat)),
occ AS (SELECT *, unnest(range(1, len(p))) AS i FROM parts),
found AS (SELECT doc_id AS chunk_id, pattern_idx, substr(text, s + 1, length(pat)) AS name, s AS char_start, s + length(pat) AS char_end, entity_type, confidence
 FROM (SELECT *, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(pat))::INT AS s FROM occ))"""
_REC = f"""{_FOUND},
rec AS (SELECT *, CASE lower(name) WHEN 'sdo' THEN 'solar dynamics observatory' ELSE lower(name) END AS canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pattern_idx, char_start) AS arrival FROM found WHERE confidence >= 0.7) WHERE arrival <= 20)"""
_GRAPH = """nodes AS (SELECT 'c' || c_custkey AS node_id, 'customer' AS node_type FROM customer UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region UNION ALL SELECT 'o' || o_orderkey, 'order' FROM orders),
edges AS (SELECT 'c' || c_custkey AS source_id, 'n' || c_nationkey AS target_id, 'located_in' AS relationship_type, NULL::DOUBLE AS confidence FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 0.9::DOUBLE FROM nation
 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'placed_by', (o_orderkey % 10) / 10.0::DOUBLE FROM orders)"""
_KHOP = f"""{_GRAPH},
b AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
h0 AS (SELECT 'c' || c_custkey AS center, 'c' || c_custkey AS node FROM customer WHERE c_custkey % 100 = 0),
h1 AS (SELECT DISTINCT center, b.b AS node FROM h0 JOIN b ON node = b.a),
h2 AS (SELECT DISTINCT center, b.b AS node FROM h1 JOIN b ON node = b.a),
seen AS (SELECT center, node, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY center, node),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY hop, node) AS n FROM seen) WHERE n <= 100)"""
_M = "m AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS e FROM lineitem), s AS (SELECT o_orderkey AS seed FROM orders WHERE o_orderkey % 100 = 0)"
_PAIRS = f"{_M}, own AS (SELECT seed, e FROM m JOIN s ON d = seed), f AS (SELECT seed, m.d AS document_id, count(*) AS n_shared, string_agg(e::VARCHAR, ',' ORDER BY e) AS entities, list_sort(list(e::VARCHAR)) AS l FROM own JOIN m USING (e) WHERE m.d <> seed GROUP BY seed, m.d)"
_BODY = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
# The patterns and words below are written out again, apart from those that the queries use.
_TERMS = (
    (r"solar\s+wind", "scientific_concept", 0.85), (r"magnetic\s+reconnection", "scientific_concept", 0.85), (r"coronal\s+mass\s+ejection", "scientific_concept", 0.85), (r"geomagnetic\s+storm", "scientific_concept", 0.85),
    (r"solar\s+flare", "scientific_concept", 0.85), ("magnetosphere", "scientific_concept", 0.85), ("ionosphere", "scientific_concept", 0.85), ("heliosphere", "scientific_concept", 0.85), (r"plasma\s+sheet", "scientific_concept", 0.85),
    (r"bow\s+shock", "scientific_concept", 0.85), (r"Parker\s+Solar\s+Probe", "mission", 0.9), (r"Solar\s+Orbiter", "mission", 0.9), ("SDO", "mission", 0.9), ("STEREO", "mission", 0.9), ("ACE", "mission", 0.9),
    (r"Wind\s+spacecraft", "mission", 0.9), (r"Voyager\s+[0-9]", "mission", 0.9), ("MMS", "mission", 0.9), (r"Van\s+Allen\s+Probes", "mission", 0.9),
)
_EACH = " UNION ALL ".join(f"SELECT chunk_id, {i} AS pattern_idx, string_split_regex(text, '(?i){p}') AS p, regexp_extract_all(text, '(?i){p}') AS m, '{t}' AS entity_type, {c}::DOUBLE AS confidence FROM c" for i, (p, t, c) in enumerate(_TERMS))
_KINDS = (
    ("abstract", "abstract|summary|synopsis"),
    ("introduction", "introduction|background|motivation|overview"),
    ("methods", "method|methodology|approach|procedure|material|data|observation|instrument|experimental|technique|implementation"),
    ("results", "result|finding|outcome|analysis|measurement|observation"),
    ("discussion", "discussion|interpretation|implication"),
    ("conclusion", "conclusion|concluding|summary|future work"),
    ("references", "reference|bibliography|citation"),
    ("acknowledgments", "acknowledgment|acknowledgement|thank"),
    ("appendix", "appendix|supplement|supporting information"),
)
_CASES = " ".join(f"WHEN regexp_matches(t, '{words}') THEN '{k}'" for k, words in _KINDS)
_SEG = rf"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
l1 AS (SELECT *, {_BODY} AS body FROM l0),
l2 AS (SELECT *, CASE WHEN length(body) BETWEEN 1 AND 100 THEN CASE WHEN regexp_matches(body, '(?i)^(\d+\.?\d*\.?)\s+(.+)$') THEN regexp_extract(body, '(?i)^(\d+\.?\d*\.?)\s+(.+)$', 2)
 WHEN regexp_matches(body, '(?i)^([IVX]+\.?)\s+(.+)$') THEN regexp_extract(body, '(?i)^([IVX]+\.?)\s+(.+)$', 2) WHEN regexp_matches(body, '(?i)^([A-Z][A-Z\s]{{3,}})$') THEN body WHEN upper(body) = body AND lower(body) <> body AND length(body) > 3 THEN body END END AS header FROM l1),
l3 AS (SELECT *, count(header) OVER (PARTITION BY doc_id ORDER BY no) AS section, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) AS past FROM l2),
p AS (SELECT doc_id, section, lower(max(header)) AS t, string_agg(body, chr(10) ORDER BY no) FILTER (header IS NULL AND length(body) > 0) AS text, max(past) AS e FROM l3 GROUP BY doc_id, section),
q AS (SELECT doc_id, section, text, e, CASE WHEN section = 0 THEN 'other' {_CASES} ELSE 'other' END AS section_type FROM p WHERE length(text) > 0),
sec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS section_no, section_type, CASE WHEN section > 0 THEN section_type END AS title, text, (e - length(text) - 1)::INT AS char_offset_start, (e - 1)::INT AS char_offset_end FROM q
 UNION ALL SELECT doc_id, 1, 'other', NULL, text, 0, length(text)::INT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM q))"""


def _no_tags(html: str) -> str:
    for tag in ("script", "style", "nav", "head", "noscript", "template"):
        html = rf"regexp_replace({html}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    return f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"


def _plain(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in files.ENTITIES:
        out = f"replace({out}, '{a}', {chr(39)}{b.replace(chr(39), chr(39) * 2)}{chr(39)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


ORACLES = {
    "entity_mentions": f"WITH {_FOUND} SELECT * FROM found",
    "default_mentions": f"""WITH n AS (SELECT *, [{", ".join(f"'{x}'" for x in NAMES)}] AS n, [' ', '  ', chr(10), chr(9) || chr(10) || ' '][conv_id % 4 + 1] AS gap FROM conversations),
c AS (SELECT conv_id || '-' || turn AS chunk_id, replace(n[(conv_id + 7 * turn) % {len(NAMES)} + 1] || ' and ' || n[conv_id % {len(NAMES)} + 1] || ' and ', ' ', gap) || text AS text FROM n),
f AS ({_EACH}), o AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT *, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS a FROM o)
SELECT chunk_id, pattern_idx, m[i] AS name, a AS char_start, a + length(m[i])::INT AS char_end, entity_type, confidence FROM s""",
    "entity_merge": f"WITH {_REC} SELECT canonical_name, entity_type, arg_min(name, chunk_id * 100 + arrival) AS name, count(*) AS n_mentions, array_to_string(list_sort(list(DISTINCT name)), '|') AS aliases, max(confidence) AS confidence FROM rec GROUP BY canonical_name, entity_type",
    "entity_types": """SELECT p_partkey, ['scientific_concept', 'method', 'dataset', 'spacecraft', 'celestial_body', NULL, 'author'][p_partkey % 7 + 1] AS entity_type, ['celestial_body', 'instrument', 'celestial_body', NULL][p_partkey % 4 + 1] AS node_type,
['causes', 'related_to', 'uses_instrument', NULL][p_partkey % 4 + 1] AS edge_type, ['coronal mass ejection', 'parker solar probe', 'kp index', 'solar wind'][p_partkey % 4 + 1] AS canonical FROM part""",
    "cooccurrence_relations": f"""WITH {_REC},
pr AS (SELECT a.chunk_id, a.name AS source, b.name AS target, a.char_start, b.char_end, a.char_end AS ae, b.char_start AS bs, a.entity_type AS t1, b.entity_type AS t2, row_number() OVER (PARTITION BY a.chunk_id ORDER BY a.char_start, a.arrival, b.char_start, b.arrival) AS n
 FROM rec a JOIN rec b ON a.chunk_id = b.chunk_id AND b.char_start - a.char_end BETWEEN 0 AND 200 AND a.canonical_name <> b.canonical_name),
x AS (SELECT pr.*, text, lower(substr(text, ae + 1, bs - ae)) AS btw, greatest(0, char_start - 20) AS s FROM pr JOIN documents ON doc_id = chunk_id WHERE n <= 30)
SELECT chunk_id, source, target, CASE WHEN contains(btw, 'causes') OR contains(btw, 'caused by') OR contains(btw, 'results in') THEN 'causes' WHEN contains(btw, 'observes') OR contains(btw, 'observed') OR contains(btw, 'detected') THEN 'observes'
 WHEN (contains(btw, 'using') OR contains(btw, 'used') OR contains(btw, 'employed')) AND t2 IN ('method', 'instrument', 'dataset') THEN 'uses_' || t2 WHEN contains(btw, 'part of') OR contains(btw, 'component') THEN 'part_of'
 WHEN contains(btw, 'studies') OR contains(btw, 'studied') OR contains(btw, 'investigates') THEN 'studies' WHEN t1 = 'mission' AND t2 = 'instrument' THEN 'part_of' WHEN t1 = 'phenomenon' AND t2 = 'phenomenon' THEN 'related_to' ELSE 'mentions' END AS relationship_type,
 char_start, char_end, md5(substr(text, s + 1, char_end + 20 - s)) AS snippet_md5 FROM x""",
    "relation_normalize": "SELECT l_orderkey, l_linenumber, ['cites', 'causes', 'observes', 'part_of'][l_partkey % 5 + 1] AS relationship_type, l_quantity / 50 AS confidence, 500::INT AS n FROM lineitem WHERE l_partkey % 5 < 4 AND l_quantity / 50 >= 0.6",
    "relation_endpoints": "SELECT c_custkey, 'c' || c_custkey AS source_id, 's' || s_suppkey AS target_id FROM customer JOIN supplier ON s_suppkey = c_nationkey WHERE c_custkey % 2 = 0",
    "evidence_snippets": """WITH p AS (SELECT doc_id, text, strpos(lower(text), 'the') AS a, strpos(lower(text), 'tion') AS b FROM documents), q AS (SELECT *, greatest(0, least(a, b) - 51) AS s, least(length(text), greatest(a, b) + 99) AS e FROM p)
SELECT doc_id, CASE WHEN a > 0 AND b > 0 THEN md5(trim(substr(text, s + 1, e - s))) END AS snippet_md5 FROM q""",
    "node_index_search": r"""WITH t AS (SELECT p_partkey AS id, p_name AS label, p_brand AS b, list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM part),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t), tf AS (SELECT id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT id, unnest(w) AS term, len(w) AS dl FROM t) GROUP BY ALL),
df AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, size GROUP BY term, n),
wt AS (SELECT id, term, idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tf JOIN df USING (term), size),
q AS (SELECT qid, term, count(*) AS qn FROM (SELECT id AS qid, unnest(w) AS term FROM t WHERE id % 100 = 0) GROUP BY ALL),
sc AS (SELECT qid, id, round(sum(qn * weight), 6) AS score FROM q JOIN wt USING (term) GROUP BY ALL HAVING score > 0.1),
k AS (SELECT 'any' AS kind, sc.*, label FROM sc JOIN t USING (id) UNION ALL SELECT 'one', sc.*, label FROM sc JOIN t USING (id) WHERE b = 'Brand#13')
SELECT kind, qid, id AS node_id, label, score, row_number() OVER (PARTITION BY kind, qid ORDER BY score DESC, id) AS rank FROM k QUALIFY rank <= 20""",
    "mention_merge": """WITH r AS (SELECT l_orderkey AS document_id, l_returnflag AS entity, l_orderkey * 1000 + l_linenumber * 100 + l_quantity AS arrival, min(l_linestatus || l_suppkey) AS chunk_id, max(l_discount) AS confidence FROM lineitem GROUP BY ALL),
f AS (SELECT document_id, entity, chunk_id, min(arrival) AS arrival, max(confidence) AS confidence FROM r GROUP BY ALL)
SELECT document_id, entity, string_agg(chunk_id, ',' ORDER BY arrival) AS chunk_ids, max(confidence) AS confidence FROM f GROUP BY document_id, entity""",
    "edge_merge": "SELECT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS relationship_type, max(l_discount) AS confidence, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber) AS evidence FROM lineitem GROUP BY ALL",
    "entity_upsert": """WITH o AS (SELECT p_name, p_type, min('e' || p_partkey) AS i, list_sort(list(DISTINCT p_brand)) AS al FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), n AS (SELECT p_name, p_type, min('n' || p_partkey) AS i, list_sort(list(DISTINCT p_brand)) AS al FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
SELECT p_name AS canonical_name, p_type AS entity_type, coalesce(o.i, n.i) AS entity_id, upper(p_name) AS name, array_to_string(list_concat(list_filter(coalesce(o.al, []), lambda x: NOT list_contains(coalesce(n.al, []), x)), coalesce(n.al, [])), ',') AS aliases FROM o FULL JOIN n USING (p_name, p_type)""",
    "khop_nodes": f"WITH {_KHOP} SELECT center, node, hop FROM kept",
    "khop_edges": f"WITH {_KHOP} SELECT k.center, source_id, target_id, relationship_type, confidence FROM edges JOIN kept k ON k.node = source_id JOIN kept l ON l.node = target_id AND l.center = k.center WHERE confidence IS NULL OR confidence >= 0.5",
    "graph_stats": f"""WITH {_GRAPH} SELECT 'node' AS kind, coalesce(node_type, 'all') AS label, count(*) AS n FROM nodes GROUP BY ROLLUP (node_type) UNION ALL SELECT 'edge', coalesce(relationship_type, 'all'), count(*) FROM edges GROUP BY ROLLUP (relationship_type)""",
    "graph_projection": f"""WITH {_GRAPH}, ok AS (SELECT node_id FROM nodes WHERE node_type IN ('order', 'customer', 'nation'))
SELECT relationship_type, count(*) AS n, round(sum(coalesce(confidence, 1.0)), 4) AS confidence, min(source_id || '-' || upper(relationship_type) || '-' || target_id) AS first_edge, (SELECT count(*) FROM ok) AS n_nodes
FROM edges WHERE source_id IN (SELECT node_id FROM ok) AND target_id IN (SELECT node_id FROM ok) GROUP BY relationship_type""",
    "node_projection": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'entity-' ELSE 'doc-' END || md5(p_partkey::VARCHAR) AS id, p_name, p_type FROM part)
SELECT id AS node_id, CASE WHEN p_partkey % 2 = 1 THEN 'article' ELSE 'entity' END AS node_type, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE substr(id, 1, 8) END AS label FROM p""",
    "node_search": r"""WITH s AS (SELECT p_partkey AS node_id, p_name AS label, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+')), ['red', 'small', 'widget'])) / 3.0::DOUBLE, 6) AS score FROM part)
SELECT * FROM s WHERE score > 0.1 ORDER BY score DESC, node_id LIMIT 50""",
    "edge_evidence": "SELECT 'k' || l_orderkey AS chunk_id, 'd' || l_partkey AS document_id, l_linenumber AS char_start, l_linenumber + 5 AS char_end, l_returnflag AS snippet FROM lineitem WHERE l_suppkey = 1 AND l_linenumber < 6",
    "shared_entities": f"WITH {_PAIRS} SELECT seed, document_id, n_shared, entities FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n_shared DESC, document_id) AS r FROM f WHERE n_shared >= 2) WHERE r <= 20",
    "similar_docs": f"WITH {_PAIRS} SELECT seed, document_id, n_shared / 10.0::DOUBLE AS score, 'Shared entities: ' || array_to_string(l[1:3], ', ') AS reason FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n_shared DESC, document_id) AS r FROM f) WHERE r <= 10",
    "document_expansion": f"""WITH {_M}, w AS (SELECT e, count(*) AS w FROM m JOIN s ON d = seed GROUP BY e),
near AS (SELECT d FROM m JOIN w USING (e) WHERE d NOT IN (SELECT seed FROM s) GROUP BY d HAVING sum(w) >= 2 ORDER BY sum(w) DESC, d LIMIT 75),
o1 AS (SELECT DISTINCT d AS document_id, 'seed' AS how FROM m JOIN s ON d = seed UNION SELECT seed, 'seed' FROM s UNION ALL SELECT d, 'shared' FROM near),
o2 AS (SELECT DISTINCT d AS document_id, 'entity:part-7' AS how FROM m WHERE contains('part-' || e, 'part-7') AND d NOT IN (SELECT document_id FROM o1) ORDER BY d LIMIT 5),
o3 AS (SELECT DISTINCT d AS document_id, 'entity:part-19' AS how FROM m WHERE contains('part-' || e, 'part-19') AND d NOT IN (SELECT document_id FROM o1 UNION ALL SELECT document_id FROM o2) ORDER BY d LIMIT 5)
SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3""",
    "entity_paths": """WITH e AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s, CASE WHEN l_suppkey % 5 > 0 THEN max(l_discount) * 10 END AS c FROM lineitem GROUP BY l_partkey, l_suppkey),
f AS (SELECT a AS asked, p, s, coalesce(c, 1.0) AS c, row_number() OVER (PARTITION BY a ORDER BY p, s) AS r FROM e, (VALUES ('p77'), ('p19')) t(a) WHERE contains(p, a) AND (c IS NULL OR c > 0.5))
SELECT asked, p || '>' || s AS path, 'supplied_by' AS edge, round(c, 6) AS confidence FROM f WHERE r <= 10""",
    "citing_docs": """SELECT cited, document_id, title, year FROM (SELECT 'c' || o_custkey AS cited, 'o' || o_orderkey AS document_id, o_orderpriority AS title, year(o_orderdate)::INT AS year, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, 'o' || o_orderkey) AS r
FROM orders JOIN customer ON c_custkey = o_custkey) WHERE r <= 20""",
    "section_segment": f"WITH {_SEG} SELECT doc_id, section_no, section_type, title, md5(text) AS text_md5, char_offset_start, char_offset_end FROM sec",
    "structure_map": f"""WITH {_SEG} SELECT doc_id, count(*) AS n, '["' || array_to_string(list_sort(list(DISTINCT section_type)), '","') || '"]' AS kinds FROM sec GROUP BY doc_id""",
    "section_lookup": f"WITH {_SEG} SELECT d.doc_id, (n_chars // 2)::INT AS \"offset\", arg_min(section_type, section_no) AS section_type FROM documents d LEFT JOIN sec s ON s.doc_id = d.doc_id AND n_chars // 2 >= char_offset_start AND n_chars // 2 < char_offset_end GROUP BY d.doc_id, n_chars",
    "chunk_estimate": rf"WITH {_SEG} SELECT doc_id, greatest(1, sum(CASE WHEN section_type <> 'references' THEN len(regexp_extract_all(text, '\S+')) ELSE 0 END) // 412)::BIGINT AS n FROM sec GROUP BY doc_id",
    "merged_sections": f"""WITH RECURSIVE {_SEG},
f AS (SELECT doc_id, 1::BIGINT AS i, 0 AS grp, section_type, title, text, char_offset_start AS a, char_offset_end AS b FROM sec WHERE section_no = 1
 UNION ALL SELECT s.doc_id, s.section_no, grp + (length(f.text) >= 100)::INT, s.section_type, CASE WHEN length(f.text) < 100 THEN coalesce(nullif(s.title, ''), f.title) ELSE s.title END, CASE WHEN length(f.text) < 100 THEN f.text || chr(10) || chr(10) || s.text ELSE s.text END,
  CASE WHEN length(f.text) < 100 THEN f.a ELSE s.char_offset_start END, s.char_offset_end FROM f JOIN sec s ON s.doc_id = f.doc_id AND s.section_no = f.i + 1)
SELECT doc_id, grp AS n, section_type, title, md5(text) AS text_md5, a AS char_offset_start, b AS char_offset_end FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, grp ORDER BY i DESC) = 1""",
    "layout_sections": """WITH i AS (SELECT conv_id, turn, ['text', 'section_header', 'list_item', 'footnote', 'page_footer'][turn % 5 + 1] AS label, trim(replace(text, chr(10), ' ')) AS text FROM conversations),
l AS (SELECT *, count(*) FILTER (label = 'section_header') OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM i WHERE length(text) > 0 AND label <> 'page_footer'),
p AS (SELECT conv_id, section, max(text) FILTER (label = 'section_header') AS title, coalesce(string_agg(CASE label WHEN 'footnote' THEN '[footnote] ' ELSE '' END || text, chr(10) ORDER BY turn) FILTER (label <> 'section_header'), '') AS text FROM l GROUP BY conv_id, section),
q AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS a, lower(title) AS t FROM p WHERE length(text) > 0 OR title IS NOT NULL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY section) AS section_no, CASE WHEN title IS NULL THEN 'other' WHEN contains(t, 'abstract') THEN 'abstract' WHEN contains(t, 'introduction') THEN 'introduction' WHEN regexp_matches(t, 'method|material|approach|technique') THEN 'methods'
 WHEN contains(t, 'result') THEN 'results' WHEN contains(t, 'discussion') THEN 'discussion' WHEN contains(t, 'conclusion') THEN 'conclusion' WHEN regexp_matches(t, 'reference|bibliography') THEN 'references' WHEN regexp_matches(t, 'acknowledge?ment') THEN 'acknowledgments' WHEN contains(t, 'appendix') THEN 'appendix' ELSE 'other' END AS section_type,
 md5(title) AS title_md5, md5(text) AS text_md5, a AS char_offset_start, (a + length(text))::INT AS char_offset_end FROM q""",
    "sentence_split": r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0))::INT AS n_sentences, len(regexp_extract_all(text, '\S+'))::INT AS n_tokens,
md5(CASE WHEN len(regexp_extract_all(text, '\S+')) <= 100 THEN text ELSE array_to_string(list_slice(regexp_extract_all(text, '\S+'), -100, -1), ' ') || ' ' END) AS tail_md5, length(text) // 4 AS tokens FROM documents""",
    "html_extract": f"SELECT page_id, CASE WHEN length(t) > 0 THEN {_plain('t')} END AS title, md5({_plain('b')}) AS text_md5 FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, {_no_tags('html')} AS b FROM pages)",
    "html_sections": rf"""WITH b AS (SELECT page_id, string_split(regexp_replace({_no_tags("html")}, '(?is)<h[1-6][^>]*>', chr(1), 'g'), chr(1)) AS p FROM pages),
u AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS section_no FROM b),
v AS (SELECT page_id, section_no, CASE WHEN section_no > 0 THEN {_plain("regexp_extract(part, '(?is)^(.*?)</h[1-6]\\s*>', 1)")} END AS title, {_plain("CASE WHEN section_no > 0 THEN regexp_replace(part, '(?is)^.*?</h[1-6]\\s*>', '') ELSE part END")} AS text FROM u)
SELECT page_id, section_no::INT AS section_no, title, CASE WHEN length(title) > 0 THEN CASE {_CASES.replace("(t,", "(lower(title),")} ELSE 'other' END ELSE 'other' END AS section_type, md5(text) AS text_md5 FROM v WHERE length(text) > 0 OR length(title) > 0""",
    "tei_parse": """SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN lang || chr(10) || chr(10) || 'Methods ' || source || chr(10) || chr(10) || 'T Ann Lee' ELSE '' END AS full_text, CASE WHEN doc_id % 10 > 0 THEN 'abstract,methods,references' ELSE '' END AS kinds,
CASE WHEN doc_id % 10 > 0 THEN source END AS title, CASE WHEN doc_id % 10 > 0 THEN 2020::INT END AS year, CASE WHEN doc_id % 10 > 0 THEN 'Ann Lee' END AS authors, doc_id % 10 = 0 AS broken FROM documents""",
}
