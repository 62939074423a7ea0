"""Queries over the registry, listing, job and source operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import registry as R
from loomspark.operators.keyed_store import KeyedStore
from loomspark.plans.retrieval import read
from loomspark.scratch import fresh_path
from loomspark.sources import connectors as C
from loomspark.sources import files



def _line():
    return F.substring_index("text", "\n", 1)


def _doi():
    return F.concat(F.lit("10.1000/"), F.substring(F.md5("text"), 1, 10))


def title_normalize(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", X.normalize_title(_line()).alias("title_normalized"), X.search_title(_line()).alias("search_title"))


def doi_normalize(spark, d):
    kind = F.col("o_orderkey") % 8
    lead = F.element_at(F.array(*[F.lit(x) for x in ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:", "DOI:", "", "  ")]), (kind + 1).cast("int"))
    raw = F.when(F.col("o_orderkey") % 50 == 7, F.lit("")).otherwise(F.concat(lead, F.lit("10.1234/ORD."), F.col("o_orderkey").cast("string"), F.lit(" ")))
    return read(spark, d, "orders").select("o_orderkey", X.normalize_doi(raw).alias("doi"))


def author_names(spark, d):
    name = F.concat(F.lit("Dr. "), "c_name", F.lit("  O'Neil-Smith, Ann"))
    rows = read(spark, d, "customer").select("c_custkey", name.alias("n"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("m"))
    given, family = zip(*(X.split_name(F.col("n" if s == "comma" else "m"), s) for s in ("comma", "first_token", "last_token")), strict=True)
    return rows.select("c_custkey", X.normalize_author(F.col("n")).alias("normalized"), *(g.alias(f"given_{i}") for i, g in enumerate(given)), *(f.alias(f"family_{i}") for i, f in enumerate(family)))


def reference_parse(spark, d):
    o = F.col("o_orderkey").cast("string")
    raw = F.concat(
        F.lit("Smith, J. ("), F.year("o_orderdate").cast("string"), F.lit("). On orders. "),
        F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("doi:10.5555/ord."), o, F.lit(". "))).otherwise(F.lit("")),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ARXIV:"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "1"), F.lit(".01234"))).otherwise(F.lit("no preprint")),
    )
    return read(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", X.reference_doi(F.col("raw")).alias("doi"), X.reference_year(F.col("raw")).alias("year"), X.reference_arxiv(F.col("raw")).alias("arxiv_id"))


def file_types(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".DOCX", ".htm", ".jpeg", ".md", ".xyz", "", ".tar.adoc")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    head = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("255044462D312E34", "89504E470D0A1A0A", "FFD8FFE000104A46", "49492A0008000000", "504B030414000000", "0000000000000000")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), ext)
    return read(spark, d, "part").select("p_partkey", X.file_type(name, head).alias("file_type"), files.pdf_errors(head).alias("error"), X.safe_filename(name).alias("safe_name"), files.storage_key(F.col("p_partkey"), head).alias("key"))


def content_dedup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return docs.join(first, "content_hash").select("doc_id", "content_hash", "first_id", "copies", (F.col("doc_id") > F.col("first_id")).alias("is_duplicate"))


def _papers(spark, d):
    docs = read(spark, d, "documents")
    has = F.col("doc_id") % 4
    return docs.select(
        F.col("doc_id").alias("arrival"),
        F.element_at(F.array(F.lit("crossref"), F.lit("semantic_scholar"), F.lit("arxiv")), (F.col("doc_id") % 3 + 1).cast("int")).alias("source"),
        _line().alias("title"),
        F.when(F.col("doc_id") % 7 > 0, F.lit(2000) + F.length("lang") + F.length(_line()) % 5).cast("int").alias("year"),
        F.when(has == 0, F.upper(_doi())).when(has == 3, F.lit("")).alias("doi"),
        F.when(has < 2, F.concat(F.lit("2301."), F.substring(F.md5("text"), 1, 8))).alias("arxiv_id"),
        F.when(F.col("doc_id") % 5 > 2, F.col("source")).alias("abstract"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("journal"),
        F.lit(None).cast("string").alias("pdf_url"),
        F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / 10.0).alias("relevance_score"),
    )


def search_merge(spark, d):
    made = R.merge_results(_papers(spark, d))
    return made.select("arrival", "source", "title", "year", "doi", "arxiv_id", "abstract", "journal", F.array_join("sources_found", ",").alias("sources_found"), F.round("relevance_score", 6).alias("relevance_score"))


def federated_search(spark, d):
    rows = _papers(spark, d).withColumn("position", F.col("arrival"))
    sources = {n: rows.where(F.col("source") == n).drop("source", "arrival") for n in ("crossref", "semantic_scholar", "arxiv")}
    made = R.federated(sources, None, 40, 20)
    return made.select("source", "title", F.round("relevance_score", 6).alias("relevance_score"))


def _requests(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, _doi()).alias("doi"), X.content_hash(F.col("text")).alias("content_hash"), X.normalize_title(_line()).alias("title"), F.ascii("lang").alias("year"))
    return rows.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "request_id"), rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "document_id")


def dedup_cascade(spark, d):
    # its SQL holds the exact steps only; dedup_cascade_fuzzy has them all
    requests, registry = _requests(spark, d)
    return R.find_duplicates(requests, registry, fuzzy=False).select("request_id", "document_id", "match_type")


def register_batch(spark, d):
    # its SQL holds the exact steps only; register_batch_fuzzy has them all
    requests, registry = _requests(spark, d)
    return R.register(requests, registry, fuzzy=False).select("request_id", "document_id", "status", "match_type")


def dedup_cascade_fuzzy(spark, d):
    requests, registry = _requests(spark, d)
    return R.find_duplicates(requests, registry).select("request_id", "document_id", "match_type")


def register_batch_fuzzy(spark, d):
    requests, registry = _requests(spark, d)
    return R.register(requests, registry).select("request_id", "document_id", "status", "match_type")


def fuzzy_titles(spark, d):
    docs = read(spark, d, "documents").select("doc_id", X.normalize_title(_line()).alias("title"), F.ascii("lang").alias("year"))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("request_id"), "title", "year")
    made = R.fuzzy_matches(asked, docs.withColumnRenamed("doc_id", "document_id"))
    return made.select("request_id", "document_id", F.round("ratio", 6).alias("ratio"))


def _jobs(spark, d):
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderkey") % 2 == 0, "completed").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("job_type"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval(mins=F.col("o_orderkey") % 90)).alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(100), secs=F.col("o_custkey") % 60)).alias("completed_at"),
    )


def status_counts(spark, d):
    return R.count_by(_jobs(spark, d), "status", ["pending", "running", "completed", "failed", "cancelled"])


def job_avg_duration(spark, d):
    done = _jobs(spark, d).where("status = 'completed' and started_at is not null and completed_at is not null")
    secs = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return done.agg(F.count("*").alias("n"), F.round(F.avg(secs), 4).alias("avg_seconds"))


def pending_queue(spark, d):
    return _jobs(spark, d).where("status = 'pending'").orderBy("created_at", "job_id").limit(50).select("job_id", "created_at")


def pending_capped(spark, d):
    return _jobs(spark, d).where("status = 'pending'").limit(1000).agg(F.count("*").alias("n"))


def stale_reset(spark, d):
    now = F.lit("2001-01-01 01:00:00").cast("timestamp_ntz")
    return R.stale_reset(_jobs(spark, d), now).select("job_id", "status", "started_at")


def job_claims(spark, d):
    now = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    jobs = R.claim_jobs(_jobs(spark, d), 100, now)
    return R.cancel_jobs(jobs, jobs.where("job_id % 10 = 3")).select("job_id", "status", "started_at")


def offset_page(spark, d):
    docs = read(spark, d, "orders").where(F.col("o_orderstatus") == "F")
    return R.offset_page(docs, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5000, 40).select("o_orderkey", "o_orderdate")


def keyset_page(spark, d):
    orders = read(spark, d, "orders")
    page = R.keyset_page(orders, "o_orderdate", "o_orderkey", 20)
    after = R.page_after(orders, "o_orderdate", "o_orderkey", 20, page)
    return after.select("o_orderkey", "o_orderdate", R.cursor_of(F.col("o_orderkey")).alias("cursor"))


def lifecycle_validate(spark, d):
    e = read(spark, d, "events")
    state = F.when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "indexed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    made = R.transitions(e.withColumn("state", state), "user_id", "state", ["ts", "event_id"])
    return made.select("event_id", "user_id", "previous", "state", "allowed")


def soft_delete(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("deleted_at"))
    asked = docs.where("document_id % 3 = 0")
    gone = R.soft_delete(docs, asked, at=F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).withColumnRenamed("outcome", "delete_outcome")
    return R.restore(gone, docs.where("document_id % 4 = 0")).withColumnRenamed("outcome", "restore_outcome")


def vector_upsert(spark, d):
    points = read(spark, d, "embeddings").select("vec_id", "label")
    fresh = points.where("vec_id % 3 = 0").select((F.col("vec_id") + 3).alias("vec_id"), (F.col("label") + 100).cast("int").alias("label"))
    kept = R.delete_rows(points, points.where("vec_id % 11 = 0"), "vec_id")
    return R.upsert(kept, fresh, ["vec_id"])


def keyed_store(spark, d):
    """Rows put, added and taken away in a stored table, range by range."""
    points = read(spark, d, "embeddings").select("vec_id", "label")
    store = KeyedStore(spark, fresh_path(spark, "keyed-store"), ["vec_id"]).create(points)
    store.delete(points.where("vec_id % 11 = 0"))
    moved = lambda step, up: points.where("vec_id % 3 = 0").select((F.col("vec_id") + step).alias("vec_id"), (F.col("label") + up).cast("int").alias("label"))
    store.upsert(moved(3, 100))
    store.insert(moved(6, 500))
    return store.read()


def insert_or_get(spark, d):
    requests, registry = _requests(spark, d)
    rows = requests.select(F.col("request_id").alias("document_id"), "content_hash")
    _, marked = R.insert_or_get(rows, registry.select("document_id", "content_hash"), "content_hash", "document_id")
    return marked.select("document_id", F.col("__created").alias("created"))


def latency_histogram(spark, d):
    return R.latency_buckets(read(spark, d, "events"), "value", ["event_type"])


def metadata_merge(spark, d):
    o = read(spark, d, "orders")
    old = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    new = F.create_map(F.lit("status"), F.lit("X"), F.lit("customer"), F.col("o_custkey").cast("string"))
    made = R.merge_maps(old, F.when(F.col("o_orderkey") % 2 == 0, new))
    return o.select("o_orderkey", *(made[k].alias(k) for k in ("status", "priority", "customer")))


def _imports(spark, d, external_id, source):
    rows = _papers(spark, d).select("*", external_id.alias("external_id"), source.alias("from_source")).drop("source").withColumnRenamed("from_source", "source")
    asked = rows.select(F.col("arrival").alias("request_id"), "arxiv_id", "doi", F.lit(None).cast("string").alias("bibcode"), F.when(F.col("arrival") % 2 == 0, F.lit("http://x")).alias("url"))
    found = rows.where("arrival % 6 < 5").select(F.col("arrival").alias("request_id"), "external_id", "source")
    known = rows.where("arrival % 8 = 0").select("doi", "external_id", "source")
    return R.import_outcomes(asked, found, known).select("request_id", "import_source", "import_status")


def import_outcomes(spark, d):
    none = F.lit(None).cast("string")  # its papers have no external ids; those of import_existing do
    return _imports(spark, d, none, none)


def import_existing(spark, d):
    key = F.when((F.col("arrival") % 24).isin(0, 3), F.lit("")).otherwise(F.floor(F.col("arrival") / 4).cast("string"))
    return _imports(spark, d, key, F.col("source"))


def source_lookup(spark, d):
    rows = _papers(spark, d).where("length(doi) > 0").select(F.lower("doi").alias("doi"), "title", "source", "arrival")
    one = rows.where("source = 'crossref'").groupBy("doi").agg(F.min_by("title", "arrival").alias("title"), F.first("source").alias("source"))
    two = rows.where("source = 'semantic_scholar'").groupBy("doi").agg(F.min_by("title", "arrival").alias("title"), F.first("source").alias("source"))
    return R.first_found(rows.select("doi").distinct(), [one, two], "doi")


def _crossref_payload():
    return F.to_json(
        F.struct(
            _doi().alias("DOI"), F.array(_line()).alias("title"),
            F.array(F.struct(F.col("lang").alias("given"), F.col("source").alias("family"))).alias("author"),
            F.struct(F.array(F.array((F.lit(1990) + F.col("doc_id") % 30).cast("int"), F.lit(1))).alias("date-parts")).alias("published-online"),
            F.array(F.struct(F.lit("http://h").alias("URL"), F.lit("text/html").alias("content-type")), F.struct(F.concat(F.lit("http://p/"), F.col("doc_id").cast("string")).alias("URL"), F.lit("application/pdf").alias("content-type"))).alias("link"),
            F.array("source").alias("container-title"),
        )
    )


def connector_crossref(spark, d):
    made = C.crossref(read(spark, d, "documents").select("doc_id", _crossref_payload().alias("payload")), keep=["doc_id"])
    return made.select("doc_id", "external_id", "title", "year", "journal", "pdf_url", "url", F.element_at("authors", 1)["family_name"].alias("family"))


def connector_scholar(spark, d):
    payload = F.to_json(
        F.struct(
            F.md5("text").alias("paperId"), F.struct(F.when(F.col("doc_id") % 2 == 0, _doi()).alias("DOI"), F.lit("2301.1").alias("ArXiv")).alias("externalIds"), _line().alias("title"), F.lit(2020).alias("year"),
            F.array(F.struct(F.concat(F.lit("Ann Mary "), F.col("source")).alias("name"))).alias("authors"), F.col("lang").alias("venue"), (F.col("doc_id") % 3 == 0).alias("isOpenAccess"), F.struct(F.lit("http://o").alias("url")).alias("openAccessPdf"),
        )
    )
    made = C.semantic_scholar(read(spark, d, "documents").select("doc_id", payload.alias("payload")), keep=["doc_id"])
    first = F.element_at("authors", 1)
    return made.select("doc_id", "external_id", "title", "doi", "arxiv_id", "journal", "pdf_url", first["given_name"].alias("given"), first["family_name"].alias("family"))


def connector_arxiv(spark, d):
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("http://arxiv.org/abs/2301."), F.col("doc_id").cast("string"), F.lit("v2")).alias("id"), F.concat(F.lit(" "), _line(), F.lit("\n")).alias("title"), F.col("source").alias("summary"),
            F.when(F.col("doc_id") % 4 > 0, F.lit("2019-05-01T00:00:00Z")).alias("published"), F.array(F.struct(F.concat(F.lit("Ann Mary "), F.col("source")).alias("name"))).alias("authors"),
        )
    )
    made = C.year_filter(C.arxiv(read(spark, d, "documents").select("doc_id", payload.alias("payload")), keep=["doc_id"]), 2000)
    first = F.element_at("authors", 1)
    return made.select("doc_id", "external_id", "title", "year", "pdf_url", "abstract", first["given_name"].alias("given"), first["family_name"].alias("family"))


def connector_ads(spark, d):
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("2020ApJ"), F.col("doc_id").cast("string")).alias("bibcode"), F.array(_line()).alias("title"), F.array(F.concat("source", F.lit(", Ann M."))).alias("author"), F.lit("2020").alias("year"), F.array(_doi()).alias("doi"),
            F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("EPRINT_PDF"))).alias("esources"), F.array(F.lit("x:1"), F.concat(F.lit("arXiv:2001."), F.col("doc_id").cast("string"))).alias("identifier"),
        )
    )
    made = C.ads(read(spark, d, "documents").select("doc_id", payload.alias("payload")), keep=["doc_id"])
    first = F.element_at("authors", 1)
    return made.select("doc_id", "external_id", "title", "year", "doi", "arxiv_id", "pdf_url", first["given_name"].alias("given"), first["family_name"].alias("family"))


QUERIES = {
    f.__name__: f
    for f in (
        title_normalize, doi_normalize, author_names, reference_parse, file_types, content_dedup, search_merge, federated_search, dedup_cascade, register_batch, dedup_cascade_fuzzy, register_batch_fuzzy, fuzzy_titles, status_counts, job_avg_duration,
        pending_queue, pending_capped, stale_reset, job_claims, offset_page, keyset_page, lifecycle_validate, soft_delete, vector_upsert, keyed_store, insert_or_get, latency_histogram, metadata_merge, import_outcomes, import_existing, source_lookup,
        connector_crossref, connector_scholar, connector_arxiv, connector_ads,
    )
}

_L, _D = "split_part(text, chr(10), 1)", "('10.1000/' || substr(md5(text), 1, 10))"
_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({_L})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_STITLE = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_PAPERS = f"""papers AS (SELECT doc_id AS arrival, ['crossref', 'semantic_scholar', 'arxiv'][doc_id % 3 + 1] AS source, {_L} AS title,
 CASE WHEN doc_id % 7 > 0 THEN (2000 + length(lang) + length({_L}) % 5)::INT END AS year, CASE WHEN doc_id % 4 = 0 THEN upper({_D}) WHEN doc_id % 4 = 3 THEN '' END AS doi,
 CASE WHEN doc_id % 4 < 2 THEN '2301.' || substr(md5(text), 1, 8) END AS arxiv_id, CASE WHEN doc_id % 5 > 2 THEN source END AS abstract, CASE WHEN doc_id % 2 = 0 THEN lang END AS journal,
 CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS score FROM documents)"""
_KEY = f"({_STITLE.format('title')} || '|' || coalesce(CASE WHEN year <> 0 THEN year::VARCHAR END, 'unknown'))"


def _group(src: str, key: str) -> str:
    return f"""SELECT {key} AS k, min(arrival) AS arrival, arg_min(source, arrival) AS source, arg_min(title, arrival) AS title, first(year ORDER BY arrival) AS year,
 arg_min(doi, arrival) FILTER (length(doi) > 0) AS doi, arg_min(arxiv_id, arrival) FILTER (length(arxiv_id) > 0) AS arxiv_id, arg_min(abstract, arrival) FILTER (length(abstract) > 0) AS abstract,
 arg_min(journal, arrival) FILTER (length(journal) > 0) AS journal, string_agg(source, ',' ORDER BY arrival) AS sources_found, avg(score) FILTER (score <> 0) AS score FROM {src} GROUP BY k"""


_MERGED = f"""WITH {_PAPERS},
g1 AS ({_group("(SELECT * FROM papers WHERE length(doi) > 0)", "lower(doi)")}),
g2 AS (SELECT * FROM ({_group("(SELECT * FROM papers WHERE NOT coalesce(length(doi) > 0, false) AND length(arxiv_id) > 0)", "arxiv_id")}) WHERE k NOT IN (SELECT arxiv_id FROM g1 WHERE arxiv_id IS NOT NULL)),
cap AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2),
g3 AS (SELECT * FROM ({_group("(SELECT * FROM papers WHERE NOT coalesce(length(doi) > 0, false) AND NOT coalesce(length(arxiv_id) > 0, false))", _KEY)}) WHERE k NOT IN (SELECT {_KEY} FROM cap)),
merged AS (SELECT * FROM cap UNION ALL SELECT * FROM g3)"""
_FEDERATED = _MERGED.replace("papers AS (", "papers0 AS (", 1).replace(
    "\ng1 AS",
    """
papers AS (SELECT * REPLACE ((list_position(['crossref', 'semantic_scholar', 'arxiv'], source) - 1) * 40 + arrival AS arrival) FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY arrival) AS n FROM papers0) WHERE n <= 40),
g1 AS""",
    1,
)
_REQ = f"""r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_D} END AS doi, sha256(text) AS h FROM documents),
old AS (SELECT * FROM r WHERE doc_id % 2 = 0), new AS (SELECT * FROM r WHERE doc_id % 2 = 1),
bd AS (SELECT doi, min(doc_id) AS m FROM old WHERE doi IS NOT NULL GROUP BY doi), bh AS (SELECT h, min(doc_id) AS m FROM old GROUP BY h),
p AS (SELECT n.doc_id AS request_id, n.doi, n.h, coalesce(bd.m, bh.m) AS document_id, CASE WHEN bd.m IS NOT NULL THEN 'doi' WHEN bh.m IS NOT NULL THEN 'content_hash' END AS match_type FROM new n LEFT JOIN bd ON n.doi = bd.doi LEFT JOIN bh ON n.h = bh.h)"""
_JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS created_at,
 CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_orderkey % 90) END AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_minutes(100) + to_seconds(o_custkey % 60) END AS completed_at FROM orders)"""
_LE = ", ".join(f"count(*) FILTER (value <= {b}) AS le_{str(b).replace('.', '_')}" for b in R.V.LATENCY_BUCKETS)

ORACLES = {
    "title_normalize": f"SELECT doc_id, {_NORM} AS title_normalized, {_STITLE.format(_L)} AS search_title FROM documents",
    "doi_normalize": """SELECT o_orderkey, CASE WHEN length(raw) > 0 THEN trim(lower(regexp_replace(trim(raw), '^(https?://(dx\\.)?doi\\.org/|doi:|DOI:)', ''))) END AS doi FROM (SELECT o_orderkey,
CASE WHEN o_orderkey % 50 = 7 THEN '' ELSE ['https://doi.org/', 'http://doi.org/', 'https://dx.doi.org/', 'http://dx.doi.org/', 'doi:', 'DOI:', '', '  '][o_orderkey % 8 + 1] || '10.1234/ORD.' || o_orderkey || ' ' END AS raw FROM orders)""",
    "author_names": """SELECT c_custkey, 'dr customer' || lpad(c_custkey::VARCHAR, 9, '0') || ' oneilsmith ann' AS normalized, 'Ann' AS given_0, 'Dr. ' || c_name || '  O''Neil-Smith' AS family_0,
c_mktsegment AS given_1, c_name AS family_1, c_mktsegment AS given_2, c_name AS family_2 FROM customer""",
    "reference_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN '10.5555/ord.' || o_orderkey END AS doi, year(o_orderdate)::INT AS year,
CASE WHEN o_orderkey % 2 = 0 THEN lpad((o_orderkey % 10000)::VARCHAR, 4, '1') || '.01234' END AS arxiv_id FROM orders""",
    "file_types": """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '/') || ['.pdf', '.DOCX', '.htm', '.jpeg', '.md', '.xyz', '', '.tar.adoc'][p_partkey % 8 + 1] AS name,
['255044462D312E34', '89504E470D0A1A0A', 'FFD8FFE000104A46', '49492A0008000000', '504B030414000000', '0000000000000000'][p_partkey % 6 + 1] AS h FROM part)
SELECT p_partkey, coalesce(['pdf', 'docx', 'html', 'image', 'markdown', NULL, NULL, 'asciidoc'][p_partkey % 8 + 1], ['pdf', 'image', 'image', 'image', 'docx', 'pdf'][p_partkey % 6 + 1]) AS file_type,
CASE WHEN h NOT LIKE '25504446%' THEN 'not_pdf' END AS error, replace(name, '/', '_') AS safe_name, 'documents/' || p_partkey || '/' || sha256(unhex(h)) || '.pdf' AS key FROM p""",
    "content_dedup": "SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, count(*) OVER (PARTITION BY sha256(text)) AS copies, doc_id > min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents",
    "search_merge": f"{_MERGED} SELECT arrival, source, title, year, doi, arxiv_id, abstract, journal, sources_found, round(score, 6) AS relevance_score FROM merged",
    "federated_search": f"{_FEDERATED} SELECT source, title, round(score, 6) AS relevance_score FROM merged ORDER BY coalesce(score, 0) DESC, arrival LIMIT 20",
    "dedup_cascade": f"WITH {_REQ} SELECT request_id, document_id, match_type FROM p",
    "register_batch": f"""WITH {_REQ}, f AS (SELECT *, min(request_id) OVER (PARTITION BY match_type IS NULL, CASE WHEN match_type IS NULL THEN h ELSE request_id::VARCHAR END) AS f FROM p)
SELECT request_id, CASE WHEN match_type IS NULL THEN f ELSE document_id END AS document_id, CASE WHEN match_type IS NULL AND f = request_id THEN 'created' ELSE 'duplicate' END AS status,
CASE WHEN match_type IS NULL AND f <> request_id THEN 'race_condition' ELSE match_type END AS match_type FROM f""",
    "status_counts": f"WITH {_JOBS} SELECT s AS status, count(job_id) AS n FROM (SELECT unnest(['pending', 'running', 'completed', 'failed', 'cancelled']) AS s) LEFT JOIN jobs ON status = s GROUP BY s",
    "job_avg_duration": f"WITH {_JOBS} SELECT count(*) AS n, round(avg(epoch(completed_at - started_at)), 4) AS avg_seconds FROM jobs WHERE status = 'completed' AND started_at IS NOT NULL AND completed_at IS NOT NULL",
    "pending_queue": f"WITH {_JOBS} SELECT job_id, created_at FROM jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 50",
    "pending_capped": f"WITH {_JOBS} SELECT least(1000, count(*)) AS n FROM jobs WHERE status = 'pending'",
    "stale_reset": f"""WITH {_JOBS}, s AS (SELECT *, coalesce(status = 'running' AND started_at < TIMESTAMP '2001-01-01 00:00:00', false) AS stale FROM jobs)
SELECT job_id, CASE WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN NOT stale THEN started_at END AS started_at FROM s""",
    "job_claims": f"""WITH {_JOBS}, c AS (SELECT job_id FROM jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 100),
n AS (SELECT j.job_id, CASE WHEN c.job_id IS NOT NULL THEN 'running' ELSE status END AS status, CASE WHEN c.job_id IS NOT NULL THEN TIMESTAMP '2001-01-01 00:00:00' ELSE started_at END AS started_at FROM jobs j LEFT JOIN c USING (job_id))
SELECT job_id, CASE WHEN job_id % 10 = 3 AND status IN ('pending', 'running') THEN 'cancelled' ELSE status END AS status, started_at FROM n""",
    "offset_page": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000 OFFSET 40",
    "keyset_page": "SELECT o_orderkey, o_orderdate, replace(replace(to_base64(o_orderkey::VARCHAR::BLOB), '+', '-'), '/', '_') AS cursor FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21 OFFSET 20",
    "lifecycle_validate": """WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'indexed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS state FROM events),
p AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'registered') AS previous FROM e)
SELECT event_id, user_id, previous, state, (previous || '>' || state) IN ('registered>processing', 'processing>indexed', 'processing>failed', 'failed>processing') AS allowed FROM p""",
    "soft_delete": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS t FROM documents),
e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN t IS NULL THEN 'DELETED' ELSE 'ALREADY_DELETED' END END AS o, CASE WHEN doc_id % 3 = 0 AND t IS NULL THEN TIMESTAMP '2024-06-01' ELSE t END AS t FROM d)
SELECT doc_id AS document_id, CASE WHEN doc_id % 4 <> 0 THEN t END AS deleted_at, o AS delete_outcome, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN t IS NULL THEN 'NOT_DELETED' ELSE 'RESTORED' END END AS restore_outcome FROM e""",
    "vector_upsert": """WITH n AS (SELECT vec_id + 3 AS vec_id, (label + 100)::INT AS label FROM embeddings WHERE vec_id % 3 = 0)
SELECT vec_id, label FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n""",
    "keyed_store": """WITH n AS (SELECT vec_id + 3 AS vec_id, (label + 100)::INT AS label FROM embeddings WHERE vec_id % 3 = 0),
t AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n)
SELECT * FROM t UNION ALL SELECT vec_id + 6, (label + 500)::INT FROM embeddings WHERE vec_id % 3 = 0 AND vec_id + 6 NOT IN (SELECT vec_id FROM t)""",
    "insert_or_get": """WITH r AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id AS document_id,
h NOT IN (SELECT h FROM r WHERE doc_id % 2 = 0) AND doc_id = min(doc_id) OVER (PARTITION BY h) AS created FROM r WHERE doc_id % 2 = 1""",
    "latency_histogram": f"SELECT event_type, {_LE}, count(value) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type",
    "metadata_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR END AS customer FROM orders",
    "import_outcomes": f"""WITH {_PAPERS} SELECT arrival AS request_id, CASE WHEN length(arxiv_id) > 0 THEN 'arxiv' WHEN length(doi) > 0 THEN 'crossref' WHEN arrival % 2 = 0 THEN 'upload' ELSE 'unknown' END AS import_source,
CASE WHEN arrival % 6 >= 5 THEN 'NOT_FOUND' WHEN lower(doi) IN (SELECT lower(doi) FROM papers WHERE arrival % 8 = 0 AND doi IS NOT NULL) THEN 'DUPLICATE' ELSE 'IMPORTED' END AS import_status FROM papers""",
    "import_existing": f"""WITH {_PAPERS}, e AS (SELECT *, CASE WHEN arrival % 24 IN (0, 3) THEN '' ELSE (arrival // 4)::VARCHAR END AS ext FROM papers), k AS (SELECT * FROM e WHERE arrival % 8 = 0)
SELECT arrival AS request_id, CASE WHEN length(arxiv_id) > 0 THEN 'arxiv' WHEN length(doi) > 0 THEN 'crossref' WHEN arrival % 2 = 0 THEN 'upload' ELSE 'unknown' END AS import_source,
CASE WHEN arrival % 6 >= 5 THEN 'NOT_FOUND' WHEN lower(doi) IN (SELECT lower(doi) FROM k WHERE length(doi) > 0) OR (length(ext) > 0 AND (ext, source) IN (SELECT (ext, source) FROM k)) THEN 'DUPLICATE' ELSE 'IMPORTED' END AS import_status FROM e""",
    "source_lookup": f"""WITH {_PAPERS}, p AS (SELECT lower(doi) AS doi, title, source, arrival FROM papers WHERE length(doi) > 0)
SELECT k.doi, coalesce(a.title, b.title) AS title, coalesce(a.source, b.source) AS source FROM (SELECT DISTINCT doi FROM p) k
LEFT JOIN (SELECT doi, arg_min(title, arrival) AS title, any_value(source) AS source FROM p WHERE source = 'crossref' GROUP BY doi) a ON a.doi = k.doi
LEFT JOIN (SELECT doi, arg_min(title, arrival) AS title, any_value(source) AS source FROM p WHERE source = 'semantic_scholar' GROUP BY doi) b ON b.doi = k.doi""",
    "connector_crossref": f"SELECT doc_id, {_D} AS external_id, {_L} AS title, (1990 + doc_id % 30)::INT AS year, source AS journal, 'http://p/' || doc_id AS pdf_url, 'https://doi.org/' || {_D} AS url, source AS family FROM documents",
    "connector_scholar": f"""SELECT doc_id, md5(text) AS external_id, {_L} AS title, CASE WHEN doc_id % 2 = 0 THEN {_D} END AS doi, '2301.1' AS arxiv_id, lang AS journal, CASE WHEN doc_id % 3 = 0 THEN 'http://o' END AS pdf_url,
'Ann' AS given, 'Mary ' || source AS family FROM documents""",
    "connector_arxiv": f"""SELECT doc_id, '2301.' || doc_id AS external_id, trim({_L}) AS title, CASE WHEN doc_id % 4 > 0 THEN 2019::INT END AS year, 'https://arxiv.org/pdf/2301.' || doc_id || '.pdf' AS pdf_url, source AS abstract,
'Ann Mary' AS given, source AS family FROM documents""",
    "connector_ads": f"""SELECT doc_id, '2020ApJ' || doc_id AS external_id, {_L} AS title, 2020::INT AS year, {_D} AS doi, '2001.' || doc_id AS arxiv_id,
CASE WHEN doc_id % 2 = 0 THEN 'https://ui.adsabs.harvard.edu/link_gateway/2020ApJ' || doc_id || '/PUB_PDF' ELSE 'https://arxiv.org/pdf/2001.' || doc_id || '.pdf' END AS pdf_url, 'Ann M.' AS given, source AS family FROM documents""",
}
