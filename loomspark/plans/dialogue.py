"""Queries over question understanding, answers and streaming folds, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark import values as V
from loomspark.functions import answer as A
from loomspark.functions import question as Q
from loomspark.plans.retrieval import read
from loomspark.streaming import folds, stateful

#: Openings that give the synthetic turns something to understand.
OPENINGS = (
    "What is the ", "Compare ", "Explain how ", "Is there evidence for ", "Tell me about CME and SW since 2010 to 2015 by Smith et al. ", "list ", "How does the solar wind and the Aurora differ in 2020 ",
    "Describe work by Jones and Miller until 2018 on magnetosphere ", "show solar flares and their causes now", "",
)


def _pick(key: str, items) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.col(key) % len(items) + 1).cast("int"))


def _questions(spark, d):
    rows = read(spark, d, "conversations").where("role = 'user'").withColumn("k", F.col("conv_id") + F.col("turn"))
    text = F.when(F.col("k") % len(OPENINGS) == 8, _pick("k", OPENINGS)).otherwise(F.concat(_pick("k", OPENINGS), F.replace("text", F.lit("\n"), F.lit(" "))))
    return rows.select("conv_id", "turn", text.alias("q"))


def query_understanding(spark, d):
    q = F.col("q")
    first, last = Q.year_range(q)
    return _questions(spark, d).select("conv_id", "turn", Q.intent(q).alias("intent"), first.alias("year_from"), last.alias("year_to"), Q.author(q).alias("author"), F.array_join(Q.keywords(q), " ").alias("keywords"))


def query_entities(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.array_join(Q.spotted(F.col("q")), "|").alias("entities"))


#: Every name that questions are searched for, and spaces that part its words.
PHRASES = (
    "solar wind", "coronal mass ejection", "CME", "magnetic reconnection", "geomagnetic storm", "solar flare", "magnetosphere", "ionosphere", "heliosphere", "Parker Solar Probe", "Solar Orbiter", "SDO",
    "STEREO", "Van Allen belts", "van allen probe", "radiation belt", "bow shock", "magnetopause", "plasmasphere", "auroral", "Aurora", "substorm", "ring current", "plasma sheet", "Van Allen",
)
GAPS = (" ", "  ", "\n", "\t\n ")


def query_entity_forms(spark, d):
    """Questions that hold every known name, its words parted by each of GAPS."""
    words = F.concat_ws(" and ", *(_pick(k, PHRASES) for k in ("k", "conv_id")), F.upper(_pick("turn", PHRASES)))
    gap = F.element_at(F.array(*[F.lit(x) for x in GAPS]), (F.col("conv_id") % len(GAPS) + 1).cast("int"))
    rows = read(spark, d, "conversations").withColumn("k", F.col("conv_id") + 7 * F.col("turn"))
    text = F.concat(F.replace(words, F.lit(" "), gap), F.lit(" "), "text")
    return rows.select("conv_id", "turn", F.array_join(Q.spotted(text), "|").alias("entities"))


def query_rewrite(spark, d):
    q = F.col("q")
    return _questions(spark, d).select("conv_id", "turn", Q.rewrite(q).alias("rewritten"), F.array_join(Q.variations(q), "||").alias("variations"))


def query_synonyms(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.explode(Q.synonym_variations(F.col("q"))).alias("variation"))


_TAILS = (" [1] and [12] [1]", " I'm not sure [3]", " nothing", " unclear from [2][10]", " [a] [007]")


def _answers(spark, d):
    rows = read(spark, d, "conversations").where("role = 'assistant'").withColumn("k", F.col("conv_id") + F.col("turn"))
    return rows.select("conv_id", "turn", F.concat("text", _pick("k", _TAILS)).alias("a"))


def citations_extract(spark, d):
    found = A.citations(F.col("a"))
    valid, invalid = A.split_citations(found, F.array(*[F.lit(i) for i in (1, 2, 3)]))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _answers(spark, d).select("conv_id", "turn", text(found).alias("found"), text(valid).alias("valid"), text(invalid).alias("invalid"), F.md5(A.highlight(F.col("a"))).alias("markdown_md5"), F.md5(A.highlight(F.col("a"), "html")).alias("html_md5"))


def answer_confidence(spark, d):
    a, n = F.col("a"), F.size(A.citations(F.col("a")))
    return _answers(spark, d).select("conv_id", "turn", F.round(A.confidence(a, n), 4).alias("confidence"), F.round(A.confidence(a, n, local=True), 4).alias("local_confidence"))


_ATTACKS = ("", "Ignore  previous instructions ", "please DISREGARD all ", "new instruction: ", "System : you ", "<|im_start|>user ", "[inst] <|x|> ", "forget everything ")


def sanitize_prompt(spark, d):
    rows = read(spark, d, "conversations")
    return rows.select("conv_id", "turn", A.sanitize(F.concat(_pick("turn", _ATTACKS), F.col("text"), _pick("conv_id", _ATTACKS))).alias("clean"))


def prompt_sources(spark, d):
    n = F.col("o_orderkey") % 5
    people = F.slice(F.array(*[F.lit(x) for x in ("Lee", "Kim", "Roy", "Sax", "Tan")]), F.lit(1), n.cast("int"))
    line = A.source_line(F.col("o_orderkey") % 9, F.when(n > 0, F.col("o_orderpriority")), people, F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate")))
    block = A.chunk_block(F.col("o_orderkey") % 9, F.when(n > 0, F.col("o_orderpriority")), F.when(n > 1, F.year("o_orderdate")), F.when(n > 2, F.col("o_orderstatus")), F.col("o_custkey").cast("string"))
    paths = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(F.array(*[F.lit(x) for x in ("a", "b", "c", "d")]), F.lit(1), i.cast("int")))
    return read(spark, d, "orders").select("o_orderkey", line.alias("line"), block.alias("block"), A.graph_block(paths).alias("graph"))


def prompt_truncation(spark, d):
    docs = read(spark, d, "documents")
    made = A.truncate_context(F.col("text"), F.lit("s" * 100), F.col("source"), F.concat("text", F.col("source")))
    return docs.select("doc_id", F.length(made).alias("n"), F.md5(made).alias("context_md5"))


def batch_summaries(spark, d):
    """Replies of every form that a line can have, to batches of a document's source, language and text."""
    k = F.col("doc_id") % 6
    first = F.when(k == 0, F.concat(F.lit("Here: [Chunk 1]: "), F.col("source"))).when(k == 1, F.lit("[Chunk 1]:  no_relevant_info. ")).when(k == 2, F.lit("[Chunk 1]:")).when(k == 3, F.lit("[Chunk 1] without colon  ")).when(k == 4, F.lit("nothing"))
    second = F.when(F.col("doc_id") % 4 < 2, F.concat(F.lit("\n[Chunk 2] note: a: "), F.col("lang"), F.lit("\n[Chunk 2]: again"))).otherwise(F.lit("\n[Chunk 12]: other"))
    made = A.batch_summaries(F.concat(first, second), F.array("source", "lang", "text"))
    rows = read(spark, d, "documents").select("doc_id", F.explode(made).alias("c"))
    return rows.select("doc_id", "c.chunk", F.md5("c.text").alias("text_md5"), "c.summarized")


# --- events ---


def _events(spark, d):
    return read(spark, d, "events")


def idempotent_events(spark, d):
    rows = _events(spark, d).withColumn("key", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.lit("POST"), "event_type"), 256))
    return folds.run_fold(rows, folds.Idempotency(7 * 86_400.0), "key", F.col("ts"), ["event_id"], ["event_id"])


def session_gaps(spark, d):
    made = folds.run_fold(_events(spark, d), folds.Sessions(), "user_id", F.col("ts"), ["event_id"], ["user_id", "event_id"])
    return made.select("user_id", "event_id", "session")


def session_windows(spark, d):
    rows = _events(spark, d).withColumn("t", F.col("ts").cast("timestamp"))
    made = rows.groupBy("user_id", F.session_window("t", "24 hours")).agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def token_bucket(spark, d):
    fold = folds.TokenBucket(rate=1 / 86_400, burst=3)
    return folds.run_fold(_events(spark, d), fold, "user_id", F.col("ts"), ["event_id"], ["event_id"]).select("event_id", "allowed", "remaining")


def circuit_breaker(spark, d):
    rows = _events(spark, d).withColumn("ok", F.col("event_type") != "error")
    fold = folds.CircuitBreaker(failures=2, wait=3 * 86_400.0)
    return folds.run_fold(rows, fold, "user_id", F.col("ts"), ["event_id"], ["event_id"])


def lifecycle_apply(spark, d):
    target = F.when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "indexed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    rows = _events(spark, d).select("event_id", "user_id", "ts", target.alias("target"), F.when(F.col("event_id") % 7 == 0, F.lit("processing")).alias("expected"))
    return folds.run_fold(rows, folds.Lifecycle(), "user_id", F.col("ts"), ["event_id"], ["event_id"])


def retry_schedule(spark, d):
    body = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("document_id"))))
    rows = _events(spark, d).select("event_id", body.alias("body"), (F.col("event_id") % 6).cast("int").alias("attempts"), "event_type")
    made = stateful.triage(rows, ok=F.col("event_type") != "error")
    return made.select("event_id", "route", "delay")


def dead_letters(spark, d):
    body = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("document_id"))))
    rows = _events(spark, d).select("event_id", body.alias("body"), (F.col("event_id") % 6).cast("int").alias("attempts"), "event_type")
    sent = stateful.dead_letter(stateful.triage(rows, ok=F.col("event_type") != "error"), F.lit("handler failed"))
    return sent.groupBy(F.get_json_object("body", "$.original_message").alias("original"), F.get_json_object("body", "$.retry_count").cast("int").alias("retries")).agg(F.count("*").alias("n"))


def last_job_update(spark, d):
    return stateful.latest(_events(spark, d).select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id")


def late_split(spark, d):
    fresh, late = stateful.split_late(_events(spark, d), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "1 hour")
    one = fresh.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("side", F.lit("fresh"))
    return one.union(late.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("side", F.lit("late")))


def rate_limit_keys(spark, d):
    u, n = F.col("user_id"), F.col("event_id")
    key = stateful.rate_key(F.when(n % 4 == 0, u.cast("string")), F.when(n % 4 == 1, F.md5(u.cast("string"))), F.when(n % 4 == 2, F.concat(F.lit(" 10.0.0."), u.cast("string"), F.lit(", 1.1.1.1"))), F.when(n % 8 == 3, F.lit("9.9.9.9")))
    return _events(spark, d).select("event_id", key.alias("key"))


def token_stream(spark, d):
    rows = _answers(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.regexp_extract_all("a", F.lit("(?s)(.{1,7})"), F.lit(1)).alias("deltas"))
    return stateful.split_tokens(rows, "id", "deltas")


QUERIES = {
    f.__name__: f
    for f in (
        query_understanding, query_entities, query_entity_forms, query_rewrite, query_synonyms, citations_extract, answer_confidence, sanitize_prompt, prompt_sources, prompt_truncation, batch_summaries, idempotent_events, session_gaps, session_windows,
        token_bucket, circuit_breaker, lifecycle_apply, retry_schedule, dead_letters, last_job_update, late_split, rate_limit_keys, token_stream,
    )
}


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_QS = f"""qs AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % {len(OPENINGS)} = 8 THEN '{OPENINGS[8]}' ELSE {_list(OPENINGS)}[(conv_id + turn) % {len(OPENINGS)} + 1] || replace(text, chr(10), ' ') END AS q FROM conversations WHERE role = 'user')"""
_AS = f"""ans AS (SELECT conv_id, turn, text || {_list(_TAILS)}[(conv_id + turn) % {len(_TAILS)} + 1] AS a FROM conversations WHERE role = 'assistant')"""
# The patterns below are written out again, apart from those that the queries use.
_INTENT = r"""WHEN regexp_matches(lower(q), 'summarize|summary of|overview of|what is known about|tell me about') THEN 'summary'
WHEN regexp_matches(lower(q), 'compare|difference between|how does .+ differ from|vs\.?|versus|similarities between') THEN 'compare'
WHEN regexp_matches(lower(q), 'evidence for|evidence that|support for|prove|show that|demonstrate') THEN 'find_evidence'
WHEN regexp_matches(lower(q), 'related to|connections? between|explore|what else|associated with') THEN 'explore'
WHEN regexp_matches(lower(q), 'explain|how does|why does|what causes|mechanism of|how is .+ related') THEN 'explain'
WHEN regexp_matches(lower(q), 'list|what are the|which .+ are|enumerate|name the') THEN 'list'
WHEN regexp_matches(lower(q), 'what is|when did|who|where|how many|how much') THEN 'factual'"""
_YEAR = r"(?:from|after|since|between)\s+(\d{4})(?:\s+(?:to|and|until)\s+(\d{4}))?|(?:before|until|up to)\s+(\d{4})|in\s+(\d{4})"
_BY = r"(?:by|author(?:ed by)?)\s+([A-Z][a-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-z]+))?)"
_NAMED = (
    r"solar\s+wind", r"coronal\s+mass\s+ejection", "CME", r"magnetic\s+reconnection", r"geomagnetic\s+storm", r"solar\s+flare", "magnetosphere", "ionosphere", "heliosphere", r"Parker\s+Solar\s+Probe", r"Solar\s+Orbiter",
    "SDO", "STEREO", r"Van\s+Allen\s+(?:belt|probe)s?", r"radiation\s+belt", r"bow\s+shock", "magnetopause", "plasmasphere", "auroral?", "substorm", r"ring\s+current",
)
_FOUND = "array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(q, '(?i){p}')" for p in _NAMED) + "]))), '|')"
_OTHER_WORDS = (
    ("solar wind", "SW"), ("solar wind", "interplanetary medium"), ("solar wind", "solar plasma"), ("coronal mass ejection", "CME"), ("coronal mass ejection", "solar eruption"), ("coronal mass ejection", "plasma ejection"),
    ("geomagnetic storm", "magnetic storm"), ("geomagnetic storm", "space weather event"), ("magnetic reconnection", "reconnection event"), ("magnetic reconnection", "field line merging"),
    ("magnetosphere", "Earth''s magnetic field"), ("magnetosphere", "geospace"), ("aurora", "northern lights"), ("aurora", "southern lights"), ("aurora", "auroral emission"),
)
_EXPAND = " || ".join(["q", *(f"CASE WHEN regexp_matches(q, '(?i)\\b{a}\\b') THEN ' {b}' ELSE '' END" for a, b in V.ACRONYM_EXPANSIONS)])


def _chain(expr: str, patterns, to: str) -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, '(?i){p}', '{to}', 'g')"
    return expr


def _hedge(words) -> str:
    return "(" + " OR ".join("contains(lower(a), '" + w.replace("'", "''") + "')" for w in words) + ")"


_CITES = r"list_sort(list_distinct(list_transform(regexp_extract_all(a, '\[(\d+)\]', 1), lambda x: x::INT)))"
_JOIN = "array_to_string({}, ',')"
_SEQ = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events)"

ORACLES = {
    "query_understanding": rf"""WITH {_QS}, y AS (SELECT *, try_cast(nullif(regexp_extract(q, '{_YEAR}', 1), '') AS INT) AS a, try_cast(nullif(regexp_extract(q, '{_YEAR}', 2), '') AS INT) AS b, try_cast(nullif(regexp_extract(q, '{_YEAR}', 3), '') AS INT) AS c, try_cast(nullif(regexp_extract(q, '{_YEAR}', 4), '') AS INT) AS e FROM qs)
SELECT conv_id, turn, CASE {_INTENT} ELSE 'factual' END AS intent, coalesce(a, e) AS year_from, coalesce(b, c, e) AS year_to, nullif(regexp_extract(q, '{_BY}', 1), '') AS author,
array_to_string(list_filter(regexp_extract_all(lower(q), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({_list(V.KEYWORD_STOPWORDS)}, w)), ' ') AS keywords FROM y""",
    "query_entities": f"WITH {_QS} SELECT conv_id, turn, {_FOUND} AS entities FROM qs",
    "query_entity_forms": f"""WITH p AS (SELECT conv_id, turn, text, {_list(PHRASES)} AS p, [' ', '  ', chr(10), chr(9) || chr(10) || ' '][conv_id % 4 + 1] AS gap FROM conversations),
x AS (SELECT conv_id, turn, replace(p[(conv_id + 7 * turn) % {len(PHRASES)} + 1] || ' and ' || p[conv_id % {len(PHRASES)} + 1] || ' and ' || upper(p[turn % {len(PHRASES)} + 1]), ' ', gap) || ' ' || text AS q FROM p)
SELECT conv_id, turn, {_FOUND} AS entities FROM x""",
    "query_rewrite": rf"""WITH {_QS}, x AS (SELECT *, {_EXPAND} AS r, lower(q) AS low FROM qs), y AS (SELECT *, {_chain("lower(r)", V.QUESTION_PREFIXES, "")} AS bare, trim(regexp_replace(low, '(?i){V.QUESTION_STRIP}', '')) AS s, string_split(low, ' and ') AS h FROM x),
z AS (SELECT conv_id, turn, CASE WHEN bare <> lower(r) THEN r || ' ' || bare ELSE r END AS rewritten, list_concat([q, low], list_concat(CASE WHEN length(s) > 10 AND s <> low THEN [s] ELSE [] END, CASE WHEN len(h) = 2 AND length(h[1]) > 5 AND length(h[2]) > 5 THEN h ELSE [] END)) AS v FROM y)
SELECT conv_id, turn, rewritten, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '||') AS variations FROM z""",
    "query_synonyms": f"""WITH {_QS}, v AS (SELECT conv_id, turn, q AS variation FROM qs UNION {" UNION ".join(f"SELECT conv_id, turn, regexp_replace(q, '(?i){chr(92)}b{t}{chr(92)}b', '{o}', 'g') FROM qs WHERE contains(lower(q), '{t}')" for t, o in _OTHER_WORDS)}) SELECT * FROM v""",
    "citations_extract": rf"""WITH {_AS}, c AS (SELECT *, {_CITES} AS f FROM ans) SELECT conv_id, turn, {_JOIN.format("f")} AS found, {_JOIN.format("list_filter(f, lambda x: x IN (1, 2, 3))")} AS valid, {_JOIN.format("list_filter(f, lambda x: x NOT IN (1, 2, 3))")} AS invalid,
md5(regexp_replace(a, '\[(\d+)\]', '**[\1]**', 'g')) AS markdown_md5, md5(regexp_replace(a, '\[(\d+)\]', '<span class="citation">[\1]</span>', 'g')) AS html_md5 FROM c""",
    "answer_confidence": f"""WITH {_AS}, c AS (SELECT *, len({_CITES}) AS n FROM ans) SELECT conv_id, turn, round(greatest(0.1, least(0.95, 0.5 + least(0.3, n * 0.1) - CASE WHEN {_hedge(V.HEDGES)} THEN 0.2 ELSE 0 END))::DOUBLE, 4) AS confidence,
round(greatest(0.1, least(0.9, 0.4 + least(0.35, n * 0.1) - CASE WHEN {_hedge(V.HEDGES[:4])} THEN 0.2 ELSE 0 END))::DOUBLE, 4) AS local_confidence FROM c""",
    "sanitize_prompt": f"""SELECT conv_id, turn, replace(replace({_chain(f"({_list(_ATTACKS)}[turn % {len(_ATTACKS)} + 1] || text || {_list(_ATTACKS)}[conv_id % {len(_ATTACKS)} + 1])", V.INJECTION_PATTERNS, "[FILTERED]")}, '<|', '< |'), '|>', '| >') AS clean FROM conversations""",
    "prompt_sources": """WITH o AS (SELECT *, o_orderkey % 5 AS n, o_orderkey % 9 AS k, ['Lee', 'Kim', 'Roy', 'Sax', 'Tan'] AS p, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, concat_ws(' ', '[' || k || ']', CASE WHEN n > 0 THEN o_orderpriority END, CASE WHEN n > 0 THEN 'by ' || array_to_string(p[1:least(n, 3)], ', ') END, CASE WHEN n > 3 THEN 'et al.' END, CASE WHEN o_orderkey % 2 = 0 THEN '(' || y || ')' END) AS line,
concat_ws(chr(10), '[' || k || ']', CASE WHEN n > 0 THEN concat_ws(' ', 'Source: ' || o_orderpriority, CASE WHEN n > 1 THEN '(' || y || ')' END, CASE WHEN n > 2 THEN 'Section: ' || o_orderstatus END) END, o_custkey::VARCHAR) AS block,
concat_ws(chr(10), 'Related concepts from knowledge graph:', CASE WHEN n > 1 THEN '- a -> b' END, CASE WHEN n > 2 THEN '- a -> b -> c' END, CASE WHEN n > 3 THEN '- a -> b -> c -> d' END) AS graph FROM o""",
    "prompt_truncation": """WITH c AS (SELECT doc_id, CASE WHEN 100 + length(text) + length(source) > 20000 THEN substr(text, 1, 20000 - 100 - length(source) - 500) || chr(10) || '[Context truncated...]' ELSE text END AS c FROM documents) SELECT doc_id, length(c)::INT AS n, md5(c) AS context_md5 FROM c""",
    "batch_summaries": """WITH a AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'Here: [Chunk 1]: ' || source WHEN 1 THEN '[Chunk 1]:  no_relevant_info. ' WHEN 2 THEN '[Chunk 1]:' WHEN 3 THEN '[Chunk 1] without colon  ' WHEN 4 THEN 'nothing' END || CASE WHEN doc_id % 4 < 2 THEN chr(10) || '[Chunk 2] note: a: ' || lang || chr(10) || '[Chunk 2]: again' ELSE chr(10) || '[Chunk 12]: other' END AS reply FROM documents),
c AS (SELECT doc_id, reply, unnest([source, lang, text]) AS chunk_text, unnest([1, 2, 3]) AS chunk FROM a), l AS (SELECT *, list_filter(string_split(reply, chr(10)), lambda x: contains(x, '[Chunk ' || chunk || ']'))[1] AS line FROM c),
s AS (SELECT *, trim(CASE WHEN contains(line, ':') THEN substr(line, strpos(line, ':') + 1) ELSE line END) AS summary FROM l)
SELECT doc_id, chunk, md5(coalesce(summary, chunk_text)) AS text_md5, summary IS NOT NULL AS summarized FROM s WHERE summary IS NULL OR (summary <> '' AND NOT contains(upper(summary), 'NO_RELEVANT_INFO'))""",
    "idempotent_events": """WITH RECURSIVE e AS (SELECT event_id, user_id || event_type AS k, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, k, ts, rn, ts AS since, 'first' AS outcome FROM e WHERE rn = 1
 UNION ALL SELECT e.event_id, e.k, e.ts, e.rn, CASE WHEN e.ts - f.since <= INTERVAL 7 DAY THEN f.since ELSE e.ts END, CASE WHEN e.ts - f.since <= INTERVAL 7 DAY THEN 'replay' ELSE 'first' END FROM f JOIN e ON e.k = f.k AND e.rn = f.rn + 1)
SELECT event_id, outcome FROM f""",
    "session_gaps": """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, (sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM g""",
    "session_windows": """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.n""",
    "token_bucket": f"""WITH RECURSIVE {_SEQ},
b AS (SELECT user_id, rn, event_id, t, true AS allowed, 2.0::DOUBLE AS tokens FROM e WHERE rn = 1
 UNION ALL SELECT user_id, rn, event_id, t, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END FROM (SELECT e.user_id, e.rn, e.event_id, e.t, least(3.0::DOUBLE, b.tokens + (e.t - b.t) * (1.0::DOUBLE / 86400)) AS have FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1))
SELECT event_id, allowed, greatest(0, floor(tokens))::BIGINT AS remaining FROM b""",
    "circuit_breaker": f"""WITH RECURSIVE {_SEQ.replace("SELECT *,", "SELECT *, event_type <> 'error' AS ok,")},
c AS (SELECT user_id, rn, event_id, 'closed' AS s, 0 AS failed, -1.0::DOUBLE AS lastf, 0 AS probing, 0 AS good, true AS admitted FROM (SELECT DISTINCT user_id, 0 AS rn, NULL::BIGINT AS event_id FROM e)
 UNION ALL SELECT user_id, rn, event_id, CASE WHEN admitted AND ok AND s = 'half_open' AND good + 1 >= 2 THEN 'closed' WHEN admitted AND NOT ok AND (s = 'half_open' OR failed + 1 >= 2) THEN 'open' ELSE s END,
  CASE WHEN admitted AND ok AND s = 'half_open' AND good + 1 >= 2 THEN 0 WHEN admitted AND NOT ok THEN failed + 1 ELSE failed END, CASE WHEN admitted AND NOT ok THEN t ELSE lastf END,
  CASE WHEN admitted AND s = 'half_open' THEN probing + 1 ELSE probing END, CASE WHEN admitted AND ok AND s = 'half_open' THEN good + 1 ELSE good END, admitted
 FROM (SELECT *, s = 'closed' OR s = 'half_open' AND probing < 3 AS admitted FROM (SELECT e.user_id, e.rn, e.event_id, e.t, e.ok, CASE WHEN c.s = 'open' AND e.t - c.lastf >= 259200 THEN 'half_open' ELSE c.s END AS s, c.failed, c.lastf,
   CASE WHEN c.s = 'open' AND e.t - c.lastf >= 259200 THEN 0 ELSE c.probing END AS probing, CASE WHEN c.s = 'open' AND e.t - c.lastf >= 259200 THEN 0 ELSE c.good END AS good FROM c JOIN e ON e.user_id = c.user_id AND e.rn = c.rn + 1)))
SELECT event_id, admitted, s AS state FROM c WHERE rn > 0""",
    "lifecycle_apply": f"""WITH RECURSIVE {_SEQ.replace("SELECT *,", "SELECT *, CASE event_type WHEN 'purchase' THEN 'indexed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS target, CASE WHEN event_id % 7 = 0 THEN 'processing' END AS expected,")},
c AS (SELECT user_id, rn, event_id, NULL::VARCHAR AS previous, 'registered' AS state, 0::BIGINT AS version, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT user_id, 0 AS rn, NULL::BIGINT AS event_id FROM e)
 UNION ALL SELECT user_id, rn, event_id, p, CASE WHEN o = 'applied' THEN target ELSE p END, version + (o = 'applied')::INT, o FROM (SELECT e.user_id, e.rn, e.event_id, e.target, c.version, c.state AS p,
  CASE WHEN e.expected IS NOT NULL AND e.expected <> c.state THEN 'conflict' WHEN (c.state || '>' || e.target) IN ('registered>processing', 'processing>indexed', 'processing>failed', 'failed>processing') THEN 'applied' ELSE 'invalid' END AS o FROM c JOIN e ON e.user_id = c.user_id AND e.rn = c.rn + 1))
SELECT event_id, previous, state, version, outcome FROM c WHERE rn > 0""",
    "retry_schedule": """WITH r AS (SELECT event_id, event_id % 6 AS n, CASE WHEN event_id % 10 = 0 THEN 'dead' WHEN event_type <> 'error' THEN 'done' WHEN event_id % 6 >= 3 THEN 'dead' ELSE 'retry' END AS route FROM events)
SELECT event_id, route, CASE WHEN route = 'retry' THEN least(600.0::DOUBLE, 60 * pow(2.0::DOUBLE, n - 1)) END AS delay FROM r""",
    "dead_letters": """SELECT CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE '{"document_id":"' || event_id || '"}' END AS original, (event_id % 6)::INT AS retries, count(*) AS n FROM events WHERE event_id % 10 = 0 OR (event_type = 'error' AND event_id % 6 >= 3) GROUP BY ALL""",
    "last_job_update": "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "late_split": "SELECT event_type, count(*) AS n, CASE WHEN ts < TIMESTAMP '2024-01-14 23:00:00' THEN 'late' ELSE 'fresh' END AS side FROM events GROUP BY ALL",
    "rate_limit_keys": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'user:' || user_id WHEN 1 THEN 'key:' || md5(user_id::VARCHAR) WHEN 2 THEN 'ip:10.0.0.' || user_id ELSE CASE WHEN event_id % 8 = 3 THEN 'ip:9.9.9.9' ELSE 'ip:unknown' END END AS key FROM events""",
}
