"""Queries that SQL can't express, whole, against plain versions."""

import hashlib
import re

import numpy as np

from loomspark import values as V
from loomspark.functions.text import normalize_title
from loomspark.operators import dense, extract, fusion, graph, ingest, registry, segment, sparse
from loomspark.plans import catalog, dialogue, ingestion, knowledge, retrieval
from loomspark.sources import files
from loomspark.streaming import stateful
from pyspark.sql import functions as F


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def _packed(text, start, end, most=V.CHUNK_MAX, overlap=V.CHUNK_OVERLAP, least=V.CHUNK_MIN):
    """(text, start, end, words) of a section's chunks, sentence by sentence."""
    words = lambda t: len(re.findall(r"\S+", t))
    if words(text) <= most:
        return [(text, start, end, words(text))]
    out, held, n, at = [], "", 0, start
    for s in re.split(r"(?<=[.!?])\s+", text):
        if not s.strip():
            continue
        if n + words(s) > most:
            if held and n >= least:
                out.append((held.strip(), at, at + len(held), n))
            tail = re.findall(r"\S+", held)
            held = (held if len(tail) <= overlap else " ".join(tail[-overlap:]) + " ") + s
            n, at = words(held), end - len(held)
        else:
            held, n = held + s, n + words(s)
    return out + ([(held.strip(), at, end, n)] if held and n >= least else [])


def test_chunk_documents(spark, sf_dir):
    sections = {}
    for x in knowledge._sections(spark, sf_dir).collect():
        sections.setdefault(x["id"], []).append(x)
    want = set()
    for i, found in sections.items():
        live = [s for s in sorted(found, key=lambda s: s["section_no"]) if s["section_type"] != "references" and s["text"].strip()]
        chunks = [(s["section_type"], *c) for s in live for c in _packed(s["text"], s["char_offset_start"], s["char_offset_end"])]
        want |= {(i, n, *c) for n, c in enumerate(chunks)}
    got = knowledge.chunk_documents(spark, sf_dir).collect()
    assert {tuple(x[c] for c in ("doc_id", "sequence", "section_type", "text", "char_start", "char_end", "tokens")) for x in got} == want and len(got) == len(want)


def test_fuzzy_titles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(x["doc_id"], x["t"], ord(x["lang"][0])) for x in docs.select("doc_id", "lang", normalize_title(F.substring_index("text", "\n", 1)).alias("t")).collect()]
    want = {}
    for i, t, y in rows:
        if i % 100 == 0:
            best = max((round(registry._ratio(t, u), 12), -j) for j, u, z in rows if z == y)
            want[i] = (-best[1], round(best[0], 6)) if best[0] >= 0.9 else None
    got = {x["request_id"]: (x["document_id"], x["ratio"]) for x in catalog.fuzzy_titles(spark, sf_dir).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_mmr_select(spark, sf_dir):
    vectors = {x["vec_id"]: np.array(x["embedding"], float) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    got = {(x["qid"], x["mmr_rank"]): x["id"] for x in retrieval.mmr_select(spark, sf_dir).collect()}
    want = {}
    for q in (i for i in vectors if i % 100 == 0):
        top = sorted(((-round(float(unit[q] @ unit[i]), 6), i) for i in vectors))[: V.SEARCH_K]
        score, rest, picked = {i: -s for s, i in top}, [i for _, i in top], []
        while len(picked) < V.RERANK_K:
            value = [0.7 * score[i] - (0.3 * max(float(unit[i] @ unit[j]) for j in picked) if picked else 0) for i in rest]
            picked.append(rest.pop(int(np.argmax(value))))
            want[q, len(picked)] = picked[-1]
    assert got == want


def test_token_stream(spark, sf_dir):
    want = set()
    for x in dialogue._answers(spark, sf_dir).collect():
        deltas, held, out = [x["a"][i : i + 7] for i in range(0, len(x["a"]), 7)], "", []
        for d in deltas:
            held += d
            m = re.search(r"\[(\d+)\]", held)
            if m:
                out += ([("text", held[: m.start()])] if m.start() else []) + [("citation", m[1])]
                held = held[m.end() :]
            elif len(held) > 50:
                out.append(("text", held))
                held = ""
        out += [("text", held)] if held else []
        want |= {(f"{x['conv_id']}-{x['turn']}", n, k, p) for n, (k, p) in enumerate(out)}
    got = dialogue.token_stream(spark, sf_dir).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_ingest_points_and_reprocessing(spark, sf_dir):
    got = {x["chunk_id"]: x for x in ingestion.ingest_points(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 20 > 0 and doc_id % 30 <> 7")
    chunks = segment.chunk_sections(segment.segment_text(docs, "doc_id", "text")).collect()
    want = {f"{x['id']}-{x['sequence']}": (x["id"], x["section_type"], x["tokens"], md5(x["text"]), 64) for x in chunks}
    assert {k: (x["document_id"], x["section"], x["tokens"], x["text_md5"], x["dims"]) for k, x in got.items()} == want
    parsed = docs.limit(5).select(F.col("doc_id").alias("id"), F.col("text").alias("full_text"), F.lit(None).cast("array<struct<section_type:string,title:string,text:string,char_offset_start:int,char_offset_end:int>>").alias("sections"), F.lit(None).cast("string").alias("error"))
    first = ingest.ingest(parsed)
    again = ingest.ingest(parsed, encoder=dense.HashingEncoder(8), from_stage="embed", before=first)
    assert {len(x["embedding"]) for x in again.points.collect()} == {8} and again.points.count() == first.points.count()
    assert {x["status"] for x in again.outcomes.collect()} == {"indexed"}


def test_plans_keep_to_the_matched_terms_and_blocks(spark, sf_dir, tmp_path):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    sparse.write_statistics(docs, f"{tmp_path}/s")
    plan = sparse.search(docs, items, 5, statistics=sparse.read_statistics(spark, f"{tmp_path}/s"))._jdf.queryExecution().executedPlan().toString()
    # read from the scan up: the tokens meet the questions' terms before they are shuffled
    above = plan[: plan.index("documents.parquet")]
    assert above.rindex("LeftSemi") > above.rindex("Exchange hashpartitioning(id") and plan.count("documents.parquet") == 1
    given = sparse.search(docs, items, 5, statistics=sparse.read_statistics(spark, f"{tmp_path}/s")).collect()
    assert sorted(map(tuple, given)) == sorted(map(tuple, sparse.search(docs, items, 5).collect()))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = dense.search(vectors, vectors.where("vec_id % 2 = 0"), 5, query_block=7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_dense_search_beyond_the_sent_queries(spark, monkeypatch):
    r = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in r.normal(size=6)]) for i in range(150)], "vec_id long, embedding array<float>").repartition(4)
    want = sorted(map(tuple, dense.search(vectors, vectors, 3).collect()))
    monkeypatch.setattr(dense, "SENT_QUERIES", 5)
    monkeypatch.setattr(sparse, "SENT_TERMS", 0)
    assert sorted(map(tuple, dense.search(vectors, vectors, 3, query_block=11).collect())) == want


def test_subgraph_of_hubs_against_plain_search(spark):
    r = np.random.default_rng(4)
    links = {(f"n{a}", f"n{b}") for a, b in r.integers(0, 60, (90, 2)) if a != b} | {("hub", f"n{i}") for i in range(60)} | {(f"n{i}", "hub2") for i in range(0, 60, 2)}
    edges = spark.createDataFrame([(a, b, "x", 0.9) for a, b in links], "source_id string, target_id string, relationship_type string, confidence double")
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    centers = ["n1", "n2", "hub", "lonely"]
    for most, depth in ((5, 2), (12, 3), (40, 2), (200, 3)):
        want = set()
        for c in centers:
            seen, front = {c: 0}, [c]
            for hop in range(1, depth + 1):
                front = sorted({b for a in front for b in near.get(a, ()) if b not in seen})
                seen.update(dict.fromkeys(front, hop))
            want |= {(c, n, h) for n, h in sorted(seen.items(), key=lambda x: (x[1], x[0]))[:most]}
        nodes, lines = graph.subgraph(edges, spark.createDataFrame([(c,) for c in centers], "center string"), depth, 0.5, most)
        assert {tuple(x) for x in nodes.collect()} == want
        inside = {c: {n for d, n, _ in want if d == c} for c in centers}
        assert sorted(tuple(x)[:3] for x in lines.collect()) == sorted((c, a, b) for c in centers for a, b in links if a in inside[c] and b in inside[c])


def test_shared_entities_with_a_hot_one(spark):
    r = np.random.default_rng(5)
    rows = {(int(d), int(e)) for d, e in zip(r.integers(0, 80, 500), r.integers(0, 40, 500), strict=True)} | {(d, 99) for d in range(80)}
    mentions = spark.createDataFrame(list(rows), "document_id long, entity long")
    own = {d: {e for x, e in rows if x == d} for d in range(80)}
    for least, limit in ((1, 3), (2, 5), (3, None)):
        got = graph.shared_entities(mentions, spark.createDataFrame([(1,), (2,)], "seed long"), least, limit).collect()
        want = set()
        for s in (1, 2):
            found = sorted((-len(own[s] & own[d]), d) for d in own if d != s and len(own[s] & own[d]) >= least)
            want |= {(s, d, -n, tuple(sorted(own[s] & own[d]))) for n, d in found[:limit]}
        assert {(x["seed"], x["document_id"], x["n_shared"], tuple(x["entities"])) for x in got} == want


def test_short_tables_page(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(7)], "k long, at long")
    page = registry.keyset_page(rows, "at", "k", 5)
    after = [x["k"] for x in registry.page_after(rows, "at", "k", 5, page).collect()]
    assert after == [3, 0] and registry.page_after(rows.where("k < 3"), "at", "k", 5, registry.keyset_page(rows.where("k < 3"), "at", "k", 5)).collect() == []
    assert registry.page_after(rows.where("false"), "at", "k", 5, registry.keyset_page(rows.where("false"), "at", "k", 5)).collect() == []


def test_insert_or_get_takes_every_null_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b")], "n long, k string")
    table, marked = registry.insert_or_get(rows, spark.createDataFrame([(0, "b")], "n long, k string"), "k", "n")
    assert {x["n"]: x["__created"] for x in marked.collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}
    assert sorted(x["n"] for x in table.collect()) == [0, 1, 2, 4]


def test_extraction_job_isolates_bad_chunks(spark):
    chunks = spark.createDataFrame([("a", "d1", "The solar wind meets the " + "bow  shock near the magnetosphere of the planet."), ("b", "d1", None), ("c", "d2", None)], "chunk_id string, document_id string, text string")
    _, _, out = extract.extraction_job(chunks)
    assert {x["document_id"]: (x["n_chunks"], x["n_errors"], x["n_entities"], x["status"]) for x in out.collect()} == {"d1": (2, 1, 3, "completed"), "d2": (1, 1, 0, "failed")}


def test_batches_are_sent_apart(spark):
    def sender(batch):
        if any(m["body"] == "poison" for m in batch):
            raise RuntimeError("refused")
        return [m["id"] for m in batch if m["body"] != "no"]

    rows = spark.createDataFrame([(i, "poison" if i == 4 else "no" if i % 3 == 0 else "yes") for i in range(12)], "n long, body string").coalesce(1)
    got = {int(x["id"]): x["sent"] for x in stateful.send_batches(rows, "n", "body", sender, 3).collect()}
    assert got == {i: i % 3 > 0 and i not in (3, 4, 5) for i in range(12)}


def test_model_reranker_and_pdf_reader_plug_in(spark, tmp_path):
    hits = spark.createDataFrame([(1, i, i, "q", "x" * i) for i in range(1, 6)], "qid long, id long, rank int, question string, text string")
    best = fusion.rerank(hits, 2, lambda q, t: t.str.len().astype("float64"), model=True).collect()
    assert [x["id"] for x in sorted(best, key=lambda x: x["rerank_rank"])] == [5, 4]
    assert [x["id"] for x in sorted(fusion.rerank(hits, 2).collect(), key=lambda x: x["rerank_rank"])] == [1, 2]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Title (A Study) /Author () /Type /Page (Hello) Tj (world) Tj /Type /Page (Two) Tj")
    (tmp_path / "b.pdf").write_bytes(b"")
    made = {x["path"][-5:]: x for x in files.pdf_extract(files.objects(spark, str(tmp_path))).collect()}
    assert (made["a.pdf"]["text"], made["a.pdf"]["first_page"], made["a.pdf"]["page_count"], made["a.pdf"]["metadata"]) == ("Hello world\n\nTwo", "Hello world", 2, {"title": "A Study"})
    broken = files.pdf_extract(files.objects(spark, str(tmp_path)), lambda content: {}["pages"]).collect()
    assert all(x["error"] and x["text"] is None for x in broken)
