"""Small fixtures with known answers, and operators that SQL does not express."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import dense, registry, segment
from loomspark.plans import catalog
from loomspark.sources import connectors, files
from loomspark.streaming import stateful


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalisers(spark):
    titles = {"Test Document: A Study!": "test document a study", "Magnétic   Ñandú": "magnetic nandu", "multi-word_title": "multi word title", "": "", "  x ": "x"}
    assert {t: _one(spark, X.normalize_title(F.lit(t))) for t in titles} == titles
    dois = {"10.1/A": "10.1/a", "https://doi.org/10.1/a": "10.1/a", "http://dx.doi.org/10.1/a": "10.1/a", "doi:10.1/a": "10.1/a", "": None, " 10.1/a ": "10.1/a"}
    assert {t: _one(spark, X.normalize_doi(F.lit(t))) for t in dois} == dois
    assert _one(spark, X.normalize_author(F.lit("O'Brien,  Ann-Lee"))) == "obrien annlee"


def test_headers(spark):
    lines = {"1. Introduction": "Introduction", "2.1 Methods": "Methods", "IV. Results": "Results", "INTRODUCTION": "INTRODUCTION", "METHODS AND MATERIALS": "METHODS AND MATERIALS", "ABC": None, "This is regular text.": None, "": None}
    assert {t: _one(spark, X.header_title(F.lit(t))) for t in lines} == lines
    assert _one(spark, X.header_title(F.lit("only letters here"), strict_caps=True)) is None
    kinds = {"Summary": "abstract", "Observations": "methods", "Related": "other", "Future Work": "conclusion"}
    assert {t: _one(spark, X.section_type(F.lit(t))) for t in kinds} == kinds


def _common(a, b):
    row = np.zeros(len(b) + 1, int)
    for x in a:
        up = row.copy()
        for j, y in enumerate(b):
            row[j + 1] = up[j] + 1 if x == y else max(row[j], up[j + 1])
    return int(row[-1])


def test_indel_ratio_against_plain_table():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé ") for _ in range(r.randint(0, 70))) for _ in range(2))
        want = 2 * _common(a, b) / (len(a) + len(b)) if a and b else float(a == b)
        assert abs(registry._ratio(a, b) - want) < 1e-12


@pytest.mark.parametrize("threshold", [0.6, 0.875, 0.9, 0.97, 1.0])
def test_similar_titles_of_all_lengths(spark, monkeypatch, threshold):
    monkeypatch.setattr(registry, "GRAM_TITLES", (9, 40))
    monkeypatch.setattr(registry, "TITLE_BLOCK", 7)
    r = random.Random(7)
    titles = ["".join(r.choice("aab ") for _ in range(r.randint(0, 70))) for _ in range(60)]
    for t in list(titles):
        for n in (1, 2, 4, 7):
            u = list(t)
            for _ in range(n):
                at = r.randint(0, len(u))
                u[at : at + r.randint(0, 1)] = r.choice(["", "a", "x", "b"])
            titles.append("".join(u))
    rows = [(i, t, 2000 + i % 2) for i, t in enumerate(titles + titles[:20])]
    asked = spark.createDataFrame([(i, t, y) for i, t, y in rows if i % 3 == 0] + [(900, None, 2000), (901, "aab", None)], "request_id long, title string, year int")
    held = spark.createDataFrame([(i, t, y) for i, t, y in rows if i % 3 > 0] + [(1, None, 2001)], "document_id long, title string, year int")
    want = {}
    for i, t, y in rows:
        if i % 3 == 0:
            ratio, j = max((registry._ratio(t, u), -j) for j, u, z in rows if j % 3 > 0 and z == y)
            if ratio >= threshold:
                want[i] = (-j, ratio)
    assert {x["request_id"]: (x["document_id"], x["ratio"]) for x in registry.fuzzy_matches(asked, held, threshold).collect()} == want
    assert want


def test_long_titles_are_seldom_compared(monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("etaoinsrhl") for _ in range(r.randint(2, 6))) for _ in range(300)]
    titles = [" ".join(r.choice(words) for _ in range(120))[:300] for _ in range(40)]
    near = [t[:40] + "xyz" + t[55:] for t in titles[:10]]
    compared, ratio = [], registry._ratio
    monkeypatch.setattr(registry, "_ratio", lambda *a: compared.append(a) or ratio(*a))
    got = {(i, j) for i, j, _ in registry._best_of_block(list(range(20)), titles[:20], list(range(30)), near + titles[20:], 0.9, (9, 48))}
    assert got == {(i, i) for i in range(10)} and len(compared) < 30


def test_ratio_that_ends_early_is_below_the_least():
    r = random.Random(5)
    for _ in range(300):
        a = "".join(r.choice("ab c") for _ in range(r.randint(0, 300)))
        b = "".join(c for c in a if r.random() < 0.8) if r.random() < 0.5 else "".join(r.choice("ab c") for _ in range(r.randint(0, 300)))
        want = registry._ratio(a, b)
        for least in (0.5, 0.8, want):
            assert registry._ratio(a, b, least) == want if want >= least else registry._ratio(a, b, least) in (0.0, want)


def test_fuzzy_matches_lose_nothing(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randint(5, 60))) for _ in range(25)]
    noisy = [t[:i] + r.choice("xyz") + t[i + 1 :] for t in base for i in [r.randrange(len(t))]] + [t + "zz" for t in base]
    left = spark.createDataFrame([(i, t, 2000 + i % 2) for i, t in enumerate(base)], "request_id long, title string, year int")
    right = spark.createDataFrame([(i, t, 2000 + i % 2) for i, t in enumerate(noisy)], "document_id long, title string, year int")
    got = {x["request_id"]: (x["document_id"], round(x["ratio"], 9)) for x in registry.fuzzy_matches(left, right).collect()}
    want = {}
    for i, t in enumerate(base):
        best = max(((registry._ratio(t, u), -j) for j, u in enumerate(noisy) if j % 2 == i % 2), default=(0, 0))
        if best[0] >= 0.9:
            want[i] = (-best[1], round(best[0], 9))
    assert got == want


def test_whole_cascade_against_brute_force(spark, sf_dir):
    rows = {k: [x.asDict() for x in t.collect()] for k, t in zip(("new", "old"), catalog._requests(spark, sf_dir), strict=True)}
    want = {}
    for q in rows["new"]:
        probes = [(kind, min((o["document_id"] for o in rows["old"] if q[kind] is not None and o[kind] == q[kind]), default=None)) for kind in ("doi", "content_hash")]
        alike = [(registry._ratio(q["title"], o["title"]), -o["document_id"]) for o in rows["old"] if q["title"] is not None and o["title"] is not None and q["year"] is not None and o["year"] == q["year"]]
        best = max(alike, default=(0, 0))
        probes.append(("fuzzy_title", -best[1] if best[0] >= 0.9 else None))
        want[q["request_id"]] = next(((i, kind) for kind, i in probes if i is not None), (None, None))
    assert "fuzzy_title" in {k for _, k in want.values()}
    assert {x["request_id"]: (x["document_id"], x["match_type"]) for x in catalog.dedup_cascade_fuzzy(spark, sf_dir).collect()} == want
    made = {x["request_id"]: x for x in catalog.register_batch_fuzzy(spark, sf_dir).collect()}
    for i, (doc, kind) in want.items():
        if kind:
            assert (made[i]["document_id"], made[i]["status"], made[i]["match_type"]) == (doc, "duplicate", kind)
        else:
            assert made[i]["status"] == "created" or made[i]["match_type"] == "race_condition"


def test_register_runs_the_fuzzy_step(spark):
    schema = "long, doi string, content_hash string, title string, year int"
    asked = spark.createDataFrame([(1, "d9", "h9", "a study of dwarf galaxies", 2001), (2, None, "h8", "a study of dwarf galaxies", 2002)], f"request_id {schema}")
    held = spark.createDataFrame([(50, "d1", "h1", "a study of dwarf galaxy", 2001)], f"document_id {schema}")
    got = {x["request_id"]: tuple(x)[1:] for x in registry.register(asked, held).collect()}
    assert got == {1: (50, "duplicate", "fuzzy_title"), 2: (2, "created", None)}


def test_imports_known_by_external_id(spark):
    asked = spark.createDataFrame([(1, None), (2, "10.1/New"), (3, "10.1/OLD"), (4, None), (5, ""), (6, None), (7, None)], "request_id long, doi string").selectExpr("*", "null as arxiv_id", "null as bibcode", "'http://x' as url")
    found = [(1, "a1", "arxiv"), (2, "a1", "arxiv"), (3, "b9", "crossref"), (4, "a1", "crossref"), (5, "", "arxiv"), (6, None, "arxiv")]
    held = [(None, "a1", "arxiv"), (None, "a1", "arxiv"), ("10.1/old", "c3", "crossref"), ("", "", "arxiv"), (None, None, "arxiv")]
    got = registry.import_outcomes(asked, spark.createDataFrame(found, "request_id long, external_id string, source string"), spark.createDataFrame(held, "doi string, external_id string, source string"))
    want = {1: "DUPLICATE", 2: "DUPLICATE", 3: "DUPLICATE", 4: "IMPORTED", 5: "IMPORTED", 6: "IMPORTED", 7: "NOT_FOUND"}
    assert sorted((x["request_id"], x["import_status"]) for x in got.collect()) == sorted(want.items())


def _plain_chunks(text, most, overlap, least):
    """Sentence by sentence, the straightforward way."""
    words = lambda t: re.findall(r"\S+", t)
    if len(words(text)) <= most:
        return [text]
    out, held, n = [], "", 0
    for s in [x for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]:
        if n + len(words(s)) > most:
            if held and n >= least:
                out.append(held.strip())
            tail = words(held)
            held = (held if len(tail) <= overlap else " ".join(tail[-overlap:]) + " ") + s
            n = len(words(held))
        else:
            held, n = held + s, n + len(words(s))
    return out + ([held.strip()] if held and n >= least else [])


def test_chunks(spark):
    r = random.Random(3)
    for most, overlap, least in ((100, 10, 10), (20, 8, 5), (20, 2, 10)):
        packer = segment.Packer(most, overlap, least)
        for _ in range(60):
            text = " ".join(" ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 30))) + r.choice(".!?") for _ in range(r.randint(1, 15)))
            assert [c[0] for c in packer.pack(text, 5, 5 + len(text))] == _plain_chunks(text, most, overlap, least)
    rows = [("d", 1, "abstract", "Short abstract.", 0, 15), ("d", 2, "references", "[1] x", 17, 22), ("d", 3, "methods", " ".join(f"This is sentence number {i}." for i in range(50)), 24, 1500), ("d", 4, "other", " ", 1502, 1503)]
    docs = spark.createDataFrame(rows, "id string, section_no int, section_type string, text string, char_offset_start int, char_offset_end int")
    made = segment.chunk_sections(docs, segment.Packer(100, 10, 10)).orderBy("sequence").collect()
    assert [x["sequence"] for x in made] == list(range(len(made))) and len(made) > 2 and {x["section_type"] for x in made} == {"abstract", "methods"}


def test_merge_short_sections(spark):
    rows = [("d", [("abstract", "A", "x" * 30, 0, 30), ("methods", None, "y" * 200, 32, 232), ("results", "R", "z", 234, 235)])]
    docs = spark.createDataFrame(rows, "id string, s array<struct<section_type:string,title:string,text:string,char_offset_start:int,char_offset_end:int>>")
    got = docs.select(segment.merge_short(F.col("s")).alias("m")).first()["m"]
    assert [(s["section_type"], s["title"], len(s["text"]), s["char_offset_start"], s["char_offset_end"]) for s in got] == [("methods", "A", 232, 0, 232), ("results", "R", 1, 234, 235)]


def test_mmr_is_greedy():
    r = np.random.default_rng(1)
    rel, vec = r.random(12), r.normal(size=(12, 6))
    sim = dense.unit(vec) @ dense.unit(vec).T
    picked = [int(np.argmax(rel))]
    while len(picked) < 5:
        rest = [i for i in range(12) if i not in picked]
        picked.append(max(rest, key=lambda i: 0.7 * rel[i] - 0.3 * max(sim[i][j] for j in picked)))
    assert dense.mmr_order(rel, vec, 5) == picked and dense.mmr_order(rel, vec, 12) == list(range(12))


def test_dense_search_in_blocks(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(200)] + [(999, None), (1000, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    one = dense.search(vectors, vectors.where("vec_id < 20"), 5).collect()
    many = dense.search(vectors, vectors.where("vec_id < 20"), 5, query_block=3).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 100


def test_connectors_describe_the_same_paper(spark):
    payloads = {
        "crossref": '{"DOI":"10.1234/test.2024.001","title":["A Study"],"author":[{"given":"Ann","family":"Lee"}],"published-print":{"date-parts":[[2024,1,2]]},"container-title":["J"]}',
        "semantic_scholar": '{"paperId":"p","externalIds":{"DOI":"10.1234/test.2024.001","ArXiv":"2401.1"},"title":"A Study","year":2024,"authors":[{"name":"Ann Lee"}],"isOpenAccess":true,"openAccessPdf":{"url":"u"}}',
        "arxiv": '{"id":"http://arxiv.org/abs/2401.1v3","title":"A\\nStudy","published":"2024-01-01","authors":[{"name":"Ann Lee"}],"arxiv_doi":"10.1234/test.2024.001"}',
        "scixplorer": '{"bibcode":"b","title":["A Study"],"author":["Lee, Ann"],"year":"2024","doi":["10.1234/test.2024.001"],"identifier":["arXiv:2401.1"]}',
    }
    for name, payload in payloads.items():
        x = connectors.PARSERS[name](spark.createDataFrame([(payload,)], "payload string")).first()
        assert (x["source"], x["title"], x["year"], x["doi"]) == (name, "A Study", 2024, "10.1234/test.2024.001")
        assert [(a["given_name"], a["family_name"]) for a in x["authors"]] == [("Ann", "Lee")]
    broken = connectors.crossref(spark.createDataFrame([("{nonsense",), (None,)], "payload string")).collect()
    assert [x["title"] for x in broken] == ["Untitled", "Untitled"]
    assert connectors.request_filters(2000, None)["scixplorer"] == "year:[2000 TO *]"


def test_tei_and_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Type /Pages")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.PNG").write_bytes(b"\x89PNG\r\n\x1a\n")
    found = files.classify_files(files.objects(spark, str(tmp_path))).select(F.element_at(F.split("path", "/"), -1).alias("n"), "file_type", files.pdf_errors(F.col("content")).alias("e"), files.pdf_pages(F.col("content")).alias("p")).collect()
    assert {(x["n"], x["file_type"], x["e"], x["p"]) for x in found} == {("a.pdf", "pdf", None, 1), ("b.pdf", "pdf", "not_pdf", 0), ("c.PNG", "image", "not_pdf", 0)}
    got = files.parse_tei_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader/><text><body><div><head>Intro</head><p>One <b>two</b></p></div><div/></body></text></TEI>')
    assert got["full_text"] == "Intro One two" and got["sections"][0]["char_offset_end"] == 13 and got["error"] is None
    assert files.parse_tei_text("<broken")["error"] and files.parse_tei_text(None)["sections"] == []


def test_token_events():
    assert list(stateful.token_events(["Hello [", "1", "] there", "", " [2][3]"])) == [("text", "Hello "), ("citation", "1"), ("text", " there "), ("citation", "2"), ("text", "[3]")]
    assert list(stateful.token_events(["a" * 51, "b"])) == [("text", "a" * 51), ("text", "b")]
