"""Payloads of four literature services as one result schema. Rows hold one JSON item each; no network is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import normalize_doi, split_name

AUTHORS = "array<struct<given_name:string,family_name:string>>"
#: Columns of a search result.
RESULT_COLUMNS = ("source", "external_id", "title", "authors", "year", "doi", "arxiv_id", "abstract", "journal", "pdf_url", "url", "source_metadata", "relevance_score")

_CROSSREF = (
    "DOI string, URL string, title array<string>, author array<struct<given:string,family:string,name:string>>, "
    "`published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>, "
    "`container-title` array<string>, abstract string, link array<struct<URL:string,`content-type`:string>>, type string, publisher string"
)
_SCHOLAR = (
    "paperId string, externalIds struct<DOI:string,ArXiv:string>, title string, abstract string, year int, authors array<struct<name:string>>, venue string, "
    "publicationVenue struct<name:string>, citationCount int, referenceCount int, isOpenAccess boolean, openAccessPdf struct<url:string>"
)
_ARXIV = (
    "id string, title string, summary string, published string, authors array<struct<name:string>>, links array<struct<href:string,type:string>>, "
    "tags array<struct<term:string>>, arxiv_primary_category struct<term:string>, arxiv_doi string, arxiv_journal_ref string"
)
_ADS = (
    "bibcode string, title array<string>, author array<string>, year string, doi array<string>, abstract string, pub string, citation_count int, read_count int, "
    "esources array<string>, property array<string>, identifier array<string>"
)


def _first(items: Column, default: str | None = None) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(default))


def _names(items: Column, style: str) -> Column:
    def one(name: Column) -> Column:
        given, family = split_name(name, style)
        return F.struct(given.alias("given_name"), family.alias("family_name"))

    return F.coalesce(F.transform(items, one), F.array().cast(AUTHORS))


def _metadata(**items: Column) -> Column:
    """A string map of the items that are there."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in items.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _result(rows: DataFrame, source: str, keep: list[str], **columns: Column) -> DataFrame:
    nothing = F.lit(None).cast("string")
    made = {"source": F.lit(source), "arxiv_id": nothing, "relevance_score": F.lit(None).cast("double")} | columns
    return rows.select(*keep, *(made[c].alias(c) for c in RESULT_COLUMNS))


def crossref(items: DataFrame, payload: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Works: the year from print, online or creation date; the first PDF link."""
    rows = items.withColumn("i", F.from_json(payload, _CROSSREF))
    i = F.col("i")
    part = lambda name: F.get(F.get(i[name]["date-parts"], F.lit(0)), F.lit(0))
    pdf = F.get(F.filter(i["link"], lambda x: x["content-type"] == "application/pdf"), F.lit(0))["URL"]
    people = F.coalesce(F.transform(i["author"], lambda a: F.struct(a["given"].alias("given_name"), F.coalesce(a["family"], a["name"], F.lit("Unknown")).alias("family_name"))), F.array().cast(AUTHORS))
    return _result(
        rows, "crossref", list(keep), external_id=F.coalesce(i["DOI"], i["URL"], F.lit("")), title=_first(i["title"], "Untitled"), authors=people,
        year=F.coalesce(part("published-print"), part("published-online"), part("created")), doi=i["DOI"], abstract=i["abstract"], journal=_first(i["container-title"]),
        pdf_url=pdf, url=F.when(F.length(i["DOI"]) > 0, F.concat(F.lit("https://doi.org/"), i["DOI"])), source_metadata=_metadata(type=i["type"], publisher=i["publisher"]),
    )


def semantic_scholar(items: DataFrame, payload: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Papers: PDF only where access is open, the venue's own name before the free-text one."""
    rows = items.withColumn("i", F.from_json(payload, _SCHOLAR))
    i = F.col("i")
    venue = F.coalesce(i["publicationVenue"]["name"], i["venue"])
    paper = F.coalesce(i["paperId"], F.lit(""))
    return _result(
        rows, "semantic_scholar", list(keep), external_id=paper, title=F.coalesce(i["title"], F.lit("Untitled")), authors=_names(F.transform(i["authors"], lambda a: a["name"]), "first_token"),
        year=i["year"], doi=i["externalIds"]["DOI"], arxiv_id=i["externalIds"]["ArXiv"], abstract=i["abstract"], journal=F.when(F.length(venue) > 0, venue),
        pdf_url=F.when(i["isOpenAccess"], i["openAccessPdf"]["url"]), url=F.when(F.length(paper) > 0, F.concat(F.lit("https://www.semanticscholar.org/paper/"), paper)),
        source_metadata=_metadata(arxiv_id=i["externalIds"]["ArXiv"], citation_count=i["citationCount"], reference_count=i["referenceCount"], is_open_access=i["isOpenAccess"]),
    )


def arxiv(items: DataFrame, payload: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Entries: the id without version, a PDF address made from it where no link is given."""
    rows = items.withColumn("i", F.from_json(payload, _ARXIV))
    i = F.col("i")
    found = F.regexp_extract(i["id"], r"arxiv\.org/abs/(.+?)(?:v\d+)?$", 1)
    key = F.when(F.length(found) > 0, found).otherwise(F.coalesce(i["id"], F.lit("")))
    flat = lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    pdf = F.get(F.filter(i["links"], lambda x: x["type"] == "application/pdf"), F.lit(0))["href"]
    year = F.when(F.length(i["published"]) >= 4, F.substring(i["published"], 1, 4).try_cast("int"))
    return _result(
        rows, "arxiv", list(keep), external_id=key, title=F.coalesce(flat(i["title"]), F.lit("Untitled")), authors=_names(F.transform(i["authors"], lambda a: a["name"]), "last_token"), year=year,
        doi=i["arxiv_doi"], arxiv_id=key, abstract=flat(F.coalesce(i["summary"], F.lit(""))), journal=i["arxiv_journal_ref"],
        pdf_url=F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), key, F.lit(".pdf"))), url=F.concat(F.lit("https://arxiv.org/abs/"), key),
        source_metadata=_metadata(arxiv_id=key, categories=F.array_join(F.transform(i["tags"], lambda t: t["term"]), ","), primary_category=i["arxiv_primary_category"]["term"]),
    )


def ads(items: DataFrame, payload: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Documents of the astrophysics service: first title and DOI, PDF by its resolver, else from the arXiv id."""
    rows = items.withColumn("i", F.from_json(payload, _ADS))
    i = F.col("i")
    bib = F.coalesce(i["bibcode"], F.lit(""))
    preprint = F.substring(F.get(F.filter(i["identifier"], lambda x: x.startswith("arXiv:")), F.lit(0)), 7, 1000)
    own = F.coalesce(F.array_contains(i["esources"], "PUB_PDF") | F.array_contains(i["esources"], "EPRINT_PDF"), F.lit(False))
    pdf = F.when(own, F.concat(F.lit("https://ui.adsabs.harvard.edu/link_gateway/"), bib, F.lit("/PUB_PDF"))).when(preprint.isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), preprint, F.lit(".pdf")))
    return _result(
        rows, "scixplorer", list(keep), external_id=bib, title=_first(i["title"], "Untitled"), authors=_names(i["author"], "comma"), year=i["year"].try_cast("int"), doi=_first(i["doi"]), arxiv_id=preprint,
        abstract=i["abstract"], journal=i["pub"], pdf_url=pdf, url=F.when(F.length(bib) > 0, F.concat(F.lit("https://ui.adsabs.harvard.edu/abs/"), bib, F.lit("/abstract"))),
        source_metadata=_metadata(bibcode=bib, arxiv_id=preprint, citation_count=i["citation_count"], read_count=i["read_count"]),
    )


PARSERS = {"crossref": crossref, "semantic_scholar": semantic_scholar, "arxiv": arxiv, "scixplorer": ads}


def explode_items(responses: DataFrame, body: str, path: str) -> DataFrame:
    """One row (payload, position) for each item of the array at a dotted path of a JSON response."""
    items = F.from_json(F.get_json_object(body, f"$.{path}"), "array<string>")
    return responses.select(F.posexplode(items).alias("position", "payload"))


def linked_papers(responses: DataFrame, body: str, side: str) -> DataFrame:
    """Papers of a citations (citingPaper) or references (citedPaper) response."""
    items = explode_items(responses, body, "data")
    return semantic_scholar(items.select("position", F.get_json_object("payload", f"$.{side}").alias("payload")).where("payload is not null"), keep=["position"])


def year_filter(results: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Results of the years asked for; those without a year pass."""
    if first is not None:
        results = results.where(F.col("year").isNull() | (F.col("year") >= first))
    if last is not None:
        results = results.where(F.col("year").isNull() | (F.col("year") <= last))
    return results


def request_filters(first: int | None, last: int | None) -> dict[str, str | None]:
    """How each service is told about years; an open end is a star, or left out."""
    if first is None and last is None:
        return dict.fromkeys(PARSERS)
    a, b = first if first is not None else "*", last if last is not None else "*"
    from_, until = (f"{first}-01-01" if first is not None else "*"), (f"{last}-12-31" if last is not None else "*")
    dash = f"{'' if first is None else first}-{'' if last is None else last}"
    return {"crossref": f"from-pub-date:{from_},until-pub-date:{until}", "semantic_scholar": dash, "arxiv": None, "scixplorer": f"year:[{a} TO {b}]"}


def cited_by(responses: DataFrame, doi: str, body: str, most: int = 100) -> DataFrame:
    """responses(doi asked for, body of a works listing) -> (cited, doi): DOIs of the papers that cite each one, as the
    listing orders them; items without DOI and unreadable responses give none."""
    items = F.from_json(F.get_json_object(body, "$.message.items"), "array<struct<DOI:string>>")
    rows = responses.select(F.col(doi).alias("cited"), F.posexplode(F.slice(items, 1, most)).alias("position", "i"))
    return rows.where(F.length("i.DOI") > 0).select("cited", "position", F.col("i.DOI").alias("doi"))


def works_by_doi(responses: DataFrame, doi: str, body: str) -> DataFrame:
    """responses(doi asked for, body of a single work) -> a search result each, under the normalised DOI asked for."""
    rows = responses.select(normalize_doi(F.col(doi)).alias("asked"), F.get_json_object(body, "$.message").alias("payload"))
    return crossref(rows.where("payload is not null and length(asked) > 0"), keep=["asked"])
