"""Document registry: duplicate cascade, insert-or-get, lifecycle, listings, jobs, search-result merging."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark import values as V
from loomspark.functions.text import search_title

# --- duplicates ---


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _ratio(a: str | None, b: str | None, least: float = 0.0) -> float | None:
    """The ratio, or 0 as soon as it is known to be below `least`."""
    if a is None or b is None:
        return None
    if not a or not b:
        return 1.0 if a == b else 0.0
    # bit-parallel longest common subsequence: one word of len(a) bits, one step a character of b
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, need = full, least * (len(a) + len(b)) / 2 - 1e-9
    for k in range(0, len(b), 64):
        for c in b[k : k + 64]:
            hit = row & where.get(c, 0)
            row = (row + hit | row - hit) & full
        # the rest of b adds at most its length to what is in common before as much of the end of a
        rest = max(0, len(b) - k - 64)
        head = max(0, len(a) - rest)
        if head - (row & (1 << head) - 1).bit_count() + rest < need:
            return 0.0
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


#: Signs of a gram; lengths of titles that meet over rare grams, and the least threshold at which all of these keep one (other
#: titles meet over their length); the grams whose frequency is known where titles are ordered by it, others counting as rare.
GRAM, GRAM_TITLES, GRAM_THRESHOLD, KNOWN_GRAMS = 3, (9, 48), 0.875, 20_000
#: Titles of a block, signs of its grams, and most places that these are dealt to.
TITLE_BLOCK, LONG_GRAM, GRAM_PLACES = 256, 4, 1 << 17


def _lost_grams(length: Column, threshold: float) -> Column:
    """Most grams of a title that differ from the matching ones of a similar title.

    A title of n signs matches none of fewer than m = n * t / (2 - t), and none that is more than d = (1 - t) * (n + m)
    insertions and deletions away; a sign that is missing there costs GRAM grams, one more sign GRAM - 1. Of all partners
    the shortest costs most.
    """
    shortest = threshold / (2 - threshold)
    edits = (1 - threshold) * (1 + shortest)
    return F.floor(length * ((GRAM - 0.5) * edits + 0.5 * (1 - shortest)) + 1e-9)


def _rare_grams(titles: DataFrame, frequent: DataFrame, threshold: float) -> DataFrame:
    """(n, year, title, gram, at): of each title the rarest grams, one more than can be lost, in the order of all titles."""
    starts = F.sequence(F.lit(1), F.length("title") - GRAM + 1)
    grams = titles.select("n", "year", "title", F.posexplode(F.transform(starts, lambda i: F.substring("title", i, GRAM))).alias("at", "gram"))
    order = Window.partitionBy("n").orderBy(F.coalesce("df", F.lit(0)), "gram", "at")
    placed = grams.join(F.broadcast(frequent), "gram", "left").withColumn("place", F.row_number().over(order))  # at most KNOWN_GRAMS rows
    return placed.where(F.col("place") <= _lost_grams(F.length("title"), threshold) + 1).select("n", "year", "title", "gram", "at")


def _gram_hashes(title: str) -> np.ndarray:
    signs = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = np.zeros(max(0, len(signs) - LONG_GRAM + 1), np.uint64)
    for i in range(LONG_GRAM if len(mixed) else 0):
        mixed = (mixed ^ signs[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _gram_places(grams: np.ndarray, width: int, places: int, step: int = 0) -> np.ndarray:
    """Places of grams by themselves and by the stretch of `width` signs they stand in, or one that is `step` further on."""
    stretch = (np.arange(len(grams)) // width + step + 1).astype(np.uint64)
    mixed = (grams ^ stretch) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(places)).astype(np.int64)


def _title_blocks(rows: DataFrame, names: tuple[str, str]) -> DataFrame:
    """rows(n, year, bin, title) in lists of up to TITLE_BLOCK of the same year and bin, put together within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, tuple[list, list]] = {}
            for n, year, bin_, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ns, titles = groups.setdefault((year, bin_), ([], []))
                ns.append(n)
                titles.append(title)
            cut = [(*key, ns[i : i + TITLE_BLOCK], titles[i : i + TITLE_BLOCK]) for key, (ns, titles) in groups.items() for i in range(0, len(ns), TITLE_BLOCK)]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in cut], kind) for i, kind in enumerate(kinds)], ["year", "bin", *names])

    plain = rows.select("n", F.col("year").cast("int").alias("year"), F.col("bin").cast("long").alias("bin"), "title").sortWithinPartitions("year", "bin", F.length("title"))
    return plain.mapInArrow(run, f"year int, bin long, {names[0]} array<long>, {names[1]} array<string>")


def _best_of_block(ns1: list[int], titles1: list[str], ns2: list[int], titles2: list[str], threshold: float, inside: tuple[int, int]) -> Iterator[tuple[int, int, float]]:
    """(n1, n2, ratio) of the best partner of each title that has one; pairs of two titles of lengths inside are left out.

    A pair is compared if it has as many grams in common, at about the same place, as its distance leaves at least. Signs that
    match are at most half the distance and half the difference of lengths apart, so in the same stretch of that width or in the next.
    Grams that share a place only raise what two titles have in common.
    """
    lengths1, lengths2 = (np.array([len(t) for t in titles]) for titles in (titles1, titles2))
    total, least = lengths1[:, None] + lengths2, np.minimum(lengths1[:, None], lengths2)
    fits = 2 * least >= threshold * total - 1e-9
    if inside[1] >= inside[0]:
        fits &= ~(((lengths1 >= inside[0]) & (lengths1 <= inside[1]))[:, None] & (lengths2 >= inside[0]) & (lengths2 <= inside[1]))
    if not fits.any():
        return
    longer = total - least
    edits = (1 - threshold) * total
    width = int(((edits + longer - least)[fits] / 2).max()) + 1
    places = min(GRAM_PLACES, 1 << int(32 * max(lengths1.max(), lengths2.max(), 1)).bit_length())
    there = np.zeros((places, len(titles2)), np.uint8)
    for j in np.flatnonzero(fits.any(axis=0)).tolist():
        grams = _gram_hashes(titles2[j])
        for step in (-1, 0, 1):
            there[_gram_places(grams, width, places, step), j] = 1
    need = longer - LONG_GRAM + 1 - (LONG_GRAM - 0.5) * edits - (2 * longer - total) / 2
    for i in np.flatnonzero(fits.any(axis=1)).tolist():
        n1, title = ns1[i], titles1[i]
        common = there[_gram_places(_gram_hashes(title), width, places)].sum(axis=0, dtype=np.int32)
        at = np.flatnonzero(fits[i] & (common >= need[i] - 1e-9))
        found = [(r, -ns2[j]) for j in at.tolist() if (r := _ratio(title, titles2[j], threshold)) >= threshold]
        if found:
            ratio, n2 = max(found)
            yield n1, -n2, ratio


def _similar_titles(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(n1, n2, ratio): of pairs of distinct titles of a year that reach the threshold, at least the best of each n1.

    Titles of both bounds of GRAM_TITLES meet over a rare gram at about the same place: the first of the grams that both
    have in common, in the one order of all grams, stands among the rarest of each. Other pairs meet in blocks of titles
    of about the same length, so that they are never made into rows.
    """
    low, high = GRAM_TITLES if threshold >= GRAM_THRESHOLD else (-1, -2)
    total, least = F.length("t1") + F.length("t2"), F.least(F.length("t1"), F.length("t2"))
    both = [side.where(F.length("title").between(low, high)) for side in (left, right)]
    starts = F.sequence(F.lit(1), F.length("title") - GRAM + 1)
    every = both[0].select("title").union(both[1].select("title"))
    counts = every.select(F.explode(F.transform(starts, lambda i: F.substring("title", i, GRAM))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    frequent = counts.orderBy(F.desc("df"), "gram").limit(KNOWN_GRAMS)
    one, two = (_rare_grams(side, frequent, threshold).toDF(f"n{i}", "year", f"t{i}", "gram", f"at{i}") for i, side in ((1, both[0]), (2, both[1])))
    edits = (1 - threshold) * total + 1e-9
    met = one.join(two, ["year", "gram"]).where((2 * least >= threshold * total) & (F.abs(F.col("at1") - F.col("at2")) <= edits)).select("n1", "t1", "n2", "t2").distinct()
    short = met.where(F.levenshtein("t1", "t2") <= edits).withColumn("ratio", indel_ratio("t1", "t2")).where(F.col("ratio") >= threshold).select("n1", "n2", "ratio")
    size = max(math.log((2 - threshold) / threshold), 0.01)
    bin_ = F.floor(F.log(F.greatest(F.length("title"), F.lit(1))) / size)
    alone = [side.where(~F.length("title").between(2 * low, high // 2)) if high > 0 else side for side in (left, right)]  # others' pairs met above
    held = _title_blocks(alone[1].withColumn("bin", bin_), ("ns2", "titles2"))
    asked = _title_blocks(alone[0].withColumn("bin", F.explode(F.sequence(bin_ - 1, bin_ + 1))), ("ns1", "titles1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = list(_best_of_block(*(c[i].as_py() for c in batch.columns), threshold, (low, high)))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in made], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["n1", "n2", "ratio"])

    # pairs of blocks are little data and much work, so they are dealt out evenly by their number
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    blocks = asked.join(held, ["year", "bin"]).select("ns1", "titles1", "ns2", "titles2").repartition(tasks)
    return short.union(blocks.mapInArrow(run, "n1 long, n2 long, ratio double"))


def fuzzy_matches(requests: DataFrame, registry: DataFrame, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    """requests(request_id, title, year) x registry(document_id, title, year) -> (request_id, document_id, ratio).

    Titles of the same year whose indel ratio reaches the threshold; the best one a request, ties by id.
    Equal titles are found by a join; of what is left, each title is compared once, whatever the number of its
    copies, with those that share a rare gram at about the same place or have about its length. All bounds keep every
    match. Rows without year or title match nothing.
    """
    held = registry.where("year is not null and title is not null").groupBy("year", "title").agg(F.min("document_id").alias("document_id"))
    asked = requests.where("year is not null and title is not null").select("request_id", "title", "year")
    right = held.withColumn("n", F.col("document_id"))
    left = asked.groupBy("year", "title").agg(F.min("request_id").alias("n")).join(held, ["year", "title"], "left_anti")
    good = _similar_titles(left, right, threshold)
    best = good.groupBy("n1").agg(F.max_by(F.struct("n2", "ratio"), F.struct("ratio", -F.col("n2"))).alias("b")).select(F.col("n1").alias("n"), F.col("b.n2").alias("document_id"), "b.ratio")
    found = left.join(best, "n").select("year", "title", "document_id", "ratio").union(held.select("year", "title", "document_id", F.lit(1.0)))
    return asked.join(found, ["year", "title"]).select("request_id", "document_id", "ratio")


def find_duplicates(requests: DataFrame, registry: DataFrame, fuzzy: bool = True) -> DataFrame:
    """requests(request_id, doi, content_hash, title, year) with document_id and match_type of the first kind that hits.

    doi, then content_hash, then fuzzy_title; null match_type where nothing does. DOIs and titles are normalised
    already. Soft-deleted documents count, as they do in the original lookups.
    """
    by_doi = registry.where("doi is not null").groupBy("doi").agg(F.min("document_id").alias("by_doi"))
    by_hash = registry.where("content_hash is not null").groupBy("content_hash").agg(F.min("document_id").alias("by_hash"))
    out = requests.join(by_doi, "doi", "left").join(by_hash, "content_hash", "left")
    if fuzzy:
        open_ = out.where("by_doi is null and by_hash is null").select("request_id", "title", "year")
        near = fuzzy_matches(open_, registry).select("request_id", F.col("document_id").alias("by_title"))
        out = out.join(near, "request_id", "left")
    else:
        out = out.withColumn("by_title", F.lit(None).cast(registry.schema["document_id"].dataType))
    kind = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_hash").isNotNull(), "content_hash").when(F.col("by_title").isNotNull(), "fuzzy_title")
    return out.withColumn("document_id", F.coalesce("by_doi", "by_hash", "by_title")).withColumn("match_type", kind).drop("by_doi", "by_hash", "by_title")


def register(requests: DataFrame, registry: DataFrame, fuzzy: bool = True) -> DataFrame:
    """One outcome a request: created or duplicate, with the document it belongs to and how it matched.

    Requests are taken in the order of request_id. Among new ones the first of each content hash (else DOI) creates
    the document, under its request_id; later ones of the batch lose the race and are labelled race_condition.
    """
    probed = find_duplicates(requests, registry, fuzzy)
    key = F.coalesce(F.concat(F.lit("h:"), "content_hash"), F.concat(F.lit("d:"), "doi"), F.concat(F.lit("r:"), F.col("request_id").cast("string")))
    first = F.min("request_id").over(Window.partitionBy("__new", "__key"))
    out = probed.withColumn("__new", F.col("match_type").isNull()).withColumn("__key", F.when(F.col("__new"), key).otherwise(F.col("request_id").cast("string")))
    out = out.withColumn("__first", first)
    created = F.col("__new") & (F.col("__first") == F.col("request_id"))
    return out.select(
        "request_id",
        F.when(F.col("__new"), F.col("__first")).otherwise(F.col("document_id")).alias("document_id"),
        F.when(created, "created").otherwise("duplicate").alias("status"),
        F.when(F.col("__new") & ~created, "race_condition").otherwise(F.col("match_type")).alias("match_type"),
    )


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps, the new one's values where they share keys; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def insert_or_get(rows: DataFrame, table: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(table with the first new row of each key, rows with __created). Null keys always insert.

    `order` tells rows apart. Only the least order of each key travels, so neither null nor frequent keys meet in a task.
    """
    held = table.select(key).where(F.col(key).isNotNull())
    firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__o")).join(held, key, "left_anti").select("__o")
    ids = firsts.union(rows.where(F.col(key).isNull()).select(order)).withColumn("__made", F.lit(True))
    marked = rows.join(ids, F.col(order) == F.col("__o"), "left").withColumn("__created", F.coalesce("__made", F.lit(False))).drop("__o", "__made")
    return table.unionByName(marked.where("__created").drop("__created"), allowMissingColumns=True), marked


# --- lifecycle ---


def valid_transition(old: Column, new: Column) -> Column:
    return F.struct(old.alias("f"), new.alias("t")).isin([F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in V.TRANSITIONS])


def next_states(state: str) -> list[str]:
    return [b for a, b in V.TRANSITIONS if a == state]


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """events with previous (registered before the first) and whether the step from there is allowed."""
    w = Window.partitionBy(key).orderBy(*order)
    previous = F.coalesce(F.lag(state).over(w), F.lit("registered"))
    return events.withColumn("previous", previous).withColumn("allowed", valid_transition(F.col("previous"), F.col(state)))


def soft_delete(docs: DataFrame, requests: DataFrame, key: str = "document_id", at: Column | None = None) -> DataFrame:
    """docs with deleted_at set for requested ones, and outcome DELETED, ALREADY_DELETED or null."""
    asked = requests.select(key).distinct().withColumn("__asked", F.lit(True))
    out = docs.join(asked, key, "left")
    gone = F.col("deleted_at").isNotNull()
    outcome = F.when(F.col("__asked") & gone, "ALREADY_DELETED").when(F.col("__asked"), "DELETED")
    return out.withColumn("outcome", outcome).withColumn("deleted_at", F.when(F.col("__asked") & ~gone, F.current_timestamp() if at is None else at).otherwise(F.col("deleted_at"))).drop("__asked")


def restore(docs: DataFrame, requests: DataFrame, key: str = "document_id") -> DataFrame:
    """docs with deleted_at cleared for requested ones, and outcome RESTORED, NOT_DELETED or null."""
    asked = requests.select(key).distinct().withColumn("__asked", F.lit(True))
    out = docs.join(asked, key, "left")
    gone = F.col("deleted_at").isNotNull()
    outcome = F.when(F.col("__asked") & ~gone, "NOT_DELETED").when(F.col("__asked"), "RESTORED")
    return out.withColumn("outcome", outcome).withColumn("deleted_at", F.when(F.col("__asked"), F.lit(None)).otherwise(F.col("deleted_at"))).drop("__asked")


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the rows of the given keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """table with rows in place of those that share their keys; of several rows of a key the last by `order`."""
    if order is not None:
        w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


# --- listings ---


def offset_page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))


def keyset_page(rows: DataFrame, created: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """limit + 1 rows newest first after the cursor (created, key); the extra one tells that there is more."""
    if after is not None:
        at, last = after
        rows = rows.where((F.col(created) < F.lit(at)) | ((F.col(created) == F.lit(at)) & (F.col(key) < F.lit(last))))
    return rows.orderBy(F.col(created).desc(), F.col(key).desc()).limit(limit + 1)


def page_after(rows: DataFrame, created: str, key: str, limit: int, page: DataFrame) -> DataFrame:
    """The page that follows one made by keyset_page(): rows beyond the last of its first `limit` rows, none if it was short.

    The cursor is found within the plan and is one row, so it is broadcast.
    """
    shown = page.orderBy(F.col(created).desc(), F.col(key).desc()).limit(limit)
    last = F.broadcast(shown.agg(F.min(F.struct(F.col(created).alias("at"), F.col(key).alias("key"))).alias("__last")))
    beyond = rows.crossJoin(last).where(F.struct(F.col(created).alias("at"), F.col(key).alias("key")) < F.col("__last")).drop("__last")
    return beyond.orderBy(F.col(created).desc(), F.col(key).desc()).limit(limit + 1)


def cursor_of(key: Column) -> Column:
    """The opaque form of a row's key."""
    return F.translate(F.base64(F.encode(key.cast("string"), "utf-8")), "+/", "-_")


def count_by(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(column, n) for every listed value, zero where it is missing."""
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return listed.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# --- jobs ---


def stale_reset(jobs: DataFrame, now: Column, minutes: int = V.STALE_MINUTES) -> DataFrame:
    """Running jobs that started before now - minutes go back to pending."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {minutes} minutes"))
    return jobs.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "started_at": F.when(stale, F.lit(None)).otherwise(F.col("started_at"))})


def update_job(jobs: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """updates(job_id, new_status, new_data): maps merge, started_at is set once, completed_at at the end."""
    out = jobs.join(updates, "job_id", "left")
    state, hit = F.coalesce("new_status", "status"), F.col("new_status").isNotNull()
    return out.withColumns(
        {
            "started_at": F.when((F.col("new_status") == "running") & F.col("started_at").isNull(), now).otherwise(F.col("started_at")),
            "completed_at": F.when(F.col("new_status").isin("completed", "failed"), now).otherwise(F.col("completed_at")),
            "result_data": F.when(hit, merge_maps(F.col("result_data"), F.col("new_data"))).otherwise(F.col("result_data")),
            "status": state,
        }
    ).drop("new_status", "new_data")


def cancel_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Pending and running jobs of the requests become cancelled; others stay as they are."""
    asked = requests.select("job_id").distinct().withColumn("__asked", F.lit(True))
    hit = F.col("__asked") & F.col("status").isin("pending", "running")
    return jobs.join(asked, "job_id", "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("__asked")


def claim_jobs(jobs: DataFrame, n: int, now: Column) -> DataFrame:
    """The n oldest pending jobs become running."""
    oldest = jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(n).select("job_id").withColumn("__claimed", F.lit(True))
    hit = F.coalesce("__claimed", F.lit(False))
    return jobs.join(oldest, "job_id", "left").withColumns({"started_at": F.when(hit, now).otherwise(F.col("started_at")), "status": F.when(hit, "running").otherwise(F.col("status"))}).drop("__claimed")


# --- search results of several sources ---


def _merged(group: DataFrame, key: str) -> DataFrame:
    """First result of each key in arrival order, gaps filled by later ones."""
    first = lambda c: F.min_by(c, "arrival")
    filled = lambda c: F.min_by(F.when(F.length(c) > 0, F.col(c)), F.when(F.length(c) > 0, F.col("arrival")))
    truthy = F.when(F.col("relevance_score") != 0, F.col("relevance_score"))
    return group.groupBy(key).agg(
        F.min("arrival").alias("arrival"),
        *(first(c).alias(c) for c in ("source", "title", "year")),
        *(filled(c).alias(c) for c in ("doi", "abstract", "pdf_url", "journal", "arxiv_id")),
        F.transform(F.array_sort(F.collect_list(F.struct("arrival", "source"))), lambda s: s["source"]).alias("sources_found"),
        F.avg(truthy).alias("relevance_score"),
    )


def _title_key() -> Column:
    return F.concat(search_title(F.col("title")), F.lit("|"), F.coalesce(F.when(F.col("year") != 0, F.col("year").cast("string")), F.lit("unknown")))


def merge_results(results: DataFrame) -> DataFrame:
    """results(arrival, source, title, year, doi, arxiv_id, abstract, journal, pdf_url, relevance_score), one row a paper.

    Results with a DOI group by it, others with an arXiv id by that, the rest by title and year; a later group is
    dropped where an earlier one has its arXiv id or title already. Null and empty count as missing.
    """
    has_doi, has_arxiv = F.length("doi") > 0, F.length("arxiv_id") > 0
    tagged = results.withColumn("__doi", F.when(has_doi, F.lower("doi"))).withColumn("__arxiv", F.when(~F.coalesce(has_doi, F.lit(False)) & has_arxiv, F.col("arxiv_id")))
    one = _merged(tagged.where("__doi is not null"), "__doi").drop("__doi")
    two = _merged(tagged.where("__doi is null and __arxiv is not null"), "__arxiv")
    two = two.join(one.where("arxiv_id is not null").select(F.col("arxiv_id").alias("__arxiv")), "__arxiv", "left_anti").drop("__arxiv")
    captured = one.unionByName(two)
    three = _merged(tagged.where("__doi is null and __arxiv is null").withColumn("__key", _title_key()), "__key")
    three = three.join(captured.select(_title_key().alias("__key")), "__key", "left_anti").drop("__key")
    return captured.unionByName(three)


def federated(sources: dict[str, DataFrame], asked: list[str] | None = None, per_source: int = 20, limit: int = 20) -> DataFrame:
    """The best of several sources' results, merged; by default three of them, an empty request means all."""
    default = ["crossref", "semantic_scholar", "arxiv"]
    names = default if asked is None else (asked or sorted(sources))
    rows = None
    for n, name in enumerate(x for x in names if x in sources):
        part = sources[name].orderBy("position").limit(per_source).withColumn("source", F.lit(name)).withColumn("arrival", F.lit(n * per_source) + F.col("position"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    merged = merge_results(rows)
    return merged.orderBy(F.coalesce("relevance_score", F.lit(0.0)).desc(), "arrival").limit(limit)


def first_found(keys: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """keys with the row of the first source, in order, that has them."""
    rows = None
    for n, s in enumerate(sources):
        part = s.withColumn("__n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__n")
    best = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__n")
    return keys.join(best, key, "left")


def import_outcomes(requests: DataFrame, found: DataFrame, registry: DataFrame) -> DataFrame:
    """requests(request_id, arxiv_id, doi, bibcode, url) -> source chosen and NOT_FOUND, DUPLICATE or IMPORTED.

    found(request_id, external_id, source) are the papers that the sources returned, registry(doi, external_id, source)
    the imports so far. DUPLICATE by the lower-cased DOI, else by external id and source; null and empty match nothing.
    """
    source = F.when(F.length("arxiv_id") > 0, "arxiv").when(F.length("doi") > 0, "crossref").when(F.length("bibcode") > 0, "scixplorer").when(F.length("url") > 0, "upload").otherwise("unknown")
    there = found.select("request_id", F.lit(True).alias("__found")).distinct()
    known = registry.where("length(doi) > 0").select(F.lower("doi").alias("__doi"), F.lit(True).alias("__by_doi")).distinct()
    pairs = registry.where("length(external_id) > 0 and source is not null").select("external_id", "source").distinct()
    same = found.join(pairs, ["external_id", "source"]).select("request_id", F.lit(True).alias("__by_id")).distinct()
    out = requests.withColumn("import_source", source).join(there, "request_id", "left").join(known, F.lower("doi") == F.col("__doi"), "left").join(same, "request_id", "left")
    status = F.when(F.col("__found").isNull(), "NOT_FOUND").when(F.coalesce("__by_doi", "__by_id"), "DUPLICATE").otherwise("IMPORTED")
    return out.withColumn("import_status", status).drop("__found", "__doi", "__by_doi", "__by_id")


def latency_buckets(rows: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """Cumulative counts of each bucket, count and sum by labels."""
    sums = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).cast("long").alias(f"le_{str(b).replace('.', '_')}") for b in V.LATENCY_BUCKETS]
    return rows.groupBy(*labels).agg(*sums, F.count(value).alias("n"), F.round(F.sum(value), 6).alias("total"))


# --- further lookups ---


def composite_matches(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests(request_id, content_hash, title, year) with the least document_id of the same hash, title and year; a
    missing year only meets a missing year."""
    known = registry.groupBy("content_hash", "title", "year").agg(F.min("document_id").alias("document_id"))
    same = [requests[c] == known[c] for c in ("content_hash", "title")] + [requests["year"].eqNullSafe(known["year"])]
    return requests.join(known, same, "left").select("request_id", "document_id")


def with_provenance(docs: DataFrame, provenance: DataFrame, key: str = "document_id", order: str = "created_at") -> DataFrame:
    """docs with provenance: the array of their provenance rows, oldest first, empty where there are none."""
    fields = [c for c in provenance.columns if c != key]
    listed = provenance.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in fields if c != order)))).alias("provenance"))
    return docs.join(listed, key, "left").withColumn("provenance", F.coalesce("provenance", F.array().cast(listed.schema["provenance"].dataType)))


def source_status(results: DataFrame, merged: DataFrame, errors: DataFrame) -> DataFrame:
    """(source, success, n_results, n_kept, error): results(source), merged(sources_found array), errors(source, error).

    n_kept counts merged results that the source found first; a source that failed has its error and no success.
    """
    counts = results.groupBy("source").agg(F.count("*").alias("n_results"))
    kept = merged.groupBy(F.element_at("sources_found", 1).alias("source")).agg(F.count("*").alias("n_kept"))
    out = counts.join(errors.select("source", "error"), "source", "full").join(kept, "source", "left")
    zero = F.lit(0).cast("long")
    return out.select("source", F.col("error").isNull().alias("success"), F.coalesce("n_results", zero).alias("n_results"), F.coalesce("n_kept", zero).alias("n_kept"), "error")


def upload_completion(uploads: DataFrame, objects: DataFrame, registrations: DataFrame | None = None) -> DataFrame:
    """(upload_id, status, outcome, size, content_hash, title, document_id, error) of each of uploads(upload_id, user_id,
    asked_by, object_key, status, filename, size, title).

    Nobody else's upload is found, and only a pending one is completed; without its object in objects(object_key, size,
    content_hash) it stays pending, for another try. A stored one takes the object's size and hash, the title asked for
    or the file's name up to its last dot, and registrations(content_hash, document_id, error) says how it goes on:
    processing with a document, failed with an error, uploaded as long as there is neither. Others keep status and size.
    outcome: completed, failed, not_found, already_<status>, not_found_in_storage.
    """
    stored = objects.groupBy("object_key").agg(F.max(F.struct(F.col("size"), F.col("content_hash"))).alias("__stored"))
    out = uploads.join(stored, "object_key", "left")
    if registrations is None:
        registrations = out.sparkSession.createDataFrame([], "content_hash string, document_id string, error string")
    known = registrations.groupBy(F.col("content_hash").alias("__hash")).agg(F.min("document_id").alias("document_id"), F.min("error").alias("error"))
    own, waits, there = F.col("user_id") == F.col("asked_by"), F.col("status") == "pending", F.col("__stored").isNotNull()
    open_ = F.coalesce(own & waits & there, F.lit(False))
    out = out.withColumn("__open", open_).withColumn("content_hash", F.when(F.col("__open"), F.col("__stored.content_hash")))
    out = out.join(known, F.col("content_hash") == F.col("__hash"), "left").withColumn("error", F.when(F.col("document_id").isNull(), F.concat(F.lit("Registration failed: "), "error")))
    failed = F.col("__open") & F.col("error").isNotNull()
    outcome = F.when(~F.coalesce(own, F.lit(False)), "not_found").when(~waits, F.concat(F.lit("already_"), "status")).when(~there, "not_found_in_storage").when(failed, "failed").otherwise("completed")
    status = F.when(failed, "failed").when(F.col("__open") & F.col("document_id").isNotNull(), "processing").when(F.col("__open"), "uploaded").otherwise(F.col("status"))
    title = F.when(F.col("__open"), F.coalesce(F.when(F.length("title") > 0, F.col("title")), F.regexp_replace("filename", r"\.[^.]*$", "")))
    size = F.when(F.col("__open"), F.col("__stored.size")).otherwise(F.col("size"))
    return out.select("upload_id", status.alias("status"), outcome.alias("outcome"), size.alias("size"), "content_hash", title.alias("title"), "document_id", "error")


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens that are neither revoked nor expired."""
    return tokens.where(~F.coalesce(F.col("revoked"), F.lit(False)) & (F.col("expires_at") > now))


def has_scopes(have: Column, need: Column) -> Column:
    """Whether every needed scope is there; a star grants all."""
    return (F.size(F.array_except(need, have)) == 0) | F.array_contains(have, "*")


def key_probe(asked: DataFrame, keys: DataFrame, now: Column, prefix: int = 8) -> DataFrame:
    """asked(request_id, key) with the key_id whose prefix and SHA-256 agree and that has not expired; null without one."""
    probes = asked.select("request_id", F.substring("key", 1, prefix).alias("key_prefix"), F.sha2("key", 256).alias("__hash"))
    live = keys.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("key_prefix", F.col("key_hash").alias("__hash"), "key_id")
    hits = probes.join(live, ["key_prefix", "__hash"]).groupBy("request_id").agg(F.min("key_id").alias("key_id"))
    return asked.select("request_id").join(hits, "request_id", "left")


def touched_keys(asked: DataFrame, keys: DataFrame, prefix: int = 8) -> DataFrame:
    """keys(key_id, key_prefix, key_hash, is_active, expires_at, last_used_at) after asked(key, asked_at): last_used_at is the
    last time a key that was active and had not expired by then was asked for, or what it was before if that is later."""
    probes = asked.groupBy(F.substring("key", 1, prefix).alias("key_prefix"), F.sha2("key", 256).alias("key_hash"), "asked_at").agg(F.lit(1).alias("__asked"))
    live = keys.where(F.col("is_active")).select("key_id", "key_prefix", "key_hash", "expires_at")
    valid = live.join(probes, ["key_prefix", "key_hash"]).where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("asked_at")))
    used = valid.groupBy("key_id").agg(F.max("asked_at").alias("__used"))
    return keys.join(used, "key_id", "left").withColumn("last_used_at", F.greatest("last_used_at", "__used")).drop("__used")
