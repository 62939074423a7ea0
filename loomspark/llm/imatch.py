"""I-Match fingerprints: terms of a middle document-frequency band, hashed over randomised lexicon subsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import PIECE

_TERM = re.compile(r"\w+")


@dataclass(frozen=True)
class IMatchPlan:
    """Parameters. Terms in least_share..most_share of all documents (and in at least 2) form the lexicon.

    As documents have a bounded mean number of distinct terms D, at most D / least_share terms can reach the lower
    bound, so the lexicon's size does not follow the corpus's. subsets lexicon subsets are drawn at each level;
    level j keeps a term with probability 2^-j, and a document is fingerprinted at the two levels where about
    `aim` and half as many of its terms are left in a subset.
    """

    least_share: float = 2e-4
    most_share: float = 0.1
    subsets: int = 24
    aim: float = 1.5
    levels: int = 24


def term_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the terms of a whole text: runs of letters, digits and _, lower-cased."""
    digest, found = xxhash.xxh64_intdigest, set()
    for start, end in _stretches(text):
        found.update(_TERM.findall(text[start:end].lower()))
    made = np.fromiter((digest(t.encode("utf-8", "surrogatepass")) for t in found), np.uint64, len(found))
    made.sort()
    return made


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield at, end
        at = end


def lexicon(docs: DataFrame, text_col: str, plan: IMatchPlan) -> np.ndarray:
    """Sorted hashes of the terms inside the band, counted over all documents. Null texts have no terms.

    Map tasks count their own terms first; only terms inside the band reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(term_hashes(text.as_py() or ""))
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.count()
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    least, most = max(2.0, plan.least_share * rows), plan.most_share * rows
    band = counted.where((F.col("n") >= least) & (F.col("n") <= most)).select("term").toArrow().column(0).to_numpy()
    return np.sort(band.view(np.uint64))


def fingerprint(text: str, lex: np.ndarray, plan: IMatchPlan) -> str:
    """`level:marks:marks`: a mark of four hex digits for each subset at the level and at the next sparser one.

    An empty subset's mark is `----`. A text without lexicon terms is fingerprinted over all its terms (level
    prefix `x`), one without terms over its characters (`t` and a hash of the text).
    """
    terms, lead = term_hashes(text), ""
    if not len(terms):
        return "t" + xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))
    if len(lex):
        inside = lex[np.minimum(np.searchsorted(lex, terms), len(lex) - 1)] == terms
    else:
        inside = np.zeros(len(terms), bool)
    if inside.any():
        terms = terms[inside]
    else:
        lead = "x"
    level = int(min(plan.levels, max(0, round(np.log2(max(1.0, len(terms) / plan.aim))))))
    salts = _mix(np.arange(1, plan.subsets + 1, dtype=np.uint64))
    drawn = _mix(terms[None, :] ^ salts[:, None])
    marks = []
    for j in (level, level + 1):
        # a hash below 2^(64-j) keeps the term, so each sparser subset lies within the denser one
        kept = drawn < np.uint64(1 << (64 - j)) if j else np.ones_like(drawn, bool)
        for row, keep in enumerate(kept):
            left = terms[keep]
            marks.append(blake2b(left.tobytes(), digest_size=2, salt=row.to_bytes(2, "little")).hexdigest() if len(left) else "----")
    return f"{lead}{level}:{''.join(marks[: plan.subsets])}:{''.join(marks[plan.subsets :])}"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def likeness(a: str, b: str) -> float:
    """Share of the subsets with equal marks among those not empty in both, at the best level that both have.

    Levels follow the terms inside the lexicon, so texts share none only if one has at least twice as many as the other;
    less than half of all their terms are common then, and they count as unlike.
    """
    if a == b:
        return 1.0
    if ":" not in a or ":" not in b or (a[0] == "x") != (b[0] == "x"):
        return 0.0
    (la, *ma), (lb, *mb) = a.split(":"), b.split(":")
    first, second = int(la.lstrip("x")), int(lb.lstrip("x"))
    best = 0.0
    for j in {first, first + 1} & {second, second + 1}:
        x, y = ma[j - first], mb[j - second]
        pairs = [(x[i : i + 4], y[i : i + 4]) for i in range(0, len(x), 4)]
        pairs = [p for p in pairs if p != ("----", "----")]
        if pairs:
            best = max(best, sum(p == q for p, q in pairs) / len(pairs))
    return best


def fingerprints(docs: DataFrame, plan: IMatchPlan = IMatchPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row for each input row; null and empty texts share one fingerprint.

    Repeated rows and null ids each give their own row, texts of any length are taken whole, other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py() or "", held.value, plan) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


@dataclass(frozen=True)
class _Cuts:
    """Where the ranges of with_next() begin, in its order: ids falling, then nulls, texts of one id by their hash.

    ids and marks are the ranges' first keys, the ids as ~id, which rises; nulls the first hashes of the null ids' ranges.
    """

    ids: np.ndarray
    marks: np.ndarray
    nulls: np.ndarray

    @classmethod
    def of(cls, own: DataFrame, ranges: int) -> _Cuts:
        """Ranges of about equal rows; the rows of an id that would fill several are cut by their texts' hashes."""
        share = [i / ranges for i in range(1, ranges)]
        told = own.agg(F.percentile_approx("id", share, 20 * ranges).alias("at"), F.count("*").alias("n"), F.count("id").alias("known")).first()
        each: dict[int, int] = {}
        for i in told["at"] or []:
            each[i] = each.get(i, 0) + 1
        cuts = sorted((~i, (1 << 63) // n * k) for i, n in each.items() for k in range(n))
        apart = max(1, round(ranges * (told["n"] - told["known"]) / max(1, told["n"])))
        return cls(*(np.array([c[k] for c in cuts], np.int64) for k in (0, 1)), np.array([(1 << 63) // apart * k for k in range(apart)], np.int64))

    def place(self, ids: pa.Array, marks: pa.Array) -> pa.Array:
        """The range of each row."""
        null, v = ids.is_null().to_numpy(zero_copy_only=False), marks.to_numpy(zero_copy_only=False)
        a = ~ids.fill_null(0).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(self.ids, a, "left"), np.searchsorted(self.ids, a, "right")
        out = high.copy()
        for n in np.unique(low[(low < high) & ~null]):
            mine = (low == n) & (low < high)
            out[mine] = n + np.searchsorted(self.marks[n : high[mine][0]], v[mine], "right")
        out[null] = len(self.ids) + np.searchsorted(self.nulls, v[null], "right")
        return pa.array(out.astype(np.int32))


def with_next(docs: DataFrame, use: Callable[[int | None, str, str], tuple], out_schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of use(id, text, next text) for each row, the next being that of the next smaller id, cyclically.

    Rows of one id stand in the order of their texts' hashes; null ids come after all others. Rows are dealt out by
    ranges of (id, hash) and sorted; the first row of each range travels to the range before it as well, so every row
    meets its successor in one shuffle of the texts. Rows of a table read from files are told apart by their place, so
    just one row is the first; of others all that equal it travel. What the driver holds is one key a range. Null texts
    are empty, texts of any length are taken whole, an empty table gives an empty result, other columns are not read.
    """
    spark = docs.sparkSession
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:
        place = F.lit(0).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("mark"), place.alias("place"), text.alias("text"))
    cuts = _Cuts.of(own, 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    @F.arrow_udf(T.IntegerType())
    def placed(ids: pa.Array, marks: pa.Array) -> pa.Array:
        return cuts.place(ids, marks)

    ranged = own.withColumn("range", placed("id", "mark"))
    head = F.min(F.struct(F.bitwise_not("id").alias("a"), F.col("mark"), F.col("place"), F.col("id")))
    heads = {r["range"]: (r["f"]["id"], r["f"]["mark"], r["f"]["place"]) for r in ranged.groupBy("range").agg(head.alias("f")).collect()}
    order = sorted(heads)
    if not order:
        return ranged.mapInArrow(lambda batches: iter(()), out_schema)
    before = {r: order[i - 1] for i, r in enumerate(order)}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def homes(ranges: pa.Array, ids: pa.Array, marks: pa.Array, places: pa.Array) -> pa.Array:
        """A row's range, and for the head of a range the one before it, as a guest."""
        rows = zip(ranges.to_pylist(), ids.to_pylist(), marks.to_pylist(), places.to_pylist(), strict=True)
        return pa.array([[r, before[r]] if (i, m, p) == heads[r] else [r] for r, i, m, p in rows], pa.list_(pa.int32()))

    dealt = ranged.select("id", "mark", "place", "text", F.posexplode(homes("range", "id", "mark", "place")).alias("guest", "range"))
    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", F.col("id").desc_nulls_last(), "mark", "place").select("range", "guest", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_arrow_schema(out_schema))
        last: tuple | None = None
        met = False
        for batch in batches:
            made = []
            for r, guest, i, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                r, guest, i, text = r.as_py(), guest.as_py(), i.as_py(), text.as_py()
                if last is not None and last[0] == r and not met:
                    made.append(use(last[1], last[2], text))
                    met = bool(guest)
                if not guest:
                    last, met = (r, i, text), False
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], f.type) for k, f in enumerate(schema)], schema=schema)

    return ordered.mapInArrow(run, out_schema)


def _arrow_schema(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return [(n, kinds[k]) for n, k in (part.split() for part in ddl.split(","))]


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by the start of the following text, as long as it is there."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


class EditLikeness:
    """(id, characters, SHA-256 of the edited text, both fingerprints, likeness to the edited and to the next text).

    Texts come in a row, each the next one's predecessor, so the last fingerprint is kept for reuse.
    """

    COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def __init__(self, held, plan: IMatchPlan) -> None:
        self.held, self.plan, self.last = held, plan, (None, "")

    def _print(self, text: str) -> str:
        return self.last[1] if text is self.last[0] else fingerprint(text, self.held.value, self.plan)

    def __call__(self, doc_id: int | None, text: str, following: str) -> tuple:
        other = edited(text, following)
        own, changed = self._print(text), fingerprint(other, self.held.value, self.plan)
        coming = own if following is text else fingerprint(following, self.held.value, self.plan)
        self.last = (following, coming)
        digest = sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, own, changed, likeness(own, changed), likeness(own, coming)
