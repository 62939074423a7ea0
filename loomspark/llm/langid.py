"""Language identification in two steps: a family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ISO 639-1 codes of language families that share scripts and vocabulary.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "is", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu", "fa"),
    "sinitic": ("zh", "ja", "ko"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@dataclass(frozen=True)
class LangIdPlan:
    """Parameters. per_lang bounds the distinct texts that a language's training takes; piece is code points a step."""

    per_lang: int = 400
    features: int = 1 << 13
    orders: tuple[int, ...] = (1, 2, 3)
    epochs: int = 12
    penalty: float = 1e-4
    piece: int = 1 << 20
    families: dict[str, str] = field(default_factory=lambda: dict(_FAMILY_OF))


def features(text: str, plan: LangIdPlan) -> np.ndarray:
    """Unit vector of hashed character n-gram counts of a whole text, letters only, words edged by a space.

    Long texts are walked in pieces; each carries over the codes that its first n-grams begin with, so the vector does
    not depend on where a text is cut.
    """
    total = np.zeros(plan.features, np.float64)
    carried = np.zeros(0, np.uint64)
    for new in _codes(text, plan.piece):
        for n in plan.orders:
            codes = np.concatenate([carried[max(0, len(carried) - n + 1) :], new])
            if len(codes) < n:
                continue
            mixed = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            total += np.bincount((mixed % np.uint64(plan.features)).astype(np.int64), minlength=plan.features)
        carried = np.concatenate([carried, new])[-(max(plan.orders) - 1) :] if max(plan.orders) > 1 else carried
    total = np.sqrt(total)
    norm = np.linalg.norm(total)
    return total / norm if norm else total


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str, piece: int) -> Iterator[np.ndarray]:
    """Lower-cased code points with every run of other characters than letters made one space, edges included."""
    low = f"{text.lower()} "
    before = True  # a space stands in front of the first word
    for start in range(0, len(low), piece):
        codes = np.frombuffer(low[start : start + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[codes]
        keep = letter.copy()
        keep[0] |= not before
        keep[1:] |= letter[:-1]
        made = np.where(letter, codes, 32)[keep].astype(np.uint64)
        yield made if start else np.concatenate([np.array([32], np.uint64), made])
        before = not letter[-1]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int, penalty: float, seed: int = 7) -> np.ndarray:
    """Weights (with a last one for the bias) of a linear SVM by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    bound = 1 / (penalty * len(x))
    counts = {s: max(1, int((y == s).sum())) for s in (1, -1)}
    caps = np.where(y > 0, bound * len(y) / (2 * counts[1]), bound * len(y) / (2 * counts[-1]))
    alpha, w, square = np.zeros(len(x)), np.zeros(x.shape[1]), np.einsum("ij,ij->i", x, x)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), caps[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class LangIdModel:
    """Binary models: between two families, and between two languages of one family."""

    plan: LangIdPlan
    families: list[str]
    langs: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def vote(self, x: np.ndarray, names: list[str]) -> tuple[str, float]:
        """The name that wins most duels, then the largest summed margin; its confidence from its weakest duel."""
        if len(names) == 1:
            return names[0], 1.0
        wins, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in combinations(names, 2):
            w = self.pairs[a, b]
            margin = float(x @ w[:-1] + w[-1])
            wins[a if margin >= 0 else b] += 1
            for name, m in ((a, margin), (b, -margin)):
                sums[name] += m
                least[name] = min(least[name], m)
        best = max(names, key=lambda n: (wins[n], sums[n]))
        return best, float(1 / (1 + np.exp(-3 * np.clip(least[best], -20, 20))))

    def predict(self, text: str | None) -> tuple[str, float]:
        """A learned language and a confidence from 0 to 1; und and 0 for null and letterless texts."""
        if not has_letter(text) or not self.families:
            return "und", 0.0
        x = features(text, self.plan)
        family, sure = self.vote(x, self.families)
        lang, surer = self.vote(x, self.langs[family])
        return lang, sure * surer


def _chosen(known: DataFrame, plan: LangIdPlan) -> DataFrame:
    """known(lang, text) -> (lang, h): hashes of plan.per_lang distinct texts of each language, all where there are no more.

    An estimate of the distinct texts leaves about twice the texts wanted, well above its error; the least hashes of
    those are taken, so no more than the small surplus is ever ranked, however often a text is repeated.
    """
    hashes = known.select("lang", F.xxhash64("text").alias("h"))
    counts = hashes.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))  # a row a language
    unit = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    some = hashes.join(F.broadcast(counts), "lang").where(unit * F.col("n") < 2 * plan.per_lang + 50).select("lang", "h").distinct()
    # in the order of unit, so that the surplus cut off and the rows left out above lie on the same side
    least = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h")
    return some.withColumn("n", F.row_number().over(least)).where(F.col("n") <= plan.per_lang).select("lang", "h")


def fit(docs: DataFrame, plan: LangIdPlan = LangIdPlan(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangIdModel:
    """Train on at most plan.per_lang distinct labelled texts a language, chosen by a hash of the text.

    Rows without language, text or letters teach nothing, repeated texts count once, whole texts are used. Features are
    made on the executors; what reaches the driver is one sparse vector for each chosen text, per_lang a language. A
    language without listed family is a family of its own. Names of other columns can't clash: none is read.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    taken = F.broadcast(_chosen(known, plan))  # per_lang rows a language
    chosen = known.withColumn("h", F.xxhash64("text")).join(taken, ["lang", "h"]).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, langs, at, of = [], [], [], []
            for lang, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (lang, key) not in seen and has_letter(text.as_py()):
                    x = features(text.as_py(), plan)
                    nz = np.flatnonzero(x)
                    keys.append(key)
                    langs.append(lang)
                    at.append(nz.astype(np.int32))
                    of.append(x[nz].astype(np.float32))
                seen.add((lang, key))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((langs, keys, at, of), kinds, strict=True)], ["lang", "h", "at", "of"])

    made = chosen.mapInArrow(run, "lang string, h long, at array<int>, of array<float>").groupBy("lang", "h").agg(F.first("at").alias("at"), F.first("of").alias("of"))
    rows = made.toArrow().to_pylist()
    if not rows:
        return LangIdModel(plan, [], {}, {})
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    x = np.zeros((len(rows), plan.features), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["of"]
    lang = np.array([r["lang"] for r in rows], dtype=object)
    family = np.array([plan.families.get(v, v) for v in lang], dtype=object)
    names = sorted(set(family))
    langs = {f: sorted(set(lang[family == f])) for f in names}
    duels = [(family, p) for p in combinations(names, 2)] + [(lang, p) for f in names for p in combinations(langs[f], 2)]
    pairs = {}
    for labels, (a, b) in duels:
        held = (labels == a) | (labels == b)
        pairs[a, b] = train_svm(x[held], np.where(labels[held] == a, 1.0, -1.0), plan.epochs, plan.penalty)
    return LangIdModel(plan, names, langs, pairs)


def identify(docs: DataFrame, model: LangIdModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row for each input row, from its whole text alone; und and 0 without letters.

    Repeated rows and null ids each give their own row; an empty table gives none; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights a pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [held.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimals leaves 1 when divided by 3; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
