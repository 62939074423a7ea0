"""URL filters by hashed host-suffix and path-prefix expressions. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import materialize, packed, unpacked

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host, with all its subdomains, and what a path has to start with; verdict is allow or block."""

    host: str
    path: str
    verdict: str


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(host, path, verdict) of a rule list; any DataFrame of these columns serves as well."""
    fields = [T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")]
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], T.StructType(fields))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """Digests of every host suffix of up to `labels` labels with every path prefix of the given lengths.

    Both bounds come from the rules: longer suffixes and other prefix lengths fit no rule.
    """
    parts = F.split(host, r"\.")
    n = F.least(F.size(parts), labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", prefix: int = 8, salts: int = 16, frequent: int = 1000) -> DataFrame:
    """pages with __host, __path, __rule (host and path, or null) and __verdict (the rule's, else default).

    Distinct URLs are expanded once, joined with the rules on the first `prefix` hex digits of SHA-256 digests and
    confirmed on whole digests. The longest rule (host and path together) wins; of equally long ones that with the
    longer host, then the one that blocks, then the smallest text. A null or scheme-less URL has an empty host and
    path; only a rule with an empty host could fit it. Rules with a null part are ignored, repeated rules count once.
    Every row of pages comes back once, repeated rows included, however long its URL; an empty table gives an empty
    result. Without rules the default decides. Input columns named like the added ones are replaced; others can't clash.

    A digest that many URLs share is spread over `salts` keys, with a copy of the rules for each. The verdicts of the
    `frequent` most frequent URLs are sent to the pages, so neither they nor URLs without host meet in a task.
    """
    host, path = split_url(F.col(url_col))
    own = packed(pages, host=host, path=path)
    listed = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    bounds = listed.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),  # at most the longest rule's length
        F.coalesce(F.max(F.col("host") == ""), F.lit(False)).alias("hostless"),
    ).first()
    names = ("host", "path", "rule", "verdict")
    if not bounds["labels"]:
        return unpacked(own.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}), pages.columns, *names)
    short = lambda c: F.substring(c, 1, prefix)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    held = listed.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict", _digest(F.col("host"), F.col("path")).alias("d"), salt.alias("salt"))
    held = held.withColumn("short", short("d"))
    asked = F.lit(True) if bounds["hostless"] else F.col("host") != ""
    lengths = F.array(*[F.lit(n) for n in bounds["lengths"]])
    urls = own.where(asked).groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
    each = urls.withColumn("digest", F.explode_outer(expressions(F.col("host"), F.col("path"), F.lit(bounds["labels"]), lengths))).withColumn("short", short("digest"))
    found = each.join(held, ["short", "salt"], "left")
    rank = F.struct(F.length(F.concat("h", "p")), F.length("h"), F.col("verdict") == "block", F.concat("h", "p"))
    fits = F.when(F.col("digest") == F.col("d"), rank)
    judged = found.groupBy("host", "path").agg(F.max("n").alias("n"), F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), fits).alias("best"))
    judged = materialize(judged, "urls")
    most = F.broadcast(judged.orderBy(F.desc("n")).limit(frequent).select(F.col("host").alias("fh"), F.col("path").alias("fp"), F.col("best").alias("known")))
    marked = own.join(most, (F.col("host") == F.col("fh")) & (F.col("path") == F.col("fp")), "left")
    # rows that need no join any more get a key of their own, which meets nothing
    done = F.col("fh").isNotNull() | ~asked
    keyed = marked.withColumn("kh", F.when(~done, F.col("host"))).withColumn("spread", F.when(done, F.xxhash64("row", "host", "path") if _hashable(own) else F.xxhash64("host", "path")).otherwise(F.lit(0).cast("long")))
    rest = judged.select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.lit(0).cast("long").alias("rs"), F.col("best").alias("later"))
    joined = keyed.join(rest, (F.col("kh") == F.col("rh")) & (F.col("path") == F.col("rp")) & (F.col("spread") == F.col("rs")), "left")
    best = F.coalesce("known", "later")
    made = joined.select("row", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
    return unpacked(made, pages.columns, *names)


def _hashable(rows: DataFrame) -> bool:
    """Whether rows' struct holds no map, which can't be hashed."""
    return "map<" not in rows.schema["row"].dataType.simpleString()
