"""URL filter: expressions of host suffixes and path prefixes, joined to rules on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celloom.llm.groups import hot_join
from celloom.session import small, stored

#: Hex digits of a digest on which the join works; 8 are 32 bits.
SHORT = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or where there is no ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (host and path of the winning rule, else null) and verdict (the rule's, else the default).

    rules(host, path, verdict): a rule fits its host and all subdomains if the url's path starts with the rule's. The longest host
    wins, then the longest path; of rules that are equal in both, block beats allow. Null urls have an empty host and path, which no
    rule fits, as rules without a host are left out. Columns host, path, rule and verdict are replaced. Rows are kept as they are,
    repeats too; urls of any length are read whole. Without rules every url gets the default; an empty table gives an empty one.
    """
    kept = rules.where(F.length("host") > 0).select(
        F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    kept = stored(
        kept.groupBy("r_host", "r_path")
        .agg(F.max(F.struct((F.col("r_verdict") == "block").alias("b"), "r_verdict"))["r_verdict"].alias("r_verdict"))
        .withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("short", F.substring("digest", 1, SHORT)),
        "url-rules",
    )
    # a url has only as many path prefixes as there are lengths among the rules' paths
    lengths = sorted(r[0] for r in kept.select(F.length("r_path")).distinct().collect())
    held = df.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    held = held.withColumn("__place", F.concat("host", F.lit("\n"), "path"))
    places = stored(held.groupBy("__place").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("n")), "url-places")
    pairs = places.select("host", "path").where("host != ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    spread = (
        pairs.select("host", "path", F.explode(suffixes).alias("e_host"), prefixes.alias("prefixes"))
        .select("host", "path", "e_host", F.explode("prefixes").alias("n"))
        .withColumn("e_path", F.expr("substring(path, 1, n)"))
        .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
        .withColumn("short", F.substring("e_digest", 1, SHORT))
    )
    rank = F.struct(F.length("r_host").alias("h"), F.length("r_path").alias("p"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = (
        spread.join(small(kept), "short")
        .where((F.col("digest") == F.col("e_digest")) & (F.col("r_host") == F.col("e_host")) & (F.col("r_path") == F.col("e_path")))
        .groupBy("host", "path")
        .agg(F.max(rank).alias("best"))
    )
    told = places.join(best, ["host", "path"], "left").select("__place", F.col("best")["rule"].alias("rule"), F.coalesce(F.col("best")["verdict"], F.lit(default)).alias("verdict"), "n")
    return hot_join(held, stored(told, "url-verdicts"), "__place").drop("__place")
