"""Verdicts on urls from listed hosts and paths, by a cascade of Bloom filters over all keys that the corpus can ask for.

A rule (host, path) is the key ``host + path``. A url asks for one key per *shape* of the rules: a number of host labels from the
right and a number of path characters from the left. The distinct keys of the corpus and the listed ones make the key
universe. Level 1 of the cascade encodes the listed keys; level 2 the unlisted keys that level 1 lets through; level 3 the listed
ones that level 2 lets through, and so on until none is left. Within the universe membership is then exact, and the scan of
the urls needs no join. A second, smaller cascade tells block from allow among the listed keys.

Everything runs as DataFrame functions. A filter is a binary literal; lists whose filter would pass ``FILTER_BYTES`` are cut by
key hash into shares, each with a cascade of its own, and the urls pass the shares one after another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.runtime import new_table_path

# Bound of one filter literal.
FILTER_BYTES = 4 << 20
# Rate at which the levels after the first let wrong keys through.
LATER_RATE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed: text before the host, host, path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty for null and for texts without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Path of a url up to ``?`` or ``#``; empty for null and for texts without ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as bytes, the lowest bit of the first byte first."""

    number: int
    bits: int
    probes: int
    data: bytes

    def spots(self, key: Column) -> list[Column]:
        first = F.pmod(F.xxhash64(F.lit(2 * self.number), key), F.lit(self.bits))
        step = F.pmod(F.xxhash64(F.lit(2 * self.number + 1), key), F.lit(self.bits))
        return [F.pmod(first + step * i + i, F.lit(self.bits)) for i in range(self.probes)]

    def passes(self, key: Column) -> Column:
        data, out = F.lit(self.data), F.lit(True)
        for spot in self.spots(key):
            byte = F.conv(F.hex(F.substring(data, (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, (spot % 8).cast("int")) == 1)
        return out


def filled(level: Level, keys: DataFrame) -> Level:
    """The level with the bits of all ``keys`` set; they are put together word by word in Spark."""
    spot = keys.select(F.explode(F.array(*level.spots(F.col("key")))).alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    words = spot.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("value")).collect()
    data = bytearray(math.ceil(level.bits / 64) * 8)
    for word, value in words:
        data[8 * word : 8 * word + 8] = (value % 2**64).to_bytes(8, "little")
    return Level(level.number, level.bits, level.probes, bytes(data))


def filter_bits(keys: int, rate: float) -> int:
    return max(64, math.ceil(keys * -math.log(rate) / math.log(2) ** 2))


def first_rate(listed: int, others: int) -> float:
    """Rate of the first level: about 0.7 wrong keys for each listed one get through, however large the universe."""
    return min(LATER_RATE, math.sqrt(0.5) * listed / max(1, others))


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that stops it is an even one, or there is none and their number is odd."""
    out = F.lit(False)
    for level in reversed(levels):
        out = level.passes(key) & ~out
    return out


def cascade(keys: DataFrame) -> list[Level]:
    """Levels over the universe ``keys`` (columns key, listed; a key stands once) until no key is let through wrongly.

    An empty list needs no level. Every level has its own hash functions and the later ones stop half of what comes, so
    the number of levels grows with the logarithm of the list.
    """
    sizes = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    levels: list[Level] = []
    rate, left = first_rate(sizes.get(True, 0), sizes.get(False, 0)), sizes.get(True, 0)
    while left:
        level = Level(len(levels) + 1, filter_bits(left, rate), max(1, round(-math.log2(rate))), b"")
        own = F.col("listed") == F.lit(level.number % 2 == 1)
        levels.append(filled(level, keys.where(own)))
        keys = keys.where(own | levels[-1].passes(F.col("key")))
        left, rate = keys.where(~own).count(), LATER_RATE
    return levels


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path) as a table."""
    names = ("verdict", "host", "path")
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(rule, names)]) for rule in rules])))


def rule_keys(rules: DataFrame) -> DataFrame:
    """Distinct keys of the rules with their shape. Rules without a host, or whose path no url's can start with, fit nothing and go."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    return (
        rules.where((host != "") & ((path == "") | path.startswith("/")))
        .select(
            F.concat(host, path).alias("key"), F.size(F.split(host, r"\.", -1)).alias("labels"), F.length(path).alias("chars"),
            (F.col("verdict") == "block").alias("block"),
        )
        .groupBy("key", "labels", "chars").agg(F.bool_or("block").alias("block"))
    )


def asked_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of one url, one for each shape that it is large enough for."""
    labels = F.size(F.split(host, r"\.", -1))
    keys = [
        F.when((host != "") & (labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n, m in shapes
    ]
    return F.filter(F.array(*keys), lambda key: key.isNotNull()) if keys else F.array().cast("array<string>")


def longest(host: Column, path: Column, keys: Column) -> Column:
    """The longest key; of equally long ones that with the longer host."""
    host_chars = lambda key: F.length(F.substring_index(key, "/", 1))
    return F.array_max(F.transform(keys, lambda key: F.struct(F.length(key).alias("n"), host_chars(key).alias("h"), key.alias("key"))))["key"]


def url_verdicts(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", unlisted: str = "allow", filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rules`` has ``verdict`` (block, or anything else for allow), ``host`` and ``path``. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest counts, and of rules with one key a blocking one. ``rule`` is its host
    and path as one text. A url that no rule fits is not a member of the cascade: its rule is null and its verdict ``unlisted``.

    Null urls and such without ``://`` have an empty host and path and fit nothing. Repeated rows and ids stay, null ids
    too; an empty table gives an empty one, and without rules all urls are unlisted. Urls may be of any length: only the characters
    that a rule can ask for make keys. Other columns of ``pages``, whatever their names, are not read.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    listed = rule_keys(rules)
    shapes = sorted((r["labels"], r["chars"]) for r in listed.select("labels", "chars").distinct().collect())
    asked = asked_keys(F.col("host"), F.col("path"), shapes)
    occurring = urls.select(F.explode(asked).alias("key")).groupBy("key").agg(
        F.lit(True).alias("seen"), F.lit(False).alias("listed"), F.lit(False).alias("block")
    )
    rule_rows = listed.select("key", F.lit(False).alias("seen"), F.lit(True).alias("listed"), "block")
    universe = occurring.unionByName(rule_rows).groupBy("key").agg(*[F.bool_or(c).alias(c) for c in ("seen", "listed", "block")])
    place = new_table_path(spark, "url-keys")
    universe.where("seen").drop("seen").write.parquet(place)
    keys = spark.read.schema("key string, listed boolean, block boolean").parquet(place)

    counts = keys.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("others")).first()
    bits = filter_bits(counts["listed"], first_rate(counts["listed"], counts["others"])) if counts["listed"] else 0
    shares = max(1, math.ceil(bits / 8 / filter_bytes))

    def share_of(key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(0), key), F.lit(shares))

    state = urls.withColumns({"rules": F.array().cast("array<string>"), "blocking": F.array().cast("array<string>")})
    for share in range(shares):
        part = keys.where(share_of(F.col("key")) == share)
        is_listed = cascade(part.select("key", "listed"))
        blocks = cascade(part.where("listed").select("key", F.col("block").alias("listed")))
        hits = F.filter(asked, lambda key: (share_of(key) == share) & member(is_listed, key))
        state = state.withColumn("hits", hits)
        state = state.withColumns({
            "rules": F.concat("rules", "hits"), "blocking": F.concat("blocking", F.filter("hits", lambda key: member(blocks, key)))
        }).drop("hits")
        if shares > 1:
            place = new_table_path(spark, "url-share")
            schema = state.schema
            state.write.parquet(place)
            state = spark.read.schema(schema).parquet(place)
    rule = longest(F.col("host"), F.col("path"), F.col("rules"))
    verdict = F.when(F.col("rule").isNull(), unlisted).when(F.array_contains("blocking", F.col("rule")), "block").otherwise("allow")
    return state.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
