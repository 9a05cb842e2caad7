"""URL filters by a cascade of Bloom filters, in DataFrame functions alone.

Level 1 encodes the listed keys. The unlisted keys of the corpus that pass it by mistake are encoded in level 2, the
listed keys that pass level 2 in level 3, and so on until no key is mistaken. Since the levels are built over all
keys of the corpus, the first level that a key fails tells exactly whether it is listed; no join is needed to judge
rows. A level is one array of 64-bit words, read by the rows' plan as a scalar subquery.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stage

#: The upper and lower case letters that hosts fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 12
HASHES = 6
#: A level lets at most one of so many other keys pass by mistake (0.4 % at these settings).
KEYS_PER_MISTAKE = 200
#: Bits of one level at most (8 MB in each task); a longer list is split by key into several cascades, each judging its keys in a pass of its own.
MOST_BITS = 1 << 26


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; nulls where none fits.

    rules: (verdict, host and path). A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        name, says = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(says)
    return name, says


def _bit(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(bits))


class Level:
    """One Bloom filter: an array of words in a staged table of one row."""

    def __init__(self, keys: DataFrame, number: int, count: int):
        self.number, self.bits = number, -(-max(1, count) * BITS_PER_KEY // 64) * 64
        spots = keys.select(F.explode(F.array(*(_bit(F.col("key"), number, k, self.bits) for k in range(HASHES)))).alias("spot"))
        words = spots.select(F.expr("spot div 64").alias("word"), F.expr("shiftleft(1L, cast(spot % 64 as int))").alias("bits"))
        blank = keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        whole = words.union(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
        self.words = stage(row, f"bloom-{number}").select("words")

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        tests = [F.getbit(F.get(words, F.floor(_bit(key, self.number, k, self.bits) / 64).cast("int")), (_bit(key, self.number, k, self.bits) % 64).cast("int")) == 1 for k in range(HASHES)]
        return reduce(lambda a, b: a & b, tests)


def build_cascade(keys: DataFrame) -> list[Level]:
    """keys: a staged table (key, listed) of all keys of the corpus, each once. The levels, until no key is mistaken."""
    here, there, levels = keys.where("listed").select("key"), keys.where("not listed").select("key"), []
    count = here.count()
    while count:
        levels.append(level := Level(here, len(levels), count))
        here, there = stage(there.where(level.passes(F.col("key"))), "bloom-mistaken"), here
        count = here.count()
    return levels


def listed(key: Column, levels: list[Level]) -> Column:
    """Exact for every key that the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    for n, level in reversed(list(enumerate(levels))):
        out = F.when(level.passes(key), out).otherwise(F.lit(n % 2 == 1))
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], blocked: DataFrame | list[str], id_col: str = "page_id") -> DataFrame:
    """For each row of pages: its id, host, path, the rule that fits (or null) and the verdict, block or allow.

    blocked lists host names (a column `host`, or a plain list); they hold where no rule fits. The empty host is never
    listed. Null and repeated listed hosts count once or not at all; repeated urls get equal verdicts; an empty list or table is fine. Other columns of
    pages are not read.
    """
    spark = pages.sparkSession
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in blocked], "host string")
    listing = blocked.select(F.translate("host", UPPER, LOWER).alias("key"), F.lit(True).alias("listed"))
    here = pages.select(F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = here.select(F.col("host").alias("key"), F.lit(False).alias("listed"))
    keys = stage(listing.union(universe).where("key <> ''").groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
    here_, there_ = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    segments = -(-max(1, here_, there_ // KEYS_PER_MISTAKE) * BITS_PER_KEY // MOST_BITS)
    name, says = rule_for(F.col("host"), F.col("path"), rules)
    parts = []
    for n in range(segments):
        own = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(segments)) == n
        levels = build_cascade(keys if segments == 1 else stage(keys.where(own), "url-keys-part"))
        rows = here if segments == 1 else here.where(F.pmod(F.xxhash64("host", F.lit("part")), F.lit(segments)) == n)
        method = F.when(listed(F.col("host"), levels), "block").otherwise("allow")
        parts.append(rows.select(id_col, "host", "path", name.alias("rule"), F.coalesce(says, method).alias("verdict")))
    return reduce(DataFrame.unionByName, parts)
