"""Allow and block rules for URLs: a sort-merge range join of canonical keys.

A rule names a host and the beginning of a path; it fits that host and its subdomains. The canonical key of
a rule is its host with the labels reversed, a slash, and its path. A URL has one key for every suffix of its host
that starts at a label. A rule fits exactly if its key is a prefix of one of these keys, that is, if the URL's key lies
in the interval of strings that begin with the rule's key. Such intervals nest or are disjoint, so one sweep over
sorted keys answers all of them with a stack of the rules that are open.

The sweep is distributed by ranges of keys. A rule that is open where a range begins is a prefix of the range's first key;
these rules are found by an equi-join with the prefixes of the bounds, and are put before the other events of the range.
Equal URL keys meet the sweep once, so a host or page that holds a third of all rows is one event; its answers go
back to the rows by joins that Spark can split.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, partitions, short_batches

RULE_SCHEMA = "verdict string, host string, path string"
ALLOW, BLOCK = "allow", "block"
# Sampled keys for each range bound.
OVERSAMPLE = 20
# Characters of a range bound.
BOUND_CHARS = 256


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def level_keys(host: Column, path: Column, levels: list[int]) -> Column:
    """Keys of a URL's last labels, as many labels as ``levels`` says; none for an empty host.

    A rule fits at the level of its own host only, so levels that no rule has need no key.
    """
    labels = F.reverse(F.split(host, r"\.", -1))
    wanted = F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n <= F.size(labels))
    keys = F.transform(wanted, lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("/"), path))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events (part, key, rule) to (key, rule): the longest rule that is open at each URL key."""
    part, stack = None, []
    for batch in batches:
        keys, rules = [], []
        for p, key, rule in zip(*(batch.column(n).to_pylist() for n in ("part", "key", "rule")), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule))
            elif stack:
                keys.append(key)
                rules.append(stack[-1][1])
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "rule": pa.array(rules, pa.string())})


def _bounds(keys: DataFrame, parts: int) -> list[str]:
    """At most ``parts - 1`` keys that cut the keys into even ranges: quantiles of a uniform sample by hash order."""
    # Any string can be a bound, so a long key gives its beginning.
    picked = keys.orderBy(F.xxhash64("key"), "key").limit(OVERSAMPLE * parts).select(F.left("key", F.lit(BOUND_CHARS)).alias("key")).collect()
    drawn = sorted(r["key"] for r in picked)
    return sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []


def longest_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule) for the distinct ``keys`` that lie in the interval of a rule; ``rules`` has distinct (key, rule).

    ``rule`` is the one with the longest key. Rules and keys are range partitioned alike; none is broadcast.
    """
    spark = keys.sparkSession
    short_batches(spark)
    parts = partitions(spark)
    bounds = _bounds(keys, parts)

    @F.pandas_udf("int")
    def part_of(key):
        return key.map(lambda k: bisect_right(bounds, k))

    events = keys.select("key", F.lit(None).cast("string").alias("rule")).unionByName(rules.select("key", "rule"))
    events = events.select(part_of("key").alias("part"), "key", "rule")
    if bounds:
        begin = spark.createDataFrame(list(enumerate(bounds, 1)), "part int, bound string")
        prefixes = begin.select(
            "part", "bound", F.explode(F.expr("transform(sequence(1, length(bound)), n -> substring(bound, 1, n))")).alias("key")
        ).filter("key <> bound")  # a rule with the bound itself as key is an event of this range
        carried = prefixes.join(rules, "key").select("part", "key", "rule")
        events = events.unionByName(carried)
    # A rule sorts before the URLs that share its key, and a shorter key before those that it begins.
    ranged = events.repartitionById(parts, "part").sortWithinPartitions("part", "key", F.col("rule").isNull(), "rule")
    return ranged.select("part", "key", "rule").mapInArrow(_sweep, "key string, rule string")


def judge(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", otherwise: str = ALLOW
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has (verdict, host, path). Of several rules that fit, the longest host wins, then the longest path. Of two rules
    with the same host and path, block wins. Rows that no rule fits get ``otherwise``. A null url or one without ``://`` has an
    empty host and path and fits no rule. Rules with a null or empty host fit nothing. Repeated rows stay; empty tables give
    empty results; other columns of ``pages`` are not read.
    """
    parsed = pages.select(
        col(page_id).alias("page_id"), host_of(col(url)).alias("host"), path_of(col(url)).alias("path")
    )
    tidy = (
        rules.select(F.lower("verdict").alias("verdict"), F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .filter("host <> '' and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .select(
            F.concat(reversed_host(F.col("host")), F.lit("/"), "path").alias("key"),
            F.to_json(F.struct("host", "path", "verdict")).alias("rule"),
        )
    )
    urls = parsed.filter("host <> ''").select("host", "path").distinct()
    depths = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\.", -1)).alias("n")).filter("n > 0").distinct().collect())
    levels = urls.select("host", "path", F.explode(level_keys(F.col("host"), F.col("path"), depths)).alias("key"))
    found = longest_rules(levels.select("key").distinct(), tidy)
    rule = F.from_json("rule", "host string, path string, verdict string")
    best = (
        levels.join(found, "key")
        .select("host", "path", rule.alias("rule"))
        .groupBy("host", "path")
        .agg(F.max_by("rule", F.struct(F.length("rule.host"), F.length("rule.path"))).alias("best"))
    )
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"),
    )
