"""URL filters by a Bloom filter cascade.

Listed keys go into a first Bloom filter.  The keys of the corpus that pass it
without being listed go into a second, listed keys that pass that one into a
third, and so on until no key is wrong.  Over the key universe the cascade was
built on (every key of every url of the corpus) membership is then exact, and a
url is judged by its own row and the filters: no join with the rules.

Lists too long for one cascade of bounded size are dealt by a hash of the key
into several, each exact over its share of the keys; a url's keys are then asked
cascade by cascade.

A rule is a host and the start of a path; it fits the host and its subdomains.
The keys of a url are the suffixes of its host joined with the starts of its
path, of the lengths that rules have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Stage, lower_ascii

#: The first filter of a cascade has at most so many bytes; the later ones hold
#: half of the keys before them at most, so a broadcast has about twice that.
MAX_BYTES = 32 << 20

#: Bytes of a filter that travel in one row.
CHUNK = 1 << 16

#: Cascades that one pass over the pages asks, each in a worker of its own.
TOGETHER = 4

#: Share of keys outside that pass a filter after the first.
LATER_RATE = 0.5


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[str]) -> list[Rule]:
    """Rules from lines like `block example.com/en/`."""
    out = []
    for line in lines:
        action, _, where = line.partition(" ")
        host, slash, path = where.partition("/")
        if action not in ("allow", "block") or not host:
            raise ValueError(f"no rule: {line!r}")
        out.append(Rule(action, host.lower(), slash + path))
    return out


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A to Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def keys_of(host: str, path: str, lengths: Sequence[int], labels: int) -> list[str]:
    """The keys of a url that rules with paths of `lengths` and at most `labels`
    labels could have, longest first, then longest host first."""
    if not host:
        return []
    parts = host.split(".")
    suffixes = [".".join(parts[i:]) for i in range(max(0, len(parts) - labels), len(parts))]
    found = [(len(s) + n, len(s), s + path[:n]) for s in suffixes for n in lengths if n <= len(path)]
    return [k for _, _, k in sorted(found, reverse=True)]


@dataclass(frozen=True)
class Bloom:
    bits: bytes
    hashes: int
    seed: int

    def places(self, key: str) -> list[int]:
        return places(key, self.seed, self.hashes, 8 * len(self.bits))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key))


def places(key: str, seed: int, hashes: int, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key, seed)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % size for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _bytes_for(count: int, rate: float) -> int:
    return max(1, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 8))


def _bloom(keys: DataFrame, count: int, rate: float, seed: int) -> Bloom:
    """A filter of the `count` rows of `keys` (key): tasks set bits in a filter of
    their own, and what they set is united chunk by chunk on the executors."""
    hashes, size = max(1, round(-math.log2(rate))), _bytes_for(count, rate)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = [p for key in batch.column("key").to_pylist() for p in places(key, seed, hashes, 8 * size)]
            where = np.array(at, np.int64)
            np.bitwise_or.at(bits, where >> 3, (1 << (where & 7)).astype(np.uint8))
        for n in range(0, size, CHUNK):
            part = bits[n : n + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([n // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, raw in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint8)
                whole[n] = whole[n] | part if n in whole else part
        for n, part in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "bits"])

    bits = bytearray(size)
    # A row for each chunk of the filter, whose size is bounded.
    for row in keys.mapInArrow(set_bits, "chunk int, bits binary").repartition("chunk").mapInArrow(unite, "chunk int, bits binary").collect():
        bits[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(row["bits"])] = row["bits"]
    return Bloom(bytes(bits), hashes, seed)


def _rate(count: int, others: int) -> float:
    """The first filter's share of false positives, by the sizes of both sides."""
    return min(LATER_RATE, max(1e-9, math.sqrt(0.5) * count / max(1, others)))


def build(listed: DataFrame, universe: DataFrame, stage: Stage) -> Cascade:
    """The cascade of the distinct keys `listed` that is exact over `universe`
    and `listed` (both: key).  Only keys that pass a filter are shuffled."""
    listed = stage.write(listed.distinct())
    count = listed.count()
    if not count:
        stage.drop(listed)
        return Cascade(())
    others = universe.agg(F.approx_count_distinct("key")).first()[0]  # for the first filter's size only
    levels = [_bloom(listed, count, _rate(count, others), 0)]
    inside, outside, spark = listed, None, listed.sparkSession
    while True:
        level = levels[-1]
        if len(levels) == 1:
            wrong = outside = stage.write(_passing(universe, level, spark).distinct().join(listed, "key", "left_anti"))
        elif len(levels) % 2 == 0:
            wrong = stage.write(_passing(inside, level, spark))
            stage.drop(inside)
            inside = wrong
        else:
            wrong = stage.write(_passing(outside, level, spark))
            stage.drop(outside)
            outside = wrong
        left = wrong.count()
        if not left:
            stage.drop(inside, outside)
            return Cascade(tuple(levels))
        levels.append(_bloom(wrong, left, LATER_RATE, len(levels)))


def _passing(keys: DataFrame, level: Bloom, spark: SparkSession) -> DataFrame:
    shared = spark.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([k in own for k in batch.column("key").to_pylist()], pa.bool_()))

    return keys.mapInArrow(run, "key string")


def _share(key: str, shares: int) -> int:
    return xxhash.xxh64_intdigest(key, 0xC0FFEE) % shares


def _own(keys: DataFrame, share: int, shares: int) -> DataFrame:
    """The keys that fall into one of several shares."""
    if shares == 1:
        return keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_share(k, shares) == share for k in batch.column("key").to_pylist()], pa.bool_()))

    return keys.mapInArrow(run, "key string")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(action, host, path) of rules given as a list."""
    return spark.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Every row of `pages` with its host, path, rule and verdict.

    The longest rule that fits decides; a url that no rule fits is in no list,
    so its verdict is `default`.  If one rule is both allowed and blocked, block
    holds.  A null url, or one without `://`, has an empty host and path and no
    rule.  Returns page_id, host, path, rule, verdict.

    rules: a list, or a table of any length (action, host, path).
    """
    spark = pages.sparkSession
    stage = Stage(spark, "url-cascade")
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    known = stage.write(table.select(F.concat("host", "path").alias("key"), (F.col("action") == "block").alias("bad"), F.length("path").alias("n"), F.size(F.split("host", r"\.", -1)).alias("labels")))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # path lengths: as many as a path has characters
    labels = known.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]
    every, blocked = known.select("key"), known.filter("bad").select("key")
    parsed = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def every_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True) for k in keys_of(h, p, lengths, labels)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["key"])

    universe = parsed.select("host", "path").mapInArrow(every_key, "key string")
    count = every.distinct().count()
    shares = max(1, -(-_bytes_for(count, 1e-9) // MAX_BYTES))
    judged = parsed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    for share in range(shares):
        own = _own(every, share, shares)
        listed = build(own, _own(universe, share, shares), stage)
        barred = build(_own(blocked, share, shares), own, stage)
        judged = _asked(judged, spark.sparkContext.broadcast((listed, barred)), share, shares, lengths, labels)
        if share % TOGETHER == TOGETHER - 1 and share + 1 < shares:
            judged = stage.write(judged)
    stage.drop(known)
    return judged


def _asked(pages: DataFrame, shared: Broadcast, share: int, shares: int, lengths: Sequence[int], labels: int) -> DataFrame:
    """`pages` with the rule and verdict of one share's cascades where they have a
    longer rule than the shares before them (of equal length: with a longer host)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, bad = shared.value
        for batch in batches:
            rules, verdicts = [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("host", "path", "rule", "verdict")], strict=True)
            for host, path, rule, verdict in rows:
                for k in keys_of(host, path, lengths, labels):
                    if k == rule:
                        break  # what follows is not longer
                    if _share(k, shares) == share and k in inside:
                        rule, verdict = k, "block" if k in bad else "allow"
                        break
                rules.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=batch.schema.names)

    return pages.mapInArrow(run, pages.schema)
