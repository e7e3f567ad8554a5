import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from chronoledger.llm import sharding

from .fixtures import clashing, corpus, frame, table


def hash_of(key, shard):
    """XXH64 of the key's bytes, and of the shard as 4 bytes with that as its seed."""
    seed = xxhash.xxh64_intdigest(key.encode(), 42)
    return xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed)


def shard_of(key, weights):
    text = "null" if key is None else f"k{key}"
    score = lambda s: weights[s] / -math.log(((hash_of(text, s) >> 11) + 0.5) / 2**53)
    return max(sorted(weights), key=score)


@pytest.mark.parametrize("weights", [dict.fromkeys(range(16), 1.0), {0: 1.0, 3: 2.5, 7: 0.2}])
def test_shards_are_those_of_a_recomputation(spark, weights):
    keys = [None, *range(-5, 3000), 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1)
    got = {r.k: r.s for r in df.select("k", sharding.rendezvous(F.col("k"), weights).alias("s")).collect()}
    assert got == {k: shard_of(k, weights) for k in keys}


def test_growth_moves_rows_into_the_new_shard_only(spark):
    rows = spark.range(20_000).select(sharding.rendezvous(F.col("id"), dict.fromkeys(range(16), 1.0)).alias("a"), sharding.rendezvous(F.col("id"), dict.fromkeys(range(17), 1.0)).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert {r.b for r in moved} == {16}
    assert 0.7 < len(moved) / (len(rows) / 17) < 1.3
    assert max(Counter(r.a for r in rows).values()) < 1.2 * len(rows) / 16


def test_shares_follow_weights(spark):
    got = Counter(r[0] for r in spark.range(30_000).select(sharding.rendezvous(F.col("id"), {0: 1.0, 1: 2.0, 2: 3.0})).collect())
    assert abs(got[0] / 30_000 - 1 / 6) < 0.02 and abs(got[2] / 30_000 - 1 / 2) < 0.02


def test_a_changed_weight_moves_rows_only_to_or_from_its_shard(spark):
    base = {0: 1.0, 1: 1.0, 2: 1.0}
    rows = spark.range(5000).select(sharding.rendezvous(F.col("id"), base).alias("a"), sharding.rendezvous(F.col("id"), base | {2: 2.0}).alias("b")).collect()
    assert all(r.a == r.b or r.b == 2 for r in rows)


def test_places_are_gapless_and_sizes_are_bytes(spark, tmp_path):
    rows = corpus() + corpus()[:20] + [(None, "no key", None), (None, "no key", None)]
    weights = dict.fromkeys(range(5), 1.0)
    got = sharding.shard_records(table(clashing(spark, rows), tmp_path), {s: 1.0 for s in range(4)}, weights).collect()
    assert len(got) == len(rows)
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4) and r.law == "key"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_many_buckets_number_like_one(spark, tmp_path, monkeypatch):
    from chronoledger.llm import common

    monkeypatch.setattr(common, "BUCKET_ROWS", 7)
    got = sharding.shard_records(table(frame(spark, corpus()), tmp_path), {0: 1.0}, {0: 1.0}).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))


def test_empty_table_and_bad_weights(spark, tmp_path):
    assert sharding.shard_records(table(frame(spark, []), tmp_path), {0: 1.0}, {0: 1.0}).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), {0: 0.0})
