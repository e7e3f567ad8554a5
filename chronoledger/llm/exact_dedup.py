"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters.  The
distinct blocks of the corpus are sorted and numbered: two blocks have one name
only if they are equal.  Adjacent names are then paired, the distinct pairs
sorted and numbered in turn, until each document has a single name.  Documents
of equally many blocks and equal final name are equal texts: names are numbers
of distinct values, not hashes of them, so there is nothing to collide.

What travels: each block's text is shuffled once, for the distinct (combined on
the map side, so a block of a million copies is a row per task).  Elsewhere a
block goes by a 128-bit fingerprint that is *proved* unambiguous on this very
corpus: if two distinct blocks ever share one, other seeds are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import Stage, lower_ascii, sized_broadcast, unused

#: Characters in a block.  Most documents have one or two; a text of n
#: characters needs log2(n / 2048) rounds of pairing.
BLOCK_CHARS = 2048

#: Distinct values in one sorting bucket, about.
NAMES_PER_BUCKET = 10_000


def blocks_of(text: Column) -> Column:
    """The array of blocks; one empty block for an empty text."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _fingerprint(block: Column, seed: int, bits: int) -> list[Column]:
    whole = [F.xxhash64(F.lit(f"{seed}.{i}"), block) for i in (0, 1)]
    return [F.shiftrightunsigned(x, 64 - bits) if bits < 64 else x for x in whole]


def _named(values: DataFrame, keys: list[str], distinct: int) -> DataFrame:
    """The distinct rows `values` of `keys`, sorted bucket by bucket and numbered:
    adds `name`, the bucket in the high bits and the rank in it in the low 40."""
    buckets = max(1, -(-distinct // NAMES_PER_BUCKET))
    dealt = values.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)).cast("long")
    return dealt.withColumn("name", F.shiftleft(F.col("_b"), 40).bitwiseOR(rank)).drop("_b")


def block_identities(docs: DataFrame, stage: Stage, text: str = "text", fingerprint_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows, identities) of `docs`, which must read alike each time (a table).

    rows: _rid, and all columns of `docs` but `text`, and text_sha256 of the
    normalised text.  identities: _rid, n_blocks, name; equal pairs of the last
    two are equal texts.
    """
    normal = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    seed = 0
    while True:
        # The only pass that shuffles text.
        distinct = (
            docs.select(F.explode(blocks_of(normal)).alias("block"))
            .select(*[x.alias(f"h{i}") for i, x in enumerate(_fingerprint(F.col("block"), seed, fingerprint_bits))], "block")
            .distinct()
        )
        counted = stage.write(distinct.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n")))
        found = counted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("all")).first()
        if found["most"] <= 1:
            break
        stage.drop(counted)
        seed += 1
        fingerprint_bits = min(64, fingerprint_bits + 8)
    prints = F.transform(blocks_of(normal), lambda b: F.struct(*[x.alias(f"h{i}") for i, x in enumerate(_fingerprint(b, seed, fingerprint_bits))]))
    rows = stage.write(docs.select(
        F.monotonically_increasing_id().alias("_rid"), *[c for c in docs.columns if c != text],
        F.sha2(normal, 256).alias("text_sha256"), prints.alias("_prints"),
    ))
    names = _named(counted, ["h0", "h1"], found["all"])
    spread = rows.select("_rid", F.size("_prints").alias("n_blocks"), F.posexplode("_prints").alias("pos", "p")).select("_rid", "n_blocks", "pos", "p.h0", "p.h1")
    level = stage.write(spread.join(names, ["h0", "h1"]).select("_rid", "n_blocks", "pos", "name"))
    stage.drop(counted)
    done = [level.filter("n_blocks = 1").select("_rid", "n_blocks", "name")]
    left = 1  # blocks that a document has at this level, at most
    width = level.agg(F.max("n_blocks")).first()[0] or 1
    while left < width:
        half = (
            level.filter(f"n_blocks > {left}")
            .groupBy("_rid", "n_blocks", F.expr("pos div 2").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        half = stage.write(half)
        pairs = stage.write(half.select("a", "b").distinct())
        names = _named(pairs, ["a", "b"], pairs.count())
        level = stage.write(half.join(names, ["a", "b"]).select("_rid", "n_blocks", "pos", "name"))
        left *= 2
        done.append(level.filter(f"n_blocks > {left // 2} and n_blocks <= {left}").select("_rid", "n_blocks", "name"))
    identities = done[0]
    for more in done[1:]:
        identities = identities.unionByName(more)
    return rows.drop("_prints"), identities


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with its group of equal texts.

    Texts are equal when identical after lower-casing A to Z; a null text
    counts as empty.  Of each group the row with the largest key stays (null
    keys are smallest); of repeated rows with one key exactly one.  Returns
    doc_id, keep_id, group_size, kept, text_sha256, one row per input row.
    """
    stage = Stage(docs.sparkSession, "exact-dedup")
    rows, groups = _grouped(docs, key, text, stage)
    return rows.join(groups, "_rid").select(
        F.col("_key").alias("doc_id"), "keep_id", "group_size", (F.col("_rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )


def _grouped(docs: DataFrame, key: str, text: str, stage: Stage) -> tuple[DataFrame, DataFrame]:
    rows, identities = block_identities(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), stage, "_text")
    known = rows.select("_rid", "_key").join(identities, "_rid")
    # Written first, the groups meet their members in a plain join, of which
    # Spark splits the partition of a group with very many copies.
    groups = stage.write(known.groupBy("n_blocks", "name").agg(F.max(F.struct("_key", "_rid")).alias("last"), F.count(F.lit(1)).alias("group_size")))
    each = identities.join(groups, ["n_blocks", "name"]).select(
        "_rid", F.col("last._key").alias("keep_id"), F.col("last._rid").alias("keep_rid"), "group_size"
    )
    return rows, each


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that exact_duplicates() drops; its columns as they are.

    The rows dropped are known by key and digest.  Rows repeated with one key
    and one text are made one first; other rows that share a key are told apart
    by the digest of the raw text, that of a null text being null.
    """
    stage = Stage(docs.sparkSession, "exact-dedup")
    (mark,) = unused(docs, "__raw")
    raw = F.sha2(F.col(text).cast("binary"), 256)
    marked = docs.select(F.struct(F.col(key).alias("key"), raw.alias("raw")).alias("_key"), F.col(text).alias("_text"))
    rows, groups = _grouped(marked, "_key", "_text", stage)
    each = rows.join(groups, "_rid")
    gone = stage.write(each.filter("_rid <> keep_rid and _key <> keep_id").select(F.col("_key.key").alias("_k"), F.col("_key.raw").alias("_raw")).distinct())
    again = stage.write(each.filter("_rid <> keep_rid and _key <=> keep_id").select(F.col("_key.key").alias("_k"), F.col("_key.raw").alias("_raw")).distinct())
    gone, again = (t.toDF(*unused(docs, "__gone_key", "__gone_raw")) for t in (gone, again))
    on = lambda a, b: a[key].eqNullSafe(b[b.columns[0]]) & a[mark].eqNullSafe(b[b.columns[1]])
    keyed = docs.withColumn(mark, raw)
    gone = sized_broadcast(gone, 400_000)
    kept = keyed.join(gone, on(keyed, gone), "left_anti")
    if again.isEmpty():
        return kept.drop(mark)
    single = kept.join(again, on(kept, again), "left_anti")
    repeated = kept.join(again, on(kept, again), "left_semi").dropDuplicates([key, mark])
    return single.unionByName(repeated).drop(mark)
