"""The ledger: envelope validation and the sequenced, idempotent append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.scalars import bound
from ..schema import CONTENT_COMPANIONS, EVENT_TYPES, FIELDS, SCHEMA_VERSION

#: Arrivals that one bucket of the numbering covers.
BUCKET = 100_000


def violations(envelope: Column) -> Column:
    """What is wrong with an envelope (JSON text), as an array of messages in
    the order of the checks; empty for a valid one."""
    return bound(F.struct(envelope.alias("text"), F.try_parse_json(envelope).alias("v")), _violations)


def _violations(given: Column) -> Column:
    """violations of (text, v: the text parsed).  Text, kinds and names are read
    once each, then compared."""
    get = lambda name, kind: F.try_variant_get(given["v"], f"$.{name}", kind)
    kind_of = lambda name: F.schema_of_variant(get(name, "variant"))
    told = F.struct(
        *[kind_of(name).alias(name) for name, _, _ in FIELDS], kind_of("payload.event_type").alias("event_kind"), get("payload.event_type", "string").alias("event"),
        F.get_json_object(given["text"], "$.schema_version").alias("version"), F.coalesce(F.json_object_keys(given["text"]), F.array().cast("array<string>")).alias("names"),
    )
    return F.when(given["v"].isNull() | ~F.schema_of_variant(given["v"]).startswith("OBJECT"), F.array(F.lit("no object"))).otherwise(bound(told, _broken))


def _broken(told: Column) -> Column:
    """What is wrong with an object of which the kind of each field is told."""
    fits = {
        "string": lambda k: k == "STRING", "integer": lambda k: k == "BIGINT", "boolean": lambda k: k == "BOOLEAN", "object": lambda k: k.startswith("OBJECT"),
        "number": lambda k: (k == "BIGINT") | k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT"),
    }
    checks = []
    for name, kind, required in FIELDS:
        k = told[name]
        absent = k.isNull() | (k == "VOID")
        checks.append(F.when(absent, F.lit(f"missing {name}") if required else F.lit(None)).when(~fits[kind](k), F.lit(f"{name} is no {kind}")))
    checks.append(F.when(told["version"] != SCHEMA_VERSION, "unsupported schema_version"))
    known = F.array(*[F.lit(name) for name, _, _ in FIELDS])
    extra = F.array_sort(F.array_except(told["names"], known))
    checks.append(bound(extra, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("unknown fields: "), F.array_join(x, ", ")))))
    given = lambda name: F.coalesce(told[name] != "VOID", F.lit(False))
    has = given("content_ciphertext")
    for name in CONTENT_COMPANIONS:
        checks.append(F.when(has & ~given(name), f"content without {name}").when(~has & given(name), f"{name} without content"))
    checks.append(F.when(told["event_kind"].isNull() | (told["event_kind"] != "STRING"), "event_type is no string").when(~told["event"].isin(*EVENT_TYPES), "unknown event_type"))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def fresh_records(batch: DataFrame, *targets: DataFrame) -> DataFrame:
    """The first arrival of each dedup_key that no target (ledger, tombstones)
    has.  batch: arrival (whole number) and dedup_key."""
    first = F.row_number().over(Window.partitionBy("dedup_key").orderBy("arrival"))
    out = batch.withColumn("_n", first).filter("_n = 1").drop("_n")
    for target in targets:
        out = out.join(target.select("dedup_key"), "dedup_key", "left_anti")
    return out


def sequenced(fresh: DataFrame, high_water: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """`fresh` (installation_id, arrival) with producer_sequence: the high water
    of its installation plus its place in order of arrival, without a hole.

    Buckets of the arrival are numbered alone and offset by the counts of
    earlier ones, so a bulk load needs no task with all of an installation.
    """
    rows = fresh.withColumn("_b", F.expr(f"arrival div {bucket}"))
    earlier = Window.partitionBy("installation_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("installation_id", "_b").agg(F.count(F.lit(1)).alias("_n")).select("installation_id", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("installation_id", "_b").orderBy("arrival"))
    out = rows.join(base, ["installation_id", "_b"]).withColumn("_place", F.col("_base") + place)
    return out.join(high_water, "installation_id", "left").withColumn("producer_sequence", (F.coalesce("high", F.lit(0)) + F.col("_place")).cast("long")).drop("_b", "_base", "_place", "high")


def next_high_water(high_water: DataFrame, appended: DataFrame) -> DataFrame:
    new = appended.groupBy("installation_id").agg(F.max("producer_sequence").alias("high"))
    return high_water.unionByName(new).groupBy("installation_id").agg(F.max("high").alias("high"))


def companions(parents: DataFrame, event_type: str, payload: Column, key_suffix: str) -> DataFrame:
    """Findings about records: they take the parent's identity and name it as
    their cause."""
    return parents.select(
        "installation_id", "session_id", "correlation_id", "profile", F.lit(event_type).alias("event_type"), F.col("occurred_at"), F.col("event_id").alias("causation_id"),
        payload.alias("payload"), F.concat_ws(":", "dedup_key", F.lit(key_suffix)).alias("dedup_key"),
    )


def stats(events: DataFrame, high_water: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per installation: events, first and last sequence, bytes, high water and
    what is still to be shipped."""
    own = events.groupBy("installation_id").agg(F.count(F.lit(1)).alias("events"), F.min("producer_sequence").alias("first_sequence"), F.max("producer_sequence").alias("last_sequence"), F.sum("bytes").cast("long").alias("bytes"))
    return own.join(high_water, "installation_id", "left").join(cursors, "installation_id", "left").select("installation_id", "events", "first_sequence", "last_sequence", "bytes", F.col("high").alias("high_water"), (F.col("high") - F.coalesce("cursor", F.lit(0))).alias("pending"))


def authoritative(events: DataFrame, keys: list[str]) -> DataFrame:
    """Of partial and final events about one thing the one readers go by: final
    before partial, then the latest."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct(~F.col("partial"), F.col("producer_sequence"))).alias("_e")).select(*keys, "_e.*")


def parse_since(text: str) -> float:
    """Epoch seconds of a number or an ISO 8601 time; naive times are UTC."""
    import datetime

    try:
        return float(text)
    except ValueError:
        at = datetime.datetime.fromisoformat(text)
        return (at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)).timestamp()
