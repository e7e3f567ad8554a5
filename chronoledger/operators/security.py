"""Secret findings: scan targets, matches with byte offsets, fingerprints that
do not give the secret away, suppression, and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

#: Our own documented rules: type -> (pattern, group that is the secret).
RULES = {
    "access_key": (r"\b(AKIA[0-9A-Z]{16})\b", 1),
    "assigned_secret": (r"(?i)\b(?:api_?key|passwd|password|secret|token)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_.=-]{8,})", 1),
    "private_key": (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1),
}

FINGERPRINT = r"^[A-Za-z0-9_-]{22}$"


def scan_targets(records: DataFrame, targets: dict[str, str], key: str) -> DataFrame:
    """(key, target, text) of each named text column that is not empty."""
    pairs = F.array(*[F.struct(F.lit(name).alias("target"), F.col(column).alias("text")) for name, column in targets.items()])
    return records.select(key, F.inline(pairs)).filter("text <> ''")


def secret_matches(targets: DataFrame, key: str, rules: dict[str, tuple[str, int]] = RULES) -> DataFrame:
    """(key, target, type, byte_start, byte_end, value) of each match.

    Offsets are of the group's bytes, end exclusive: the text before the n-th
    match is what splitting by the pattern leaves before it and the matches
    already passed.
    """
    found = None
    for kind, (pattern, group) in rules.items():
        whole, value = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        hits = targets.filter(F.col("text").rlike(pattern)).select(key, "target", F.lit(kind).alias("type"), whole.alias("whole"), value.alias("values"), F.split("text", pattern, -1).alias("gaps"))
        each = hits.select(key, "target", "type", "whole", "gaps", F.posexplode("values").alias("i", "value"))
        size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.octet_length(x))
        before = size(F.slice("gaps", F.lit(1), F.col("i") + 1)) + size(F.slice("whole", F.lit(1), F.col("i")))
        mine = F.get("whole", F.col("i"))
        lead = F.octet_length(F.substring(mine, F.lit(1), F.position("value", mine) - 1))
        rows = each.select(key, "target", "type", (before + lead).cast("long").alias("byte_start"), (before + lead + F.octet_length("value")).cast("long").alias("byte_end"), "value")
        found = rows if found is None else found.unionByName(rows)
    return found


def budgeted(targets: DataFrame, key: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(targets to scan, status) under a budget of bytes for each record.

    Targets are taken whole in order of their names as long as they fit with
    those before them.  status: (key, status), `complete` or, if any was left
    out, `partial`.  Time has no part in it: a scan is a plan, and a task that
    fails is tried again.
    """
    size = F.octet_length("text").cast("long")
    upto = F.sum(size).over(Window.partitionBy(key).orderBy("target").rowsBetween(Window.unboundedPreceding, 0))
    fits = targets.withColumn("_fits", upto <= max_bytes)
    status = fits.groupBy(key).agg(F.when(F.min("_fits"), "complete").otherwise("partial").alias("status"))
    return fits.filter("_fits").drop("_fits"), status


def fingerprinted(matches: DataFrame, secret: bytes) -> DataFrame:
    """Matches with a keyed fingerprint in place of the value."""
    return matches.withColumn("fingerprint", S.fingerprint(secret, F.concat_ws(":", "type", "value"))).drop("value")


def unsuppressed(matches: DataFrame, baseline: DataFrame) -> DataFrame:
    """Matches that the baseline (type, fingerprint) does not have."""
    return matches.join(baseline.select("type", "fingerprint"), ["type", "fingerprint"], "left_anti")


def update_baseline(baseline: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """A baseline with valid entries added and entries removed."""
    out = baseline.select("type", "fingerprint")
    if add is not None:
        out = out.union(add.select("type", "fingerprint").filter(F.col("fingerprint").rlike(FINGERPRINT)))
    if remove is not None:
        out = out.join(remove.select("type", "fingerprint"), ["type", "fingerprint"], "left_anti")
    return out.distinct()


def secret_groups(matches: DataFrame, order: Column) -> DataFrame:
    """A row for each fingerprint: where it was first, and how often it is."""
    first = F.min_by(F.struct("type", "target", "byte_start", "byte_end", F.col("first_event")), order)
    return matches.groupBy("fingerprint").agg(first.alias("f"), F.count(F.lit(1)).alias("occurrences")).select("fingerprint", "f.*", "occurrences")
