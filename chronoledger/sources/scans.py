"""Readers of the ledger's sources.  Each is lazy and pushes its filters down."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


def tolerant(df: DataFrame, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """`columns` (name -> (type, default)) of `df`; absent ones become their typed
    default, so a source with an older schema still reads."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(v).cast(t).alias(c) for c, (t, v) in columns.items()])


def bounded(df: DataFrame, column: str, mark: int, overlap: int, high: int) -> DataFrame:
    """Rows with `column` in (mark - overlap, high]: what a poll reads again and
    what is new.  The bounds are literals, so they reach the scan."""
    return df.filter((F.col(column) > max(0, mark - overlap)) & (F.col(column) <= max(mark, high)))


def high_water(df: DataFrame, column: str, mark: int) -> int:
    return df.agg(F.greatest(F.lit(mark), F.coalesce(F.max(column), F.lit(mark)))).first()[0]


def messages(df: DataFrame, mark: int, overlap: int, high: int, roles: Sequence[str]) -> DataFrame:
    return bounded(df, "id", mark, overlap, high).filter(F.col("role").isin(*roles))


def sessions_to_read(sessions: DataFrame, recent: Column, subjects: DataFrame) -> DataFrame:
    """Sessions that a poll needs: recent ones, those still open, those that
    `subjects` (session_id) names, and all ancestors of these.

    Ancestors are found by pointer doubling: a round reaches twice as far, and
    the last one adds none.  What has been found and the pointers are
    checkpointed, so plans don't grow with the depth.
    """
    from ..operators.lineage import cut

    still_open = F.col("ended_at").isNull() | (F.col("expiry_finalized") == 0)
    first = sessions.filter(recent | still_open).select("id").union(sessions.join(subjects.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi").select("id"))
    found = cut(first.distinct())
    size = found.count()
    jump = cut(sessions.select("id", F.col("parent_session_id").alias("up")).filter("up is not null").distinct())
    while True:
        found = cut(found.union(jump.join(found, "id", "left_semi").select(F.col("up").alias("id"))).distinct())
        now = found.count()
        if now == size:
            return sessions.join(found, "id", "left_semi")
        size = now
        onward = jump.select(F.col("id").alias("up"), F.col("up").alias("far"))
        jump = cut(jump.join(onward, "up").select("id", F.col("far").alias("up")).distinct())


def usage_to_read(usage: DataFrame, touched: DataFrame | None) -> DataFrame:
    """Usage of touched sessions (session_id); all of it on the first run."""
    return usage if touched is None else usage.join(touched.select("session_id").distinct(), "session_id", "left_semi")


def board_runs(runs: DataFrame, mark: int, overlap: int, referenced: DataFrame, was_open: DataFrame) -> DataFrame:
    """Runs changed since `mark`, named by events, or open in the last pass
    (both: board, id)."""
    keys = referenced.select("board", "id").union(was_open.select("board", "id")).distinct()
    changed = F.col("id") > max(0, mark - overlap)
    return runs.filter(changed).unionByName(runs.filter(~changed).join(keys, ["board", "id"], "left_semi"))


def boards(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One table of several boards' tables, each row with its board."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn("board", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def spool(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of a JSONL spool: (value, file).  As a stream the checkpoint is the
    offset; a file appears whole, so there are no partial lines."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").load(path).select("value", F.col("_metadata.file_name").alias("file"))


def spool_files(spark: SparkSession, path: str, generation: str = r"") -> DataFrame:
    """Files below `path` as tail_lines takes them: (file, generation, content).
    The generation is the first group of the pattern in the file's name, or empty
    without one.  Spools are rotated at 64 MB, so a task holds one."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    name = F.col("_metadata.file_name")
    return files.select(name.alias("file"), (F.regexp_extract(name, generation, 1) if generation else F.lit("")).alias("generation"), F.col("value").alias("content"))


def spool_lines(spark: SparkSession, path: str, generation: str = r"") -> DataFrame:
    """Complete lines of the files below `path`, as tail_lines gives them: (file,
    generation, offset, until, value).

    Files are read in the parts that Spark splits them into, of any size: offsets
    are the running sums of a part's own lines and, for its first, the bytes of
    the parts before it, of which a table has one row each.  Names are told apart
    by their folders.  Files must not be compressed.
    """
    meta = lambda name: F.col(f"_metadata.file_{name}")
    name = meta("name")
    read = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").load(path)
    lines = read.select(
        meta("path").alias("_path"), meta("block_start").alias("_part"), meta("size").alias("_size"), F.monotonically_increasing_id().alias("_i"), name.alias("file"),
        (F.regexp_extract(name, generation, 1) if generation else F.lit("")).alias("generation"), (F.octet_length("value") + 1).cast("long").alias("_n"), "value",
    )
    earlier = Window.partitionBy("_path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = lines.groupBy("_path", "_part").agg(F.sum("_n").alias("_sum")).select("_path", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_path", "_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.join(F.broadcast(base), ["_path", "_part"]).withColumn("until", F.col("_base") + F.sum("_n").over(within))
    # A last line without a line feed would end one byte behind its file.
    return placed.filter("until <= _size").select("file", "generation", (F.col("until") - F.col("_n")).alias("offset"), "until", "value")


def tail_lines(files: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """New complete lines of files that grow: (file, generation, offset, until,
    value), the offset in bytes being where a line starts.

    files: (file, generation, content), a snapshot of each; a file is read whole,
    so its writer bounds it by rotation.  cursors: (file, generation, offset) of
    the last pass.  A cursor of another generation, or beyond the end (the file
    was truncated), starts at 0.  A last line without a line feed is still being
    written and waits.
    """
    known = files.withColumn("size", F.octet_length("content").cast("long"))
    if cursors is not None:
        last = cursors.select(F.col("file").alias("_f"), F.col("generation").alias("_g"), F.col("offset").alias("_o"))
        known = known.join(last, (F.col("file") == F.col("_f")) & (F.col("generation") == F.col("_g")) & (F.col("_o") <= F.col("size")), "left")
    else:
        known = known.withColumn("_o", F.lit(0).cast("long"))
    # The split is an input of posexplode only: beside it, it would be one for each line.
    whole = S.bound(F.split("content", "\n", -1), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
    lines = known.select("file", "generation", F.coalesce("_o", F.lit(0)).alias("_from"), F.posexplode(whole).alias("_i", "value"))
    upto = Window.partitionBy("file", "generation").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("until", F.sum(F.octet_length("value") + 1).over(upto).cast("long")).withColumn("offset", F.col("until") - F.octet_length("value") - 1)
    return placed.filter(F.col("offset") >= F.col("_from")).select("file", "generation", "offset", "until", "value")


def tail_cursors(files: DataFrame, lines: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """(file, generation, offset) for the next pass, after `lines` were taken."""
    done = lines.groupBy("file", "generation").agg(F.max("until").alias("until"))
    now = files.select("file", "generation", F.octet_length("content").cast("long").alias("size")).join(done, ["file", "generation"], "left")
    if cursors is None:
        return now.select("file", "generation", F.coalesce("until", F.lit(0)).cast("long").alias("offset"))
    joined = now.join(cursors.withColumnRenamed("offset", "was"), ["file", "generation"], "left")
    return joined.select("file", "generation", F.coalesce("until", F.when(F.col("was") <= F.col("size"), F.col("was")), F.lit(0)).cast("long").alias("offset"))


def json_objects(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of `lines` that are JSON objects, parsed by `schema` as `object`."""
    # The condition is on the text: one on the object would parse it twice.
    return lines.filter(F.trim(column).startswith("{") & F.try_parse_json(column).isNotNull()).withColumn("object", F.from_json(column, schema))


def failure_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Failed model calls in log lines: (value, occurred_at, session_id,
    attempts, summary, provider, model, http_status, error_class)."""
    part = lambda i: F.regexp_extract(column, S.FAILURE_LINE, i)
    found = lines.filter(F.col(column).rlike(S.FAILURE_LINE)).select(
        F.col(column).alias("value"), F.to_timestamp(F.replace(part(1), F.lit(","), F.lit(".")), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"),
        part(2).alias("session_id"), part(3).cast("int").alias("attempts"), part(4).alias("summary"), part(5).alias("provider"), part(6).alias("model"),
    )
    return found.withColumn("occurred_at", F.unix_micros("at") / F.lit(1e6)).drop("at").withColumn("http_status", S.http_status("summary")).withColumn("error_class", S.error_class(F.col("http_status")))


def last_epoch(lines: DataFrame, order: str, column: str = "value") -> DataFrame:
    """(last) the value of the last line that is a number; null if none is."""
    number = F.trim(column).try_cast("double")
    return lines.select(number.alias("number"), order).agg(F.max_by("number", F.when(F.col("number").isNotNull(), F.col(order))).alias("last"))


def single_float(lines: DataFrame, column: str = "value") -> DataFrame:
    """(value) of a file that holds one number; null if absent, empty or malformed."""
    return lines.agg(F.when(F.count(F.lit(1)) == 1, F.first(F.trim(column).try_cast("double"))).alias("value"))


def jobs(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a document `{"jobs": [...]}`; entries that are no objects are dropped."""
    schema = "id string, enabled boolean, state string, paused_at string, created_at string, next_run_at string, schedule struct<kind:string,minutes:double,run_at:string,expression:string,cron:string,expr:string>, repeat struct<times:int,completed:int>"
    items = F.from_json(F.get_json_object(column, "$.jobs"), "array<string>")
    return text.select(F.explode(items).alias("item")).select(F.from_json("item", schema).alias("job")).select("job.*").filter("id is not null")


EXECUTION = {"id": ("string", None), "job_id": ("string", None), "status": ("string", None), "claimed_at": ("string", None), "finished_at": ("string", None)}


def executions(df: DataFrame) -> DataFrame:
    """A snapshot of runs with epoch seconds beside the times as they are (ISO
    texts or numbers); columns that an older source lacks are null."""
    return tolerant(df, EXECUTION).withColumn("claimed_epoch", S.to_epoch("claimed_at")).withColumn("finished_epoch", S.to_epoch("finished_at"))


def active_jobs(df: DataFrame) -> DataFrame:
    """Jobs that are enabled, not paused, and have repeats left."""
    done = F.col("repeat.times").isNotNull() & (F.coalesce(F.col("repeat.completed"), F.lit(0)) >= F.col("repeat.times"))
    paused = (F.coalesce(F.col("state"), F.lit("")) == "paused") | (F.coalesce(F.col("paused_at"), F.lit("")) != "")
    return df.filter(F.coalesce(F.col("enabled"), F.lit(True)) & ~paused & ~F.coalesce(done, F.lit(False)))


def artifact_files(files: DataFrame, excluded: DataFrame, keep: int) -> DataFrame:
    """Files of tracked artifacts in a `binaryFile` listing (path below the root):
    no excluded names, safe paths only, the `keep` smallest paths of each."""
    named = files.withColumn("name", F.regexp_extract("path", "^([^/]+)/", 1)).withColumn("rel", F.regexp_extract("path", "^[^/]+/(.*)$", 1))
    safe = named.filter((F.col("name") != "") & safe_path(F.col("rel"))).join(excluded.select("name").distinct(), "name", "left_anti")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("rel"))
    return safe.withColumn("rank", rank).filter(F.col("rank") <= keep).drop("rank")


def safe_path(path: Column) -> Column:
    """A relative path without empty, `.` or `..` parts, backslashes and control
    characters, of at most 512 characters."""
    parts = F.split(path, "/", -1)
    return path.isNotNull() & (path != "") & (F.char_length(path) <= 512) & ~path.rlike(r"[\\\x00-\x1f\x7f]") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def ledger(df: DataFrame, installation: str | None = None, after: int | None = None, since: float | None = None) -> DataFrame:
    """Events of a ledger table, filtered at the scan."""
    if installation is not None:
        df = df.filter(F.col("installation_id") == installation)
    if after is not None:
        df = df.filter(F.col("producer_sequence") > after)
    if since is not None:  # a missing time counts as 0
        df = df.filter(F.col("occurred_at") >= since) if since > 0 else df.filter(S.epoch_or_zero("occurred_at") >= since)
    return df
