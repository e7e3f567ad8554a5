"""Quality rules as a short-circuit cascade.

Each rule is a boolean expression over the text that rejects a document.  On a
sample of bounded size every rule's cost and rejections are measured; the rules
are then asked in the order of rejections per second, and a document that one
rule rejects is not shown to the next (CASE WHEN evaluates no further).  The
order changes the work, never the verdict: a document stays if no rule rejects it.

A rule's cost is the CPU time that the executors report for the very expression
that the cascade will ask: with counts taken from columns where the table has
them.  Scheduling and the driver's clock have no part in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import Stage

#: Documents in the sample that costs and selectivities come from, about, and
#: how often each rule is run on it; the least cost counts.
SAMPLE_DOCS, RUNS = 2000, 3

WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def chars_of(text: Column, kind: str) -> Column:
    """Code points that the character class `kind` has, by what is left without
    its runs: counting matches would make a string of each."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"{kind}+", ""))).cast("long")


def word_chars(text: Column) -> Column:
    """Code points that stand in words."""
    return F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return chars_of(text, "[#*$%&|<>]")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that the text has twice or more.

    Windows are sorted by a 64-bit hash with their places; equal neighbours
    repeat.  The covered words are counted from the sorted places, so the work
    is n log n in the length of the text.
    """
    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i")),
        )

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        found = let(F.sort_array(windows(w)), repeated)
        return F.when(F.size(w) <= width, F.lit(0)).otherwise(let(found, covered))

    return let(words(text), count).cast("long")


class Text:
    """A text and its counts.  Counts that a table has already are taken from
    it, the others are computed where a rule asks for them."""

    COUNTS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}

    def __init__(self, body: Column, known: tuple[str, ...] = ()):
        self.body, self.known = body, known

    def __getattr__(self, name: str) -> Column:
        if name not in self.COUNTS:
            raise AttributeError(name)
        return F.col(name) if name in self.known else self.COUNTS[name](self.body)

    def chars(self, kind: str) -> Column:
        return chars_of(self.body, kind)


@dataclass(frozen=True)
class Rule:
    """Rejects the documents for which `rejects(text)` is true."""

    name: str
    rejects: Callable[[Text], Column]


#: The rules asked in production.  All bounds are strict.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("symbols", lambda t: t.n_symbols * 10 > t.n_words),
    Rule("exclamations", lambda t: t.chars("[!]") * 5 > t.n_words),
    Rule("capitals", lambda t: t.chars(r"\p{Lu}") * 2 > t.chars(r"\p{L}")),
    Rule("no_letters", lambda t: t.chars(r"\p{L}") * 2 < t.word_chars),
    Rule("word_length", lambda t: let(F.struct(t.word_chars.alias("c"), t.n_words.alias("n")), lambda x: (x["c"] < 2 * x["n"]) | (x["c"] > 25 * x["n"]))),
    Rule("dup_lines", lambda t: t.n_dup_lines * 2 > F.size(F.split(t.body, "\n", -1))),
    Rule("repeats", lambda t: t.n_repeat_words * 2 > t.n_words),
)


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        """Share of documents rejected in a second of work over the sample."""
        return self.rejected / self.seconds


def cpu_seconds(df: DataFrame) -> float:
    """CPU seconds that the executors' tasks take to compute `df`."""
    sc = df.sparkSession.sparkContext
    own, before = uuid.uuid4().hex, sc.getLocalProperty("spark.jobGroup.id")
    sc.setLocalProperty("spark.jobGroup.id", own)
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before)
    jsc, tracker = sc._jsc.sc(), sc.statusTracker()
    jsc.listenerBus().waitUntilEmpty()
    stages = {s for j in tracker.getJobIdsForGroup(own) for s in tracker.getJobInfo(j).stageIds}
    return sum(jsc.statusStore().lastStageAttempt(s).executorCpuTime() for s in stages) / 1e9


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_docs: int = SAMPLE_DOCS, known: tuple[str, ...] = ()) -> list[Measured]:
    """Cost and selectivity of each rule over a sample, best gain first, for a
    table that has the counts `known` as columns.

    The sample is uniform with about `sample_docs` rows at every size of the
    corpus.  Over an empty sample all rules are equal and keep their order.
    """
    total = docs.count()
    stage = Stage(docs.sparkSession, "rule-sample")
    part = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    share = min(1.0, sample_docs / max(1, total))
    part = (part if share == 1.0 else part.sample(fraction=share, seed=17)).coalesce(4)
    sample = stage.write(part.select("text", *[Text.COUNTS[c](F.col("text")).alias(c) for c in known]))
    body = Text(F.col("text"), known)
    hits = sample.agg(*[F.coalesce(F.avg(r.rejects(body).cast("double")), F.lit(0.0)).alias(r.name) for r in rules]).first()
    seconds = lambda column: min(cpu_seconds(sample.select("text", *known, column.alias("_x"))) for _ in range(RUNS))
    floor = seconds(F.lit(0))
    found = [Measured(r.name, max(1e-4, seconds(r.rejects(body)) - floor), hits[r.name]) for r in rules]
    stage.drop(sample)
    return sorted(found, key=lambda m: -m.gain)


def cascade(text: Text, rules: tuple[Rule, ...], order: list[Measured]) -> Column:
    """The name of the first rule in `order` that rejects `text`, else null."""
    by = {r.name: r for r in rules}
    chain = None
    for m in order:
        test = by[m.name].rejects(text)
        chain = F.when(test, F.lit(m.name)) if chain is None else chain.when(test, F.lit(m.name))
    return F.lit(None).cast("string") if chain is None else chain


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", verdict: str = "rejected_by") -> DataFrame:
    """`docs` with `verdict`: the rule that rejected the row, null if it stays.
    Which of several rules is named depends on their measured order; whether
    one is named does not.  A null text counts as empty."""
    return docs.withColumn(verdict, cascade(Text(F.coalesce(F.col(text), F.lit(""))), rules, measure(docs, rules, text)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, columns as they are."""
    order = measure(docs, rules, text)
    return docs.filter(cascade(Text(F.coalesce(F.col(text), F.lit(""))), rules, order).isNull())


def base_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts behind the rules for every row, and the cascade's verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and kept.  A null text has no words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # The counts answer two rules for every row already; the cascade asks the rest.
    rest = tuple(r for r in rules if r.name not in ("few_words", "repeats"))
    order = measure(docs, rest, text, known=tuple(Text.COUNTS))
    counted = docs.select(
        F.col(key).alias("doc_id"), n_words(body).alias("n_words"), word_chars(body).alias("word_chars"), n_symbols(body).alias("n_symbols"),
        n_dup_lines(body).alias("n_dup_lines"), n_repeat_words(body).alias("n_repeat_words"), body.alias("_body"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = counted.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(Text(F.col("_body"), tuple(Text.COUNTS)), rest, order).isNull())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
