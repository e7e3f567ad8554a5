r"""Secret scans: fixed patterns, and a randomness battery for the rest.

Patterns find assignments of credentials, access key ids and long hex strings.
Beyond them every run of 16 or more key characters is a candidate, cut at inner
`=`; so are its parts of that length between `+` or `/` and between `_` or `-`, as
names and paths are glued to values by these.  Runs of digits alone are numbers
and not tested.  A candidate's encoding is inferred from the characters it has, and three tests ask whether it is a
uniform draw from that alphabet: a chi-squared test of symbol counts, a runs test
of the upper against the lower half of the alphabet, and the serial correlation
of neighbours.  Fisher's sum of their log p-values is the candidate's statistic:
small for random strings, large for words.

How small a word's statistic can be by chance depends on its length, so the
letters-only runs of the same corpus that are words serve as decoys.  A third or
more of a word's pairs of letters are among those common in European languages
(of a random string's, a tenth); other letters-only runs are tested.  Within
its length band (and the shorter ones, where words look more random) a
candidate's p-value is the share of decoys that look as random.  Benjamini and
Hochberg's step-up over all candidates then bounds the share of false findings.

All of it is built-in expressions, in one pass over the text; counts of (band,
statistic) are all that leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from .common import Stage
from .quality_rules import let

#: The patterns of the base scan, by kind, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a maximal run of 32 or more
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Runs without inner =, with their padding.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?"

#: Parts of a run that has separators of either kind.
PARTS = (r"[A-Za-z0-9_-]{16,}=*", r"[A-Za-z0-9+/]{16,}=*")

#: Common pairs of letters, and the least share of them in a word (1 of so many).
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ei ie ge sc qu ue ai el la os ci ad do ta un ns tr ss us et il".split()
WORD_PAIRS = 3

#: Lower ends of the length bands.
BANDS = (16, 20, 24, 32, 48)

#: Statistics are counted in steps of half a unit up to this many.
STEPS = 340

#: Bound on the expected share of false findings.
FALSE_SHARE = 0.05

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

#: (pattern, alphabet, whether words of it are decoys), first fit holds.
ENCODINGS = (
    ("^[0-9]+$", None, False),
    ("^[0-9a-f]+$", _DIGITS + _LOWER[:6], False),
    ("^[0-9A-F]+$", _DIGITS + _UPPER[:6], False),
    ("^[A-Z]?[a-z]+$", _LOWER, True),
    ("^[A-Z]+$", _UPPER, True),
    ("^[A-Za-z]+$", _UPPER + _LOWER, True),
    ("^[A-Z2-7]+$", _UPPER + "234567", False),
    ("^[A-Z0-9]+$", _DIGITS + _UPPER, False),
    ("^[a-z0-9]+$", _DIGITS + _LOWER, False),
    ("^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER, False),
    ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", False),
    ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", False),
    ("^[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/-_", False),
)

_SPANS = "array<struct<start:int,end:int,value:string>>"


def running_sums(x: Column) -> Column:
    """Inclusive running sums of an int array, in pieces of 512 so that the
    copies of a growing array stay linear in its length."""
    piece = 512

    def scan(part: Column, base: Column) -> Column:
        start = F.struct(base.cast("int").alias("s"), F.array().cast("array<int>").alias("out"))
        step = lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["out"], F.array(a["s"] + v)).alias("out"))
        return F.aggregate(part, start, step, lambda a: a["out"])

    def both(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v))
        bases = let(sums, lambda s: scan(s, F.lit(0)))
        return let(bases, lambda b: F.flatten(F.transform(parts, lambda p, i: scan(p, F.coalesce(F.get(b, i - 1), F.lit(0))))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / piece).cast("int")), lambda c: F.slice(v, c * piece + 1, F.lit(piece)))
    return let(x, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(cut(v), both)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: start and end of the whole match in
    code points, and the text of `group`.  What splits a text by its matches
    lies between them, so the places are running sums of lengths."""
    def placed(x: Column) -> Column:
        gaps = F.transform(F.slice(F.split(x["t"], pattern, -1), F.lit(1), F.size(x["m"])), lambda g: F.char_length(g))
        ends = running_sums(F.zip_with(gaps, x["m"], lambda g, m: g + F.char_length(m)))
        with_ends = F.zip_with(ends, x["m"], lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end")))
        return F.zip_with(with_ends, F.regexp_extract_all(x["t"], F.lit(pattern), F.lit(group)), lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))

    return let(F.struct(text.alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), placed).cast(_SPANS)


def _found_if(there: Column, spans: Column) -> Column:
    return F.when(there, spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: array of (start, rank of the kind, end)."""
    named = F.lower(text)
    keyed = named.contains("passw") | named.contains("secret") | named.contains("token") | named.contains("key")
    assign = F.filter(_found_if(keyed, matches(text, ASSIGN, 2)), lambda s: F.char_length(s["value"]) >= LEAST_ASSIGN)
    access = F.filter(_found_if(text.contains("AKIA"), matches(text, ACCESS)), lambda s: F.char_length(s["value"]) >= LEAST_ACCESS)
    hexes = _found_if(text.rlike(HEX), matches(text, HEX))
    ranked = lambda spans, rank: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))
    return F.array_sort(F.concat(ranked(assign, 0), ranked(access, 1), ranked(hexes, 2)))


def _two_sided(z: Column) -> Column:
    """p-value of |z| under the normal law, by its logistic approximation."""
    x = F.least(F.abs(z), F.lit(8.0))
    return F.greatest(F.lit(1e-15), 2 / (1 + F.exp(1.5976 * x + 0.07056 * x * x * x)))


def battery(value: Column, alphabet: Column) -> Column:
    """Fisher's statistic (double) of the three tests of `value`, whose
    characters are all in `alphabet`.  Of random strings it has about a
    chi-squared law of six degrees; a constant string has the largest."""
    def tests(x: Column) -> Column:
        idx, k = x["i"], x["k"]
        zero, none = F.lit(0.0), F.lit(-1.0)
        squares = F.aggregate(
            F.sort_array(idx), F.struct(none.alias("p"), zero.alias("r"), zero.alias("s")),
            lambda a, e: F.when(e == a["p"], F.struct(e.alias("p"), (a["r"] + 1).alias("r"), (a["s"] + 2 * a["r"] + 1).alias("s"))).otherwise(F.struct(e.alias("p"), F.lit(1.0).alias("r"), (a["s"] + 1).alias("s"))),
            lambda a: a["s"],
        )
        high = lambda e: F.when(e * 2 >= k, F.lit(1.0)).otherwise(F.lit(0.0))
        start = F.struct(none.alias("p"), zero.alias("hi"), zero.alias("runs"), zero.alias("s"), zero.alias("ss"), zero.alias("lag"))
        sums = F.aggregate(idx, start, lambda a, e: F.struct(
            e.alias("p"), (a["hi"] + high(e)).alias("hi"), (a["runs"] + F.when((a["p"] < 0) | (high(e) != high(a["p"])), 1.0).otherwise(0.0)).alias("runs"),
            (a["s"] + e).alias("s"), (a["ss"] + e * e).alias("ss"), (a["lag"] + F.when(a["p"] < 0, 0.0).otherwise(a["p"] * e)).alias("lag"),
        ))
        return let(F.struct(F.size(idx).cast("double").alias("n"), k.alias("k"), squares.alias("sq"), sums.alias("a"), F.get(idx, F.lit(0)).alias("first"), F.get(idx, F.size(idx) - 1).alias("last")), combined)

    def combined(x: Column) -> Column:
        n, k, a = x["n"], x["k"], x["a"]
        chi = (k / n * x["sq"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        pairs = 2 * a["hi"] * (n - a["hi"])
        runs = F.when(pairs <= n, F.lit(8.0)).otherwise((a["runs"] - pairs / n - 1) / F.sqrt(pairs * (pairs - n) / (n * n * (n - 1))))
        m = a["s"] / n
        spread = a["ss"] - n * m * m
        lag = a["lag"] - m * (2 * a["s"] - x["first"] - x["last"]) + (n - 1) * m * m
        serial = F.when(spread < 1e-9, F.lit(8.0)).otherwise((lag / spread + 1 / n) * F.sqrt(n))
        return -2 * (F.log(_two_sided(chi)) + F.log(_two_sided(runs)) + F.log(_two_sided(serial)))

    chars = F.transform(F.regexp_extract_all(value, F.lit("."), F.lit(0)), lambda c: (F.position(c, alphabet) - 1).cast("double"))
    return let(F.struct(chars.alias("i"), F.char_length(alphabet).cast("double").alias("k")), tests)


def _is_word(value: Column) -> Column:
    """Whether enough pairs of neighbours in a string of letters are common."""
    def enough(v: Column) -> Column:
        n = F.char_length(v) - 1
        common = F.filter(F.sequence(F.lit(1), n), lambda i: v.substr(i, F.lit(2)).isin(PAIRS))
        return F.size(common) * WORD_PAIRS >= n

    return let(F.lower(value), enough)


def _with_parts(run: Column) -> Column:
    """A run and its parts, each place once."""
    def moved(pattern: str) -> Column:
        return F.transform(matches(run["value"], pattern), lambda m: F.struct((run["start"] + m["start"]).alias("start"), (run["start"] + m["end"]).alias("end"), m["value"].alias("value")))

    whole = F.array(run).cast(_SPANS)
    return F.when(run["value"].rlike("[+/_-]"), F.array_distinct(F.concat(whole, *[moved(p).cast(_SPANS) for p in PARTS]))).otherwise(whole)


def candidates(text: Column) -> Column:
    """Tested runs: array of (start, end, band, step, decoy)."""
    def tested(s: Column) -> Column:
        return let(F.rtrim(s["value"], F.lit("=")), lambda v: inferred(s, v))

    def inferred(s: Column, v: Column) -> Column:
        alphabet, decoy = F.lit(None).cast("string"), F.lit(False)
        for pattern, letters, words in reversed(ENCODINGS):
            alphabet = F.when(v.rlike(pattern), F.lit(letters).cast("string")).otherwise(alphabet)
            decoy = F.when(v.rlike(pattern), _is_word(v) if words else F.lit(False)).otherwise(decoy)
        n = F.char_length(v)
        band = sum(((n >= b).cast("int") for b in BANDS[1:]), F.lit(0))
        stat = let(alphabet, lambda a: F.when(a.isNotNull() & (n >= BANDS[0]), battery(v, a)))
        step = let(stat, lambda x: F.when(x.isNotNull(), F.least(F.lit(STEPS), F.floor(x * 2)).cast("int")))  # least() skips nulls
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), band.alias("band"), step.alias("step"), decoy.alias("decoy"))

    runs = _found_if(text.rlike(CANDIDATE), matches(text, CANDIDATE))
    found = F.flatten(F.transform(runs, _with_parts))
    return F.filter(F.transform(found, tested), lambda c: c["step"].isNotNull())


def cutoffs(counts: list[Row], share: float = FALSE_SHARE) -> dict[int, int]:
    """band -> largest step that is a finding, from counts of (band, step,
    decoy, n), by Benjamini and Hochberg's step-up.  A band without decoys in it
    or below it has no findings."""
    decoys = {b: [0] * (STEPS + 1) for b in range(len(BANDS))}
    targets = []
    for r in counts:
        if r["decoy"]:
            for b in range(r["band"], len(BANDS)):
                decoys[b][r["step"]] += r["n"]
        else:
            targets.append((r["band"], r["step"], r["n"]))
    total = {b: sum(x) for b, x in decoys.items()}
    p = {(b, s): (1 + sum(decoys[b][: s + 1])) / (1 + total[b]) for b, s, _ in targets}
    tested = sum(n for *_, n in targets)
    level, seen = 0.0, 0
    by_p: dict[float, int] = {}
    for b, s, n in targets:
        by_p[p[b, s]] = by_p.get(p[b, s], 0) + n
    for value in sorted(by_p):
        seen += by_p[value]
        if value <= share * seen / tested:
            level = value
    out: dict[int, int] = {}
    for b, s, _ in targets:
        if total[b] and p[b, s] <= level:
            out[b] = max(out.get(b, -1), s)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with its secrets.

    Returns doc_id, and spans: array of (start, rank in KINDS, end), sorted, in
    code points with the end exclusive.  `random` spans are those candidates
    that the battery finds and no span of a pattern overlaps, joined where they
    overlap each other.  A null text is empty; repeated rows are scanned each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    stage = Stage(docs.sparkSession, "secret-scan")
    seen = stage.write(docs.select(F.col(key).alias("doc_id"), base_spans(body).alias("base"), candidates(body).alias("tokens")))
    counts = seen.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.step", "t.decoy").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 5 * 341 * 2 rows
    cut = cutoffs(counts)
    apart = lambda t, b: (t["end"] <= b["start"]) | (b["end"] <= t["start"])
    added = F.transform(
        F.filter("tokens", lambda t: ~t["decoy"] & _within(t, cut) & F.forall(F.col("base"), lambda b: apart(t, b))),
        lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")),
    )
    added = let(F.array_sort(added), _joined)
    return seen.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def _joined(spans: Column) -> Column:
    """Sorted `random` spans, those that overlap made one.  A span begins where
    all before it have ended, and ends where the last before the next begin does."""
    opens = F.filter(spans, lambda s: ~F.exists(spans, lambda o: (o["start"] < s["start"]) & (s["start"] < o["end"])))
    begins = F.array_distinct(F.transform(opens, lambda s: s["start"]))
    last = lambda b, i: F.array_max(F.transform(F.filter(spans, lambda s: (s["start"] >= b) & F.coalesce(s["start"] < F.get(begins, i + 1), F.lit(True))), lambda s: s["end"]))
    return F.transform(begins, lambda b, i: F.struct(b.alias("start"), F.lit(3).alias("rank"), last(b, i).alias("end")))


def _within(t: Column, cut: dict[int, int]) -> Column:
    out = F.lit(False)
    for band, step in cut.items():
        out = out | ((t["band"] == band) & (t["step"] <= step))
    return out


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
