"""N-gram Jaccard join by a size-aware heavy-light join.

Documents are sets of word shingles; two link when den * |x & y| >= num * |x | y|.
Every set is ordered by one global order, rare shingles first.  If x and y link,
they share at least c shingles among the first |x| - o(x) + c of x and the first
|y| - o(y) + c of y, o(x) = ceil(num * |x| / den) being the least overlap of x with
any partner.  So

* light sets, up to a boundary B, enumerate all subsets of fixed size (pairs) of
  that prefix with c = 2: two light sets that link share a subset;
* heavy sets, and light ones that may have a heavy partner, post the shingles of
  the prefix with c = 1 to inverted lists, which are scanned.

B is where the estimated cost of both ways together is least.

Lists are scanned without emitting the pairs of a group.  First each list links
its members to one hub, the member in which the shared shingle comes earliest;
what these links join is one component.  Lists that still hold several
components elect other hubs and ask again.  What is left is scanned: the members
outside a list's largest component meet those of the other components, and only
in the first list that both are in, so a pair that shares a hundred lists is one
candidate and not a hundred.  Each candidate passes three lossless tests (sizes,
places of the shared shingle, parity bitmaps) and is then verified on the full
sets.  Equal sets are one node throughout.

No order of the shingles is wrong, so their frequencies may be estimated: a
count sketch over all documents, which grows with them up to a bound, says
which are frequent.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from .common import Stage, arrow_rows, components, sized_broadcast
from .shingles import batches_of, shingle_sets

#: Rows of an Arrow batch: texts and sets are large.
ARROW_ROWS = 1000

#: The frequency sketch has 2^20 to 2^24 cells, 8 for each document within these
#: bounds (64 MB in a task, 16 MB broadcast), and travels in so many rows.
CELL_BITS, CHUNKS = (20, 24), 256

#: Costs of the boundary's estimate, in shuffled rows: of a posting or subset,
#: and of a candidate pair (told apart, looked up twice and verified).
POST_COST, COMPARE_COST = 1.0, 6.0

#: (cells, largest set) of the parity prints that go with each posting into the
#: scan of a list: half as many cells as shingles, so that sets that differ in
#: much more than linked ones can are told apart.
PRINTS = ((512, 1024), (2048, 4096), (8192, 1 << 31))

#: Lists in which a set asks for a hub: its rarest ones; and how often lists that
#: hold several components elect new hubs.  The scan that follows covers all
#: lists, so these set the work only.
HUB_LISTS, HUB_ROUNDS = 8, 1

#: Lists before its own that a posting remembers in the scan.
LOOK_BACK = 12


def least_overlap(n: int, num: int, den: int) -> int:
    """Of a set of n with any set it links to."""
    return -(-num * n // den)


def prefix_length(n: int, c: int, num: int, den: int) -> int:
    return min(n, n - least_overlap(n, num, den) + c)


def order_levels(cells: np.ndarray) -> tuple[np.ndarray, float]:
    """(level of each cell in the order of shingles, how many other sets a posting
    of a rare shingle meets on average).

    Levels rise with the count, in eighths of its standard deviation and, far
    above the mean, with its logarithm: a shingle of n documents stands behind
    almost all others as soon as n exceeds a few deviations.  Cells are taken
    piece by piece, so that little is held beside them.
    """
    mean = float(cells.mean(dtype=np.float64)) if len(cells) else 0.0
    levels, n, total, squares = np.empty(len(cells), np.uint8), 0, 0.0, 0.0
    for at in range(0, len(cells), 1 << 18):
        part = cells[at : at + (1 << 18)].astype(np.float64)
        z = (part - mean) / max(math.sqrt(mean), 1e-9)
        near = np.clip((z + 4) * 8, 0, 96)
        far = 96 + 8 * np.log2(np.maximum(z, 8) / 8)
        levels[at : at + (1 << 18)] = np.clip(np.where(z <= 8, near, far), 0, 255)
        rare = part[part <= max(4.0, mean + 6 * math.sqrt(mean))]
        n, total, squares = n + len(rare), total + float(rare.sum()), squares + float((rare**2).sum())
    return levels, max(0.0, squares - total**2 / max(1, n) - total) / max(1.0, total)


def choose_boundary(sizes: dict[int, int], shared: float, num: int, den: int) -> int:
    """The largest size that enumerates subsets.

    sizes: how many sets have each size; shared: how many other sets a posting
    of a rare shingle meets on average.
    """
    light, heavy = {}, {}
    for n, sets in sizes.items():
        p = prefix_length(n, 2, num, den)
        light[n] = sets * POST_COST * max(1, p * (p - 1) // 2)
        heavy[n] = sets * prefix_length(n, 1, num, den) * (POST_COST + COMPARE_COST * shared)
    best = None
    for b in [1, *sorted(sizes)]:
        cost = sum(v for n, v in light.items() if n <= b) + sum(v for n, v in heavy.items() if n * den >= num * (b + 1))
        if best is None or cost < best[0]:
            best = (cost, b)
    return best[1]


def _bitmap(h: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2^k >= 2n cells, k from 9 to 16."""
    cells = 1 << min(16, max(9, (2 * len(h) - 1).bit_length()))
    odd = np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _print(bitmap: bytes, cells: int) -> np.ndarray:
    """A bitmap folded to so many cells, as longs."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.int64).reshape(-1, cells // 64), axis=0)


def _prints(bitmap: bytes, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The print of a set's own class, and that of the next class for a set that
    may link with one of it."""
    own = next(i for i, (_, top) in enumerate(PRINTS) if n <= top)
    near = n * den >= num * (PRINTS[own][1] + 1)
    return _print(bitmap, PRINTS[own][0]), _print(bitmap, PRINTS[own + 1][0]) if near else None


def may_link(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """False only if the sets differ in more shingles than linked sets can."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    overlap = -(-num * (na + nb) // (num + den))
    return int(np.bitwise_count(x ^ y).sum()) <= na + nb - 2 * overlap


def links(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both) and both > 0


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class _Join:
    """One run over `docs` (columns _key and _text, a table)."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int, stage: Stage):
        self.docs, self.width, self.num, self.den, self.stage = docs, width, num, den, stage
        self.cell_bits = min(CELL_BITS[1], max(CELL_BITS[0], (8 * docs.count()).bit_length()))

    # -- sets ---------------------------------------------------------------

    def describe(self) -> DataFrame:
        """Per row: _key, n, s1, s2 (digest of the set), bits and the prints made
        of them; and the partial sketches of each task in rows that have a chunk."""
        num, den = self.num, self.den
        width, bits_of_cell = self.width, self.cell_bits
        per = (1 << bits_of_cell) // CHUNKS
        schema = StructType([self.docs.schema["_key"]]).add("n", IntegerType()).add("s1", LongType()).add("s2", LongType()).add("bits", BinaryType()).add("print", ArrayType(LongType())).add("upper", ArrayType(LongType())).add("chunk", IntegerType()).add("counts", BinaryType())
        shape = pa.schema([("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("bits", pa.binary()), ("print", pa.list_(pa.int64())), ("upper", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, kind = np.zeros(1 << bits_of_cell, np.uint32), None
            for whole in batches:
                kind = whole.schema.field("_key").type
                for batch in batches_of(whole, "_text"):
                    sets = list(shingle_sets(batch.column("_text"), width))
                    every = np.concatenate(sets)
                    np.add.at(cells, (every >> np.uint64(64 - bits_of_cell)).astype(np.int64), np.uint32(1))
                    digests = np.array([np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets]).reshape(-1, 2)
                    n = np.array([len(x) for x in sets], np.int32)
                    none = pa.nulls(len(sets), pa.int32())
                    bits = [_bitmap(x) for x in sets]
                    cols = [n, digests[:, 0], digests[:, 1], bits, *zip(*[_prints(b, len(x), num, den) for b, x in zip(bits, sets, strict=True)], strict=True), none, pa.nulls(len(sets), pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column("_key"), *[c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, shape, strict=True)]], names=["_key", *shape.names])
            if kind is not None:
                parts = [(i, c.tobytes()) for i, c in enumerate(cells.reshape(CHUNKS, per)) if c.any()]
                void = [pa.nulls(len(parts), t.type) for t in list(shape)[:6]]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), kind), *void, pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=["_key", *shape.names])

        return self.docs.select("_key", "_text").mapInArrow(run, schema)

    def frequencies(self, described: DataFrame) -> np.ndarray:
        """The sketch's cells, summed on the executors: 64 MB at most.  A sum that
        is beyond 32 bits stays at the largest; it only orders shingles."""
        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, c in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    got = np.frombuffer(c, np.uint32).astype(np.int64)
                    sums[i] = sums[i] + got if i in sums else got
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

        parts = described.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(total, "chunk int, counts binary")
        out = np.zeros((CHUNKS, (1 << self.cell_bits) // CHUNKS), np.uint32)
        for row in parts.collect():
            out[row["chunk"]] = np.frombuffer(bytes(row["counts"]), np.uint32)
        return out.reshape(-1)

    def renamed(self, ids: DataFrame) -> dict[tuple[int, int], int]:
        """New node ids for distinct sets that share the first half of their
        digest: some n^2 / 2^65 among n sets, so a handful at any size."""
        rivals = ids.filter("n > 0").groupBy("s1").agg(F.min("s2").alias("lo"), F.max("s2").alias("hi")).filter("lo <> hi").select("s1")
        if rivals.isEmpty():
            return {}
        pairs = ids.join(rivals, "s1", "left_semi").select("s1", "s2").distinct()
        if pairs.limit(100_001).count() > 100_000:
            raise RuntimeError("digests of sets collide far beyond chance")
        digest = lambda a, b: int.from_bytes(hashlib.blake2b(f"{a}.{b}".encode(), digest_size=8).digest(), "little", signed=True)
        new = {(r["s1"], r["s2"]): digest(r["s1"], r["s2"]) for r in pairs.collect()}
        taken = ids.filter(F.col("s1").isin(list(new.values()))).limit(1).count()
        if taken or len(set(new.values())) < len(new):
            raise RuntimeError("digests of sets collide far beyond chance")
        return new

    # -- signatures -----------------------------------------------------------

    def postings(self, levels: np.ndarray, boundary: int, new: dict) -> DataFrame:
        """(sig, node, n, pos): subsets of light sets, prefix shingles of the others."""
        width, num, den, bits_of_cell = self.width, self.num, self.den, self.cell_bits
        known = self.docs.sparkSession.sparkContext.broadcast(levels.tobytes())
        names = ["sig", "node", "n", "pos"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

        def signatures(x: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            n, out = len(x), []
            of = level[(x >> np.uint64(64 - bits_of_cell)).astype(np.int64)]
            ranked = x[np.argsort(of, kind="stable")[: prefix_length(n, 2, num, den)]]
            if n <= boundary and n > 1:
                i, j = subsets(len(ranked))
                out.append(((ranked[i] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (ranked[j] + np.uint64(0x165667B19E3779F9)), i))
            if n > 1 and n * den >= num * (boundary + 1):
                p = prefix_length(n, 1, num, den)
                out.append((ranked[:p], np.arange(p)))
            return out

        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def subsets(p: int) -> tuple[np.ndarray, np.ndarray]:
            if p not in made:
                two = np.array(list(combinations(range(p), 2)), np.int64).reshape(-1, 2)
                made[p] = (two[:, 0], two[:, 1])
            return made[p]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level, seen = np.frombuffer(known.value, np.uint8), set()
            for whole in batches:
                for batch in batches_of(whole, "_text"):
                    cols: list[list[np.ndarray]] = [[], [], [], []]
                    for x in shingle_sets(batch.column("_text"), width):
                        node = _node(x, new)
                        if len(x) < 2 or node in seen:  # sets of one shingle link with equal sets only
                            continue
                        if len(seen) < 200_000:
                            seen.add(node)
                        for sig, pos in signatures(x, level):
                            cols[0].append(_signed(sig))
                            cols[1].append(np.full(len(sig), node, np.int64))
                            cols[2].append(np.full(len(sig), len(x), np.int32))
                            cols[3].append(pos.astype(np.int32))
                    if cols[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

        return self.docs.select("_text").mapInArrow(run, "sig long, node long, n int, pos int")

    # -- candidates -------------------------------------------------------------

    def room(self, side: str = "") -> str:
        """SQL: how far into its order a set's shared shingle may still move; the
        rooms of two sets that link in this list add up to 0 or more.

        If the shared shingle is the first that both have, the pos shingles
        before it differ on each side; every linked pair has such a shingle.
        """
        at = f"{side}." if side else ""
        return f"({self.den - self.num} * cast({at}n as long) - {self.num + self.den} * cast({at}pos as long))"

    def fits(self, a: str, b: str) -> str:
        """SQL: sizes and places of a shared signature allow a link."""
        return f"{self.den} * cast(least({a}.n, {b}.n) as long) >= {self.num} * cast(greatest({a}.n, {b}.n) as long) and {self.room(a)} + {self.room(b)} >= 0"

    def verified(self, pairs: DataFrame, ids: DataFrame, new: dict) -> DataFrame:
        """The pairs (a, b) that link, staged.  pairs: distinct, with na and nb."""
        num, den, width = self.num, self.den, self.width
        bits = ids.groupBy("node").agg(F.first("bits").alias("bits"), F.min("_key").alias("first"))
        a = bits.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("first").alias("fa"))
        b = bits.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("first").alias("fb"))

        def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("x", "y", "na", "nb")]
                keep = [may_link(*row, num, den) for row in zip(*cols, strict=True)]
                yield batch.select(["a", "b", "fa", "fb"]).filter(pa.array(keep, pa.bool_()))

        key = self.docs.schema["_key"].dataType
        kind = StructType().add("a", LongType()).add("b", LongType()).add("fa", key).add("fb", key)
        likely = self.stage.write(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "x", "y", "fa", "fb").mapInArrow(plausible, kind))
        wanted = self.stage.write(likely.select(F.explode(F.array("fa", "fb")).alias("_k")).distinct())
        wanted_hint = sized_broadcast(wanted, 1_000_000)
        texts = self.docs.join(wanted_hint, F.col("_key").eqNullSafe(F.col("_k")), "left_semi").select("_text")

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in batches_of(whole, "_text"):
                    sets = list(shingle_sets(batch.column("_text"), width))
                    yield pa.RecordBatch.from_arrays([pa.array([_node(x, new) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

        sets = self.stage.write(texts.mapInArrow(full, "node long, shingles binary").dropDuplicates(["node"]))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Row by row: a batch of large sets is not held a second time.
                rows = zip(batch.column("x"), batch.column("y"), strict=True)
                keep = [links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in rows]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        out = self.stage.write(likely.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"))
        self.stage.drop(likely, wanted, sets)
        return out

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(rows: _key, n, node; links; roots: node, root or None)."""
        write, drop = self.stage.write, self.stage.drop
        described = write(self.describe())
        ids = described.filter("chunk is null").select("_key", "n", "s1", "s2", "bits", "print", "upper")
        new = self.renamed(ids)
        ids = ids.select("_key", "n", _node_column(new).alias("node"), "bits", "print", "upper")
        cells = self.frequencies(described)
        sizes = {r["n"]: r["count"] for r in ids.filter("n > 0").groupBy(F.least("n", F.lit(4096)).alias("n")).count().collect()}
        levels, shared = order_levels(cells)
        boundary = choose_boundary(sizes, shared, self.num, self.den)

        posted = write(self.postings(levels, boundary, new))
        lists = write(posted.join(self._of_several(posted), "sig").distinct())
        drop(posted)
        found = self.verified(self._hub_pairs(lists.withColumn("root", F.col("node")), F.struct("pos", "node")), ids, new)
        roots = None if found.isEmpty() else components(found, self.stage)
        for turn in range(HUB_ROUNDS + 1):
            mixed = write(self._mixed_lists(lists, roots))
            last = turn == HUB_ROUNDS
            pairs = self._cross_pairs(mixed, ids) if last else self._hub_pairs(mixed, F.struct(F.xxhash64("node", F.lit(turn)), "node"))
            more = self.verified(pairs, ids, new)
            drop(mixed)
            if not more.isEmpty():
                found = found.unionByName(more)
                roots = components(found, self.stage)
        drop(lists)
        return ids.select("_key", "n", "node"), found, roots

    def _of_several(self, posted: DataFrame) -> DataFrame:
        """(sig) of lists with several nodes; a list of two members, as most are,
        must also fit as a pair.  Extremes say so, so lists of any length are
        combined before they are shuffled, and nothing is summed."""
        room = F.expr(self.room())
        known = posted.groupBy("sig").agg(
            F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("members"),
            F.min("n").alias("small"), F.max("n").alias("big"), F.min(room).alias("least"), F.max(room).alias("most"),
        )
        pair = f"{self.den} * cast(small as long) >= {self.num} * cast(big as long) and least + most >= 0"
        return known.filter(f"lo < hi and most >= 0 and (members > 2 or {pair})").select("sig")

    def _hub_pairs(self, lists: DataFrame, rank: Column) -> DataFrame:
        """Pairs of a member and the hub of a list, the least by `rank`, if they
        are of two components."""
        hubs = lists.groupBy("sig").agg(F.min_by(F.struct("node", "n", "pos", "root"), rank).alias("hub"))
        asked = lists.groupBy("node", "n", "root").agg(F.slice(F.array_sort(F.collect_set(F.struct("pos", "sig"))), 1, HUB_LISTS).alias("first")).select("node", "n", "root", F.inline("first"))
        near = asked.alias("m").join(hubs.select("sig", "hub.*").alias("h"), "sig").filter("m.root <> h.root").filter(self.fits("m", "h"))
        return _pairs(near, "m", "h")

    def _mixed_lists(self, lists: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Members of lists with several components, with their component, the
        largest one of the list (major), and room for a partner there."""
        named = lists.withColumn("root", F.col("node")) if roots is None else lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = self.stage.write(named.select("sig", "node", "n", "pos", "root", F.expr(self.room()).alias("room")))
        # By component first: a list of any length is combined before it moves.
        parts = named.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("members"), F.max("room").alias("most"))
        held = parts.groupBy("sig").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("members", "root")).alias("major"), F.max("most").alias("most"))
        return named.join(held.filter("roots > 1 and most >= 0"), "sig").filter("room + most >= 0").select("sig", "node", "n", "pos", "root", "major")

    def _cross_pairs(self, mixed: DataFrame, ids: DataFrame) -> DataFrame:
        """Pairs of different components that a list's scan cannot rule out.

        Members go into the scan with a parity print of their set: the cells in
        which two prints differ are at most the shingles in which the sets do.
        They also know the LOOK_BACK lists of theirs before this one, in the one
        order that all sets share: two members that have one of these in common
        meet there or earlier, so they don't meet here.  The first list that both
        are in is never skipped.
        """
        before = Window.partitionBy("node").orderBy("pos", "sig").rowsBetween(-LOOK_BACK, -1)
        held = ids.groupBy("node").agg(F.first("print").alias("print"), F.first("upper").alias("upper"))
        scanned = self.stage.write(mixed.withColumn("back", F.collect_list("sig").over(before)).join(held, "node"))
        largest = scanned.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        found, low = None, 0
        for cells, top in PRINTS:
            # A pair is scanned in the class of its larger set.
            words = [f"p{i}" for i in range(cells // 64)]
            own = F.when(F.col("n") > low, F.col("print")).otherwise(F.col("upper"))
            members = scanned.filter((F.col("n") <= top) & ((F.col("n") > low) | F.col("upper").isNotNull() & (F.col("n") * self.den >= self.num * (low + 1))))
            members = members.withColumn("own", own).select("sig", "node", "n", "pos", "root", "major", "back", *[F.get("own", F.lit(i)).alias(w) for i, w in enumerate(words)])
            apart = " + ".join(f"bit_count(m.{w} ^ h.{w})" for w in words)
            # |x ^ y| <= |x| + |y| - 2 * least overlap of a linked pair of these sizes.
            allowed = f"{self.num + self.den} * cast({apart} as long) <= {self.den - self.num} * (m.n + h.n)"
            apart_roots = "m.root <> h.root and (h.root = h.major or m.root < h.root)"
            near = members.filter("root <> major").alias("m").join(
                members.alias("h"), F.expr(f"m.sig = h.sig and {apart_roots} and greatest(m.n, h.n) > {low} and {self.fits('m', 'h')} and {allowed} and not arrays_overlap(m.back, h.back)")
            )
            found = _pairs(near, "m", "h") if found is None else found.unionByName(_pairs(near, "m", "h"))
            low = top
            if largest <= top:
                break
        return found


def _pairs(near: DataFrame, m: str, h: str) -> DataFrame:
    down = F.expr(f"{m}.node > {h}.node")
    side = lambda c: (F.when(down, F.col(f"{m}.{c}")).otherwise(F.col(f"{h}.{c}")), F.when(down, F.col(f"{h}.{c}")).otherwise(F.col(f"{m}.{c}")))
    (a, b), (na, nb) = side("node"), side("n")
    return near.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb")).distinct()


def _node(x: np.ndarray, new: dict[tuple[int, int], int]) -> int:
    s1, s2 = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64).tolist()
    return new.get((s1, s2), s1)


def _node_column(new: dict[tuple[int, int], int]):
    out = F.col("s1")
    for (s1, s2), node in new.items():
        out = F.when((F.col("s1") == s1) & (F.col("s2") == s2), F.lit(node)).otherwise(out)
    return out


def similarity_classes(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with the size of its set and its component.

    Rows link when den * |x & y| >= num * |x | y| for their sets of `width`-word
    shingles; rows of equal sets link, rows without words link with nothing.
    component_id is the smallest key reachable by links.  `docs` must be a table
    that reads alike each time.  Repeated rows are in one component; that of
    rows with null keys is null unless it has another key.
    """
    stage = Stage(docs.sparkSession, "jaccard-join")
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        rows, found, roots = _Join(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), width, num, den, stage).run()
    named = rows.filter("n > 0")
    named = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stage.write(named.select("_key", "n", "root"))
    # Written first, so that Spark can split the partition of a large component.
    firsts = stage.write(named.groupBy("root").agg(F.min("_key").alias("component_id")))
    linked = named.join(firsts, "root").select(F.col("_key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select(F.col("_key").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("_key").alias("component_id"))
    return linked.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are the first (by key) of their component.

    Rows without words stay, as do rows with a null key; of rows repeated with
    one key and equal sets all stay, as exact dedup is another operator's task.
    """
    stage = Stage(docs.sparkSession, "jaccard-drop")
    gone = similarity_classes(docs, width, num, den, key, text).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = sized_broadcast(stage.write(gone))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
