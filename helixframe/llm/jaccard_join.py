"""Exact Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion (operator 8).

Jaccard distance is a metric on all sets of shingles. In a text corpus almost any two documents are at distance 1, so that
document pivots alone tell nothing apart; the first level therefore takes one-shingle sets as pivots. Every document lies in
the region of the first of its shingles in a fixed order, rare ones first. Restricting two sets to the first shingles of
that order can only bring them nearer, so a document is replicated into the regions of as many more of its shingles as its
distance window allows (`window_size`): two documents that share none of them are further apart than the radius.

Inside a region documents are pivots. The first is the one that shares most of its first shingles with others: what lies
within the radius of it is linked to it and needs no comparison with each other. A region whose components still differ is joined recursively in a second metric, the L1
distance of how many shingles of a set lie in each of 256 parts of the hash space. That map is 1-Lipschitz, so linked sets
are at most `reach` apart in it, a quarter of either set's size for a similarity of 0.8. Members of a region are pivots
again, every member belongs to the Voronoi cell of its nearest pivot, and boundary members, whose distances to two pivots
differ by no more than twice their reach, are replicated; cells are split again until they are small. Large regions are split
by Spark, cells that fit a task in numpy. Every link is verified on whole shingle sets. What the join returns, components, is
exact; links within a component that is known already are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from . import sketch
from .common import chunks, columns, dropped, mix64, tidied, written
from .components import components
from .shingles import shingle_sets

MEMBERS = "doc_id long, text_key long, node long, n long, parts binary, part int, content binary"
PREFIXES = "region long, salt int, node long, n int"
REGIONS = "label long, salt int, node long, n int"
PARTS = "label long, part int, other int, node long, n int, root long, home boolean, counts binary"
SETS = "node long, hashes binary"
LEAF, PIVOTS, ROUNDS = 32, 32, 3


def node_of(hashes: np.ndarray) -> int:
    """The 64-bit key of a whole shingle set, signed."""
    return xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def window_size(n: int, percent: int) -> int:
    """How many of its first shingles a set of n must be known by: sets that share none of them don't reach percent.

    Sharing at least percent of the larger set's n shingles leaves n - ceil(percent * n / 100) that aren't shared.
    """
    return n - -(-percent * n // 100) + 1


def part_counts(hashes: np.ndarray) -> bytes:
    """How many hashes lie in each of 256 parts, 255 at most."""
    return np.minimum(np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _members(docs: DataFrame, k: int) -> DataFrame:
    """A row per document with the key, size and part counts of its set, and per task the counts of its shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.Counts(), set()
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("parts", pa.binary()), ("part", pa.int32()), ("content", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sets = shingle_sets(part.column(2), k)
                nodes = [node_of(s) if len(s) else None for s in sets]
                fresh = [n is not None and n not in seen and not seen.add(n) for n in nodes]
                counts.add(np.concatenate([s for s, f in zip(sets, fresh) if f] or [np.zeros(0, np.uint64)]))
                none = pa.nulls(len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([part_counts(s) if len(s) else None for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if rows := counts.rows():
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = columns(docs, doc_id="doc_id", text="text")
    return rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidied(run), MEMBERS)


def _prefixes(docs: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """Each set in the regions of its first shingles in the order of rarity; once a task for equal sets.

    Regions of shingles that stand out by a thousand sets or more are salted by node, to groups of some hundreds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                found, nodes, sizes = [], [], []
                for s in shingle_sets(batch.column(0).slice(at, 2000), k):
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        rank = (level[sketch.bucket(s)].astype(np.uint64) << np.uint64(60)) | ((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(4))
                        m = window_size(len(s), percent)
                        found.append(np.partition(rank, m - 1)[:m])
                        nodes.append(node)
                        sizes.append(len(s))
                if found:
                    rank, times = np.concatenate(found), [len(f) for f in found]
                    node = np.repeat(np.array(nodes, np.int64), times)
                    groups = np.int64(1) << np.maximum(0, (rank >> np.uint64(60)).astype(np.int64) - 6)
                    salt = np.where(groups > 1, 1 + (node & (groups - 1)), 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(salt), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), times))], names=["region", "salt", "node", "n"])

    return columns(docs, text="text").mapInArrow(tidied(run), PREFIXES)


def _regions(prefixes: DataFrame) -> DataFrame:
    """Rows of regions of two sets or more, and of salted parts of any size: label, salt, node, n, and the shingles they stand for.

    label is a hash of the members, so that shingles of the same sets give one region; of salted parts, of the shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, 2):
            region, salt, node, n = (c.to_numpy() for c in rows.columns)
            keep = np.ones(len(node), bool)
            keep[1:] = (region[1:] != region[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
            region, salt, node, n = region[keep], salt[keep], node[keep], n[keep]
            begin = np.flatnonzero(np.concatenate(([True], (region[1:] != region[:-1]) | (salt[1:] != salt[:-1]))))
            size = np.diff(np.append(begin, len(node)))
            label = np.where(salt[begin] > 0, mix64(region[begin]), np.bitwise_xor.reduceat(mix64(node), begin)).view(np.int64)
            wanted = (size > 1) | (salt[begin] > 0)
            inside = np.repeat(wanted, size)
            if inside.any():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(label, size)[inside], salt[inside], node[inside], n[inside])], names=["label", "salt", "node", "n"])

    keys = ["region", "salt", "node"]
    dealt = prefixes.repartition("region", "salt").sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidied(run), REGIONS).groupBy("label", "salt", "node").agg(F.first("n").alias("n"), F.count("*").alias("times"))


def _with_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of regions with `lone`, and their region's pivot: the set with the least share of first shingles that are in no other set's.

    A text that others were made of shares most; what was edited more holds more of its own and would reach fewer.
    """
    window = F.expr(f"n - (({percent} * n + 99) DIV 100) + 1")
    lone = rows.groupBy("node").agg(F.sum("times").alias("shared"), F.first("n").alias("n")).select("node", (1 - F.col("shared") / window).alias("lone"))
    rows = rows.drop("times").join(lone, "node")
    least = rows.groupBy("label", "salt").agg(F.min(F.struct("lone", "n", "node")).alias("p"))
    return rows.join(least.select("label", "salt", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), ["label", "salt"])


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose part counts are near enough: |x ^ y| <= (100 - percent) / (100 + percent) * (|x| + |y|) for those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for c in (2, 3))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            sizes = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * apart <= (100 - percent) * sizes))

    one = classes.select(F.col("node").alias("a"), F.col("parts").alias("x"), F.col("n").alias("n_x"))
    two = classes.select(F.col("node").alias("b"), F.col("parts").alias("y"), F.col("n").alias("n_y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(tidied(run), "a long, b long")


def _sets(docs: DataFrame, k: int, wanted) -> DataFrame:
    """(node, hashes) of documents whose id the filter may hold, and of those without an id; once a task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            ids = batch.column(0)
            key = mix64(ids.fill_null(0).to_numpy(zero_copy_only=False)).view(np.int64)
            batch = batch.filter(pa.array(sketch.holds(bits, key) | ids.is_null().to_numpy(zero_copy_only=False)))
            for at in range(0, batch.num_rows, 500):
                rows = []
                for s in shingle_sets(pa.concat_arrays([batch.column(1).slice(at, 500)]), k):
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        rows.append({"node": node, "hashes": s.tobytes()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("node", pa.int64()), ("hashes", pa.binary())]))

    return columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), SETS)


def _sets_of(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The sets of the pairs' nodes, made anew from one document of each, and perhaps a few more; a written table."""

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix64(batch.column(0).to_numpy(zero_copy_only=False)).view(np.int64))], names=["node"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = classes.select("node", "first.doc_id").join(nodes, "node", "left_semi").where("doc_id IS NOT NULL").select("doc_id").mapInArrow(tidied(mixed), "node long")
    wanted = docs.sparkSession.sparkContext.broadcast(sketch.key_filter(ids))
    out = written(_sets(docs, k, wanted).dropDuplicates(["node"]), "sets", "none")
    wanted.unpersist()
    return out


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, total) of the pairs' sets: the sizes of intersection and union, counted on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            shared, total = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared.append(int((y[at] == x).sum()))
                total.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_arrays([a, b, pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "shared", "total"])

    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long, shared long, total long")


def reach(n: np.ndarray, percent: int) -> np.ndarray:
    """How far, in part counts, a set of n shingles can be from a set that it links with."""
    return (100 - percent) * n / percent


class Cell:
    """Members of a region that one task compares: their part counts, sizes and components, and which are at home here.

    Pairs of two guests are compared elsewhere.
    """

    def __init__(self, counts: np.ndarray, n: np.ndarray, root: np.ndarray, home: np.ndarray, percent: int, leaf: int = LEAF):
        self.counts, self.n, self.root, self.home, self.percent, self.leaf = counts, n.astype(np.int64), root, home, percent, leaf
        self.reach = reach(self.n, percent)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def near(self, x: np.ndarray, y: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Of the pairs (x, y) with one member that is at home here, which may link by their components, sizes and part counts."""
        n, m = self.n[x], self.n[y]
        ok = np.flatnonzero((self.root[x] != self.root[y]) & (here[x] | here[y]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)))
        out = np.zeros(len(x), bool)
        for at in range(0, len(ok), 1 << 14):
            k = ok[at : at + (1 << 14)]
            apart = np.abs(self.counts[x[k]] - self.counts[y[k]]).sum(axis=1, dtype=np.int64)
            out[k] = (100 + self.percent) * apart <= (100 - self.percent) * (n[k] + m[k])
        return out

    def take(self, x: np.ndarray, y: np.ndarray, here: np.ndarray | None = None) -> None:
        ok = self.near(x, y, self.home if here is None else here)
        if ok.any():
            self.found.append((x[ok], y[ok]))

    def all_pairs(self, homes: np.ndarray, guests: np.ndarray) -> None:
        """Homes with each other and with guests, of which only sizes within the window are looked at."""
        members = np.concatenate([homes, guests])
        members = members[np.argsort(self.n[members], kind="stable")]
        here = np.zeros(len(self.n), bool)
        here[homes] = True
        upto = np.searchsorted(self.n[members], 100 * self.n[members] // self.percent, side="right")
        xs, ys, waiting = [], [], 0
        for k, end in enumerate(upto.tolist()):
            if end > k + 1:
                xs.append(np.full(end - k - 1, members[k]))
                ys.append(members[k + 1 : end])
                waiting += end - k - 1
            if waiting > 1 << 16:
                self.take(np.concatenate(xs), np.concatenate(ys), here)
                xs, ys, waiting = [], [], 0
        if waiting:
            self.take(np.concatenate(xs), np.concatenate(ys), here)

    def nearest(self, members: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distances of members to pivots, a column per pivot."""
        return np.stack([np.abs(self.counts[members] - self.counts[p]).sum(axis=1, dtype=np.int64) for p in pivots.tolist()], axis=1)

    def join(self, homes: np.ndarray, guests: np.ndarray) -> None:
        """All near pairs of homes with each other and with guests, by Voronoi cells of eight far pivots, recursively."""
        if len(homes) + len(guests) <= self.leaf or len(homes) < 2:
            return self.all_pairs(homes, guests)
        pivots = [homes[np.argmin(self.n[homes])]]
        away = self.nearest(homes, np.array(pivots))[:, 0]
        while len(pivots) < 8 and away.max() > 0:
            pivots.append(homes[away.argmax()])
            away = np.minimum(away, self.nearest(homes, np.array(pivots[-1:]))[:, 0])
        pivots = np.array(pivots)
        at_home, visiting = self.nearest(homes, pivots), self.nearest(guests, pivots) if len(guests) else np.zeros((0, len(pivots)), np.int64)
        cell = at_home.argmin(axis=1)
        # a pair whose members lie in two cells is compared in the first of them
        moved = (at_home - at_home.min(axis=1)[:, None] <= 2 * self.reach[homes][:, None]) & (np.arange(len(pivots)) < cell[:, None])
        invited = visiting - visiting.min(axis=1)[:, None] <= 2 * self.reach[guests][:, None]
        parts = [(homes[cell == c], np.concatenate([homes[moved[:, c]], guests[invited[:, c]]])) for c in range(len(pivots))]
        parts = [p for p in parts if len(p[0])]
        if max(len(h) + len(g) for h, g in parts) > 0.8 * (len(homes) + len(guests)):  # too near to each other for pivots
            return self.all_pairs(homes, guests)
        for h, g in parts:
            self.join(h, g)


def _unresolved(regions: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of regions whose members are in different components, with their root and part counts; all are at home."""
    rows = regions.select("label", "node", "n").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("label").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    rows = rows.join(mixed.select("label"), "label").join(classes.select("node", F.col("parts").alias("counts")), "node")
    return rows.select("label", "node", "n", "root", F.lit(True).alias("home"), "counts")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows with `left`, how many their region has, as a written table."""
    return written(rows.join(rows.groupBy("label").agg(F.count("*").alias("left")), "label"), "open")


def _split(rows: DataFrame, percent: int, block: int, depth: int) -> DataFrame:
    """Rows of _sized regions in the Voronoi cells of about PIVOTS of their members, which become regions; a region is dealt in slices to many tasks."""
    slices = F.ceil(F.col("left") / block).cast("int")
    chosen = F.col("home") & (F.pmod(F.xxhash64("node", F.lit(depth)), F.expr(f"left DIV {PIVOTS} + 1")) == 0)
    pivots = rows.where(chosen).withColumn("part", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("other", F.lit(0))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), slices).cast("int")).withColumn("other", F.lit(1))
    names = ["label", "part", "other", "node", "n", "root", "home", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            is_pivot = group.column(2).to_numpy() == 0
            counts = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
            members, home = np.flatnonzero(~is_pivot), group.column(6).to_numpy(zero_copy_only=False)[~is_pivot]
            points = np.flatnonzero(is_pivot)
            if not len(points):  # none of its members was chosen: one cell
                points = members[:0]
                row, cell, stays = members, np.zeros(len(members), np.int64), home
            else:
                away = np.stack([np.abs(counts[members] - counts[p]).sum(axis=1, dtype=np.int64) for p in points.tolist()], axis=1)
                own = away.argmin(axis=1)
                inside = away - away.min(axis=1)[:, None] <= 2 * reach(group.column(4).to_numpy()[members].astype(np.int64), percent)[:, None]
                inside &= ~home[:, None] | (np.arange(len(points)) <= own[:, None])
                at, cell = np.nonzero(inside)
                row, stays = members[at], home[at] & (cell == own[at])
            label = mix64(group.column(0).to_numpy()[row].view(np.uint64) + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            taken = group.take(pa.array(row))
            made = [pa.array(label), *(taken.column(c).combine_chunks() for c in (3, 4, 5)), pa.array(stays), taken.column(7).combine_chunks()]
            yield from pa.Table.from_arrays(made, names=["label", "node", "n", "root", "home", "counts"]).to_batches(2000)

    dealt = pivots.select(*names).unionAll(dealt.select(*names)).repartition("label", "part").sortWithinPartitions("label", "part", "other", "node")
    cells = dealt.mapInArrow(tidied(run), "label long, node long, n int, root long, home boolean, counts binary")
    alive = cells.groupBy("label").agg(F.max("home").alias("any_home")).where("any_home").select("label")
    return cells.join(alive, "label", "left_semi")


def _window_pairs(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of a region that may be linked: of other components, and near enough in size and part counts.

    rows are _sized. Regions over `block` members, which their Voronoi cells could not reduce, are cut by node into parts;
    every pair of parts is compared by itself, in bounded memory.
    """
    parts = F.ceil(F.col("left") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "n", "root", "home", "mine", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # neighbours meet in many regions
        for chunk in chunks(batches, 3, 1 << 13):
            label, i, j, node, n, root, home, mine = (c.to_numpy(zero_copy_only=False) if c.num_chunks < 2 else c.combine_chunks().to_numpy(zero_copy_only=False) for c in chunk.columns[:8])
            counts = np.frombuffer(b"".join(chunk.column(8).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
            cell = Cell(counts, n, root, home, percent)
            begin = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            size = np.diff(np.append(begin, len(label)))
            group = np.repeat(np.arange(len(size)), size)
            small = (size <= LEAF)[group] & (i == j)
            for step in range(1, min(LEAF, int(size.max()))):  # all pairs of small groups at once
                x = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
                cell.take(x, x + step)
            for g in np.flatnonzero((size > LEAF) | (i[begin] != j[begin])).tolist():
                members = np.arange(begin[g], begin[g] + size[g])
                if i[begin[g]] == j[begin[g]]:
                    cell.join(members[home[members]], members[~home[members]])
                else:
                    left, right = members[mine[members] == i[begin[g]]], members[mine[members] == j[begin[g]]]
                    for x in left.tolist():
                        cell.take(np.full(len(right), x), right)
            if not cell.found:
                continue
            x, y = (node[np.concatenate(c)] for c in zip(*cell.found))
            out = [p for p in dict.fromkeys(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist())) if p not in done]
            if out:
                if len(done) > 1 << 19:
                    done.clear()
                done.update(out)
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(tidied(run), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Stretches of rows with equal keys (the first n_keys columns, integers) from rows that are sorted by them."""
    for rows in chunks(batches, n_keys, 1 << 12):
        new = np.zeros(rows.num_rows - 1, bool)
        for k in range(n_keys):
            key = rows.column(k).to_numpy()
            new |= key[1:] != key[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), rows.num_rows]
        for x, y in zip(edges, edges[1:]):
            yield rows.slice(x, y - x)


def _candidates(regions: DataFrame, found: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Pairs that are left when the first pivots' links are known, as a written table; None if every region is one component."""
    spark = regions.sparkSession
    rows = _sized(_unresolved(regions, found, classes))
    out, depth = None, 0
    while True:
        large = rows.where(F.col("left") > block)
        last = depth == ROUNDS or large.isEmpty()
        pairs = _window_pairs(rows if last else rows.where(F.col("left") <= block), percent, block)
        pairs = written(pairs.distinct(), "candidates")
        out = pairs if out is None else out.unionAll(pairs)
        if last:
            dropped(spark, rows)
            return out.distinct()
        cells = written(_split(large, percent, block, depth), "cells")
        dropped(spark, rows)
        rows, depth = _sized(cells), depth + 1
        dropped(spark, cells)


def _joined(docs: DataFrame, k: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: documents (doc_id, text_key, node, n), and of every node the first document of its component.

    That is `name`, a struct (no_id, doc_id, text_key), and `first`, the same of the node's own documents; documents without
    an id come last. No table is dealt by component without a count of rows that adaptive execution can split.
    """
    spark = docs.sparkSession
    made = written(_members(docs, k), "members")
    members = made.where("part IS NULL").select("doc_id", "text_key", "node", "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    classes = made.where("node IS NOT NULL").groupBy("node").agg(first.alias("first"), F.first("n").cast("int").alias("n"), F.first("parts").alias("parts"))
    classes = written(classes, "classes")
    levels = spark.sparkContext.broadcast(sketch.levels(made.where("part IS NOT NULL")))
    linked = F.expr(f"100L * shared >= {percent}L * total")

    def sizes(other: str, other_n: str) -> Column:
        return F.expr(f"node != {other} AND 100L * least(n, {other_n}) >= {percent}L * greatest(n, {other_n})")

    def links_of(pairs: DataFrame) -> DataFrame | None:
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            return None
        sets = _sets_of(docs, pairs, classes, k)
        out = written(_distances(pairs, sets).where(linked).select("a", "b"), "distances")
        dropped(spark, pairs, sets)
        return out

    rows = written(_regions(_prefixes(docs, k, percent, levels)), "rows")
    levels.unpersist()
    regions = written(_with_pivots(rows, percent), "regions")
    dropped(spark, rows)
    hubs = regions.where("salt > 0 AND node = pivot").select("label", "node", "n", "lone")  # one of each salt: 512 at most
    least = hubs.groupBy("label").agg(F.min(F.struct("lone", "n", "node")).alias("p")).select("label", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    stars = regions.where(sizes("pivot", "pivot_n")).select("node", "pivot").unionAll(hubs.join(least, "label").where(sizes("pivot", "pivot_n")).select("node", "pivot"))
    links = links_of(_near(stars.toDF("a", "b").distinct(), classes, percent))
    none = spark.createDataFrame([], "node long, root long")
    found = none if links is None else components(links)
    more = links_of(_candidates(regions, found, classes, percent, block))
    if more is not None:
        found = components(found.toDF("a", "b").unionAll(more))
    dropped(spark, regions)

    in_links = classes.join(found, "node").select("node", "root", "first")
    names = written(in_links.groupBy("root").agg(F.min("first").alias("name")), "names")
    renamed = in_links.select("node", "root").join(names, "root").select("node", "name")
    nodes = classes.select("node", "first").join(renamed, "node", "left").select("node", F.coalesce("name", "first").alias("name"), "first")
    return members, written(nodes, "nodes")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 4096) -> DataFrame:
    """A row per document: doc_id, n_shingles and component_id, the smallest doc_id that it reaches over links.

    Documents link when 100 * shared >= percent * union of their distinct k-word shingles (A-Z lower-cased; with fewer words
    the whole sequence is one). Equal sets are one node. Null, empty and blank texts have no shingles and link with
    nothing, also not with each other; their component_id is their doc_id. Rows of equal doc_id are documents of their own.
    Null doc_ids take part but don't name a component: component_id is null only if nothing it reaches has an id.
    Sets are told apart, and compared, by 64-bit hashes of shingles.
    """
    members, nodes = _joined(docs, k, percent, block)
    out = members.join(nodes.select("node", "name.doc_id").toDF("node", "name"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"))


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 4096) -> DataFrame:
    """The rows of docs, with all their columns, of which one is kept of each component: that of the smallest (doc_id, text hash).

    Rows of equal id and text are copies, of which one stays. Rows without an id take part, and stay only if nothing that
    they reach has one. Documents without a word link with nothing and all stay.
    """
    _, nodes = _joined(docs, k, percent, block)
    kept = written(nodes.where("name = first").select("name.*"), "kept")
    keys = ["\x00no_id", "\x00doc_id", "\x00text_key"]
    worded = F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\f\r")), F.lit("")) != ""
    keyed = docs.where(worded).select("*", F.col("doc_id").isNull().alias(keys[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(keys[1]), F.xxhash64("text").alias(keys[2]))
    wanted = kept.select("no_id", F.coalesce("doc_id", F.lit(0)), "text_key").toDF(*keys)
    return keyed.join(wanted, keys, "left_semi").dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in docs.columns)).unionAll(docs.where(~worded))


#: The same components in DuckDB's SQL, for k = 5 and percent = 80: every pair that shares a shingle, then all that is reachable.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r (doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
