"""Repeated passages by collinear chaining of shared k-mer seeds (operator 7).

Equal texts are one node. Each node's k-mers of words are thinned to minimizers, so that any passage of w + k - 1 words in
common has one in common. A seed joins every node that has it to one partner, the smallest of them, not to all others, at each
of its places (the smallest's further places, to the largest): the rows grow with the text, not with the square of a passage's frequency. All docs of a passage see the same partner unless
edits hide a seed, and then the chain bridges the gap. Per node and partner, matches are chained in order in both texts; the
best predecessor under a gap cost that is linear in the words skipped comes from a Fenwick tree over the partner's positions.
Chains are then aligned word by word, stretched at both ends, and kept if long and alike enough.

A partner by seed may share less than a passage where another text shares all of it. Runs of `least` words that are equal
word for word are therefore sought as wholes too: minimizers of k-mers so long that every such run has one, and, of those
in several nodes, each run of `least` words around them, joined to one partner that has the same run.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from . import common, sketch
from .common import chunks, columns, dropped, mix64, shuffles_dropped, tidied
from .shingles import bare, long_hashes, odd_constants, shingle_hashes, sliding, word_hashes

MEMBERS = "doc_id long, node long, n_words int, part int, content binary"
SEEDS = "kmer long, salt int, node long, pos int, context binary"
STARS = "kind int, key long, node long, partner long, pos int, partner_pos int, n int"
MATCH, HUB, RUN, HEAD, REST, PLACE = range(6)
CHAINS = "node long, partner long, lo int, hi int, partner_lo int, partner_hi int, anchors binary"
ALIGNED = "node long, lo long, hi long, partner long, partner_lo long, partner_hi long, n_matched long"
MARGIN = 32
#: A seed of so many nodes at most has all their pairs. For others, two seeds so many words apart at most are one key.
SMALL, FAR = 16, 64


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """As common.written; the shuffles that made the rows go as soon as they are written."""
    with shuffles_dropped(df.sparkSession):
        return common.written(df, name, compression)


def _nodes(words: np.ndarray, begins: np.ndarray, least: int) -> list[int | None]:
    """The key of each text's word sequence; None for texts of fewer than `least` words."""
    return [xxh3_64_intdigest(words[a:b].tobytes()) - (1 << 63) if b - a >= least else None for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]


def minimizers(words: np.ndarray, begins: np.ndarray, k: int, w: int, grams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in the text, hash) of the least k-mers of every w in a row, at all their places; of adjacent places of one hash, the first."""
    grams = shingle_hashes(words, k) if grams is None else grams
    none = np.zeros(0, np.int64)
    if len(grams) < w:
        return none, none, np.zeros(0, np.uint64)
    low = sliding(grams, w)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[: len(grams)]
    low[np.arange(len(low)) + w + k - 1 > begins[1:][text[: len(low)]]] = 0  # windows that reach over a text's end choose nothing
    edge = np.zeros(w - 1, np.uint64)
    chosen = sliding(np.concatenate([edge, low, edge]), w, least=False) == grams
    chosen[1:] &= (grams[1:] != grams[:-1]) | (text[1:] != text[:-1]) | ~chosen[:-1]
    at = np.flatnonzero(chosen & (grams != 0))
    return text[at], at - begins[text[at]], grams[at]


def long_seeds(words: np.ndarray, begins: np.ndarray, k: int, w: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, position, hash, hash to salt by, context) of the long minimizers that every run of `least` words has.

    The context begins with the least and greatest shift, so that every run belongs to one seed, the first least one in it:
    a run of shift i begins reach - 1 - i words before the seed. Then it has a byte for each of the reach - 1 words before (zero
    where there are none) and after (as many as there are). K-mers of one repeated word are left out. The hash to salt by is the minimizer of the first w short k-mers.
    """
    reach = _reach(k, w, least)
    size = least + 1 - reach
    long = long_hashes(words, size)
    text, pos, hashes = minimizers(words, begins, size, reach, long)
    at = pos + begins[text]
    changes = np.concatenate(([0], np.cumsum(words[1:] != words[:-1])))
    varied = changes[at + size - 1] > changes[at] if size > 1 else np.ones(len(at), bool)
    text, pos, hashes, at = text[varied], pos[varied], hashes[varied], at[varied]
    grams = shingle_hashes(words, k)
    short = grams[np.minimum(at[:, None] + np.arange(w), len(grams) - 1)].min(axis=1) if len(at) else hashes
    one = (words >> np.uint64(24)).astype(np.uint8)
    side = np.arange(reach - 1)
    before = at[:, None] - (reach - 1) + side
    left = np.where(before >= begins[text][:, None], one[np.maximum(before, 0)], 0).astype(np.uint8) if len(at) else np.zeros((0, reach - 1), np.uint8)
    ends = begins[text + 1]
    back, on = np.full(len(at), reach - 1), np.full(len(at), reach - 1)
    for j in range(reach - 1, 0, -1):
        back[(pos >= j) & (long[np.maximum(at - j, 0)] <= hashes)] = j - 1
        on[(at + j + size <= ends) & (long[np.minimum(at + j, max(len(long) - 1, 0))] < hashes)] = j - 1
    shifts = np.stack([reach - 1 - back, on], axis=1).astype(np.uint8)
    context = [s.tobytes() + a.tobytes() + one[b : min(b + reach - 1, e)].tobytes() for s, a, b, e in zip(shifts, left, (at + size).tolist(), ends.tolist())]
    return text, pos, hashes, short, context


def _reach(k: int, w: int, least: int) -> int:
    """How many long k-mers in a row have a minimizer: their size is least + 1 - reach, no less than a window of short ones."""
    return max(1, min(15, least - (w + k - 1)))


def _span(k: int, w: int, least: int) -> int:
    """How many words the seeds of a passage of `least` words span at least, with some to spare for edits at its ends."""
    return least - 2 * (w + k) - MARGIN // 4


def _members(docs: DataFrame, k: int, w: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.Counts(), set()
        schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n_words", pa.int32()), ("part", pa.int32()), ("content", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words, begins = word_hashes(part.column(1), bare)
                nodes = _nodes(words, begins, least)
                fresh = np.array([n is not None and n not in seen and not seen.add(n) for n in nodes], bool)
                text, _, hashes = minimizers(words, begins, k, w)
                counts.add(hashes[fresh[text]])
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), pa.array(np.diff(begins).astype(np.int32)), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if rows := counts.rows():
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), MEMBERS)


def _seeds(docs: DataFrame, k: int, w: int, least: int, levels) -> DataFrame:
    """Seeds of every node, once a task for equal texts. Seeds that stand out by a thousand texts or more get a salt by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                words, begins = word_hashes(batch.column(0).slice(at, 2000), bare)
                nodes = _nodes(words, begins, least)
                fresh = np.array([n is not None and n not in seen and not seen.add(n) for n in nodes], bool)
                short = minimizers(words, begins, k, w)
                for text, pos, hashes, by, context in ((*short, short[2], None), long_seeds(words, begins, k, w, least)):
                    ok = fresh[text]
                    context = pa.nulls(int(ok.sum()), pa.binary()) if context is None else pa.array(context, pa.binary()).filter(pa.array(ok))
                    text, pos, hashes, by = text[ok], pos[ok], hashes[ok], by[ok]
                    node = np.array([n or 0 for n in nodes], np.int64)[text]
                    groups = np.int64(1) << np.maximum(0, level[sketch.bucket(by)].astype(np.int64) - 6)
                    salt = np.where(groups > 1, 1 + (node & (groups - 1)), 0)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(node), pa.array(pos.astype(np.int32)), context], names=["kmer", "salt", "node", "pos", "context"])

    return columns(docs, text="text").mapInArrow(tidied(run), SEEDS)


def chain(x: np.ndarray, y: np.ndarray, k: int, gap: float, least_score: float) -> list[np.ndarray]:
    """Index arrays of chains of matches (x, y), best first; each match is in one chain at most.

    f(i) = k + max(0, max over j with x_j < x_i, y_j < y_i of f(j) - gap * ((x_i - x_j) + (y_i - y_j))). The cost is a sum of
    two coordinates, so f(j) + gap * (x_j + y_j) in a Fenwick tree for prefix maxima over y finds the best j.
    """
    order = np.lexsort((-y, x))  # equal x: larger y first, so that they can't precede each other
    rank = (np.unique(y, return_inverse=True)[1] + 1).tolist()
    n = max(rank) + 1
    tree: list[tuple[float, int]] = [(-1e18, -1)] * n
    f, before = [0.0] * len(x), [-1] * len(x)
    xs, ys = x.tolist(), y.tolist()
    for i in order.tolist():
        at, top = rank[i] - 1, (-1e18, -1)
        while at > 0:
            if tree[at] > top:
                top = tree[at]
            at -= at & -at
        gain = top[0] - gap * (xs[i] + ys[i])
        f[i] = k + max(0.0, gain)
        before[i] = top[1] if gain > 0 else -1
        mine, at = (f[i] + gap * (xs[i] + ys[i]), i), rank[i]
        while at < n:
            if mine > tree[at]:
                tree[at] = mine
            at += at & -at
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: (-f[i], xs[i])):
        if f[i] < least_score:
            break
        part, j = [], i
        while j >= 0 and not used[j]:
            part.append(j)
            used[j] = True
            j = before[j]
        if part and f[i] - (f[j] if j >= 0 else 0.0) >= least_score:
            out.append(np.array(part[::-1]))
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(node, partner, pos, partner_pos) of each pair from rows that are sorted by the pair."""
    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(p) for p in zip(held, cols)]
        cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield int(cols[0][a]), int(cols[1][a]), cols[2][a:b], cols[3][a:b]
        held = [c[edges[-1] :] for c in cols] if len(cols[0]) else None
    if held is not None and len(held[0]):
        yield int(held[0][0]), int(held[1][0]), held[2], held[3]


def _chains(matches: DataFrame, k: int, w: int, least: int) -> DataFrame:
    """Chains that, with what minimizers may miss at the ends, can be of `least` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        reach = _span(k, w, least)
        for node, partner, x, y in _grouped(batches):
            if len(x) < 2 or x.max() - x.min() < reach or y.max() - y.min() < reach:
                continue
            x, y = np.divmod(np.unique(x.astype(np.int64) << 32 | y), 1 << 32)
            for part in chain(x, y, k, gap=0.05, least_score=k + 1):
                a, b = x[part], y[part]
                if a[-1] - a[0] >= reach and b[-1] - b[0] >= reach:
                    rows.append({"node": node, "partner": partner, "lo": int(a[0]), "hi": int(a[-1]) + k, "partner_lo": int(b[0]), "partner_hi": int(b[-1]) + k, "anchors": np.stack([a - a[0], b - b[0]]).astype("<i4").tobytes()})
            if len(rows) > 2000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("node", pa.int64()), ("partner", pa.int64()), *((c, pa.int32()) for c in ("lo", "hi", "partner_lo", "partner_hi")), ("anchors", pa.binary())])
    keys = ["node", "partner"]
    return matches.select(*keys, "pos", "partner_pos").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(run), CHAINS)


def _partners(index: np.ndarray, begin: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The partner's row for each of the rows index, in groups from begin, sorted by node and place; which rows are in the first node.

    A node's places go to the partner's in their order, again from its first where it has fewer: texts that repeat a
    line are held against each other along one diagonal.
    """
    size = np.diff(np.append(begin, len(index)))
    group = np.repeat(np.arange(len(begin)), size)
    change = np.ones(len(index), bool)
    change[1:] = (node[index[1:]] != node[index[:-1]]) | (group[1:] != group[:-1])
    start = np.flatnonzero(change)
    nth = np.arange(len(index)) - np.repeat(start, np.diff(np.append(start, len(index))))
    n_first = np.append(start, len(index))[np.searchsorted(start, begin) + 1] - begin
    last = start[np.searchsorted(start, begin + size - 1, side="right") - 1]
    own = node[index] == node[index[begin]][group]
    at = np.where(own, last[group] + nth % (begin + size - last)[group], begin[group] + nth % n_first[group])
    return index[at], own


def _sizes(index: np.ndarray, begin: np.ndarray, node: np.ndarray) -> np.ndarray:
    """How many nodes each group has, of the rows index in groups from begin, sorted by node."""
    change = np.ones(len(index), np.int64)
    change[1:] = node[index[1:]] != node[index[:-1]]
    change[begin] = 1
    return np.add.reduceat(change, begin)


def _all_pairs(index: np.ndarray, begin: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of every two nodes of a group, for rows and groups as of _partners: places in their order, again from the first where a node has fewer."""
    if not len(index):
        return
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(index))))
    change = np.ones(len(index), bool)
    change[1:] = (node[index[1:]] != node[index[:-1]]) | (group[1:] != group[:-1])
    start = np.flatnonzero(change)
    size, group = np.diff(np.append(start, len(index))), group[start]
    for d in range(1, len(start)):
        b = np.flatnonzero(group[d:] == group[:-d]) + d
        if not len(b):
            return
        a = b - d
        n = np.maximum(size[a], size[b])
        of = np.repeat(np.arange(len(b)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        yield index[start[b][of] + nth % size[b][of]], index[start[a][of] + nth % size[a][of]]


def _stars(seeds: DataFrame, k: int, w: int, least: int) -> DataFrame:
    """What seeds say, by kind: MATCH, places of a short seed in two nodes; RUN, stretches of n words, `least` or more, that two
    nodes seem to share; of salted seeds HUB and HEAD, places (by key) that may have a partner in other salts, and REST, further
    places of a HEAD's node that is alone in its salt; and PLACE, all places of short seeds, n = 1 if not all pairs of nodes are matched.

    A short seed of SMALL nodes at most has all their pairs. Of others, every place of a seed, and of every run of `least`
    words around a long one, is held against the smallest node that has it, and that node's places against the largest. Of a salt's smallest node one place is a head, or all, if it is alone there. A run is known by its long k-mer and a byte of each word
    beside it, so a few runs too many may pass; the alignment decides.
    """
    reach = _reach(k, w, least)

    def table(kind: int, key, node, partner, pos, partner_pos, n) -> pa.RecordBatch:
        made = [np.full(len(node), kind, np.int32), key, node, partner, pos.astype(np.int32), partner_pos.astype(np.int32), n.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["kind", "key", "node", "partner", "pos", "partner_pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, 2, 1 << 17):
            kmer, salt, node, pos = (rows.column(c).to_numpy() for c in range(4))
            keep = np.ones(len(node), bool)
            keep[1:] = (kmer[1:] != kmer[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1]) | (pos[1:] != pos[:-1])
            begin = np.flatnonzero(np.concatenate(([True], (kmer[1:] != kmer[:-1]) | (salt[1:] != salt[:-1]))))
            size = np.diff(np.append(begin, len(node)))
            keep &= np.repeat((node[begin] != node[begin + size - 1]) | (salt[begin] > 0), size)
            if not keep.any():
                continue
            rows = rows.filter(pa.array(keep))
            kmer, salt, node, pos = kmer[keep], salt[keep], node[keep], pos[keep]
            is_long = rows.column(4).is_valid().to_numpy()
            short, zero = np.flatnonzero(~is_long), np.zeros(len(node), np.int64)
            if len(short):
                begin = np.flatnonzero(np.concatenate(([True], (kmer[short][1:] != kmer[short][:-1]) | (salt[short][1:] != salt[short][:-1]))))
                few = (salt[short[begin]] == 0) & (_sizes(short, begin, node) <= SMALL)
                in_few = np.repeat(few, np.diff(np.append(begin, len(short))))
                yield table(PLACE, kmer[short], node[short], node[short], pos[short], pos[short], ~in_few)
                some = short[in_few]
                for x, y in _all_pairs(some, np.flatnonzero(np.isin(np.flatnonzero(in_few), begin)), node):
                    yield table(MATCH, zero[x], node[x], node[y], pos[x], pos[y], zero[x])
                short = short[~in_few]
                begin = np.flatnonzero(np.concatenate(([True], (kmer[short][1:] != kmer[short][:-1]) | (salt[short][1:] != salt[short][:-1])))) if len(short) else short
            if len(short):
                other, own = _partners(short, begin, node)
                ok = node[other] != node[short]
                lone = own & ~ok
                ok[begin] = False  # the first place of all is the others' partner, and needs none
                lone[begin] = True
                x, y = short[ok], other[ok]
                yield table(MATCH, zero[x], node[x], node[y], pos[x], pos[y], zero[x])
                x = short[(salt[short] > 0) & lone]
                yield table(HUB, kmer[x], node[x], node[x], pos[x], pos[x], zero[x])
            long = np.flatnonzero(is_long)
            if not len(long):
                continue
            raw = rows.column(4).filter(pa.array(is_long)).combine_chunks()
            length = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1])
            context = np.zeros((len(long), 2 * reach), np.uint64)
            context[np.arange(2 * reach) < length[:, None]] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            least_shift, most_shift, context, length = context[:, 0].astype(np.int64), context[:, 1].astype(np.int64), context[:, 2:], length - 2
            own_key = mix64(kmer[long].view(np.uint64))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for shift in range(reach):
                ok = np.flatnonzero((pos[long] - (reach - 1) + shift >= 0) & (length >= shift + reach - 1) & (least_shift <= shift) & (shift <= most_shift))
                key = mix64(own_key[ok] + (context[ok, shift : shift + reach - 1] * odd_constants(reach - 1)).sum(axis=1, dtype=np.uint64) + np.uint64(shift))
                local = mix64(key + salt[long[ok]].astype(np.uint64))
                order = np.argsort(local, kind="stable")  # nodes and places of one key stay in their order
                index, local, key = long[ok[order]], local[order], key[order]
                if not len(index):
                    continue
                begin = np.flatnonzero(np.concatenate(([True], local[1:] != local[:-1])))
                other, own = _partners(index, begin, node)
                paired = node[other] != node[index]
                found.append((index[paired], other[paired], np.full(int(paired.sum()), shift - (reach - 1))))
                salted, lone = salt[index] > 0, own & ~paired
                first = np.zeros(len(index), bool)
                first[begin] = True
                for kind, some in ((HEAD, salted & first), (REST, salted & lone & ~first)):
                    x = index[some]
                    if len(x):
                        yield table(kind, key[some].view(np.int64), node[x], node[x], pos[x] + shift - (reach - 1), pos[x], np.full(len(x), least))
            x, y, by = (np.concatenate(c) for c in zip(*found)) if found else (short[:0],) * 3
            if len(x):
                stretches = merged(node[x], node[y], pos[x] + by, pos[y] + by, np.full(len(x), least))
                yield table(RUN, np.zeros(len(stretches[0]), np.int64), *stretches)

    keys = ["kmer", "salt", "node", "pos"]
    return seeds.repartition("kmer", "salt").sortWithinPartitions(*keys).mapInArrow(tidied(run), STARS)


def merged(node: np.ndarray, partner: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, partner, x, y, n) of stretches of n words from x and y, those put together that overlap or touch on one diagonal."""
    order = np.lexsort((x, x - y, partner, node))
    node, partner, x, y, n = (c[order] for c in (node, partner, x, y, n))
    new = np.ones(len(x), bool)
    new[1:] = (node[1:] != node[:-1]) | (partner[1:] != partner[:-1]) | ((x - y)[1:] != (x - y)[:-1]) | (x[1:] > x[:-1] + n[:-1])
    begin = np.flatnonzero(new)
    return node[begin], partner[begin], x[begin], y[begin], np.maximum.reduceat(x + n, begin) - x[begin]


def _across(places: DataFrame) -> DataFrame:
    """Places of one key in different salts, each held against another node: key, node, partner, pos, partner_pos, n."""
    ends = places.groupBy("key").agg(F.min(F.struct("node", "pos")).alias("least"), F.max(F.struct("node", "pos")).alias("most")).where("least.node != most.node")
    pairs = places.select("key", "node", "pos", "n").join(ends, "key").withColumn("p", F.expr("IF(node != least.node, least, most)"))
    return pairs.select("key", "node", F.col("p.node").alias("partner"), "pos", F.col("p.pos").alias("partner_pos"), "n")


def _doubles(places: DataFrame, reach: int) -> DataFrame:
    """Matches by two seeds at once, for seeds of many nodes: the two in their order are a key that far fewer nodes have.

    Keys are two different seeds of a node, `reach` to FAR words apart, one of them of more than SMALL nodes. A key of SMALL
    nodes at most has all their pairs, another one's places are held against the smallest node that has it. These are also
    given as rows with their key and n, the words between its seeds, for _compared; n is 0 in matches.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, d = odd_constants(2)
        for rows in chunks(batches, 1):
            node, pos, key, many = (x.to_numpy() for x in rows.columns)
            seed = mix64(key.view(np.uint64))
            for j in range(1, len(node)):
                apart = pos[j:] - pos[:-j]
                near = (node[j:] == node[:-j]) & (apart <= FAR)
                if not near.any():
                    break
                i = np.flatnonzero(near & (apart >= reach) & (many[j:] + many[:-j] > 0) & (key[j:] != key[:-j]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mix64(seed[i] * c + seed[i + j] * d).view(np.int64), node[i], pos[i], apart[i])], names=["key", "node", "pos", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(x: np.ndarray, y: np.ndarray, far: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            made = key[x], node[x], node[y], pos[x] + far * apart[x], pos[y] + far * apart[y], n
            return pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["key", "node", "partner", "pos", "partner_pos", "n"])

        def matches(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return table(np.tile(x, 2), np.tile(y, 2), np.repeat([0, 1], len(x)).astype(np.int32), np.zeros(2 * len(x), np.int32))

        for rows in chunks(batches, 1):
            key, node, pos, apart = (x.to_numpy() for x in rows.columns)
            index = np.arange(len(key))
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = _sizes(index, begin, node)
            for ok in (n > 1) & (n <= SMALL), n > SMALL:
                mine = np.repeat(ok, np.diff(np.append(begin, len(index))))
                some = index[mine]
                if not len(some):
                    continue
                first = np.flatnonzero(np.concatenate(([True], key[some][1:] != key[some][:-1])))
                if n[ok].max() <= SMALL:
                    for x, y in _all_pairs(some, first, node):
                        yield matches(x, y)
                else:
                    other, own = _partners(some, first, node)
                    yield matches(some, other)
                    x, y = some[~own], other[~own]
                    yield table(x, y, np.zeros(len(x), np.int32), apart[x])

    rows = places.selectExpr("node", "pos", "key", "n").repartition("node").sortWithinPartitions("node", "pos")
    rows = rows.mapInArrow(tidied(keyed), "key long, node long, pos int, apart int")
    return rows.repartition("key").sortWithinPartitions("key", "node", "pos").mapInArrow(tidied(run), "key long, node long, partner long, pos int, partner_pos int, n int")


def _both(found: DataFrame) -> DataFrame:
    """Passages from both sides, in columns of their own."""
    names = ("l_node", "l_partner", "l_lo", "l_hi", "l_partner_lo", "l_partner_hi")
    sides = (("node", "partner", "lo", "hi", "partner_lo", "partner_hi"), ("partner", "node", "partner_lo", "partner_hi", "lo", "hi"))
    one, two = (found.select(*(F.col(c).alias(n) for c, n in zip(side, names))) for side in sides)
    return one.unionAll(two)


def _held(places: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Places (pos, n words on) that a passage of the same two texts holds, or (left_anti) those that none holds."""
    there = "l_lo <= pos AND l_hi >= pos + n AND l_partner_lo <= partner_pos + n AND l_partner_hi >= partner_pos"
    return places.join(_both(found), F.expr(f"node = l_node AND partner = l_partner AND {there}"), how)


def _shared(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """All seeds that two nodes share: the places of each in their order, again from the first where a node has fewer."""
    one = pairs.join(places, "node").withColumnRenamed("at", "x")
    both = one.join(places.withColumnsRenamed({"node": "partner", "at": "y"}), ["partner", "key"])
    nth = F.explode(F.expr("transform(sequence(0, greatest(size(x), size(y)) - 1), i -> struct(x[i % size(x)] AS pos, y[i % size(y)] AS partner_pos))"))
    return both.select("node", "partner", nth.alias("m")).select("node", "partner", "m.pos", "m.partner_pos")


def _compared(keyed: DataFrame, found: DataFrame, places: DataFrame, words_of: Callable[[DataFrame], DataFrame], passages_of: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame | None:
    """Passages of texts that share a key of many nodes, but have none there with the smallest node: None if there are no such texts.

    What is left of a key's nodes is held against the first of them and the key's smallest node, by all seeds that two nodes
    share; places that no passage with these holds, against the next 7, the next 56 and so on, until nothing is left. Nodes whose
    places are held still serve as partners. So a place that is left has a passage, or its node is held against every other one
    left at the key. Two nodes are compared once, whatever the number of their keys.
    """
    spark = keyed.sparkSession
    left = written(_held(keyed, found, "left_anti"), "left")
    pairs = left.select("node", "partner")
    if pairs.isEmpty():
        dropped(spark, left)
        return None
    nodes = pairs.select(F.explode(F.array("node", "partner")).alias("node")).distinct()
    at = written(places.join(nodes, "node", "left_semi").groupBy("node", "key").agg(F.array_sort(F.collect_set("pos")).alias("at")), "places")
    words, made, asked, done, most = words_of(pairs), [], [], 0, 1
    nth = F.dense_rank().over(Window.partitionBy("key").orderBy("node"))
    rows = left.select("key", "node", "pos", "n", nth.alias("nth"), F.lit(True).alias("open"))
    ranked = written(rows.withColumn("most", F.max("nth").over(Window.partitionBy("key"))), "ranked")
    while True:
        heads = ranked.where(F.col("nth").between(done + 1, most)).selectExpr("key", "node AS partner", "pos AS partner_pos", "n AS partner_n", "open AS partner_open")
        led = ranked.where("open").join(heads, "key").where("partner < node OR partner > node AND NOT partner_open").select("key", "node", "partner", "pos", "partner_pos", "n", "partner_n")
        led = written(led if done else led.unionByName(left.withColumn("partner_n", F.col("n"))), "led")
        pairs = led.select(F.greatest("node", "partner").alias("node"), F.least("node", "partner").alias("partner")).distinct()
        asked.append(written(pairs.join(functools.reduce(DataFrame.unionAll, asked), ["node", "partner"], "left_anti") if asked else pairs, "pairs"))
        made.append(written(passages_of(_shared(asked[-1], at), words), "passages"))
        sides = led.drop("partner_n").unionByName(led.selectExpr("key", "partner AS node", "node AS partner", "partner_pos AS pos", "pos AS partner_pos", "partner_n AS n"))
        held = _held(sides, functools.reduce(DataFrame.unionByName, made), "left_semi").select("key", "node", "pos", F.lit(True).alias("held")).distinct()
        before, ranked = ranked, written(ranked.join(held, ["key", "node", "pos"], "left").withColumn("open", F.expr("open AND held IS NULL")).drop("held"), "ranked")
        dropped(spark, before, led)
        done, most = most, 8 * most
        if ranked.where(F.col("open") & (F.col("most") > done)).isEmpty():
            break
    dropped(spark, left, at, words, ranked, *asked)
    return functools.reduce(DataFrame.unionByName, made)


def _runs(stretches: DataFrame, k: int) -> DataFrame:
    """Chains of stretches that two nodes seem to share word for word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, 2):
            node, partner, x, y, n = merged(*(c.to_numpy().astype(np.int64) for c in rows.columns))
            for at in range(0, len(node), 2000):
                part = slice(at, at + 2000)
                ends = [np.array([[0, m - k] if m > k else [0]] * 2, "<i4").tobytes() for m in n[part].tolist()]
                made = [node[part], partner[part], *(c[part].astype(np.int32) for c in (x, x + n, y, y + n))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in made), pa.array(ends, pa.binary())], names=["node", "partner", "lo", "hi", "partner_lo", "partner_hi", "anchors"])

    keys = ["node", "partner"]
    return stretches.select(*keys, "pos", "partner_pos", "n").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(run), CHAINS)


def align(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, k: int, before: tuple[int, int]) -> tuple[int, int, int, int, int]:
    """Align words x and y through anchors (matches of k words at positions at_x, at_y, less `before`): lo, hi of both, and matches.

    Between anchors on one diagonal words are compared one by one; where the diagonal changes, the step is put where most
    words match. The ends are stretched along their diagonal while that gains more matches than two thirds of the words.
    """
    a, b = at_x + before[0], at_y + before[1]
    matched = 0
    for i in range(len(a) - 1):
        n, m = int(a[i + 1] - a[i]), int(b[i + 1] - b[i])
        xs, ys = x[a[i] : a[i + 1]], y[b[i] : b[i + 1]]
        short = min(n, m)
        head = xs[:short] == ys[:short]
        if n == m:
            matched += int(head.sum())
        else:
            tail = xs[n - short :] == ys[m - short :]
            matched += int((np.concatenate(([0], np.cumsum(head))) + np.concatenate((np.cumsum(tail[::-1])[::-1], [0]))).max())
    n = min(k, len(x) - int(a[-1]), len(y) - int(b[-1]))
    matched += int((x[a[-1] : a[-1] + n] == y[b[-1] : b[-1] + n]).sum())
    end_x, end_y = int(a[-1]) + n, int(b[-1]) + n
    more = _stretch(x[end_x:], y[end_y:])
    less = _stretch(x[: a[0]][::-1], y[: b[0]][::-1])
    return int(a[0]) - less[0], end_x + more[0], int(b[0]) - less[0], end_y + more[0], matched + more[1] + less[1]


def _stretch(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, 1, -2))
    best = int(score.argmax())
    return (best + 1, int(same[: best + 1].sum())) if score[best] > 0 else (0, 0)


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that spread over all bits, of ids, as they are sought in a key_filter."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix64(batch.column(0).to_numpy(zero_copy_only=False)).view(np.int64))], names=["node"])


def _words(docs: DataFrame, least: int, wanted) -> DataFrame:
    """(node, words) of documents whose id the filter may hold, and of those without an id: 32 bits a word, once a task for equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            ids = batch.column(0)
            key = mix64(ids.fill_null(0).to_numpy(zero_copy_only=False)).view(np.int64)
            batch = batch.filter(pa.array(sketch.holds(bits, key) | ids.is_null().to_numpy(zero_copy_only=False)))
            for at in range(0, batch.num_rows, 1000):
                words, begins = word_hashes(batch.column(1).slice(at, 1000), bare)
                rows = []
                for n, a, b in zip(_nodes(words, begins, least), begins[:-1].tolist(), begins[1:].tolist()):
                    if n is not None and n not in seen:
                        seen.add(n)
                        rows.append({"node": n, "words": (words[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("node", pa.int64()), ("words", pa.binary())]))

    rows = columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidied(run), "node long, words binary")


def _aligned(chains: DataFrame, words: DataFrame, k: int, least: int, percent: int, equal: bool = False) -> DataFrame:
    """Chains with the words of both passages, cut out before anything is moved on, and aligned; if equal, from each stretch of
    `least` words or more that are the same.
    """

    def cut(lo: str, hi: str) -> str:
        return f"substring(words, 4 * greatest({lo} - {MARGIN}, 0) + 1, 4 * ({hi} + {MARGIN} - greatest({lo} - {MARGIN}, 0)))"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["x"], "<u4"), np.frombuffer(r["y"], "<u4")
                at_x, at_y = np.frombuffer(r["anchors"], "<i4").reshape(2, -1)
                ox, oy = max(r["lo"] - MARGIN, 0), max(r["partner_lo"] - MARGIN, 0)
                before = r["lo"] - ox, r["partner_lo"] - oy
                tries = [(at_x, at_y)]
                if equal:
                    n = r["hi"] - r["lo"]
                    same = x[before[0] :][:n] == y[before[1] :][:n]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], same, [0])))).reshape(-1, 2)
                    tries = [(e, e) for e in (np.array([a, b - k]) if b - a > k else np.array([a]) for a, b in edges.tolist() if b - a >= least)]
                for at_x, at_y in tries:
                    lo, hi, p_lo, p_hi, matched = align(x, y, at_x, at_y, k, before)
                    if min(hi - lo, p_hi - p_lo) < least or 100 * matched < percent * max(hi - lo, p_hi - p_lo):
                        continue
                    rows.append({"node": r["node"], "lo": ox + lo, "hi": ox + hi, "partner": r["partner"], "partner_lo": oy + p_lo, "partner_hi": oy + p_hi, "n_matched": matched})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in rows[0]]))

    one = chains.join(words, "node").selectExpr("node", "partner", "lo", "hi", "partner_lo", "partner_hi", "anchors", f"{cut('lo', 'hi')} AS x")
    two = one.join(words.withColumnRenamed("node", "partner"), "partner").selectExpr("node", "partner", "lo", "hi", "partner_lo", "partner_hi", "anchors", "x", f"{cut('partner_lo', 'partner_hi')} AS y")
    return two.mapInArrow(tidied(run), ALIGNED)


def repeated_passages(docs: DataFrame, k: int = 5, w: int = 10, least_words: int = 50, percent: int = 80) -> DataFrame:
    """A row per document and passage of least_words words or more that also stands, word for word or edited, in another text.

    Columns: doc_id, start_word, end_word, other_doc_id (the smallest id of the text it was found in), other_start_word,
    other_end_word, n_matched (aligned words that are equal, at least percent of the longer side). Words are counted
    and compared in lower case without signs; those without a letter or digit don't count. A passage of many texts is listed
    for each of them, against one other text, not for all pairs. Documents with the same word sequence are one text, whose
    passages are listed for each of them; if there are several and they are long enough, the whole of each is a passage of
    the text's smallest id, listed once. Null, empty and short texts hold no passage. Null ids are listed as null.
    """
    spark = docs.sparkSession
    made = written(_members(docs, k, w, least_words), "members")
    members = made.where("part IS NULL AND node IS NOT NULL").select("doc_id", "node", "n_words")
    levels = spark.sparkContext.broadcast(sketch.levels(made.where("part IS NOT NULL")))

    names = members.groupBy("node").agg(F.min("doc_id").alias("name"), F.count("*").alias("n_copies"), F.min("n_words").cast("long").alias("n"))
    stars = written(_stars(_seeds(docs, k, w, least_words, levels), k, w, least_words), "stars")
    levels.unpersist()
    of = lambda kind: stars.where(F.col("kind") == kind)
    matches = of(MATCH).select("node", "partner", "pos", "partner_pos").unionAll(_across(of(HUB)).drop("key", "n"))
    doubles = written(_doubles(of(PLACE), max(1, _span(k, w, least_words))), "doubles")
    matches = matches.unionAll(doubles.where("n = 0").select("node", "partner", "pos", "partner_pos"))

    def words_of(chains: DataFrame) -> DataFrame:
        nodes = chains.select(F.explode(F.array("node", "partner")).alias("node")).distinct()
        ids = names.join(nodes, "node", "left_semi").where("name IS NOT NULL").select("name").mapInArrow(tidied(_mixed), "node long")
        wanted = spark.sparkContext.broadcast(sketch.key_filter(ids))
        out = written(_words(docs, least_words, wanted).dropDuplicates(["node"]), "words", "none")
        wanted.unpersist()
        return out

    chains = written(_chains(matches, k, w, least_words), "chains")
    words = words_of(chains)
    found = written(_aligned(chains, words, k, least_words, percent), "passages")
    dropped(spark, chains, words)
    aligned = lambda shared, words: _aligned(_chains(shared, k, w, least_words), words, k, least_words, percent)
    more = _compared(doubles.where("n > 0"), found, of(PLACE).select("key", "node", "pos"), words_of, aligned)
    if more is not None:
        again = _both(found).where("l_node > l_partner")
        found = written(found.unionByName(more.distinct().join(again, F.expr("node = l_node AND partner = l_partner AND l_lo <= lo AND l_hi >= hi"), "left_anti")), "passages")
    dropped(spark, doubles)
    other = found.groupBy(F.col("partner").alias("node"), F.col("partner_lo").alias("lo"), F.col("partner_hi").alias("hi")).agg(F.min(F.struct("node", "lo", "hi", "n_matched")).alias("o"))
    other = other.select("node", "lo", "hi", F.col("o.node").alias("partner"), F.col("o.lo").alias("partner_lo"), F.col("o.hi").alias("partner_hi"), F.col("o.n_matched").alias("n_matched"))
    passages = found.unionByName(other.select(*found.columns))
    listed = written(_both(found).select("l_node", "l_partner", "l_lo", "l_hi").distinct(), "listed")
    # runs that no passage of the chains of the same two texts holds
    free = lambda df, end: df.join(listed, F.expr(f"node = l_node AND partner = l_partner AND l_lo <= {'lo' if end == 'hi' else 'pos'} AND l_hi >= {end}"), "left_anti")
    heads = _across(of(HEAD))
    rest = of(REST).select("key", "node", "pos").join(heads.select("key", "node", "partner", "partner_pos", "n"), ["key", "node"])
    names_of = ("node", "partner", "pos", "partner_pos", "n")
    stretches = free(of(RUN).select(*names_of).unionAll(heads.select(*names_of)).unionAll(rest.select(*names_of)), "pos + n")
    runs = written(_runs(stretches, k), "runs")
    words = words_of(runs)
    equal = written(_aligned(runs, words, k, least_words, percent, equal=True).dropDuplicates(["node", "partner", "lo", "hi"]), "equal")
    passages = passages.unionByName(free(equal, "hi"))
    dropped(spark, stars, runs, words)
    passages = passages.join(names.select(F.col("node").alias("partner"), F.col("name").alias("other_doc_id")), "partner")
    whole = names.where("n_copies > 1").select("node", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), F.col("name").alias("other_doc_id"), F.lit(0).cast("long").alias("partner_lo"), F.col("n").alias("partner_hi"), F.col("n").alias("n_matched"))
    passages = passages.drop("partner").unionByName(whole)
    out = members.select("doc_id", "node").join(passages, "node")
    return out.select("doc_id", F.col("lo").alias("start_word"), F.col("hi").alias("end_word"), "other_doc_id", F.col("partner_lo").alias("other_start_word"), F.col("partner_hi").alias("other_end_word"), "n_matched")
