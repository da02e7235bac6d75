"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words (operator 6).

Test items are taken in blocks of a bounded number of n-grams, which tasks hold as a sorted table; a block after the other
goes over all documents, so any number of items is handled. Every n-gram of an item is a seed, however many documents hold
it: a common one costs time, never a copy. One pass joins each document's n-grams to the seeds, opens a window around hits
on near diagonals, cuts from it what holds too few of the item's words for a copy, and aligns the item with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, columns, tidied, written
from .shingles import bare, shingle_hashes, word_hashes

MATCH, MISMATCH, GAP = 2, -1, -1
HITS = 1 << 20
FOUND = "doc_id long, item_id long, similarity double, n_matched long, n_item_words long, start_word long, end_word long"


@dataclass
class Block:
    """Items' words, and their n-grams: sorted hashes with the item and position of each."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    position: np.ndarray

    def filter_bits(self) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[self.seeds >> np.uint64(44)] = True
        return bits


def block_of(ids: list[int], texts: list[str], n: int) -> Block:
    """Items shorter than n words are sought by their whole sequence, as one n-gram of its own length."""
    hashes, begins = word_hashes(pa.array(texts, pa.large_string()), bare)
    words = [hashes[a:b] for a, b in zip(begins[:-1], begins[1:])]
    grams = [shingle_hashes(w, min(n, max(1, len(w)))) for w in words]
    seeds = np.concatenate([*grams, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
    position = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(seeds, kind="stable")
    return Block(np.array(ids, np.int64), words, seeds[order], item[order], position[order])


def hits(words: np.ndarray, sizes: list[int], bits: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in words, index of a seed) for each n-gram of words, of each of the sizes, that is among the distinct sorted seeds."""
    where, which = [], []
    for n in sizes:
        grams = shingle_hashes(words, n)
        at = np.flatnonzero(bits[grams >> np.uint64(44)])
        if len(at):
            k = np.searchsorted(seeds, grams[at])
            k[k == len(seeds)] = 0
            ok = seeds[k] == grams[at]
            where.append(at[ok])
            which.append(k[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([*where, none]), np.concatenate([*which, none])


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """For each item and window of words the best local alignment: score, matches, first word and end in the window.

    All pairs go together, one anti-diagonal after the other. Of equal scores the one that ends first in the window counts.
    """
    n, rows, cols = len(items), max(map(len, items)), max(map(len, windows))
    a = np.zeros((n, rows), np.uint64)
    b = np.zeros((n, cols + 2 * rows), np.uint64)  # padded so that each anti-diagonal is a slice of the reversed window
    real_a, real_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, : len(x)], real_a[k, : len(x)] = x, True
        b[k, rows : rows + len(y)], real_b[k, rows : rows + len(y)] = y, True
    zero = np.zeros((n, rows + 1), np.int32)
    last, last2 = [zero.copy() for _ in range(3)], [zero.copy() for _ in range(3)]  # score, matches, start; column r + 1 is row r
    best = np.zeros((n, 4), np.int64)
    everyone = np.arange(n)
    for d in range(rows + cols - 1):
        column = d - np.arange(rows)
        y, ok = b[:, rows + column], real_b[:, rows + column] & real_a
        same = (a == y) & ok
        score = np.zeros((n, rows + 1), np.int32)
        matches, start = score.copy(), score.copy()
        diagonal = last2[0][:, :-1] + np.where(same, MATCH, MISMATCH)
        up, left = last[0][:, :-1] + GAP, last[0][:, 1:] + GAP
        top = np.maximum(np.maximum(diagonal, 0), np.maximum(up, left)) * ok
        score[:, 1:] = top
        by_diagonal, by_up = (top == diagonal) & (top > 0), (top == up) & (top > 0)
        fresh = by_diagonal & (last2[0][:, :-1] == 0)
        matches[:, 1:] = np.where(by_diagonal, last2[1][:, :-1] * (last2[0][:, :-1] > 0) + same, np.where(by_up, last[1][:, :-1], last[1][:, 1:]))
        start[:, 1:] = np.where(fresh, column, np.where(by_diagonal, last2[2][:, :-1], np.where(by_up, last[2][:, :-1], last[2][:, 1:])))
        r = top.argmax(axis=1)
        peak = top[everyone, r]
        better = np.flatnonzero(peak > best[:, 0])
        if len(better):
            at = r[better]
            best[better] = np.stack([peak[better], matches[better, at + 1], start[better, at + 1], d - at + 1], axis=1)
        last2, last = last, [score, matches, start]
    return [tuple(x) for x in best.tolist()]


def windows_of(where: np.ndarray, item_at: np.ndarray, length: int, slack: int) -> list[tuple[int, int]]:
    """Windows of words (from, to) around hits of one item: hits whose diagonals are within the item's length share one."""
    diagonal = np.sort(where - item_at)
    cuts = np.flatnonzero(np.diff(diagonal) > length) + 1
    return [(int(part[0]) - slack, int(part[-1]) + length + slack) for part in np.split(diagonal, cuts)]


def dense(window: np.ndarray, item: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The parts (from, to) of a window outside which no passage can reach `least`; nothing that does is cut.

    Such a passage has least * len(item) matches or more, all of them words of the item, and what its matches gain over that
    bounds the words it can skip, and so its length.
    """
    needed = int(np.ceil(least * len(item) - 1e-9))
    reach = min(len(window), len(item) + int(MATCH * (1 - least) * len(item) + 1e-9))
    held = np.concatenate(([0], np.cumsum(np.isin(window, item))))
    starts = np.flatnonzero(held[reach:] - held[: len(held) - reach] >= needed)
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > reach) + 1
    return [(int(part[0]), int(part[-1]) + reach) for part in np.split(starts, cuts)]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, block_grams: int = 1 << 21, item_col: str = "item_id") -> DataFrame:
    """A row per document and test item that it holds a copy of, exact or edited.

    Columns: doc_id, item_id, similarity (alignment score by that of the whole item with itself, `least` or more), n_matched
    and n_item_words (words), start_word and end_word (of the passage, counting words that have a letter or digit). Only the
    best passage of an item in a document is listed. Words are compared in lower case without signs. Null, empty and
    wordless texts and items match nothing; rows of equal or null doc_id are documents of their own, equal items are all
    listed. Copies that keep no n words in a row of an item aren't found. No seed is dropped for being frequent.
    """
    spark = docs.sparkSession
    rows = columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in _blocks(_items(benchmark, item_col), n, block_grams):
        table = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for part, begins, best in _searched(batches, 1, table.value, n, least):
                if best:
                    ids, words, doc_ids = table.value.ids, table.value.words, part.column(0).to_pylist()
                    made = [{"doc_id": doc_ids[d], "item_id": int(ids[i]), "similarity": s, "n_matched": m, "n_item_words": len(words[i]), "start_word": -lo - int(begins[d]), "end_word": hi - int(begins[d])} for (d, i), (s, lo, m, hi) in sorted(best.items())]
                    yield pa.RecordBatch.from_pylist(made, schema=pa.schema([(c, pa.float64() if c == "similarity" else pa.int64()) for c in made[0]]))

        found = rows.mapInArrow(tidied(find), FOUND)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, block_grams: int = 1 << 21, item_col: str = "item_id") -> DataFrame:
    """The rows of docs, with all their columns, that hold no copy of a test item, as contaminated() finds them.

    Every row is judged by its own text where it is read, so repeated and null ids are no matter, and nothing is joined.
    """
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    at = names.index("text")
    out = docs
    for k, block in enumerate(_blocks(_items(benchmark, item_col), n, block_grams)):
        table = docs.sparkSession.sparkContext.broadcast(block)
        out = written(out, "clean") if k else out

        def keep(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for part, _, best in _searched(batches, at, table.value, n, least):
                clean = np.ones(part.num_rows, bool)
                clean[[d for d, _ in best]] = False
                yield part.filter(pa.array(clean))

        out = out.mapInArrow(tidied(keep), schema)
    return out


def _items(benchmark: DataFrame, item_col: str) -> DataFrame:
    return columns(benchmark, item_id=item_col, text="text").select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")


def _blocks(items: DataFrame, n: int, block_grams: int) -> Iterator[Block]:
    """All items, streamed to the driver, in blocks of some block_grams words."""
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        words = len(r["text"].split())
        if not words:
            continue
        if ids and size + words > block_grams:
            yield block_of(ids, texts, n)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += words
    if ids:
        yield block_of(ids, texts, n)


def _searched(batches: Iterator[pa.RecordBatch], text_at: int, block: Block, n: int, least: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict]]:
    """Parts of the batches, where their texts' words begin, and by (row, item) the best passage (similarity, -start, matches, end)."""
    bits, seed_item, seed_position, item_words = block.filter_bits(), block.item, block.position, block.words
    seeds, first = np.unique(block.seeds, return_index=True)
    last = np.append(first[1:], len(block.seeds))
    sizes = sorted({min(n, len(w)) for w in item_words if len(w)})
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            words, begins = word_hashes(part.column(text_at), bare)
            all_where, all_which = hits(words, sizes, bits, seeds)
            all_doc = np.searchsorted(begins, all_where, side="right") - 1
            load = np.cumsum(np.bincount(all_doc, weights=(last - first)[all_which], minlength=part.num_rows))
            turn = (load // HITS).astype(np.int64)[all_doc]  # documents whose hits are held at a time
            todo = []
            for t in np.unique(turn).tolist():
                where, which, doc = (x[turn == t] for x in (all_where, all_which, all_doc))
                n_hits = (last - first)[which]
                where, doc = np.repeat(where, n_hits), np.repeat(doc, n_hits)
                entry = np.repeat(first[which] - (np.cumsum(n_hits) - n_hits), n_hits) + np.arange(n_hits.sum())
                item, position = seed_item[entry], seed_position[entry]
                order = np.lexsort((where, item, doc))
                where, item, position, doc = where[order], item[order], position[order], doc[order]
                cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
                for x in np.split(np.arange(len(where)), cuts):
                    d, i = int(doc[x[0]]), int(item[x[0]])
                    length = len(item_words[i])
                    for a, b in windows_of(where[x], position[x], length, slack=max(4, length // 4)):
                        a, b = max(a, int(begins[d])), min(b, int(begins[d + 1]))
                        todo += [(d, i, a + lo, a + hi) for lo, hi in dense(words[a:b], item_words[i], least)]
            best: dict[tuple[int, int], tuple] = {}
            for group in alike(todo, item_words):
                for (d, i, a, b), (score, matched, lo, hi) in zip(group, smith_waterman([item_words[t[1]] for t in group], [words[t[2] : t[3]] for t in group])):
                    similarity = score / (MATCH * len(item_words[i]))
                    if similarity >= least:
                        row = (similarity, -(a + lo), matched, a + hi)
                        best[d, i] = max(best.get((d, i), row), row)
            yield part, begins, best


def alike(todo: list[tuple[int, int, int, int]], item_words: list[np.ndarray], most: int = 256, cells: int = 1 << 19) -> Iterator[list[tuple[int, int, int, int]]]:
    """Alignments (row, item, from, to) in groups of like size, whose padded tables hold `cells` words together, or one alignment."""
    group, wide, long = [], 0, 0
    for t in sorted(todo, key=lambda t: (t[3] - t[2] + 2 * len(item_words[t[1]]), t)):
        w, l = max(wide, t[3] - t[2]), max(long, len(item_words[t[1]]))
        if group and (len(group) == most or (len(group) + 1) * (w + 2 * l) > cells):
            yield group
            group, w, l = [], t[3] - t[2], len(item_words[t[1]])
        group.append(t)
        wide, long = w, l
    if group:
        yield group
