"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 9).

A word's features are hashes of its character n-grams with word-boundary marks, and of the word itself. A passage is the
average, over its words, of the average of their features' vectors; a linear softmax on it gives the two classes. Vectors
and softmax are trained jointly, by Adagrad in numpy, so a misspelling unseen in training shares most n-grams, and so its
score, with the spelling that was seen. A document's score is that of its highest-scoring passage of `window` words, for a
few words in a long text must not be averaged away; training takes the same passage (the first pass takes whole texts).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, columns, mix64, release, tidied
from .shingles import odd_constants

_WORD = re.compile(r"[^\W_]+")
LONGEST, PIECE = 64, 16


def in_pieces(words: Iterable[str]) -> Iterator[str]:
    """The words; of one of more than LONGEST characters, as of scripts without blanks, overlapping pieces up to its end."""
    for w in words:
        if len(w) <= LONGEST:
            yield w
        else:
            yield from (w[k : k + PIECE] for k in range(0, len(w) - PIECE // 2, PIECE // 2))


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits of the whole text, long ones in pieces; a word that repeats at once counts once."""
    return [w for w, _ in groupby(in_pieces(_WORD.findall(text.lower())))]


_PLACES = odd_constants(320)


def features(words: list[str], bits: int, shortest: int = 3, longest: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams (of bytes, with marks at the ends) and of the words themselves, and how many each has.

    Some ten thousand words are hashed at a time, so that what is held is 4 bytes a bucket.
    """
    parts = [_features(words[k : k + 20_000], bits, shortest, longest) for k in range(0, len(words), 20_000)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _features(words: list[str], bits: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [f"<{w}>".encode() for w in words]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    begin = np.cumsum(length) - length
    word = np.repeat(np.arange(len(raw)), length)
    room = np.repeat(begin + length, length) - np.arange(len(text))
    whole = np.add.reduceat(text * _PLACES[np.arange(len(text)) - begin[word]], begin)
    owner, hashes = [np.arange(len(raw))], [whole]
    for n in range(shortest, longest + 1):
        at = np.flatnonzero(room >= n)
        owner.append(word[at])
        hashes.append(sum((text[at + j] * _PLACES[300 - j] for j in range(n)), np.uint64(n)))
    order = np.argsort(np.concatenate(owner), kind="stable")
    bucket = (mix64(np.concatenate(hashes)) >> np.uint64(64 - bits)).astype(np.int32)
    return bucket[order], np.bincount(np.concatenate(owner), minlength=len(raw))


@dataclass
class Model:
    """Vectors of n-gram buckets, softmax weights (dim x 2) and bias (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bits: int
    window: int

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts: the logit of an average is the mean of the words' own logits, so each distinct word of a batch gets one."""

    def __init__(self, model: Model):
        self.bits, self.window = model.bits, model.window
        self.bucket = (model.vectors @ (model.weights[:, 1] - model.weights[:, 0])).astype(np.float64)
        self.bias = float(model.bias[1] - model.bias[0])

    def __call__(self, text: str) -> float:
        return float(self.many(pa.array([text]))[0])

    def many(self, texts: pa.Array) -> np.ndarray:
        """A score per text, 0 for those without words. Words never reach across white space, so texts are cut there and words sought in distinct pieces."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        pieces = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        found = [list(in_pieces(_WORD.findall(p.lower()))) for p in coded.dictionary.to_pylist()]
        index: dict[str, int] = {}
        held = np.fromiter((index.setdefault(w, len(index)) for ws in found for w in ws), np.int64)
        n_held = np.fromiter(map(len, found), np.int64, len(found))
        first = np.cumsum(n_held) - n_held
        flat, size = features(list(index), self.bits)
        logit = np.add.reduceat(self.bucket[flat], np.cumsum(size) - size) / size if len(size) else np.zeros(0)
        n = n_held[codes]
        total = np.concatenate(([0], np.cumsum(n)))
        words = held[np.repeat(first[codes] - total[:-1], n) + np.arange(total[-1])]
        ends = total[np.cumsum(pieces)] if len(pieces) else pieces
        out, start = np.full(len(texts), -np.inf), 0
        for k, end in enumerate(ends.tolist()):
            own = words[start:end]
            if len(own):
                own = own[np.append(True, own[1:] != own[:-1])]
                out[k] = self.bias + best_window(logit[own], self.window)[0]
            start = end
        return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -500, 500))))


def best_window(logits: np.ndarray, window: int) -> tuple[float, int]:
    """The highest mean of `window` words in a row (of all words, if fewer), and where it starts."""
    if len(logits) <= window:
        return float(logits.mean()), 0
    sums = np.concatenate(([0.0], np.cumsum(logits)))
    means = (sums[window:] - sums[:-window]) / window
    k = int(means.argmax())
    return float(means[k]), k


def train(texts: Iterable[str], labels: list[int], bits: int = 17, dim: int = 12, window: int = 32, epochs: int = 12, updates: int = 800, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit vectors and softmax jointly, in `epochs` passes, or more if these make fewer than `updates` steps of 64 documents.

    With no text or one class only, the model gives that class's smoothed share.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(np.zeros((1 << bits, dim), np.float32), np.zeros((dim, 2)), np.array([0.0, np.log(share / (1 - share))]), bits, window)
    if not len(y) or y.min() == y.max():
        return model
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], dtype=np.int32) for t in texts]
    flat, size = features(list(index), bits)
    first = np.cumsum(size) - size
    del index
    vectors = rng.normal(0, 0.3, (1 << bits, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    v2, w2, b2 = np.full((1 << bits, 1), 1e-6, np.float32), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    balance = np.array([0.5, 0.5]) * len(y) / np.bincount(y, minlength=2)
    order = np.array([k for k in range(len(docs)) if len(docs[k])])
    for epoch in range(max(epochs, -(-64 * updates // max(1, len(order))))):
        if epoch:
            scalar = vectors @ (weights[:, 1] - weights[:, 0]).astype(np.float32)
            logit = np.add.reduceat(scalar[flat], first) / size
        rng.shuffle(order)
        for at in range(0, len(order), 64):
            parts, label = [], []
            for d in order[at : at + 64]:
                words = docs[d]
                if epoch:
                    k = best_window(logit[words], window)[1]
                    parts.append(words[k : k + window])
                    label.append(y[d])
                    if not y[d] and len(words) > window:
                        k = int(rng.integers(len(words) - window))
                        parts.append(words[k : k + window])
                        label.append(0)
                else:
                    parts.append(words)
                    label.append(y[d])
            label, n = np.array(label), np.array([len(p) for p in parts])
            used, word = np.unique(np.concatenate(parts), return_inverse=True)
            doc = np.repeat(np.arange(len(parts)), n)
            gram_word = np.repeat(np.arange(len(used)), size[used])
            gram = flat[np.repeat(first[used], size[used]) + np.arange(len(gram_word)) - np.repeat(np.cumsum(size[used]) - size[used], size[used])]
            begins = np.cumsum(size[used]) - size[used]
            word_vec = np.add.reduceat(vectors[gram], begins, axis=0) / size[used][:, None]
            mean = np.add.reduceat(word_vec[word], np.cumsum(n) - n, axis=0) / n[:, None]
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(label)), label] -= 1
            p *= balance[label][:, None] / len(label)
            g_weights, g_bias, g_mean = mean.T @ p, p.sum(axis=0), p @ weights.T
            g_word = np.zeros_like(word_vec)
            share_of = (g_mean / n[:, None])[doc]
            for j in range(dim):
                g_word[:, j] = np.bincount(word, weights=share_of[:, j], minlength=len(used))
            g_gram = (g_word / size[used][:, None])[gram_word]
            buckets, inverse = np.unique(gram, return_inverse=True)
            g = np.stack([np.bincount(inverse, weights=g_gram[:, j], minlength=len(buckets)) for j in range(dim)], axis=1)
            v2[buckets] += (g * g).mean(axis=1, keepdims=True)
            vectors[buckets] -= rate * g / np.sqrt(v2[buckets])
            w2 += g_weights**2
            weights -= rate * g_weights / np.sqrt(w2)
            b2 += g_bias**2
            bias -= rate * g_bias / np.sqrt(b2)
    return Model(vectors, weights, bias, bits, window)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the row's labels stay unseen: crc32 of the id as text, modulo the folds, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, folds: int = 5, label: str = "toxic", most_bytes: int = 1 << 27) -> Model:
    """Train on at most `most` labelled documents of each class that aren't held out: those whose id has the lowest hash.

    Of these, in the order of a hash, as many are taken as have most_bytes of text together, for the driver holds them. These
    bounds on the sample are the only ones; the texts are whole. Rows without an id, text or label are left out.
    """
    rows = columns(docs, doc_id="doc_id", text="text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    marks = columns(labels, doc_id="doc_id", y=label).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"), folds))
    chosen = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    found = rows.join(F.broadcast(chosen), "doc_id")  # chosen has at most 2 * most rows
    found = found.select("y", "text", F.xxhash64("doc_id", "text", "y").alias("h")).orderBy("h").limit(2 * most)  # rows of repeated ids may be more
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    sample = found.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("y", "text").toArrow()
    texts, marks = sample["text"].to_pylist(), sample["y"].to_pylist()
    del sample
    model = train(_taken(texts), marks)
    release()  # what training held would stay with the driver
    return model


def _taken(items: list) -> Iterator:
    """The items in their order, each let go once it is taken."""
    items.reverse()
    while items:
        yield items.pop()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str = "score") -> DataFrame:
    """A score from 0 to 1 for every whole text: doc_id and score, or with keep all columns of docs and the score, called name.

    Null, empty and wordless texts score 0: nothing in them is toxic. With keep, a column of that name is replaced. Each row
    is scored by itself, so repeated rows and null ids are no matter; the model, of a fixed size, is all that a task needs.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            out = [*batch.columns[:-1], pa.array(scorer.many(batch.column(batch.num_columns - 1)))]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], name])

    kept = docs.drop(name).columns if keep else []
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), *[F.col(f"`{id_col}`").alias("doc_id")] * (not keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("\x00text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(tidied(run), schema + f", `{name}` double")


_SCORERS: dict = {}


def _scorer(shared) -> Scorer:
    """This worker's scorer of the broadcast model."""
    if _SCORERS.get("model") is not shared.value:
        _SCORERS.update(model=shared.value, scorer=shared.value.scorer())
    return _SCORERS["scorer"]
