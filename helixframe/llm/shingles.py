"""Word hashes and shingle sets of whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

from .common import mix64


def odd_constants(n: int) -> np.ndarray:
    """n odd 64-bit multipliers, by a rule."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: ASCII letters in lower case, and what is neither letter nor digit.
_LOWER = bytes(range(256)).lower()
_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


def bare(word: bytes) -> bytes:
    """The word in lower case without signs; empty if it has no letter or digit."""
    if word.isascii():
        return word.translate(_LOWER, _SIGNS)
    return "".join(c for c in word.decode().lower() if c.isalnum()).encode()


def word_hashes(texts: pa.Array, normal: Callable[[bytes], bytes] = bytes.lower) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the normal forms of words `[^\\x20\\x09-\\x0D]+` of all texts, and where each text's words begin.

    Words whose normal form is empty are left out. The second array has one entry more than texts; a null text has no words.
    """
    texts = texts.cast(pa.large_string())
    cut = pc.ascii_split_whitespace(texts)
    sizes = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    words = list(map(normal, coded.dictionary.cast(pa.large_binary()).to_pylist()))
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    blank = np.fromiter((not w for w in words), bool, len(words))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    if blank.any():
        real = ~blank[codes]
        begins = np.concatenate(([0], np.cumsum(real)))[begins]
        codes = codes[real]
    return hashes[codes], begins


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, at the position of their first word; the last k - 1 positions are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(odd_constants(k)):
        out += words[j : j + n] * c
    return mix64(out)


def long_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words from hashes of short runs that cover them, in about 2 * sqrt(size) steps."""
    inner = max(1, int(size**0.5))
    short = shingle_hashes(words, inner)
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = [*range(0, size - inner, inner), size - inner]
    out = np.full(n, np.uint64(size))
    for at, c in zip(starts, odd_constants(len(starts))):
        out += short[at : at + n] * c
    return mix64(out)


def sliding(values: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """The least (or greatest) of every w values in a row, by windows of doubling width."""
    pick, width = np.minimum if least else np.maximum, 1
    while 2 * width <= w:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[: len(values) - (w - width)], values[w - width :]) if w > width else values


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted hashes; with fewer words, the whole sequence as one."""
    words, begins = word_hashes(texts)
    all_ = shingle_hashes(words, k)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(all_[a : b - k + 1]))
        elif b > a:
            out.append(mix64(np.array([(words[a:b] * odd_constants(b - a)).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
