"""Encoding whole texts with the tokenizers library, each distinct piece of a batch once.

A text is cut where no token can reach across. The pieces of a batch are dictionary-encoded by Arrow, the library encodes
the distinct ones, and numpy lays their ids out again. Pieces of letters are one pre-token each and go straight to the
library's BPE model; all others take its whole path of normaliser, pre-tokenizer and model. The ids equal those of encoding
the texts at once (tests/llm/test_tokens.py), at several times the speed.
"""

from __future__ import annotations

import os
from array import array
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII signs that end a run of letters; not the apostrophe, which starts contractions.
_SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_TABLE: dict[int, str] = {}


def _byte_chars() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies: itself, or the next of those from U+0100 on."""
    if not _TABLE:
        keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        other = iter(range(0x100, 0x200))
        _TABLE.update({b: chr(b if b in keep else next(other)) for b in range(256)})
    return _TABLE


class Encoder:
    """many(texts): the ids of whole texts, little-endian unsigned 32-bit integers.

    Strings of the vocabulary's special tokens get these tokens' ids, as the library gives them: they hold no white space,
    so no cut goes through them, and a piece that holds one is encoded by the library. For vocabularies whose normaliser drops white space, texts are cut
    at ASCII white space; for byte-level ones in front of a blank that follows another character than white space.
    Signs that end a piece after letters are a pre-token of their own in both kinds, so they are encoded by themselves, unless
    the letters' normal form ends in a mark, which joins the signs' pre-token.
    """

    def __init__(self, path: str, limit: int = 1 << 18):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_level = self.tokenizer.normalizer is None
        self.blank = " " if self.byte_level else ""
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}

    def _encode(self, piece: str) -> bytes:
        return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """The ids of a piece of letters, behind the blank that the cut took."""
        if word.isascii():
            piece = f"\u0120{word}" if self.byte_level else word.lower()
        else:
            piece = f" {word}" if self.byte_level else self.tokenizer.normalizer.normalize_str(word)
            if not self.byte_level and not piece.isalpha():
                return self._encode(word)
            piece = piece.encode().decode("latin-1").translate(_byte_chars())
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pieces, each behind the blank that the cut took."""
        if len(self.known) > self.limit:  # two generations: a piece that is still in use moves to the new one
            self.known, self.older = {}, self.known
        known, letters, stops = self.known, self._word, self.stops
        out = list(map(known.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = words[k]
            if w.isalpha():
                out[k] = letters(w)
            elif (base := w.rstrip(_SIGNS)) != w and base.isalpha() and self._stays_letters(base):
                out[k] = letters(base) + (stops.get(w[len(base) :]) or self._stop(w[len(base) :]))
            else:
                out[k] = self._encode(self.blank + w)
        return out

    def _stays_letters(self, word: str) -> bool:
        return self.byte_level or word.isascii() or normalize("NFC", word).lower().isalpha()

    def _stop(self, signs: str) -> bytes:
        if len(self.stops) > 1 << 12:
            self.stops.clear()
        ids = self.stops[signs] = self._encode(signs)
        return ids

    def _word(self, w: str) -> bytes:
        ids = self.known.get(w)
        if ids is None:
            ids = self.older.get(w) or self._letters(w)
            if len(w) <= 64:
                self.known[w] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str] | pa.Array, most: int = 1 << 23) -> list[bytes]:
        """A value per text; texts are taken some `most` bytes at a time."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out, at = [], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            out += self._slice(texts[at:to])
            at = to
        return out

    def _slice(self, texts: pa.Array) -> list[bytes]:
        if self.byte_level:
            cut = pc.split_pattern(texts, " ")
            odd = pc.match_substring_regex(texts, r"[\s\v\p{Z}\x85\x1c-\x1f] |[\s\v\p{Z}\x85\x1c-\x1f]$|^ |[\s\v\p{Z}\x85\x1c-\x1f]\z")
        else:
            cut, odd = pc.ascii_split_whitespace(texts), None
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        pieces = cut.flatten()
        if odd is not None and pc.any(odd).as_py():
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            more = [_joined(texts[int(k)].as_py().split(" ")) for k in rows]
            sizes[rows] = [len(m) for m in more]
            starts[rows] = len(pieces) + np.cumsum(sizes[rows]) - sizes[rows]
            pieces = pa.concat_arrays([pieces, pa.array(list(chain.from_iterable(more)), pieces.type)])
        coded = pieces.dictionary_encode()
        heads = pieces.take(pa.array(starts)).dictionary_encode() if self.byte_level else None
        codes = coded.indices.to_numpy(zero_copy_only=False).copy()
        made = self._learn(coded.dictionary.to_pylist())
        if self.byte_level and len(starts):  # a text's first piece has no blank in front
            codes[starts] = len(made) + heads.indices.to_numpy(zero_copy_only=False)
            made += [self._encode(h) for h in heads.dictionary.to_pylist()]
        table = np.frombuffer(b"".join(made), dtype="<u4")
        length = np.fromiter(map(len, made), np.int32, len(made)) // 4
        offset = np.cumsum(length, dtype=np.int32) - length
        # rows in their order, and their pieces in theirs; places are 32 bits wide, slices being small
        order = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes) + np.arange(sizes.sum(), dtype=np.int32)
        codes = codes[order]
        n = length[codes]
        total = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        ids = table[np.repeat(offset[codes] - total[:-1].astype(np.int32), n) + np.arange(total[-1], dtype=np.int32)].tobytes()
        ends = (4 * total[np.cumsum(sizes)]).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _joined(pieces: list[str]) -> list[str]:
    """Pieces of which none but the last ends in white space: there the next blank belongs to a run of white space."""
    out, open_, hold = [], "", True
    for k, p in enumerate(pieces):
        open_ = f"{open_} {p}" if hold and k else p
        hold = not open_ or open_[-1].isspace()
        if not hold:
            out.append(open_)
    return out + [open_] if hold else out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the vocabulary file at path: what it has learnt stays for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
