"""Ids, blocks and packing against the tokenizers library at its plainest."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing, token_blocks
from helixframe.llm.tokens import Encoder

from .util import odd_rows, table

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "a\n\n  b", "x\t y", "a.", "it's a  dog's,  'll", "\x1c a\x1cb \x85 c", "\xa0 a\xa0 b ", "a ,", "é  ̈ b", " ́a", "日本 語。 テスト", "<|endoftext|> a <|startoftext|>",
    "ΑΣ ΣΑΣ. İ", "a   ", "   a  　b", "12 345, 6.", "a\x0b\x0cb  \r\n c", "a \x1c b", "a  \x1c  b", "  .", ", .", "a , b", "x" * 100 + " b " + "y" * 100 + ".", "a.b", "of%%% it's. a'.' b.'s c_ _c d<|endoftext|> e-", "don't!? x<| y\"'", "a\n", "a  b", "a ",
    "a<|endoftext|>b", "a <|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|> ", "x<|startoftext|>.", "<|ENDOFTEXT|>", "a\t<|endoftext|><|endoftext|> b", "İßßİ_", "aİ. İ,", "İ", "<|endoftext|", "a<|endoftext|>.",
    "Ünïcode, Ａｂｃ. ﬁn", "é Éa. 가 K K", "ᾳ ǅ ß ẞ",
]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", " ", "  ", "\n", ".", ",", "'s", "1", "\t", "ß", "_", "\xa0", "日"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(600)]
    e, want = Encoder(public_tokenizers.path(name), limit=50), plain(name)
    got = e.many(texts, most=200)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == want(t), repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library_on_random_unicode(name):
    """The untouched library, on strings of special tokens, signs, marks, white space of all kinds and letters of many scripts."""
    rng = random.Random(11)
    spans = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x590, 0x700), (0x1E00, 0x2070), (0x3000, 0x3100), (0xAC00, 0xAC80), (0xFB00, 0xFB20), (0x1F600, 0x1F640)]
    some = ["<|endoftext|>", "<|startoftext|>", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u2028", "\u3000", "İ", "ǅ", "K", "ß", ".", "_", "'s", "'LL", "1"]

    def one() -> str:
        return rng.choice(some) if rng.random() < 0.5 else chr(rng.randrange(*rng.choice(spans)))

    texts = ["".join(one() for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    e, want = Encoder(public_tokenizers.path(name)), plain(name)
    bad = [t for t, ids in zip(texts, e.many(texts)) if np.frombuffer(ids, "<u4").tolist() != want(t)]
    assert not bad, bad[:5]


def test_blocks_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), rng.integers(0, 50_000, 1000, dtype=np.uint32), np.r_[np.full(300, 9), [2**32 - 1, 0]].astype(np.uint32), rng.integers(0, 2**32, 500, dtype=np.uint64).astype(np.uint32), np.where(rng.random(999) < 0.02, 2**31, rng.integers(0, 90, 999)).astype(np.uint32)):
        for block, percentile in ((128, 0.9), (32, 0.5), (128, 1.0)):
            s = token_blocks.Segment(token_blocks.segment([(1, ids.astype("<u4").tobytes())], block, percentile))
            assert (s.ids() == ids).all()
            for lo, hi in ((0, 1), (5, 200), (127, 129), (len(ids) - 1, len(ids))):
                assert (s.ids(max(lo, 0), hi) == ids[max(lo, 0) : hi]).all()


def test_outliers_are_exceptions():
    ids = np.full(128, 3, np.uint32)
    ids[5] = 40_000
    s = token_blocks.Segment(token_blocks.segment([(1, ids.tobytes())]))
    assert s.width.tolist() == [0] and s.n_exc.tolist() == [1]


def test_token_blocks_dataset(spark, tmp_path):
    rows, want = odd_rows(), plain("word_bpe_49k.json")
    token_blocks.write_token_blocks(table(spark, extra=True), str(tmp_path / "d"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, segment_ids=500)
    got = token_blocks.read_token_blocks(spark, str(tmp_path / "d"), with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    start, left = 0, [(r[0], want(r[1]) + [1]) for r in rows]
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        left.remove((r["doc_id"], r["ids"]))
        start += r["n_tokens"]
    assert not left


def test_token_blocks_of_an_empty_table(spark, tmp_path):
    token_blocks.write_token_blocks(table(spark, []), str(tmp_path / "d"), public_tokenizers.path("word_bpe_49k.json"))
    assert token_blocks.read_token_blocks(spark, str(tmp_path / "d")).count() == 0


def check_packing(pieces, lengths, window):
    """Every id in one piece, sequences gapless and full, but for powers of two."""
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert 0 < p["length"] <= window
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    covered = {}
    for p in pieces:
        covered.setdefault((p["doc_id"], p["doc_tokens"]), []).extend(range(p["start"], p["start"] + p["length"]))
    for key, n in lengths.items():
        assert sorted(covered.pop(key)) == sorted(list(range(key[1])) * n)
    assert not covered


def test_packing_covers_every_id(spark):
    rows, want = odd_rows(), plain("byte_bpe_50k.json")
    got = packing.pack_documents(table(spark, extra=True), public_tokenizers.path("byte_bpe_50k.json"), window=1024).collect()
    lengths = {}
    for r in rows:
        key = (r[0], len(want(r[1])) + 1)
        lengths[key] = lengths.get(key, 0) + 1
    check_packing(got, lengths, 1024)
    one = {r[0]: want(r[1]) + [0] for r in rows if r[0] not in (None, 1, 6)}
    for p in got:
        if p["doc_id"] in one:
            assert p["ids_crc32"] == zlib.crc32(np.array(one[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    assert packing.pack_documents(table(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_sequences_hold_the_ids(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["aa", "bbb", "c"]) for _ in range(rng.randrange(1, 90))), "en", "s", 1) for k in range(60)]
    want = plain("byte_bpe_50k.json")
    pieces = packing.pack_documents(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), window=64, with_ids=True)
    ids = {p["doc_id"]: [] for p in pieces.collect()}
    for p in sorted(pieces.collect(), key=lambda p: p["start"]):
        ids[p["doc_id"]] += p["ids"]
    assert all(ids[r[0]] == want(r[1]) + [0] for r in rows)
    assert sum(len(s["ids"]) for s in packing.sequences(pieces).collect()) == sum(map(len, ids.values()))


def test_nnls_recovers_counts_and_rounding_stays_feasible():
    rng = np.random.default_rng(1)
    window = 32
    combos = packing.combinations(window, 3, np.arange(1, window))
    assert all(c.sum() == window for c in combos) and len({tuple(c) for c in combos}) == len(combos)
    counts = rng.integers(0, 50, len(combos)) * (rng.random(len(combos)) < 0.1)
    h = np.zeros(window + 1)
    for c, n in zip(combos, counts):
        for p in c[c > 0]:
            h[p] += n
    x = packing.nnls(combos, h.copy(), steps=4000)
    back = np.zeros(window + 1)
    for c, n in zip(combos, x):
        for p in c[c > 0]:
            back[p] += n
    assert (x >= 0).all() and np.abs(back - h).max() < 0.02 * h.max()
    used = packing.repeat_counts(combos, x, h.astype(np.int64))
    taken = np.zeros(window + 1)
    for c, n in zip(combos, used):
        for p in c[c > 0]:
            taken[p] += n
    assert (taken <= h).all() and taken.sum() > 0.8 * h.sum()


def test_greedy_fills_windows():
    out = packing.greedy([(0, 0, 30), (1, 5, 9), (2, 0, 64), (3, 1, 7)], 64)
    assert [sum(n for _, _, n in s) for s in out] == [64, 32, 8, 4, 2]
