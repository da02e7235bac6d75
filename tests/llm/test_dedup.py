"""Similarity joins, repeated passages, shards and the pipeline against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import components, hilbert, jaccard_join, sketch, substring_dedup
from helixframe.llm.shingles import shingle_sets, word_hashes

from .util import odd_rows, table, words


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=80):
    """(doc_id, n_shingles, component_id) of every row, from all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [(r[0], len(sets[k]), least.get(find(k)) if sets[k] else r[0]) for k, r in enumerate(rows)]


def variants(rng, n, base, rate, first):
    out = []
    for k in range(n):
        w = [f"e{rng.randrange(10**6)}" if rng.random() < rate else x for x in base]
        out.append((first + k, " ".join(w), "en", "s0", 1))
    return out


def check_components(spark, rows, **options):
    got = [tuple(r) for r in jaccard_join.jaccard_components(table(spark, rows, extra=True), **options).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_jaccard_components_of_odd_rows(spark):
    check_components(spark, odd_rows() + [(20, "One TWO", "en", "s", 1), (21, "two one", "en", "s", 1), (None, "alone in the world here now", "en", "s", 1)])
    assert jaccard_join.jaccard_components(table(spark, [])).count() == 0


@pytest.mark.parametrize("rate,block", [(0.004, 4096), (0.012, 5), (0.03, 16)])
def test_jaccard_components_of_near_copies(spark, rate, block):
    """Groups whose members are linked, partly linked, and not linked to each other, in blocks of few rows."""
    rng = random.Random(int(rate * 1000))
    rows = []
    for g in range(3):
        base = [f"b{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        rows += variants(rng, 40, base, rate, 100 * g)
    rows += [(1000 + k, words(rng, 50, 12), "en", "s", 1) for k in range(40)] + rows[3:6]
    check_components(spark, rows, block=block)


def test_jaccard_components_with_hot_shingles(spark, monkeypatch):
    """Salted regions: with a sketch that takes every shingle for a hot one."""
    rng = random.Random(11)
    base = [f"b{rng.randrange(3000)}" for _ in range(80)]
    rows = variants(rng, 60, base, 0.01, 0)
    monkeypatch.setattr(sketch, "levels", lambda parts: np.full(1 << sketch.COUNT_BITS, 8, np.uint8))
    check_components(spark, rows, block=7)


def test_jaccard_boundaries(spark):
    """Similarities of exactly 0.8 link, anything below doesn't."""
    w = [f"x{k}" for k in range(94)]  # 90 shingles
    for cut, linked in ((18, True), (19, False)):
        rows = [(1, " ".join(w), "en", "s", 1), (2, " ".join(w[cut:]), "en", "s", 1)]
        a, b = shingles(rows[0][1]), shingles(rows[1][1])
        assert (100 * len(a & b) >= 80 * len(a | b)) == linked
        check_components(spark, rows)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 150)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_equal_sets_of_tuples():
    texts = [r[1] for r in odd_rows()] + ["A b C d E", "a B c D e", "a b c d", "é É e E x y"]
    got = shingle_sets(pa.array(["pad"] + texts).slice(1), 5)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (got[-4] == got[-3]).all()
    hashes, begins = word_hashes(pa.array([" a ", None, "", "b\nc"]))
    assert begins.tolist() == [0, 1, 1, 1, 3] and len(hashes) == 3


def test_sketches(spark):
    """Hashes that stand out by many get a level; the usual ones none."""
    rng = np.random.default_rng(2)
    usual, hot = rng.integers(0, 2**63, 20_000).astype(np.uint64) * 2, rng.integers(0, 2**63, 1).astype(np.uint64) * 2
    parts = []
    for some in (usual, np.repeat(hot, 1000), np.repeat(hot, 500)):
        c = sketch.Counts()
        c.add(some)
        parts += [(r["part"], bytearray(r["content"])) for r in c.rows()]
    levels = sketch.levels(spark.createDataFrame(parts, "part int, content binary"))
    assert levels[sketch.bucket(hot)][0] == 7 and levels[sketch.bucket(usual)].max() == 0


@pytest.mark.parametrize("n,size", [(400, 60), (300, 8), (200, 400)])
def test_voronoi_cells_miss_no_pair(n, size):
    """Every pair of a cell that passes the bounds, by pivots and windows or by trying all of them."""
    rng = np.random.default_rng(n)
    centres = [rng.integers(0, 2**63, size).astype(np.uint64) for _ in range(12)]
    sets = []
    for k in range(n):
        c = centres[k % 12].copy()
        c[rng.integers(0, size, rng.integers(0, max(2, size // 5)))] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(c[: size - int(rng.integers(0, size // 4))]))
    counts = np.stack([np.frombuffer(jaccard_join.part_counts(s), np.uint8) for s in sets]).astype(np.int16)
    home = rng.random(n) < 0.7
    cell = jaccard_join.Cell(counts, np.array([len(s) for s in sets]), np.arange(n) // 3, home, 80, leaf=6)
    cell.join(np.flatnonzero(home), np.flatnonzero(~home))
    got = {(min(a, b), max(a, b)) for x, y in cell.found for a, b in zip(x.tolist(), y.tolist())}
    x, y = np.triu_indices(n, 1)
    ok = cell.near(x, y, home)
    assert got == set(zip(x[ok].tolist(), y[ok].tolist())) and got
    for a in range(n):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared) and a // 3 != b // 3 and (home[a] or home[b]):
                assert (b, a) in got


@pytest.mark.parametrize("block", [3, 20])
def test_large_regions_are_split_into_cells(spark, block):
    """Texts that share hot shingles but differ otherwise, in regions far larger than a block."""
    rng = random.Random(block)
    rows = []
    for g in range(30):
        lead = [f"h{k}" for k in range(30)]
        base = lead + [f"g{g}x{k}" for k in range(rng.randrange(4, 12))]
        for k in range(3):
            w = list(base)
            w[-1 - k] = f"q{g}{k}"
            rows.append((1000 * g + k, " ".join(w), "en", "s", 1))
    check_components(spark, rows, block=block)


def test_distinct_documents(spark):
    """One row of each component, all wordless rows, and rows of one id that differ told apart."""
    rng = random.Random(9)
    a, b, c = (words(rng, 60, 5000) for _ in range(3))
    near = a.split()
    near[0] = "other"
    rows = [(5, a, "en", "s", 1), (3, " ".join(near), "en", "s", 2), (None, a, "en", "s", 3), (7, b, "en", "s", 4), (7, b, "en", "s", 4), (7, c, "en", "s", 5), (7, b + " ", "en", "s", 6), (8, None, None, None, None), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (None, " \n", "en", "s", 1), (None, words(rng, 9, 5000), "en", "s", 1), (9, "two words", "en", "s", 1)]
    df = table(spark, rows, extra=True)
    got = jaccard_join.distinct_documents(df)
    assert got.columns == df.columns
    ids = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    one = [x for x in ids if x[0] == 7 and x[1] != c]
    assert len(one) == 1 and ids[one[0]] == 1
    del ids[one[0]]
    assert ids == collections.Counter([(3, " ".join(near)), (7, c), (8, None), (8, ""), (8, ""), (None, " \n"), (None, rows[11][1]), (9, "two words")])


# passages


def test_passages_shared_by_documents(spark):
    rng = random.Random(5)
    prose = lambda n: [f"p{rng.randrange(6000)}" for _ in range(n)]
    exact, fuzzy, short = prose(70), prose(90), prose(30)
    edit = lambda w, rate: [f"q{rng.randrange(10**6)}" if rng.random() < rate else x for x in w]
    docs = {k: prose(150) for k in range(40)}
    for k in range(0, 6):
        docs[k][50:50] = exact
    for k in range(10, 16):
        docs[k][20:20] = edit(fuzzy, 0.06)
    for k in range(20, 24):
        docs[k][20:20] = short
    rows = [(k, " ".join(w), "en", "s", 1) for k, w in docs.items()]
    rows[2] = (2, " | ".join(docs[2]).upper(), "en", "s", 1)
    rows += [(50, rows[39][1], "en", "s", 1), (51, rows[3][1], "en", "s", 1)] + odd_rows()[2:5] + [(None, rows[0][1], None, None, None)]
    got = substring_dedup.repeated_passages(table(spark, rows, extra=True)).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {*range(6), *range(10, 16), 39, 50, 51, None}
    for k in range(6):
        assert any(r["start_word"] <= 50 and r["end_word"] >= 120 and r["end_word"] - r["start_word"] <= 76 for r in by_doc[k])
    for k in range(10, 16):
        assert any(r["start_word"] <= 32 and r["end_word"] >= 98 for r in by_doc[k])
    assert any((r["start_word"], r["end_word"], r["other_doc_id"]) == (0, 150, 39) for r in by_doc[50])
    for r in got:
        assert r["end_word"] - r["start_word"] >= 50 and 100 * r["n_matched"] >= 80 * max(r["end_word"] - r["start_word"], r["other_end_word"] - r["other_start_word"])
    assert substring_dedup.repeated_passages(table(spark, [])).count() == 0


def test_passages_that_a_document_holds_twice(spark):
    rng = random.Random(15)
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(80)
    twice = prose(30) + passage + prose(70) + passage + prose(30)
    quoted = prose(20) + passage[:40] + prose(70) + passage[40:] + prose(70) + passage + prose(20)
    rows = [(k, " ".join(w), "en", "s", 1) for k, w in enumerate([twice, quoted, prose(50) + passage + prose(50)])]
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    for doc, at in ((0, 30), (0, 180), (1, 240), (2, 50)):
        assert any(r["doc_id"] == doc and r["start_word"] <= at and r["end_word"] >= at + 80 and r["end_word"] - r["start_word"] <= 90 for r in got), (doc, at)


def test_passages_whose_parts_stand_in_other_texts(spark):
    """A and B share 80 words, C has the first and D the last of them, under 50 each; whichever nodes are smaller, A and B are found."""
    rng = random.Random(25)
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    docs, want = [], set()
    for cut, overlap in [(40, 0)] * 20 + [(40, 9)] * 10:
        passage = prose(80)
        for part in (passage, passage, passage[: cut + overlap], passage[cut - overlap :]):
            if len(part) == 80:
                want.add(len(docs))
            docs.append(prose(60) + part + prose(60))
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in enumerate(docs)]
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in got if r["start_word"] <= 60 and r["end_word"] >= 140} == want == {r["doc_id"] for r in got}


def test_every_equal_run_is_found(spark):
    """Against brute force: each run of 50 words that another text holds lies in a listed passage."""
    rng = random.Random(35)
    phrases = [[f"h{rng.randrange(10**6)}" for _ in range(24)] for _ in range(6)]
    docs = [[x for _ in range(6) for x in [*rng.choice(phrases), *(["z"] * rng.randrange(2))]] for _ in range(60)]
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in enumerate(docs)]
    holders = collections.defaultdict(set)
    for k, x in enumerate(docs):
        for i in range(len(x) - 49):
            holders[tuple(x[i : i + 50])].add(k)
    listed = collections.defaultdict(list)
    for r in substring_dedup.repeated_passages(table(spark, rows)).collect():
        listed[r["doc_id"]].append((r["start_word"], r["end_word"]))
    missed = [(k, i) for k, x in enumerate(docs) for i in range(len(x) - 49) if len(holders[tuple(x[i : i + 50])]) > 1 and not any(a <= i and b >= i + 50 for a, b in listed[k])]
    assert not missed


@pytest.mark.parametrize("hot,parts", [(False, 1), (True, 1), (False, 20)])
def test_edited_passages_whose_parts_stand_in_other_texts(spark, monkeypatch, hot, parts):
    """Two texts share an edited passage, without an equal run of 50 words; its parts, under 50 each, stand in others."""
    rng = random.Random(45)
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    docs, want = [], set()
    for _ in range(30 if parts == 1 else 6):
        passage = prose(90)
        edited = [*passage[:29], "e1", *passage[30:59], "e2", *passage[60:]]
        for part in (passage, edited, *[passage[:30], passage[30:60], passage[60:]] * parts):
            if len(part) == 90:
                want.add(len(docs))
            docs.append(prose(60) + part + prose(60))
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in enumerate(docs)]
    if hot:
        monkeypatch.setattr(sketch, "levels", lambda parts: np.full(1 << sketch.COUNT_BITS, 9, np.uint8))
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in got if r["start_word"] <= 60 and r["end_word"] >= 150} == want == {r["doc_id"] for r in got}


@pytest.mark.parametrize("hot", [False, True])
def test_edited_passages_of_which_every_two_seeds_stand_in_other_texts(spark, monkeypatch, hot):
    """Any two seeds of the passage stand in several texts of smaller nodes, none of which shares the passage."""
    rng = random.Random(65)
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    node = lambda w: substring_dedup._nodes(*word_hashes(pa.array([" ".join(w)]), substring_dedup.bare), 50)[0]
    passage = prose(90)
    edited = [*passage[:29], "e1", *passage[30:59], "e2", *passage[60:]]

    def text(part, ok):
        while not ok(node(w := prose(20) + part + prose(20))):
            pass
        return w

    docs = [text(part, lambda n: n > 1 << 62) for part in (passage, edited)]
    starts = range(0, 73, 4)
    for i in starts:
        for j in starts:
            for base in (passage, edited) * 2 if i < j else ():
                keep = {*range(i, i + 18), *range(j, j + 18)}
                docs.append(text([x if at in keep else prose(1)[0] for at, x in enumerate(base)], lambda n: n < 0))
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in enumerate(docs)]
    monkeypatch.setattr(substring_dedup, "SMALL", 1)
    if hot:
        monkeypatch.setattr(sketch, "levels", lambda parts: np.full(1 << sketch.COUNT_BITS, 9, np.uint8))
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(0, 1), (1, 0)}
    assert all(r["start_word"] <= 20 and r["end_word"] >= 110 for r in got)


def _text_of(rng, part, ok):
    """The part between 20 words of prose, drawn until the text's node is as wanted."""
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    node = lambda w: substring_dedup._nodes(*word_hashes(pa.array([" ".join(w)]), substring_dedup.bare), 50)[0]
    while not ok(node(w := prose(20) + part + prose(20))):
        pass
    return w


def test_a_text_is_held_against_texts_that_have_a_passage_already(spark):
    """All have a line of 30 words. a shares a passage around it with h, and another one with b, whose node comes after 16 others."""
    rng = random.Random(75)
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    a = prose(90)
    h = [x if i >= 30 or i % 5 else f"e{i}" for i, x in enumerate(a[:60])] + prose(30)
    b = prose(30) + [x if i < 60 or i % 5 else f"f{i}" for i, x in enumerate(a)][30:]
    quarter = 1 << 62
    docs = [_text_of(rng, a, lambda n: n > quarter), _text_of(rng, b, lambda n: n > quarter), _text_of(rng, h, lambda n: -quarter < n < 0)]
    docs += [_text_of(rng, prose(30) + a[30:60] + prose(30), ok) for ok in [lambda n: n < -quarter] + [lambda n: 0 < n < quarter] * 20]
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in enumerate(docs)]
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(0, 1), (1, 0), (0, 2), (2, 0)}


def test_what_the_smallest_node_lacks_is_compared_with_few(spark):
    """40 texts share an edited passage, the smallest node only a line of it: each is found, and the rows don't grow with its heads."""
    rng = random.Random(85)
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(75)
    docs = [_text_of(rng, prose(20) + passage[20:50] + prose(25), lambda n: n < 0)]
    for k in range(40):
        edited = [f"e{k}.{i}" if i in (2, 9, 16, 53, 60, 67) else x for i, x in enumerate(passage)]
        docs.append(_text_of(rng, edited, lambda n: n > 0))
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in enumerate(docs)]
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in got if r["start_word"] <= 30 and r["end_word"] >= 85} == {*range(1, 41)} == {r["doc_id"] for r in got}
    assert len(got) < 4 * len(rows)


def test_links_between_families_of_a_passage(spark):
    """Two texts with an equal run of 60 words are linked, also if each of them has a longer passage in common with a third."""
    rng = random.Random(55)
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(12):
        run = prose(60)
        sides = [(prose(50), prose(50)) for _ in range(2)]
        edited = [*run[:20], "e1", *run[21:40], "e2", *run[41:]]
        for a, b in sides:
            rows += [(len(rows) + k, " ".join(prose(40) + a + x + b + prose(40)), "en", "s", 1) for k, x in enumerate((run, edited))]
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    linked = {frozenset((r["doc_id"], r["other_doc_id"])) for r in got}
    assert all(frozenset((4 * g + a, 4 * g + b)) in linked for g in range(12) for a in range(4) for b in range(a))


def test_passages_of_a_hot_seed(spark, monkeypatch):
    rng = random.Random(8)
    hot = [f"h{k}" for k in range(60)]
    rows = [(k, " ".join([f"p{rng.randrange(9000)}" for _ in range(40)] + hot + [f"p{rng.randrange(9000)}" for _ in range(40)]), "en", "s", 1) for k in range(120)]
    monkeypatch.setattr(sketch, "levels", lambda parts: np.full(1 << sketch.COUNT_BITS, 9, np.uint8))
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in got if r["start_word"] <= 40 and r["end_word"] >= 100} == set(range(120))
    assert len(got) < 10 * len(rows)


def brute_chain(x, y, k, gap):
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    f = {}
    for i in order:
        f[i] = k + max([0.0] + [f[j] - gap * ((x[i] - x[j]) + (y[i] - y[j])) for j in f if x[j] < x[i] and y[j] < y[i]])
    return max(f.values())


def test_chain_is_the_best_one():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 30)
        x, y = np.array([rng.randrange(60) for _ in range(n)]), np.array([rng.randrange(60) for _ in range(n)])
        chains = substring_dedup.chain(x, y, 5, 0.05, 0.0)
        first = chains[0]
        assert all(a < b for a, b in zip(x[first], x[first][1:])) and all(a < b for a, b in zip(y[first], y[first][1:]))
        score = 5 * len(first) - 0.05 * ((x[first][-1] - x[first][0]) + (y[first][-1] - y[first][0]))
        assert abs(score - brute_chain(x.tolist(), y.tolist(), 5, 0.05)) < 1e-9
        used = [i for c in chains for i in c.tolist()]
        assert len(used) == len(set(used))


def test_minimizers_are_in_every_window():
    rng = random.Random(4)
    hashes, begins = word_hashes(pa.array([words(rng, n) for n in (3, 14, 15, 60, 200)]))
    text, pos, h = substring_dedup.minimizers(hashes, begins, 5, 10)
    for t, (a, b) in enumerate(zip(begins, begins[1:])):
        mine = set(pos[text == t].tolist())
        for i in range(0, b - a - 13):
            assert any(i <= p < i + 10 for p in mine)


def test_align_finds_edits():
    x, y = np.arange(100), np.arange(100)
    y = np.concatenate([y[:50], [900, 901], y[50:]])
    x = x.copy()
    x[20] = 777
    lo, hi, p_lo, p_hi, matched = substring_dedup.align(x, y, np.array([0, 30, 60]), np.array([0, 30, 62]), 5, (5, 5))
    assert (lo, hi, p_lo, p_hi, matched) == (0, 100, 0, 102, 99)


# shards


def brute_hilbert(cells, bits):
    """The index by going down the curve's quadrants, on Python integers."""
    x, n = list(cells), len(cells)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    q = 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[j] >> b) & 1) << (b * n + n - 1 - j) for b in range(bits) for j in range(n))


def test_hilbert_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    points = [(a, b) for a in range(16) for b in range(16)]
    rows = spark.createDataFrame(points, "a long, b long").select("a", "b", hilbert.hilbert_index([F.col("a"), F.col("b")], 4).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(256))
    assert all(abs(p["a"] - q["a"]) + abs(p["b"] - q["b"]) == 1 for p, q in zip(rows, rows[1:]))
    cube = [(a, b, c) for a in range(8) for b in range(8) for c in range(8)]
    got = spark.createDataFrame(cube, "a long, b long, c long").select("a", "b", "c", hilbert.hilbert_index([F.col(x) for x in "abc"], 3).alias("h")).collect()
    assert all(r["h"] == brute_hilbert((r["a"], r["b"], r["c"]), 3) for r in got)


@pytest.mark.parametrize("n", [0, 3, 16, 157])
def test_shards_are_even_runs_of_the_curve(spark, n):
    rng = random.Random(n)
    rows = ([(k % 140, words(rng, rng.randrange(1, 300)), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), 1) for k in range(n)] + odd_rows())[: n if n else 0]
    got = hilbert.document_shards(table(spark, rows, extra=True), 16).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    sizes = collections.Counter(r["shard"] for r in got)
    counts = [sizes.get(s, 0) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in got)


def test_written_shards_prune(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, words(rng, rng.randrange(1, 300)), "en", "s", 1) for k in range(200)]
    hilbert.write_shards(hilbert.document_shards(table(spark, rows), 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
