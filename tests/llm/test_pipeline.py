"""The pipeline: each stage against brute force on awkward rows, and all of them on one scenario."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from helixframe.llm import decontaminate, secrets, toxicity  # noqa: E402

from .test_dedup import brute_components  # noqa: E402
from .test_text_operators import brute_base, brute_entropy, brute_score, toxic_rows  # noqa: E402
from .test_tokens import check_packing, plain  # noqa: E402
from .util import odd_rows, table, words  # noqa: E402


def written(spark, base, rows, **tables):
    for name, df in {"documents": table(spark, rows, extra=True), **tables}.items():
        df.write.parquet(f"{base}/{name}.parquet")
    return spark.read.parquet(f"{base}/documents.parquet")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def kept(df, docs):
    """Rows of a stage as a multiset of (doc_id, text), with all columns of documents."""
    assert df.columns == docs.columns
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_toxicity_stage(spark, tmp_path):
    rows, labels, _, _ = toxic_rows(600)
    rows = rows + [(None, t, *r) for _, t, *r in rows[:12]] + odd_rows()
    docs = written(spark, str(tmp_path), rows, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    small = [r for r in rows if len(r[1] or "") < 5000]
    got = kept(stage("toxicity")(spark, docs, str(tmp_path)), docs)
    for r in small:
        clean = brute_score(model, r[1] or "") < 0.5
        assert got[r[0], r[1]] == (sum(x[:2] == r[:2] for x in rows) if clean else 0), r[:2]
    assert got[None, None] == got[3, ""] == 1


def test_jaccard_stage(spark, tmp_path):
    rng = random.Random(2)
    base = [words(rng, 60, 5000) for _ in range(8)]
    near = [" ".join(f"new{k}" if i == k else w for i, w in enumerate(b.split())) for k, b in enumerate(base)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(base)] + [(rng.choice([k, 100 + k, None]), t, "en", "s", 1) for k, t in enumerate(near)] + odd_rows() + odd_rows()[:6]
    docs = written(spark, str(tmp_path), rows)
    got = kept(stage("ngram_jaccard_join")(spark, docs, str(tmp_path)), docs)
    numbered = [(n, *r[1:]) for n, r in enumerate(rows)]  # ids of their own, so that groups are known row by row
    groups = collections.defaultdict(list)
    for n, size, root in brute_components(numbered):
        groups[root if size else ("alone", n)].append(n)
    want = collections.Counter()
    for members in groups.values():
        ids = [rows[n][0] for n in members if rows[n][0] is not None]
        stay = [n for n in members if rows[n][0] == (min(ids) if ids else None)]
        texts = {rows[n][1] for n in stay}
        found = [t for t in texts if got[rows[stay[0]][0], t]]
        assert len(found) == 1 if len(texts) > 1 else found
        want[rows[stay[0]][0], found[0]] += 1
    assert got == want


def local_score(item, text):
    """The best local alignment of two word lists by the full table."""
    t = np.zeros((len(item) + 1, len(text) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            t[i, j] = max(0, t[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), t[i - 1, j] - 1, t[i, j - 1] - 1)
    return int(t.max())


def test_decontamination_stage(spark, tmp_path):
    """Rows go by their own text: null ids, repeated ids, long items."""
    rng = random.Random(6)
    items = [words(rng, n, 9000) for n in (2, 8, 20, 60)]
    rows = []
    for k in range(60):
        text = words(rng, rng.randrange(10, 60), 9000).split()
        if k % 2:
            item = rng.choice(items).split()
            item = [w if rng.random() > 0.04 * (k % 12) else "other" for w in item]
            at = rng.randrange(len(text))
            text[at:at] = item
        rows.append((rng.choice([k, None, 7]), " ".join(text), "en", "s", 1))
    rows += [r for r in odd_rows() if len(r[1] or "") < 3000]
    docs = written(spark, str(tmp_path), rows, benchmark=spark.createDataFrame(list(enumerate([*items, None, "", "?"])), "item_id long, text string"))
    got = kept(stage("benchmark_decontamination")(spark, docs, str(tmp_path)), docs)
    bare = lambda t: [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in (t or "").split()) if w]
    want = collections.Counter()
    for r in rows:
        text, leak = bare(r[1]), False
        for item in map(bare, items):
            n = min(3, len(item))
            grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
            seeded = any(tuple(text[i : i + n]) in grams for i in range(len(text) - n + 1))
            leak |= seeded and local_score(item, text) >= 0.5 * 2 * len(item)
        want[r[0], r[1]] += not leak
    assert got == +want and sum(got.values()) < len(rows)


def test_long_benchmark_items(spark, tmp_path):
    """An item of thousands of words, alone in its group of alignments."""
    rng = random.Random(8)
    item = words(rng, 6000, 9000)
    short = [words(rng, 12, 9000) for _ in range(3)]
    docs = table(spark, [(1, "lead " + item, "en", "s", 1), (2, words(rng, 300, 9000), "en", "s", 1), (3, "x " + short[1], "en", "s", 1)])
    bench = spark.createDataFrame(list(enumerate([item, *short])), "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()} == {2}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 0), (3, 2)}


def test_secret_stage(spark, tmp_path):
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(32))
    rows = [(rng.choice([k, None]), f"{words(rng, 5)} {rng.choice(['token = ', 'x ', 'a=b=', ''])}{key()} {words(rng, 5)}", "en", "s", 7) for k in range(40)] + [(1, "[SECRET] stays", "en", "s", 9), *odd_rows()]
    docs = written(spark, str(tmp_path), rows)
    out = stage("secret_scan")(spark, docs, str(tmp_path))
    want = collections.Counter()
    for doc_id, text, _, _, n_chars in rows:
        clean = text
        if text:
            inside = sorted({k for _, a, b in brute_base(text) + brute_entropy(text) for k in range(a, b)})
            spans = sorted((a, b) for _, a, b in brute_base(text) + brute_entropy(text))
            merged = []
            for a, b in spans:
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            assert inside == [k for a, b in merged for k in range(a, b)]
            for a, b in reversed(merged):
                clean = clean[:a] + "[SECRET]" + clean[b:]
        want[doc_id, clean, n_chars if clean == text else len(clean)] += 1
    assert out.columns == docs.columns and collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == want
    assert secrets.redacted("abc", []) == "abc"


def test_packing_stage(spark, tmp_path):
    rows, ids = odd_rows(), plain("byte_bpe_50k.json")
    docs = written(spark, str(tmp_path), rows)
    got = stage("packing")(spark, docs, str(tmp_path)).collect()
    lengths = collections.Counter((r[0], len(ids(r[1])) + 1) for r in rows)
    check_packing(got, dict(lengths), 1024)
    one = {r[0]: ids(r[1]) + [0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    assert all(p["ids_crc32"] == zlib.crc32(np.array(one[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in got if p["doc_id"] in one)
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(13)
    base = str(tmp_path / "sf")
    clean = [(k, words(rng, rng.randrange(30, 90), 3000), "en", "s", 5) for k in range(60)]
    item = words(rng, 30, 9000)
    near = clean[4][1].split()
    near[-1] = "changed"
    toxic = [(100 + k, words(rng, 40, 3000) + " idiot moron scum", "en", "s", 5) for k in range(30)]
    rows = clean + toxic + [
        (200, " ".join(near), "en", "s", 5), (201, clean[7][1], "en", "s", 5), (202, words(rng, 40, 3000) + " " + item, "en", "s", 5), (203, words(rng, 40, 3000) + " token = abcdef0123456789abcdef0123 z", "en", "s", 5),
        (None, None, None, None, None), (204, "", "en", "s", 0), (60, None, "en", "s", None), (5, clean[5][1], "en", "s", 5),
    ]
    from pyspark.sql import functions as F

    table(spark, rows).withColumn("leak_id", F.lit(1)).write.parquet(base + "/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 100)) for r in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(base + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(base + "/benchmark.parquet")
    docs, seen = spark.read.parquet(base + "/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, base)
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            seen.append(collections.Counter(r["doc_id"] for r in docs.collect()))
        else:
            packed = out.collect()
    kept = set(range(60))
    assert all(i in kept | {200, 201, 202, 203, 204, 60, None} for i in seen[0]) and kept <= set(seen[0])
    assert set(seen[1]) == kept | {202, 203, 204, 60, None} and max(seen[1].values()) == 1
    assert set(seen[2]) == kept | {203, 204, 60, None}
    assert seen[3] == seen[2]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert "[SECRET]" in text[203] and "abcdef" not in text[203] and all(text[r[0]] == r[1] for r in clean)
    assert {p["doc_id"] for p in packed} == set(seen[3])
    assert {p["doc_id"] for p in corpus_pipeline.run(spark, base).collect()} == set(seen[3])
