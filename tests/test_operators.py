"""Operators against naive Python on random data, and on awkward rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import bins, blocks as B, codecs as K, coords as C, mathx as M, strings as S
from helixframe.operators import alignments as A, annotation as AN, genes as G, intervals as I, sets, stats
from helixframe.types import PSL_BLOCKS


def ranges(seed, n, top, longest):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s = rng.randrange(top)
        out.append((rng.choice(["c1", "c2"]), s, s + rng.randrange(1, longest), rng.choice("+-"), k))
    return out


RANGES = "chrom string, start long, end long, strand string, id int"


def test_overlap_join_hashes_levels(spark):
    """Pairs of short ranges aren't tried in the wide cells of other levels: both levels are keys of the join, and only bounds are compared."""
    rows = [("c", k * 1000, k * 1000 + 5, "+", k) for k in range(300)] + [("c", 0, 300_000, "+", 300)]
    d = spark.createDataFrame(rows, RANGES)
    joined = I.overlap_join(d, d, shifts=[4, 12, 32])
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    line = next(x for x in plan.splitlines() if "Join [" in x)
    keys, _, condition = line.partition("Inner")
    assert "__mine" in keys and "__other" in keys and "__" not in condition
    assert joined.count() == 300 + 2 * 300 + 1


@pytest.mark.parametrize("top,longest", [(5_000, 400), (1_000_000, 300_000), (2_000_000_000, 400_000_000)])
def test_overlap_join_equals_all_pairs(spark, top, longest):
    a, b = ranges(1, 120, top, longest), ranges(2, 120, top, longest)
    b += [("c1", 536_870_912 - 5, 536_870_912 + 5, "+", 900), ("c1", 536_870_912, 536_870_913, "+", 901), (None, 1, 5, "+", 902)]
    da, db = spark.createDataFrame(a + [("c1", 7, 7, "+", 950)], RANGES), spark.createDataFrame(b, RANGES)
    want = {(x[4], y[4]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1]}
    pairs = I.overlap_join(da, db).select("id", "id_r").collect()
    assert len(pairs) == len(want) and {tuple(p) for p in pairs} == want
    stranded = {(x[4], y[4]) for x in a for y in b if (x[0], x[3]) == (y[0], y[3]) and x[1] < y[2] and x[2] > y[1]}
    assert {tuple(p) for p in I.overlap_join(da, db, ["chrom", "strand"]).select("id", "id_r").collect()} == stranded
    hit = {x for x, _ in want}
    assert {r["id"] for r in I.overlap_join(da, db, how="left_semi").collect()} == hit
    assert {r["id"] for r in I.overlap_join(da, db, how="left_anti").collect()} == {x[4] for x in a} - hit | {950}
    left = I.overlap_join(da, db, how="left").select("id", "id_r").collect()
    assert len(left) == len(want) + len(a) + 1 - len(hit)


def test_no_pair_of_tables_is_crossed(spark):
    d = spark.createDataFrame(ranges(1, 5, 1000, 50), RANGES)
    plan = I.overlap_join(d, d)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def naive_islands(rows, adjacent):
    out = []
    for chrom in {r[0] for r in rows}:
        current = None
        for _, s, e, *_ in sorted(r for r in rows if r[0] == chrom):
            if current and (s < current[2] or adjacent and s == current[2]):
                current = (chrom, current[1], max(current[2], e), current[3] + 1)
                out[-1] = current
            else:
                current = (chrom, s, e, 1)
                out.append(current)
    return sorted(out)


@pytest.mark.parametrize("adjacent", [False, True])
def test_islands(spark, adjacent):
    rows = ranges(3, 150, 900, 12) + [("c1", 100, 110, "+", 1), ("c1", 110, 120, "+", 2)]
    got = I.merge_islands(spark.createDataFrame(rows, RANGES), ["chrom"], adjacent=adjacent, n=F.count("*")).collect()
    assert sorted(tuple(r) for r in got) == naive_islands(rows, adjacent)


@pytest.mark.parametrize("region", [3, 6])
def test_islands_across_regions(spark, monkeypatch, region):
    """Many regions of a few bases, ranges over several of them, and equal ranges."""
    monkeypatch.setattr(I, "REGION", region)
    rows = ranges(9, 200, 1500, 25) + ranges(10, 20, 1500, 200) + ranges(9, 60, 1500, 25)
    for adjacent in (False, True):
        got = I.merge_islands(spark.createDataFrame(rows, RANGES), ["chrom"], adjacent=adjacent, n=F.count("*")).collect()
        assert sorted(tuple(r) for r in got) == naive_islands(rows, adjacent)


def test_flatten_numbers_in_genome_order(spark):
    got = I.flatten(spark.createDataFrame(ranges(4, 60, 3000, 90), RANGES), prefix="x").collect()
    ordered = sorted(got, key=lambda r: (r["chrom"], r["start"], r["end"], r["strand"]))
    assert [r["name"] for r in ordered] == [f"x{k + 1}" for k in range(len(got))]


def test_range_select_with_and_without_bins(spark):
    rows = ranges(5, 200, 3_000_000, 200_000)
    plain = spark.createDataFrame(rows, RANGES)
    binned = I.with_bin(plain)
    want = {r[4] for r in rows if r[0] == "c1" and r[1] < 900_000 and r[2] > 500_000}
    assert {r["id"] for r in I.range_select(plain, "c1", 500_000, 900_000).collect()} == want
    assert {r["id"] for r in I.range_select(binned, "c1", 500_000, 900_000, bin_col="bin").collect()} == want
    assert {r["id"] for r in I.range_select(binned, "c1", None, None, strand=["+"]).collect()} == {r[4] for r in rows if r[0] == "c1" and r[3] == "+"}


def test_remove_entry_removes_one_copy(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "x string, y int")
    assert sorted(map(tuple, I.remove_entry(d, x="a", y=1).collect())) == [("a", 1), ("b", None)]
    assert I.remove_entry(d, x="b", y=None).count() == 2 and I.remove_entry(d, x="z", y=1).count() == 3


def test_bins_of_edges(spark):
    d = spark.createDataFrame([(0, 1), (131071, 131072), (131071, 131073), (0, 536870912), (536870911, 536870913), (2_000_000_000, 2_000_000_001)], "s long, e long")
    got = [r["b"] for r in d.select(bins.calc_bin("s", "e").alias("b")).collect()]
    assert got == [585, 585, 73, 0, 4681, 4681 + 4681 + (2_000_000_000 >> 17)]
    assert d.select(F.size(bins.overlapping_bins("s", F.col("s"))).alias("n")).distinct().first()["n"] == 0


def one(spark, column, **values):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_coordinates(spark):
    parse = lambda t, **o: one(spark, C.parse_coords(F.lit(t), **o))
    assert tuple(parse("chr1:1,001-2,000", one_based=True))[:3] == ("chr1", 1000, 2000)
    assert tuple(parse("chr1"))[:3] == ("chr1", None, None) and tuple(parse("chr1", size=F.lit(50)))[:3] == ("chr1", 0, 50)
    with pytest.raises(Exception, match="invalid coordinates"):
        parse("chr1:5-x")
    a = C.coords(F.lit("c"), F.lit(10), F.lit(20), F.lit("+"), F.lit(100))
    b = C.coords(F.lit("c"), F.lit(80), F.lit(95), F.lit("-"), F.lit(100))
    assert one(spark, C.overlaps(a, b)) and not one(spark, C.overlaps_strand(a, b))
    assert one(spark, C.equal_absolute_location(a, C.reverse(a)))
    assert tuple(one(spark, C.intersect(a, C.coords(F.lit("c"), F.lit(30), F.lit(40)))))[1:3] == (30, 30)
    assert one(spark, C.intersect(a, C.coords(F.lit("d"), F.lit(1), F.lit(4)))) is None
    assert not one(spark, C.contains(a, C.coords(F.lit("c"), F.lit(12), F.lit(25))))
    with pytest.raises(Exception, match="sequence size"):
        one(spark, C.reverse(C.coords(F.lit("c"), F.lit(1), F.lit(2), F.lit("+"))))
    with pytest.raises(Exception, match="invalid range"):
        one(spark, C.coords(F.lit("c"), F.lit(5), F.lit(2), check=True))
    nulls = C.coords(F.lit("c"), F.lit(10), F.lit(20), None, F.lit(100))
    assert one(spark, C.abs_start(nulls)) == 80 and one(spark, C.absolute(nulls)["start"]) == 10
    assert [one(spark, C.phase_to_frame(F.lit(p))) for p in "012."] == [0, 2, 1, None]
    assert one(spark, C.frame_add(F.lit(1), F.lit(-2))) == 2


def test_blocks(spark):
    def arr(*b):
        return F.array(*(B.block(F.lit(x), F.lit(y)) for x, y in b)) if b else F.array().cast("array<struct<start:bigint,end:bigint>>")

    t = lambda c: [tuple(x) for x in one(spark, c)]
    assert t(B.merge(arr((5, 9), (1, 3), (3, 4), (8, 12)))) == [(1, 4), (5, 12)]
    assert t(B.merge(arr((1, 3), (3, 4)), adjacent=False)) == [(1, 3), (3, 4)]
    assert t(B.gaps(arr((1, 3), (3, 4), (9, 10)))) == [(3, 3), (4, 9)] and t(B.gaps(arr((1, 3)))) == [] and t(B.gaps(arr())) == []
    assert t(B.clip(arr((1, 3), (5, 9)), F.lit(2), F.lit(5))) == [(2, 3)]
    assert t(B.reverse(arr((1, 3), (5, 9)), F.lit(10))) == [(1, 5), (7, 9)]
    assert one(spark, B.coverage(arr())) == 0 and one(spark, B.span(arr())) is None
    assert one(spark, B.any_overlap(arr((1, 3)), arr((3, 5)))) is False and one(spark, B.all_contained(arr((1, 9)), arr((2, 3), (8, 9))))
    assert tuple(one(spark, B.containing(arr((1, 3), (2, 8)), F.lit(2)))) == (1, 3)
    with pytest.raises(Exception, match="out of order"):
        one(spark, B.add(arr((1, 3)), F.lit(2), F.lit(5)))


def test_strings_and_codecs(spark):
    s = lambda c: one(spark, c)
    assert s(S.reverse_complement(F.lit("ACGTNn-rK"))) == "Mynn-ACGT".replace("nn", "nN") or s(S.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert [tuple(r) for r in s(S.parse_cigar(F.lit("10m 2I D3N=")))] == [("M", 10), ("I", 2), ("D", 1), ("N", 3), ("=", 1)]
    assert s(S.format_cigar(S.parse_cigar(F.lit("10M1I5D")))) == "10MI5D"
    with pytest.raises(Exception, match="invalid CIGAR"):
        s(S.parse_cigar(F.lit("10Q")))
    assert s(S.drop_unique_suffix(F.lit("NM_1.2-3.1"))) == "NM_1.2"
    assert s(S.encode_attribute(F.lit("a;b=c,d&e%é f"))) == "a%3Bb%3Dc%2Cd%26e%25%C3%A9%20f" and s(S.percent_decode(F.lit("a%20b+c"))) == "a b+c"
    assert s(S.strip_tags(F.lit("<b>x &lt; y</b>&nbsp;&amp;lt;"))) == "x < y &lt;"
    assert s(S.to_ascii(F.lit("naïve Straße “ok” 日"))) == 'naive Strasse "ok" ?'
    assert s(K.split_list(F.lit("1,2,3,"), "int")) == [1, 2, 3] and s(K.split_list(F.lit(""), "int")) == [] and s(K.split_list(F.lit("a"))) == ["a"]
    assert s(K.join_list(F.array())) == "" and s(K.join_list(F.array(F.lit(1), F.lit(2)))) == "1,2," and s(K.join_list(F.array(F.lit(1)), trailing=False)) == "1"
    assert s(K.parse_boolean(F.lit("nmd"), "nmd")) is False and s(K.format_boolean(F.lit(True), "stat")) == "ok"
    with pytest.raises(Exception, match="expected"):
        s(K.parse_boolean(F.lit("x"), "stat"))
    m = s(K.parse_attributes(F.lit("ID=a%3B1; Note=x,y%2Cz;")))
    assert m == {"ID": ["a;1"], "Note": ["x", "y,z"]} and s(K.parse_attributes(F.lit("."))) == {}
    assert s(K.format_attributes(K.parse_attributes(F.lit("b=1,2;a=x%20y")))) == "a=x y;b=1,2"
    with pytest.raises(Exception, match="several values"):
        s(K.attribute(K.parse_attributes(F.lit("a=1,2")), "a"))
    with pytest.raises(Exception):
        s(K.parse_attributes(F.lit("a=1;a=2")))
    assert s(K.enum_ordinal(F.lit("no-cds"), ["ok", "noCDS"], {"no-cds": "noCDS"})) == 1 and s(K.enum_name(F.lit(1), ["ok", "noCDS"], {"no-cds": "noCDS"})) == "no-cds"
    assert s(K.prefixed_value(F.array(F.lit("HGNC:5"), F.lit("GeneID:77")), "GeneID")) == "77"


def test_math(spark):
    s = lambda c: one(spark, c)
    assert s(M.order_of_magnitude(F.lit(0))) == 0 and s(M.order_of_magnitude(F.lit(420))) == 1000 and s(M.order_of_magnitude(F.lit(-42))) == -100
    assert s(M.frequency(F.lit(1), F.lit(0), True)) == 1 and s(M.rate(F.lit(1), F.lit(3))) == "0.333" and s(M.rate(F.lit(1), F.lit(0))) == "0"
    assert str(s(M.safe_divide(F.lit(1), F.lit(0)))) == "nan"
    for r, g, b in itertools.product((0, 17, 128, 255), repeat=3):
        c = M.rgb8(F.lit(r), F.lit(g), F.lit(b))
        assert s(M.pack_rgb8(M.from_hsv(M.to_hsv(c)["h"], M.to_hsv(c)["s"], M.to_hsv(c)["v"]))) == r * 65536 + g * 256 + b
        break
    assert s(M.format_html_color(M.parse_rgb8(F.lit("255,140,0")))) == "#ff8c00"
    assert tuple(s(M.hsv8(M.parse_html_color(F.lit("#00ff00"))))) == (120, 100, 100)
    assert s(M.format_rgb8(M.with_channel(M.parse_html_color(F.lit("#00ff00")), "h", 0.0))) == "255,0,0"


def test_genes(spark):
    d = spark.createDataFrame([("g", "c", "-", 100, 500, 150, 420, [100, 200, 400], [160, 300, 500])], "name string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, s array<long>, e array<long>")
    d = d.withColumn("exons", G.exons_from_lists("s", "e"))
    f = [tuple(None if v is None else tuple(v) for v in x) for x in d.select(G.features().alias("f")).first()["f"]]
    assert f == [(None, (150, 160), (100, 150)), (None, (200, 300), None), ((420, 500), (400, 420), None)]
    assert [e["frame"] for e in d.select(G.assign_frames().alias("e")).first()["e"]] == [120 % 3, 20 % 3, 0]
    no_cds = d.withColumn("cds_start", F.col("tx_end")).withColumn("cds_end", F.col("tx_end"))
    assert not no_cds.select(G.has_cds().alias("x")).first()["x"]
    assert [e["frame"] for e in no_cds.select(G.assign_frames().alias("e")).first()["e"]] == [-1] * 3
    assert no_cds.select(G.exon_numbers("exons").alias("x")).first()["x"] == [None] * 3


def naive_projection(blocks, lo, hi):
    """Walk the blocks base by base: runs of aligned bases and of bases between blocks, without the overhang in front."""
    out = []
    for p in range(lo, hi):
        hit = next((q + p - t for q, t, n in blocks if t <= p < t + n), None)
        kind = "aligned" if hit is not None else "t_insert"
        key = (kind, None if hit is None else hit - p, None if hit is not None else sum(t + n <= p for q, t, n in blocks))
        if out and out[-1][0] == key:
            out[-1][2] = p + 1
        else:
            out.append([key, p, p + 1])
    return [(k[0], a, b, None if k[1] is None else a + k[1]) for k, a, b in out]


def test_projection_equals_a_walk_over_bases(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        q = t = 0
        blocks = []
        for _ in range(rng.randrange(1, 6)):
            q, t, n = q + rng.randrange(0, 6), t + rng.randrange(0, 6), rng.randrange(1, 9)
            blocks.append((q, t, n))
            q, t = q + n, t + n
        lo = rng.randrange(blocks[0][1], 40)
        rows.append((k, [(b[0], b[1], b[2], None, None) for b in blocks], lo, lo + rng.randrange(1, 40)))
    d = spark.createDataFrame(rows, "k int, blocks array<struct<q_start:long,t_start:long,size:long,q_seq:string,t_seq:string>>, lo long, hi long")
    d = d.select("*", F.lit("+").alias("strand"), F.lit(100).alias("q_size"), F.lit(100).alias("t_size"))
    for r in d.select("k", "blocks", "lo", "hi", A.target_to_query("lo", "hi").alias("p")).collect():
        want = naive_projection([(b["q_start"], b["t_start"], b["size"]) for b in r["blocks"]], r["lo"], r["hi"])
        assert [(p["kind"], p["t_start"], p["t_end"], p["q_start"]) for p in r["p"]] == want


def test_projection_overhang_reaches_the_block(spark):
    d = spark.createDataFrame([([(5, 50, 10, None, None)],)], "blocks array<struct<q_start:long,t_start:long,size:long,q_seq:string,t_seq:string>>").select("*", F.lit("+").alias("strand"), F.lit(20).alias("q_size"), F.lit(100).alias("t_size"))
    p = d.select(A.target_to_query(F.lit(10), F.lit(20)).alias("p")).first()["p"]
    assert [(x["kind"], x["t_start"], x["t_end"], x["next_q_start"]) for x in p] == [("t_insert", 10, 50, 5)]
    p = d.select(A.target_to_query(F.lit(70), F.lit(80)).alias("p")).first()["p"]
    assert [(x["kind"], x["t_start"], x["t_end"], x["prev_q_end"]) for x in p] == [("t_insert", 70, 80, 15)]
    minus = d.select(A.target_to_query(F.lit(42), F.lit(45), "-").alias("p")).first()["p"]
    assert [(x["kind"], x["t_start"], x["t_end"], x["q_start"]) for x in minus] == [("aligned", 55, 58, 10)]


def test_cigar_to_alignment(spark):
    c = S.parse_cigar(F.lit("5S10M2I3M4D1=1X2H"))
    r = spark.range(1).select(*A.from_cigar(F.lit("q"), F.lit("-"), F.lit("t"), F.lit(1000), F.lit(100), c)).first()
    assert [(b["q_start"], b["t_start"], b["size"]) for b in r["blocks"]] == [(5, 100, 10), (17, 110, 3), (20, 117, 1), (21, 118, 1)]
    assert (r["q_size"], r["q_start"], r["q_end"], r["t_end"], r["q_num_insert"], r["t_base_insert"], r["match"]) == (24, 2, 19, 119, 1, 4, 15)


def test_power_set_and_venn(spark):
    d = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 3), ("c", 3)], "set_name string, item int")
    names = ["a", "b", "c"]
    got = sets.venn(d).orderBy("nth").collect()
    want = [list(c) for n in (1, 2, 3) for c in itertools.combinations(names, n)]
    assert [r["subset"] for r in got] == want and [r["count"] for r in got] == [1, 0, 1, 1, 0, 0, 0]
    assert [r["count"] for r in sets.venn(d, inclusive=True).orderBy("nth").collect()] == [2, 1, 1, 1, 0, 0, 0]
    assert sets.venn(d, exclude_empty=True).count() == 3 and sets.venn(d.limit(0)).count() == 0


def test_histograms(spark):
    d = spark.createDataFrame([(float(k),) for k in range(10)] + [(None,), (float("nan"),)], "v double")
    got = stats.histogram(d, "v", 10).orderBy("bin").collect()
    assert [r["n"] for r in got] == [1] * 10 and abs(got[0]["center"]) < 1e-9 and abs(got[9]["center"] - 9) < 1e-9
    assert [r["n"] for r in stats.histogram(d, "v", 2, lo=2, hi=5).orderBy("bin").collect()] == [2, 2]
    assert [r["n"] for r in stats.histogram(d, "v", 2, lo=2, hi=5, clamp=True).orderBy("bin").collect()] == [4, 6]
    assert [r["n"] for r in stats.histogram(d, "v", 1).collect()] == [10]
    assert stats.histogram(d.limit(0), "v").count() == 0
    assert [r["n"] for r in stats.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 4).orderBy("bin").collect()] == [4, 0, 0, 0]


def test_splice_classes(spark):
    cases = [("GT", "AG", "+", 100, "STD"), ("CT", "AC", "-", 100, "STD"), ("CT", "AC", "+", 100, "STD_RC"), ("GC", "AG", "+", 100, "RARE"), ("AT", "AC", "+", 100, "U12"), ("GT", "AG", "+", 29, "GAP"), ("AA", "AA", "+", 99, "UNKNOWN"), ("gt", "ag", "+", 30, "STD")]
    d = spark.createDataFrame(cases, "a string, b string, s string, n int, want string")
    assert all(r["x"] == r["want"] for r in d.select(stats.classify_junction(stats.junction("a", "b", "s"), "n").alias("x"), "want").collect())


def test_cds_is_sought_once_a_pair(spark):
    """The blocks of a pair are gone through once, and the CDS lies where it did."""
    d = spark.createDataFrame([(5, 30, [(0, 100, 10), (10, 120, 10), (25, 140, 10)]), (10, 12, [(0, 100, 10), (12, 130, 5)])], "lo long, hi long, blocks array<struct<q_start:long,t_start:long,size:long>>")
    c = d.select(A.project_cds("lo", "hi").alias("c"))
    assert c._jdf.queryExecution().analyzed().toString().count("filter(") == 1
    assert [None if r["c"] is None else tuple(r["c"]) for r in c.collect()] == [(105, 145), None]


def test_map_cds_equals_all_pairs(spark):
    """Pairs of few and of many blocks, empty and overlapping ones, against naive Python; plain pairs have no lambda, and their code is small enough to be compiled."""
    rng = random.Random(5)

    def alignment(k, n, wild):
        blocks, q, t = [], rng.randrange(50), rng.randrange(200)
        for _ in range(n):
            size = rng.choice([0, 3, 10, 40])
            blocks.append((q, t, size, None, None))
            q, t = q + size + rng.randrange(20), max(0, t + size + rng.randrange(-30 if wild else 0, 30))
        return (f"q{k}", "c1", rng.choice(["+", "-", "+-", "--"]), blocks, *sorted(rng.sample(range(300), 2)))

    rows = [alignment(k, rng.choice([1, 2, 5, 11, 12, 13, 20]), k % 5 == 0) for k in range(160)]
    d = spark.createDataFrame(rows, f"q_name string, t_name string, strand string, blocks {PSL_BLOCKS}, cds_start long, cds_end long")

    def carried(blocks, lo, hi, x, y):
        hit = [b for b in blocks if max(lo, b[x]) < min(hi, b[x] + b[2])]
        return (max(lo, hit[0][x]) + hit[0][y] - hit[0][x], min(hi, hit[-1][x] + hit[-1][2]) + hit[-1][y] - hit[-1][x]) if hit else None

    want = []
    for a, _, s, blocks, lo, hi in rows[:80]:
        c = carried(blocks, lo, hi, 0, 1)
        for b, _, r, others, _, _ in rows[80:]:
            first, end = others[0][1], others[-1][1] + others[-1][2]
            if c and c[0] < c[1] and first < end and s[1:] == r[1:] and first < c[1] and end > c[0]:
                want.append((a, b, *c, *(carried(others, *c, 1, 0) or (None, None))))
    numbered = F.substring("q_name", 2, 9).cast("int")
    got = A.map_cds(d.where(numbered < 80), d.where(numbered >= 80))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 500
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = A.map_cds(d.where(numbered < 80), d.where(numbered >= 80))._jdf.queryExecution()
        above, joined, _ = plan.executedPlan().toString().partition("Join [")
        assert joined and "AS cds_end" in above and "lambda" not in above
        code = plan.debug().codegenToSeq()
        assert max(code.apply(k)._3().maxMethodCodeSize() for k in range(code.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_feature_tree(spark):
    rows = [("g1", "gene", 10, 90, []), ("t1", "mRNA", 10, 90, ["g1"]), ("t2", "mRNA", 10, 95, ["g1"]), ("e1", "exon", 10, 30, ["t1", "t2"]), ("g0", "gene", 5, 8, [])]
    f = spark.createDataFrame([("c", *r) for r in rows], "seqname string, id string, type string, start long, end long, parents array<string>")
    assert [r["node"] for r in AN.feature_tree(f).orderBy("path_key").collect()] == ["g0", "g1", "t2", "e1", "t1", "e1"]
    assert AN.missing_parents(f).count() == 0
    assert [r["parent_id"] for r in AN.missing_parents(f.where("id != 'g1'")).collect()] == ["g1"]


def test_feature_tree_has_no_limit_of_rows(spark):
    rows = [("c", f"g{k}", "gene", k, k + 5, []) for k in range(30)] + [("c", f"t{k}", "mRNA", k, k + 5, [f"g{k}"]) for k in range(30)]
    f = spark.createDataFrame(rows, "seqname string, id string, type string, start long, end long, parents array<string>")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, 20)
    try:
        assert [r["node"] for r in AN.feature_tree(f).orderBy("path_key").collect()] == [f"{x}{k}" for k in range(30) for x in "gt"]
    finally:
        spark.conf.set(limit, before)


def test_walk_has_no_limit_of_rows(spark):
    """A recursive query of Spark's stops at a number of rows; a walk gives all, and fails on a cycle only."""
    edges = spark.createDataFrame([(str(k), str(k // 4)) for k in range(4, 300)] + [("b", "a"), ("a", "b")], "child_id string, parent_id string")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, 20)
    try:
        rows = AN.walk(edges, spark.createDataFrame([("1",), ("2",), ("3",)], "node string")).collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted(int(r["node"]) for r in rows) == list(range(1, 300))
    assert all(r["path"].split("/")[0] == r["root"] and len(r["path"].split("/")) == r["depth"] + 1 for r in rows)
    with pytest.raises(Exception):
        AN.walk(edges, spark.createDataFrame([("a",)], "node string"), 5).collect()


def test_agp_to_psl_needs_names(spark):
    agp = spark.createDataFrame([("o", 0, 10, "block", "x", 0, 10, "+")], "object string, object_start long, object_end long, kind string, component string, component_start long, component_end long, strand string")
    ids = spark.createDataFrame([("y", "acc")], "local_id string, accession string")
    assert AN.agp_to_psl(agp, id_map=ids, skip_unmapped=True).count() == 0
    with pytest.raises(Exception, match="unmapped component"):
        AN.agp_to_psl(agp, id_map=ids).collect()


def test_required_rows(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="k not found"):
        AN.required_rows(t, spark.createDataFrame([("a",), ("b",)], "k string"), "k").collect()


@pytest.mark.parametrize("lengths", [[1, 5, 16, 17], [0, 3, 20, 500], [2, 40, 3000, 100_000], [1]])
def test_overlap_joins_equal_all_pairs(spark, lengths):
    """Ranges of very different lengths, in one level of cells and in several; nulls, empty and negative ranges."""
    import random

    from helixframe.operators.intervals import overlap_join

    def ranges(seed, lengths):
        rng = random.Random(seed)
        out = []
        for k in range(120):
            at = rng.randrange(-50, 3000)
            out.append((None if rng.random() < 0.03 else rng.choice("ab"), None if rng.random() < 0.03 else at, at + rng.choice(lengths), k))
        return out

    a, b = ranges(1, lengths), ranges(2, lengths + [7])
    left, right = (spark.createDataFrame(x, "chrom string, start long, end long, id int") for x in (a, b))
    real = lambda x: x[0] is not None and x[1] is not None and x[2] > x[1]
    want = [(x[3], y[3]) for x in a for y in b if real(x) and real(y) and x[0] == y[0] and x[1] < y[2] and x[2] > y[1]]
    hit = {x for x, _ in want}
    pairs = overlap_join(left, right)
    assert pairs.columns == ["chrom", "start", "end", "id", "chrom_r", "start_r", "end_r", "id_r"]
    assert sorted((r.id, r.id_r) for r in pairs.collect()) == sorted(want)
    assert sorted(r.id for r in overlap_join(left, right, how="left_semi").collect()) == sorted(hit)
    assert sorted(r.id for r in overlap_join(left, right, how="left_anti").collect()) == sorted({x[3] for x in a} - hit)
    assert sorted(((r.id, r.id_r) for r in overlap_join(left, right, how="left").collect()), key=str) == sorted(want + [(x[3], None) for x in a if x[3] not in hit], key=str)


@pytest.mark.parametrize("stranded", [True, False])
def test_flatten_numbers_null_sequences_last(spark, stranded):
    rows = [(None, 1, 5, "+"), ("c1", 1, 5, "+"), ("c1", 9, 12, None), ("c1", 9, 12, "+"), ("c2", 0, 0, "-")]
    d = spark.createDataFrame(rows, "chrom string, start long, end long, strand string")
    got = {(r["chrom"], r["start"], r["strand"]): r["name"] for r in I.flatten(d, stranded, "loc").collect()}
    want = {("c1", 1, "+"): "loc1", ("c1", 9, "+"): "loc2", ("c1", 9, None): "loc3", ("c2", 0, "-"): "loc4", (None, 1, "+"): "loc5"}
    assert got == (want if stranded else {("c1", 1, "+"): "loc1", ("c1", 9, "+"): "loc2", ("c2", 0, "+"): "loc3", (None, 1, "+"): "loc4"})


def test_stream_islands_hold_empty_ranges_at_their_start():
    from helixframe.streaming.intervals import merge_into

    assert merge_into([], [(5, 5), (5, 9), (9, 9), (20, 20), (20, 20)]) == [(5, 9, 2), (9, 9, 1), (20, 20, 1), (20, 20, 1)]
    assert merge_into([(5, 5, 1)], [(5, 9)]) == [(5, 9, 2)]
