"""Readers and writers on small files, round trips, and what they refuse."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.functions.codecs import parse_boolean
from helixframe.operators import alignments as A, genes as G
from helixframe.plans import programs
from helixframe.sources import genbank, records, sinks, text


def put(tmp_path, name, content):
    p = tmp_path / name
    (p.write_bytes if isinstance(content, bytes) else p.write_text)(content)
    return str(p)


def got(path):
    import glob

    return [line for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f).read().splitlines()]


def test_lines_and_tab_rows(spark, tmp_path):
    p = put(tmp_path, "a.tab", "#c\na\tb\n\nc\t\tlast")
    assert [r["row"] for r in text.tab_rows(spark, p, comments=True, blank=True).collect()] == [["a", "b"], ["c", "", "last"]]
    numbered = text.lines(spark, p, numbered=True).orderBy("line_no").collect()
    assert [r["value"] for r in numbered] == ["#c", "a\tb", "", "c\t\tlast"]
    z = put(tmp_path, "a.gz", gzip.compress(b"x\ty\n"))
    assert text.tab_rows(spark, z).first()["row"] == ["x", "y"]
    with pytest.raises(ValueError, match="no codec"):
        text.lines(spark, str(tmp_path / "a.bgz"))


TYPES = "strCol\tintCol\tfloatCol\tonOffCol\nname1\t10\t10.01\ton\nname2\t\tnan\toff\n\"a\tb\"\"\"\t5\t1e3\ton\n"


def test_tsv_with_types(spark, tmp_path):
    p = put(tmp_path, "t.tsv", TYPES)
    nullable = lambda c: F.nullif(c, F.lit("")).cast("int")
    df = text.read_tsv(spark, p, {"intCol": nullable, "floatCol": "double", "onOffCol": lambda c: parse_boolean(c, "on_off")})
    rows = df.collect()
    assert df.dtypes == [("strCol", "string"), ("intCol", "int"), ("floatCol", "double"), ("onOffCol", "boolean")]
    assert [r["strCol"] for r in rows] == ["name1", "name2", 'a\tb"'] and [r["intCol"] for r in rows] == [10, None, 5]
    assert str(rows[1]["floatCol"]) == "nan" and [r["onOffCol"] for r in rows] == [True, False, True]
    with pytest.raises(Exception):
        text.read_tsv(spark, p, {"strCol": "int"}).collect()


def test_tsv_refuses_bad_files(spark, tmp_path):
    with pytest.raises(ValueError, match="duplicate"):
        text.read_tsv(spark, put(tmp_path, "d.tsv", "a\ta\n1\t2\n"))
    with pytest.raises(ValueError, match="empty"):
        text.read_tsv(spark, put(tmp_path, "e.tsv", ""))
    assert text.read_tsv(spark, str(tmp_path / "e.tsv"), allow_empty=True).columns == []
    for body in ("1\n", "1\t2\t3\n"):
        with pytest.raises(Exception, match="doesn't have 2 columns"):
            text.read_tsv(spark, put(tmp_path, "w.tsv", "a\tb\n" + body)).collect()
    assert text.read_tsv(spark, str(tmp_path / "w.tsv"), ignore_extra=True).first()["b"] == "2"


def test_tsv_headers_and_dialects(spark, tmp_path):
    p = put(tmp_path, "h.tsv", "# a b\tc\nx\t\"y\"\n")
    df = text.read_tsv(spark, p, rename=lambda n: n.replace(" ", "_"), quote=None)
    assert df.columns == ["a_b", "c"] and df.first()["c"] == '"y"'
    q = put(tmp_path, "c.csv", 'x,"y, z"\n1,\n')
    assert [tuple(r) for r in text.read_csv(spark, q, columns=["p", "q"]).collect()] == [("x", "y, z"), ("1", "")]
    out = str(tmp_path / "out")
    sinks.write_tsv(spark.createDataFrame([(1, None, ["a", "b"])], "x int, y string, z array<string>").coalesce(1), out)
    assert got(out) == ["x\ty\tz", "1\t\ta,b,"]


BED = "track name=x\nc1\t10\t100\tn1\t12.7\t-\t20\t90\t1,2,3\t2\t10,20,\t0,70,\textra1\textra2\nc2\t5\t9\nc2\t5\t9\tn\t.\n"


def test_bed(spark, tmp_path):
    p = put(tmp_path, "a.bed", BED)
    a, b, c = records.bed(spark, p, fix_scores=True).collect()
    assert [tuple(x) for x in a["blocks"]] == [(10, 20), (80, 100)] and a["score"] == 12 and a["extra_cols"] == ["extra1", "extra2"]
    assert [tuple(x) for x in b["blocks"]] == [(5, 9)] and b["thick_start"] == 9 and b["name"] is None and c["score"] == 0
    with pytest.raises(Exception):
        records.bed(spark, p).collect()
    rows = records.bed(spark, p, fix_scores=True)
    line = [r["v"] for r in rows.select(sinks.bed_line_extra().alias("v")).collect()]
    assert line[0] == "c1\t10\t100\tn1\t12\t-\t20\t90\t1,2,3\t2\t10,20,\t0,70,\textra1\textra2"
    assert line[1] == "c2\t5\t9\tc2:5-9\t0\t+\t9\t9\t0\t1\t4,\t0,"
    six = records.bed(spark, put(tmp_path, "b.bed", "c\t1\t2\tn\t5\t+\tx\ty\n"), n_columns=6).first()
    assert six["extra_cols"] == ["x", "y"] and six["strand"] == "+"


GP = "t1\tc1\t+\t10\t100\t20\t90\t2\t10,60,\t30,100,\t7\tg1\tcmpl\tincmpl\t0,1,"


def test_gene_pred(spark, tmp_path):
    df = records.gene_pred(spark, put(tmp_path, "a.gp", GP + "\n" + "\t".join(GP.split("\t")[:10]) + "\n"))
    a, b = df.collect()
    assert [tuple(e) for e in a["exons"]] == [(10, 30, 0), (60, 100, 1)] and a["has_frames"] and not b["has_frames"] and b["name2"] is None
    assert df.where("has_frames").select(sinks.gene_pred_line(True).alias("v")).first()["v"] == GP
    big = records.bed_from_rows(spark.createDataFrame([("c1 10 100 t1 0 + 20 90 0 2 20,40, 0,50, g1 cmpl incmpl 0,1, x y".split(),)], "row array<string>"))
    assert [tuple(e) for e in records.gene_pred_from_big(big).first()["exons"]] == [(10, 30, 0), (60, 100, 1)]


PSL = "59\t9\t0\t0\t1\t823\t1\t96\t+-\tFS_CONTIG\t5520\t172\t1063\tchr22\t47748585\t13073589\t13073753\t2\t48,20,\t171,1042,\t34674832,34674976,"


def test_psl(spark, tmp_path):
    header = "psLayout version 3\n\nmatch\tmis\n   \tx\n---------\n"
    df = records.psl(spark, put(tmp_path, "a.psl", header + PSL + "\n7\t" + PSL + "\n"))
    assert df.count() == 2 and df.select(sinks.psl_line().alias("v")).first()["v"] == PSL
    x = PSL.replace("2\t48,20,", "2\t4,2,") + "\tACGT,AC,\tACGA,AC,"
    df = records.psl(spark, put(tmp_path, "b.pslx", x + "\n"))
    assert df.select(sinks.psl_line(True).alias("v")).first()["v"] == x
    rc = A.reverse_complemented(df).first()
    assert rc["blocks"][1]["q_seq"] == "ACGT" and rc["blocks"][0]["t_seq"] == "GT" and rc["strand"] == "-+"


def test_sam(spark, tmp_path):
    sam = "@HD\tVN:1\n@SQ\tSN:c1\tLN:500\nr1\t16\tc1\t11\t60\t2S5M1D3M\t*\t0\t0\tACGTACGTAC\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n"
    r = records.sam(spark, put(tmp_path, "a.sam", sam)).collect()
    assert len(r) == 1 and (r[0]["strand"], r[0]["q_size"], r[0]["q_start"], r[0]["q_end"], r[0]["t_start"], r[0]["t_end"], r[0]["t_size"]) == ("-", 10, 0, 8, 10, 19, 500)


GFF = "##gff-version 3\n# c\nchr%20I\tsrc\tgene\t5\t10\t.\t-\t.\tID=g%3B1;Note=a,b\nchr%20I\t.\tCDS\t5\t10\t1.5\t.\t2\tID=c;Parent=g%3B1\n"


def test_gff3(spark, tmp_path):
    df = records.gff3(spark, put(tmp_path, "a.gff3", GFF))
    a, b = df.collect()
    assert (a["seqname"], a["start"], a["end"], a["score"], a["frame"], a["id"], a["attributes"]["Note"]) == ("chr I", 4, 10, None, None, "g;1", ["a", "b"])
    assert (b["source"], b["score"], b["strand"], b["frame"], b["parents"]) == (None, 1.5, None, 1, ["g;1"])
    assert [r["v"] for r in df.select(sinks.gff3_line().alias("v")).collect()] == [x for x in GFF.splitlines() if "\t" in x]
    with pytest.raises(ValueError, match="not a GFF3"):
        records.gff3(spark, put(tmp_path, "b.gff3", "x\n"))


AGP = "##agp-version 2.0\nchr1\t1\t100\t1\tF\tAC1.1\t11\t110\t-\nchr1\t101\t150\t2\tN\t50\tscaffold\tyes\tpaired-ends\n"


def test_agp(spark, tmp_path):
    df = records.agp(spark, put(tmp_path, "a.agp", AGP))
    a, b = df.collect()
    assert (a["kind"], a["component"], a["component_start"], a["gap_length"]) == ("block", "AC1.1", 10, None)
    assert (b["kind"], b["gap_length"], b["gap_type"], b["linkage"], b["component"]) == ("gap", 50, "scaffold", True, None)
    assert [r["v"] for r in df.select(sinks.agp_line().alias("v")).collect()] == AGP.splitlines()[1:]


def test_assembly_report(spark, tmp_path):
    body = "# Assembly name:  GRCh38 p7\n# Date: 2016-03-21\n# Sequence-Name\tx\nHSCHR1\tunlocalized-scaffold\t1\tChromosome\tKI1.1\t=\tna\tPrimary\t175055\tchr1_KI1\n1\tassembled-molecule\t1\tChromosome\tCM1.2\t=\tNC_1.11\tPrimary\t248956422\tchr1\n"
    p = put(tmp_path, "a.txt", body)
    rows = records.assembly_report(spark, p).collect()
    assert rows[0]["refseq_accn"] is None and rows[1]["sequence_length"] == 248956422
    assert {r["key"]: r["value"] for r in records.assembly_metadata(spark, p).collect()} == {"assembly_name": "GRCh38 p7", "date": "2016-03-21"}
    assert programs.assembly_convert(spark, p, "lift", str(tmp_path / "lift"), "genbank_accn", "refseq_accn") == 1
    assert got(tmp_path / "lift") == ["0\tCM1.2\t248956422\tNC_1.11\t248956422"]
    programs.assembly_to_tsv(spark, p, str(tmp_path / "tsv"), first_word=["assembly_name"])
    assert all(line.endswith("GRCh38") or line.endswith("assembly_name") for line in got(tmp_path / "tsv"))
    with pytest.raises(ValueError, match="metadata not found"):
        programs.assembly_to_tsv(spark, p, str(tmp_path / "t2"), keys=["nope"])


def test_taxonomy(spark, tmp_path):
    p = put(tmp_path, "nodes.dmp", "1\t|\t1\t|\tno rank\t|\t0\t|\n9606\t|\t9605\t|\tspecies\t|\t1\t|\n")
    rows = records.taxonomy_dump(spark, p, ["tax_id", "parent_id", "rank", "hidden_flag"]).collect()
    assert [tuple(r) for r in rows] == [(1, 1, "no rank", False), (9606, 9605, "species", True)]


def test_fasta_and_embl(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">s1|x desc here\nACGT\nAC\n>s2\nTTTT\n>s1|x again\nGG\n")
    rows = text.fasta(spark, p).collect()
    assert [tuple(r) for r in rows] == [("s1|x", "desc here", "ACGTAC"), ("s2", "", "TTTT"), ("s1|x", "again", "GG")]
    chunks = text.sequence_chunks(text.fasta(spark, p).where("name = 's1|x'").limit(1), 4).orderBy("nth").collect()
    assert [(c["nth"], c["seq"]) for c in chunks] == [(0, "ACGT"), (1, "AC")]
    ids = put(tmp_path, "ids", "s1\n")
    programs.fasta_select(spark, p, str(tmp_path / "sel"), ids)
    assert got(tmp_path / "sel") == [">s1", "ACGTAC"]
    e = put(tmp_path, "a.embl", "ID   X56734; SV 1; linear;\nDE   first\nDE   second\nSQ   Sequence 9 BP;\n     aaacaaacc  9\n//\nID   Y; SV 2;\nNM   NAME1\nDE   d\nSQ   S\n     tt tt 4\n//\n")
    programs.embl_to_fasta(spark, e, str(tmp_path / "fa"), width=4)
    assert got(tmp_path / "fa") == [">X56734.1 first second", "aaac", "aaac", "c", ">Y.2 d", "tttt"]
    programs.embl_to_fasta(spark, e, str(tmp_path / "fb"), by_name=True)
    assert got(tmp_path / "fb") == [">NAME1 d", "tttt"]


CHECK = "checkId\tacc\tchr\tchrStart\tchrEnd\tstrand\tstat\tframe\tstart\tstop\torfStop\tcdsGap\tcdsMult3Gap\tutrGap\tcdsUnknownSplice\tutrUnknownSplice\tcdsNonCanonSplice\tutrNonCanonSplice\tnmd\tcauses\n1\ta\tc\t1\t9\t+\terr\tbad\tno\tok\t2\t3\t1\t0\t0\t0\t0\t0\tok\torfStop,frame\n2\tb\tc\t1\t9\t+\tok\tok\tok\tok\t0\t0\t0\t0\t0\t0\t0\t0\tnmd\t\n"


def test_gene_check_program(spark, tmp_path):
    p = put(tmp_path, "c.tsv", CHECK)
    rows = records.gene_check(spark, p).collect()
    assert rows[0]["stat"] is False and rows[0]["causes"] == ["orfStop", "frame"] and rows[1]["causes"] == [] and rows[1]["nmd"] is False
    programs.gene_check_stats(spark, p, str(tmp_path / "o"))
    out = got(tmp_path / "o")
    assert out[:2] == ["probCat\tgene\trate\tnumProbs", "total\t2\t1.0\t2"] and "cdsGap\t1\t0.500\t2" in out and "start\t1\t0.500\t1" in out and "noCDS\t0\t0.000\t0" in out
    details = text.read_tsv(spark, put(tmp_path, "d.tsv", "checkId\tproblem\n1\tx\n1\ty\n"), {"checkId": "int"})
    assert {r["checkId"]: len(r["details"] or []) for r in records.with_details(records.gene_check(spark, p), details).collect()} == {1: 2, 2: 0}


LOCI = "#cluster\ttable\tgene\tchrom\ttxStart\ttxEnd\tstrand\trnaLength\tcdsLength\thasExonConflicts\thasCdsConflicts\texonConflicts\tcdsConflicts\n1\tA\tg1\tc\t5\t9\t+\t4\t0\tn\ty\t\t1,2,\n1\tB\tg2\tc\t7\t19\t+\t4\t0\tn\tn\t\t\n2\tB\tg3\tc\t30\t40\t-\t4\t0\ty\tn\t\t\n"


def test_cluster_programs(spark, tmp_path):
    p = put(tmp_path, "l", LOCI)
    programs.cluster_stats(spark, p, str(tmp_path / "s"), total=True, totals=str(tmp_path / "t"), gene_subsets=str(tmp_path / "g"), categories=put(tmp_path, "cats", "2\tbig\n"))
    assert got(tmp_path / "s") == ["subset\tloci\ttrans\tfracLoci\tfracTrans", "A\t0\t0\t0.000\t0.000", "B\t0\t0\t0.000\t0.000", "big+B\t1\t1\t0.500\t0.333", "A B\t1\t2\t0.500\t0.667", "A big+B\t0\t0\t0.000\t0.000", "B big+B\t0\t0\t0.000\t0.000", "A B big+B\t0\t0\t0.000\t0.000", "TOTAL\t2\t3\t1.000\t1.000"]
    programs.cluster_select(spark, p, str(tmp_path / "b"), bed=True, only=[["A", "B"]])
    assert got(tmp_path / "b") == ["c\t5\t19\t1\t0\t+"]


def test_bed_programs(spark, tmp_path):
    p = put(tmp_path, "a.bed", "c\t10\t100\ta\t0\t+\t15\t95\t0\t2\t10,20,\t0,70,\nc\t50\t120\tb\t0\t+\t120\t120\t0\t1\t70,\t0,\nc\t120\t130\td\t0\t-\n")
    programs.bed_flatten(spark, p, str(tmp_path / "f"), prefix="L")
    assert got(tmp_path / "f") == ["c\t10\t120\tL1\t0\t+\t120\t120\t0\t2\t10,70,\t0,40,", "c\t120\t130\tL2\t0\t-\t130\t130\t0\t1\t10,\t0,"]
    programs.bed_to_cds(spark, p, str(tmp_path / "c"))
    assert got(tmp_path / "c") == ["c\t15\t95\ta\t0\t+\t15\t95\t0\t2\t5,15,\t0,65,"]
    programs.bed_to_introns(spark, p, str(tmp_path / "i"), unique_name=True)
    assert got(tmp_path / "i") == ["c\t20\t80\ta_0\t0\t+\t80\t80\t0\t1\t60,\t0,"]


def test_splice_program(spark, tmp_path):
    seq = "A" * 20 + "GT" + "C" * 36 + "AG" + "A" * 20
    fa = put(tmp_path, "g.fa", f">c\n{seq}\n")
    bed = put(tmp_path, "b.bed", "c\t0\t80\tt\t0\t+\t0\t0\t0\t2\t20,20,\t0,60,\nc\t0\t80\tu\t0\t-\t0\t0\t0\t2\t20,20,\t0,60,\n")
    programs.splice_check(spark, fa, bed, str(tmp_path / "s"), str(tmp_path / "n"), chunk=7)
    assert got(tmp_path / "s") == ["category\tnum_introns", "STD\t1", "RARE\t0", "U12\t0", "STD_RC\t1", "GAP\t0", "UNKNOWN\t0"] or got(tmp_path / "s")[1] == "STD\t2"


GBK = """LOCUS       NC_1
VERSION     NC_1.1
FEATURES             Location/Qualifiers
     source          1..500
     gene            complement(11..200)
                     /gene="G1"
                     /db_xref="GeneID:7"
     mRNA            complement(join(11..50,
                     101..200))
                     /gene="G1"
                     /transcript_id="NM_1.1"
                     /db_xref="GeneID:7"
     CDS             complement(join(31..50,101..150))
                     /gene="G1"
                     /protein_id="NP_1.1"
                     /db_xref="GeneID:7"
     gene            300..400
                     /gene="G2"
     ncRNA           300..400
                     /gene="G2"
                     /transcript_id="NR_2.1"
ORIGIN
        1 acgt
//
"""


def test_genbank(spark, tmp_path):
    rows = {r["name"]: r for r in genbank.genbank_genes(spark, put(tmp_path, "a.gb", GBK + GBK.replace("NC_1", "NC_2"))).collect() if r["chrom"] == "NC_1.1"}
    a, b = rows["NM_1.1"], rows["NR_2.1"]
    assert (a["strand"], a["tx_start"], a["tx_end"], a["cds_start"], a["cds_end"], a["source"], a["gene_id"]) == ("-", 10, 200, 30, 150, "mRNA+CDS", "7")
    assert [tuple(e) for e in a["exons"]] == [(10, 50), (100, 200)] and (b["source"], b["cds_start"], b["cds_end"]) == ("RNA", 400, 400)
    programs.genbank_to_gene_pred(spark, str(tmp_path / "a.gb"), str(tmp_path / "o"), sources=["RNA"])
    assert got(tmp_path / "o")[0].startswith("NR_2.1\tNC_1.1\t+\t299\t400\t400\t400\t1\t299,\t400,\t0\tG2")


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([("<a>", None), ("b", "")], "x string, y string")
    page = sinks.html_table(df, caption="c")
    assert "<td>&lt;a&gt;</td><td>&nbsp;</td>" in page and page.startswith("<table>\n<caption>c</caption>")
    used = set()
    assert [sinks.sheet_name(n, used) for n in ("a/b", "a:b", "x" * 40)] == ["a_b", "a_b_2", "x" * 31]
    assert sinks.track_text({"track": "t", "type": "bed", "subtracks": [{"track": "u"}]}) == "track t\ntype bed\n\n    parent t\n    track u"
    programs.utf8_to_ascii(spark, put(tmp_path, "u", "é–x\n"), str(tmp_path / "u2"))
    assert got(tmp_path / "u2") == ["e-x"]
    programs.json_structure(spark, put(tmp_path, "j", '{"a": [{"b": 1}, {"b": "x"}], "c": null}'), str(tmp_path / "j2"))
    assert got(tmp_path / "j2")[0].startswith("a[].b\t")
    cfg = put(tmp_path, "hg.conf", "# c\ndb.host = x\n\n")
    assert text.config(cfg) == {"db.host": "x"}
    assert text.file_md5(spark, cfg).first()["md5"] == __import__("hashlib").md5(b"# c\ndb.host = x\n\n").hexdigest()


def test_binned_table_and_jobs(spark, tmp_path):
    p = put(tmp_path, "a.psl", PSL + "\n")
    programs.psl_load(spark, p, "loaded_psl")
    assert spark.table("loaded_psl").first()["bin"] == 585 + (13073589 >> 17) or spark.table("loaded_psl").first()["bin"] > 0
    runs = put(tmp_path, "r.csv", 'Run,Experiment\n"R1, R2",E\n')
    programs.sra_jobs(spark, runs, spark.createDataFrame([("R1",)], "run string"), "align {run}", str(tmp_path / "jobs"))
    assert got(tmp_path / "jobs") == ["align R2"]
    v = put(tmp_path, "v.tsv", "A\tB\tCounts\n1\t0\t5\n1\t1\t2\n0\t0\t9\n")
    programs.venn_counts(spark, v, ["A", "B"], str(tmp_path / "v2"))
    assert set(got(tmp_path / "v2")) == {"A B\t2", "A\t5", "subset\tcount"}
    cds = put(tmp_path, "cds", "FS_CONTIG\t3..9\n")
    assert records.load_psl(spark, p, cds).first()["cds_start"] == 2
    assert G.check_unique(records.psl(spark, p), "q_name").count() == 0


def test_stream(spark, tmp_path):
    from helixframe.streaming.intervals import stream_islands, stream_overlap_join

    schema = "chrom string, start long, end long"
    spark.createDataFrame([("c", 1, 5), ("c", 4, 9), ("d", 1, 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([("c", 3, 4)], schema)
    q = stream_overlap_join(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[:3] for r in spark.table("hits").collect()] == [("c", 1, 5)]
    q = stream_islands(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("isl").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("isl").collect()) == [("c", 1, 9, 2), ("d", 1, 2, 1)]


def test_range_table(spark):
    from helixframe.sources.tables import RangeTable, numeric_order, run, tables_like

    t = RangeTable(spark, "genes_by_range")
    rows = spark.createDataFrame([("c1", 5, 9, "a", "+"), ("c1", 400_000, 900_000, "b", "-"), ("c2", 1, 3, "c", "+"), ("c1", 7, 8, "d", "-")], "chrom string, start long, end long, name string, strand string")
    assert not t.exists()
    t.load(rows)
    assert t.exists() and "genes_by_range" in tables_like(spark, "genes*") and t.oid_range() == (0, 4)
    assert {r["name"] for r in t.overlapping("c1", 6, 10).collect()} == {"a", "d"} and {r["name"] for r in t.overlapping("c1", strand="-").collect()} == {"b", "d"}
    assert {r["name"] for r in t.overlapping("c1", 0, 10**6, where=F.col("start") > 6).collect()} == {"b", "d"}
    assert t.by_name("a", "zz").count() == 1 and t.names().count() == 4 and t.by_oid(1, 3).count() == 2
    with pytest.raises(Exception, match="name not found"):
        t.required(spark.createDataFrame([("zz",)], "n string")).collect()
    t.load(rows.where("name = 'a'"), mode="append")
    assert t.oid_range() == (0, 5) and t.rows().select("oid").distinct().count() == 5
    assert run(spark, "SELECT count(*) AS n FROM genes_by_range WHERE name = :who", who="a").first()["n"] == 2
    t.drop()
    assert not t.exists()
    d = spark.createDataFrame([("10",), ("9",), (" ",), ("1,000",)], "v string")
    assert [r["v"] for r in d.orderBy(*numeric_order(d, "v")).collect()] == [" ", "9", "10", "1,000"]
    x = spark.createDataFrame([("10",), ("9",), ("a",)], "v string")
    assert [r["v"] for r in x.orderBy(*numeric_order(x, "v")).collect()] == ["10", "9", "a"]


def test_value_files_and_cells(spark, tmp_path):
    p = put(tmp_path, "h", "5\t2\n#x\n7\t1\n")
    assert [tuple(r) for r in records.values_file(spark, p, count_column=1).collect()] == [(5, 2), (7, 1)]
    s = put(tmp_path, "s", "#inId\tselectId\tinOverlap\toverBases\na\tb\t0.5\t7\n")
    assert tuple(records.overlap_select_stats(spark, s).first()) == ("a", "b", 0.5, 7)
    c = spark.createDataFrame([("<b>1,000</b>",), ("",)], "v string").select(sinks.cell_fields(F.col("v")).alias("c")).collect()
    assert (c[0]["c"]["text"], c[0]["c"]["number"], c[1]["c"]["display"], c[1]["c"]["number"]) == ("1,000", 1000.0, "&nbsp;", None)
    assert sinks.page_links(0, 2) == 'prev 1 <a href="dir1.html">2</a> <a href="dir1.html">next</a>'


def test_two_bit_ranges_equal_slices(spark):
    import random

    from helixframe.sources import binary

    rng = random.Random(3)
    seqs = [(f"s{k}", "".join(rng.choice("ACGTNacgtn") * rng.choice((1, 1, 7)) for _ in range(rng.randrange(0, 40)))) for k in range(20)] + [("empty", "")]
    data = binary.two_bit_bytes(seqs)
    index = binary.two_bit_index(data)
    for name, seq in seqs:
        assert binary.two_bit_size(data, index[name]) == len(seq) and binary.two_bit_bases(data, index[name]) == seq
        for _ in range(20):
            a, b = rng.randrange(-3, 60), rng.randrange(-3, 60)
            assert binary.two_bit_bases(data, index[name], a, b) == seq[max(0, a) : max(0, b)], (name, a, b)


def test_big_bed_index_finds_every_overlap(spark):
    import random

    from helixframe.sources import binary

    rng = random.Random(4)
    entries = sorted((rng.choice(("chr1", "chr10", "chrX")), s, s + rng.randrange(1, 300), f"n{k}\t{k}") for k in range(20_000) for s in [rng.randrange(100_000)])
    data = binary.big_bed_bytes(entries, {"chr1": 200_000, "chr10": 200_000, "chrX": 200_000, "chrY": 5}, per_block=16)
    assert list(binary.big_bed_entries(data)) == entries and list(binary.big_bed_entries(data, "chrY")) == list(binary.big_bed_entries(data, "none")) == []
    for _ in range(50):
        c, a = rng.choice(("chr1", "chrX")), rng.randrange(100_000)
        b = a + rng.randrange(1, 5000)
        assert list(binary.big_bed_entries(data, c, a, b)) == [e for e in entries if e[0] == c and e[1] < b and e[2] > a]
    with pytest.raises(ValueError):
        list(binary.big_bed_entries(b"something else entirely" * 10))
    assert binary._names(binary.big_bed_bytes([], {"a": 3}), "<") == [("a", 0, 3)]


def test_frameshifts_and_gene_types():
    assert genbank.with_frameshifts([(0, 100), (200, 300)], [(20, 50), (52, 100), (200, 230), (231, 260)]) == [(0, 50), (52, 100), (200, 230), (231, 300)]
    assert genbank.with_frameshifts([(0, 100)], [(10, 40), (39, 90)]) == [(0, 100)]
    assert genbank.is_refseq("NM_000546.6") and genbank.is_refseq("XR_12") and not genbank.is_refseq("ENST1") and not genbank.is_refseq(None)


def test_packed_files_are_bounded(spark):
    """Files of at most so many rows each, which hold every entry once; none of no rows."""
    from helixframe.sources import binary

    rows = [(f"chr{k % 3}", k * 7 % 1000, k * 7 % 1000 + 5, f"n{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, rest string").repartition(7)
    files = binary.packed(df, lambda entries: binary.big_bed_bytes(entries, {e[0]: 2000 for e in entries}, 4), 64)
    sizes = [len(list(binary.big_bed_entries(r["content"]))) for r in files.collect()]
    assert max(sizes) <= 64 and min(sizes) > 0 and sum(sizes) == 1000
    assert sorted(tuple(r)[:4] for r in binary.big_bed(files).collect()) == sorted(rows)
    assert {tuple(r) for r in binary.big_bed_sizes(files).collect()} == {(f"chr{k}", 2000) for k in range(3)}
    assert binary.packed(df.limit(0), lambda entries: b"", 64).count() == 0
