"""Writers: record columns to text columns, and tables to TSV, FASTA, HTML, XLSX, track text and bulk tables."""

from __future__ import annotations

import html as _html
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codecs import format_attributes, join_list
from ..functions.bins import calc_bin
from ..functions.strings import encode_column, strip_tags, to_number


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def tab_line(*values: Column) -> Column:
    """Values as one tab-separated line, null as nothing."""
    return F.concat_ws("\t", *(_text(v) for v in values))


def write_lines(line: DataFrame, path: str) -> None:
    """A one-column table of lines as text files; the committer installs them all or none."""
    line.write.text(path)


def write_tsv(df: DataFrame, path: str, formats: Mapping[str, Column] | None = None, header: bool = True, separator: str = "\t") -> None:
    """A table as TSV: columns through their formats if given, arrays as comma lists, null as nothing."""
    kinds = dict(df.dtypes)
    out = [((formats or {}).get(c) if c in (formats or {}) else join_list(c) if kinds[c].startswith("array") else F.col(c).cast("string")).alias(c) for c in df.columns]
    df.select(*out).write.option("sep", separator).option("header", header).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def bed_line(n_columns: int = 12) -> Column:
    """A BED line with defaults: name chrom:start-end, score 0, strand +, thick range empty at the end, colour 0, one block."""
    start, end = F.col("chrom_start"), F.col("chrom_end")
    blocks = F.coalesce("blocks", F.array(F.struct(start.alias("start"), end.alias("end"))))
    values = [
        F.col("chrom"), start, end, F.coalesce("name", F.concat("chrom", F.lit(":"), start, F.lit("-"), end)), F.coalesce(F.col("score").cast("string"), F.lit("0")), F.coalesce("strand", F.lit("+")),
        F.coalesce("thick_start", end), F.coalesce("thick_end", end), F.coalesce("item_rgb", F.lit("0")), F.size(blocks),
        join_list(F.transform(blocks, lambda b: b["end"] - b["start"])), join_list(F.transform(blocks, lambda b: b["start"] - start)),
    ]
    return tab_line(*values[:n_columns])


def bed_line_extra(n_columns: int = 12) -> Column:
    return F.concat_ws("\t", bed_line(n_columns), "extra_cols")


def decoration_line(item: Column, style: Column, fill: Column, glyph: Column) -> Column:
    """A decorator row: BED12, then decorated item, style, fill colour and glyph."""
    return F.concat_ws("\t", bed_line(12), item, style, fill, glyph)


def gene_pred_line(extended: bool = False) -> Column:
    """A genePred line of 10 columns, or 15."""
    values = [F.col(c) for c in ("name", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end")] + [F.size("exons"), join_list(F.transform("exons", lambda e: e["start"])), join_list(F.transform("exons", lambda e: e["end"]))]
    if extended:
        values += [F.coalesce("score", F.lit(0)), F.coalesce("name2", F.lit("")), F.coalesce("cds_start_stat", F.lit("none")), F.coalesce("cds_end_stat", F.lit("none")), join_list(F.transform("exons", lambda e: F.coalesce(e["frame"], F.lit(-1))))]
    return tab_line(*values)


def _fields(items: str, name: str) -> Column:
    """One field of each struct of an array."""
    return F.transform(items, lambda x: x[name])


def psl_line(sequences: bool = False) -> Column:
    """A PSL line of 21 columns, or 23 with block sequences."""
    numbers = ("match", "mis_match", "rep_match", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert", "strand", "q_name", "q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end")
    lists = ("size", "q_start", "t_start", *(("q_seq", "t_seq") if sequences else ()))
    return tab_line(*(F.col(c) for c in numbers), F.size("blocks"), *(join_list(_fields("blocks", n)) for n in lists))


def gff3_line() -> Column:
    """A GFF3 line: 1-based, null as `.`, texts and attributes escaped."""
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    phase = F.when(F.col("frame") == 0, "0").when(F.col("frame") == 1, "2").when(F.col("frame") == 2, "1").otherwise(".")
    return F.concat_ws("\t", encode_column("seqname"), dot(encode_column("source")), encode_column("type"), F.col("start") + 1, "end", dot(F.col("score")), dot(F.col("strand")), phase, format_attributes("attributes"))


def agp_line(one_based: bool = True) -> Column:
    n = int(one_based)
    block = F.concat_ws("\t", "component", F.col("component_start") + n, "component_end", "strand")
    gap = F.concat_ws("\t", "gap_length", "gap_type", F.when(F.col("linkage"), "yes").otherwise("no"), "linkage_evidence")
    return F.concat_ws("\t", "object", F.col("object_start") + n, "object_end", "part", "component_type", F.when(F.col("kind") == "gap", gap).otherwise(block))


def assembly_line(columns: Sequence[str]) -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("na")) for c in columns))


def fasta_record(name: Column, seq: Column, width: int | None = None) -> Column:
    """`>name` and the sequence, wrapped at width if given, without the last line end."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq
    return F.concat(F.lit(">"), name, F.lit("\n"), body)


def html_table(df: DataFrame, header: bool = True, caption: str | None = None, most: int = 10_000) -> str:
    """An HTML table, built on the driver; empty cells become a hard blank. More than `most` rows are an error: page them first."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for one HTML table")
    cell = lambda v: "&nbsp;" if v in (None, "") else _html.escape(str(v))
    rows = [f"<tr>{''.join(f'<td>{cell(v)}</td>' for v in r)}</tr>" for r in found]
    top = [f"<caption>{_html.escape(caption)}</caption>"] * bool(caption) + ["<tr>" + "".join(f"<th>{cell(c)}</th>" for c in df.columns) + "</tr>"] * header
    return "\n".join(["<table>", *top, *rows, "</table>"])


def cell_fields(cell: Column) -> Column:
    """What an interactive table needs of an HTML cell: struct<display,text,number>, the text without tags and its number."""
    text = strip_tags(cell)
    return F.struct(F.coalesce(F.nullif(cell, F.lit("")), F.lit("&nbsp;")).alias("display"), text.alias("text"), to_number(text).alias("number"))


def page_links(page: int, n_pages: int, name: str = "dir{}.html") -> str:
    """Links from one page of a directory to the others, the page itself as plain text."""
    link = lambda k, text: f'<a href="{name.format(k)}">{text}</a>' if 0 <= k < n_pages and k != page else str(text)
    return " ".join([link(page - 1, "prev"), *(link(k, k + 1) for k in range(n_pages)), link(page + 1, "next")])


def pages(df: DataFrame, order: Sequence[Column], size: int, group: str) -> DataFrame:
    """df with page (from 0) and place on the page, in the order of (group, *order)."""
    from ..operators.intervals import number_in_order

    numbered = number_in_order(df, group, list(order), "__n", first=0)
    return numbered.withColumn("page", F.floor(F.col("__n") / size)).withColumn("place", F.col("__n") % size).drop("__n")


def sheet_name(name: str, used: set[str]) -> str:
    """A workbook sheet name: forbidden signs to _, 31 characters at most, made unique by a number."""
    plain = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or "sheet"
    out, k = plain, 1
    while out.lower() in used:
        k += 1
        out = f"{plain[: 31 - len(str(k)) - 1]}_{k}"
    used.add(out.lower())
    return out


def write_xlsx(tables: Mapping[str, DataFrame], path: str, numbers: bool = True, most: int = 1_000_000) -> None:
    """Tables as sheets of one workbook, written by the driver; needs openpyxl. More than `most` rows, which a sheet can't hold, are an error."""
    import openpyxl

    book, used = openpyxl.Workbook(write_only=True), set()
    for name, df in tables.items():
        sheet = book.create_sheet(sheet_name(name, used))
        sheet.append(list(df.columns))
        for k, r in enumerate(df.toLocalIterator()):
            if k == most:
                raise ValueError(f"{name}: more than {most} rows for one sheet")
            sheet.append([_number(v) if numbers and isinstance(v, str) else v for v in r])
    book.save(path)


def _number(v: str):
    try:
        return int(v)
    except ValueError:
        try:
            return float(v)
        except ValueError:
            return v


#: Settings that tracks of a kind have unless they are given.
TRACK_DEFAULTS: dict[str, dict] = {
    "plain": {},
    "data": {"visibility": "hide"},
    "psl": {"visibility": "hide", "searchIndex": "name", "baseColorUseSequence": "lfExtra", "indelDoubleInsert": "on", "indelQueryInsert": "on", "showDiffBasesAllScales": ".", "showDiffBasesMaxZoom": 10000, "type": "bigPsl"},
    "super": {"superTrack": "on hide"},
    "composite": {"compositeTrack": "on", "visibility": "hide"},
}


def track(kind: str, name: str, short_label: str, long_label: str | None = None, subtracks: Sequence[Mapping] = (), **settings) -> dict:
    """A track of a kind of TRACK_DEFAULTS with its settings, those of None left out; subtracks name it as their parent, unless they name one."""
    named = {"track": name, "shortLabel": short_label, "longLabel": long_label or short_label}
    own = {k: v for k, v in {**TRACK_DEFAULTS[kind], **settings}.items() if v is not None}
    children = [child if "parent" in child else {**{k: v for k, v in child.items() if k != "subtracks"}, "parent": name, "subtracks": child.get("subtracks", [])} for child in subtracks]
    return {**named, **own, "subtracks": children}


def track_stanzas(settings: Mapping, level: int = 0) -> list[str]:
    """The stanza of a track and those of its subtracks, indented by level."""
    pad = "    " * level
    own = "\n".join(f"{pad}{k} {v}" for k, v in settings.items() if k != "subtracks" and v is not None)
    return [own, *(s for child in settings.get("subtracks", ()) for s in track_stanzas(child, level + 1))]


def track_text(settings: Mapping, level: int = 0) -> str:
    """Nested track settings as stanzas with a blank line between; children without a parent get theirs."""
    children = [child if "parent" in child else {"parent": settings["track"], **child} for child in settings.get("subtracks", ())]
    return "\n\n".join(track_stanzas({**settings, "subtracks": children}, level))


def track_db(tracks: Sequence[Mapping]) -> str:
    """A track file: every stanza and a blank line."""
    return "".join(s + "\n\n" for t in tracks for s in track_stanzas(t))


def directory_pages(rows: DataFrame, order: Sequence[Column], size: int, group: str, title: str, name: str = "dir{}.html", below: bool = False) -> DataFrame:
    """page, file and html of a static directory: rows (all columns but group, as cells of HTML) on pages of `size`, with links between them.

    Cells are taken as they are; a page is one row, made by the task that has it.
    """
    cells = [c for c in rows.columns if c != group]
    placed = pages(rows, order, size, group)
    line = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("&nbsp;"))) for c in cells), F.lit("</tr>"))
    made = placed.select("page", "place", line.alias("line")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))  # `size` rows a page
    n = made.count()
    link = lambda to, label, there: F.when(there, F.concat(F.lit('<a href="'), F.replace(F.lit(name), F.lit("{}"), to.cast("string")), F.lit('">'), label, F.lit("</a>"))).otherwise(label)
    at = F.col("page")
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda k: link(k, (k + 1).cast("string"), k != at)), " ")
    links = F.concat_ws(" ", link(at - 1, F.lit("prev"), at > 0), numbers, link(at + 1, F.lit("next"), at < n - 1))
    head = F.concat(F.lit("<table>\n<tr>"), *(F.lit(f"<th>{_html.escape(c)}</th>") for c in cells), F.lit("</tr>"))
    parts = [F.lit(f"<h1>{_html.escape(title)}</h1>"), links, head, F.col("body"), F.lit("</table>"), *([links] if below else [])]
    return made.select("page", F.replace(F.lit(name), F.lit("{}"), at.cast("string")).alias("file"), F.concat_ws("\n", *parts).alias("html"))


def column_specs(df: DataFrame) -> DataFrame:
    """nth, title and filter of an interactive table's columns: range if every cell that isn't blank is a number, else text."""
    kinds = df.agg(*(F.bool_and(F.coalesce(F.trim(strip_tags(F.col(f"`{c}`"))), F.lit("")).isin("", "\u00a0") | to_number(strip_tags(F.col(f"`{c}`"))).isNotNull()).alias(f"c{k}") for k, c in enumerate(df.columns)))
    return kinds.select(F.inline(F.array(*(F.struct(F.lit(k).alias("nth"), F.lit(c).alias("title"), F.when(F.col(f"c{k}"), "range").otherwise("text").alias("filter")) for k, c in enumerate(df.columns)))))


def save_binned(df: DataFrame, table: str, seq: str, start: str, end: str, mode: str = "overwrite") -> None:
    """A range table with its bin, sorted by (sequence, bin) within files: their statistics take the place of an index."""
    out = df.withColumn("bin", calc_bin(start, end))
    out.repartitionByRange(seq, "bin", start).sortWithinPartitions(seq, "bin", start).write.mode(mode).saveAsTable(table)
