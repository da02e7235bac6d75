"""Quality rules with cross-document line frequency, in DataFrame operations only (operator 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

_BLANKS = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"
#: The words of a text; `trimmed` has no white space at its ends.
_WORDS = r"IF(trimmed = '', array(), split(trimmed, r'[ \t\n\x0B\f\r]+'))"
_WINDOWS = "transform(sequence(1, size(hashes) - 7), i -> xxhash64(slice(hashes, i, 8)))"
#: Words in 8-word windows that occur twice or more: sort windows with their places, keep those equal to a neighbour,
#: and add up what each covers beyond the one before. Arrays are bound to lambda variables, so each is made once.
_REPEATED = f"""IF(size(words) < 9, 0L, transform(array(transform(words, w -> xxhash64(w))), hashes ->
  transform(array({_WINDOWS}), windows ->
    IF(size(array_distinct(windows)) = size(windows), 0L,
      transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), s ->
        aggregate(
          array_sort(transform(filter(s, (e, j) -> e.h <=> get(s, j - 1).h OR e.h <=> get(s, j + 1).h), e -> e.i)),
          struct(0L AS total, -8 AS last),
          (acc, p) -> struct(acc.total + least(8, p - acc.last) AS total, p AS last)).total)[0]))[0])[0])"""
#: The normal form of a line: lower case, digits as one sign, runs of blanks as one.
_NORMAL_LINE = r"trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0'), r'[ \t\x0B\f\r]+', ' '))"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, host, text with a key of each distinct row; a null text is empty, a null host one of its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text")).withColumn("row_key", F.xxhash64("doc_id", "host", "text_key", F.col("doc_id").isNull(), F.col("host").isNull()))


#: The lines of a text that hold a word, as (hash of the normal form, words).
_LINES = f"""transform(filter(split(text, '\\n', -1), line -> btrim(line, {_BLANKS}) != ''),
  line -> struct(xxhash64({_NORMAL_LINE}) AS line, CAST(size(split(btrim(line, {_BLANKS}), r'[ \\t\\x0B\\f\\r]+')) AS long) AS n))"""


def text_statistics(rows: DataFrame) -> DataFrame:
    """row_key, text_key, doc_id, host, the counts of every whole text, and its lines: all that a text is read for."""
    bound = rows.selectExpr("row_key", "text_key", "doc_id", "host", "text", f"btrim(text, {_BLANKS}) AS trimmed").selectExpr("*", f"{_WORDS} AS words")
    return bound.selectExpr(
        "row_key", "text_key", "doc_id", "host",
        "CAST(size(words) AS long) AS n_words",
        "aggregate(words, 0L, (n, w) -> n + length(w)) AS word_chars",
        "CAST(size(split(text, '[#*$%&|<>]', -1)) - 1 AS long) AS n_symbols",
        f"transform(array(filter(split(text, '\\n', -1), l -> btrim(l, {_BLANKS}) != '')), x -> CAST(size(x) - size(array_distinct(x)) AS long))[0] AS n_dup_lines",
        f"CAST({_REPEATED} AS long) AS n_repeat_words",
        f"{_LINES} AS lines",
    )


def document_lines(texts: DataFrame) -> DataFrame:
    """row_key, text_key, host, line (hash of the normal form) and n, its words, for every line with a word, from text_statistics."""
    return texts.select("row_key", "text_key", "host", F.inline("lines"))


def frequent_lines(lines: DataFrame, texts: DataFrame, most_documents: int, most_percent: int) -> DataFrame:
    """(host, line) in more than most_documents distinct texts of its host and in more than most_percent of them.

    Texts are counted once for each line, then lines per host; both sums are made in part before they are shuffled.
    """
    per_line = lines.groupBy("host", "line", "text_key").agg(F.lit(1)).groupBy("host", "line").agg(F.count("*").alias("n_documents"))
    per_host = texts.groupBy("host", "text_key").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("n_host"))
    often = per_line.where(F.col("n_documents") > most_documents).alias("l").join(per_host.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    return often.where(F.col("n_documents") * 100 > F.col("n_host") * most_percent).select(F.col("l.host").alias("host"), "line", "n_documents")


def quality(docs: DataFrame, most_documents: int = 20, most_percent: int = 5, least_left_percent: int = 50) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept.

    A line (in lower case, numbers and blanks made alike) that stands in more than most_documents distinct texts of its host
    (`source`), and in more than most_percent of them, is removed. A document is depleted, and not kept, if less than
    least_left_percent of its words remain, or if base_failed (under 20 words, or over 30 % of words in repeated 8-word
    windows). Copies of a text count once per host, so that copying alone removes no line. Null and empty texts have no
    words and fail. Null hosts are one host. Rows of equal doc_id are judged each by its own text; equal rows get equal results.
    """
    texts = written(text_statistics(_keyed(docs)), "texts")  # the one pass over the documents
    lines = document_lines(texts)
    often = frequent_lines(lines, texts.select("host", "text_key"), most_documents, most_percent)
    hit = lines.alias("l").join(often.alias("o"), (F.col("l.line") == F.col("o.line")) & F.col("l.host").eqNullSafe(F.col("o.host")))
    # equal rows share a row_key: each line's words count as often as in one of them
    removed = hit.groupBy("l.row_key").agg(F.sum("n").alias("n_all"), F.count("*").alias("n_lines"))
    copies = texts.groupBy("row_key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    removed = removed.join(copies, "row_key", "left").select("row_key", F.expr("n_all DIV coalesce(n_rows, 1L)").alias("n_removed_words"))
    out = texts.drop("lines").join(removed, "row_key", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    kept = F.expr(f"NOT base_failed AND 100 * (n_words - n_removed_words) >= {least_left_percent} * n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", kept.alias("kept"))


def without_frequent_lines(docs: DataFrame, most_documents: int = 20, most_percent: int = 5) -> DataFrame:
    """row_key, doc_id and text of every document, its lines above the limits taken out, the others in their order."""
    rows = _keyed(docs)
    often = frequent_lines(document_lines(rows.selectExpr("row_key", "text_key", "host", f"{_LINES} AS lines")), rows.select("host", "text_key"), most_documents, most_percent)
    lines = rows.select("row_key", "host", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("hash", F.expr(f"xxhash64({_NORMAL_LINE})"))
    hit = lines.alias("l").join(often.alias("o"), (F.col("l.hash") == F.col("o.line")) & F.col("l.host").eqNullSafe(F.col("o.host")))
    gone = hit.groupBy("row_key").agg(F.collect_set("at").alias("gone"))
    left = F.expr("array_join(filter(split(text, '\\n', -1), (l, i) -> NOT array_contains(gone, i)), '\\n')")
    return rows.join(gone, "row_key", "left").select("row_key", "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM d),
w AS (SELECT *, CASE WHEN trimmed = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(trimmed, '[ \t\n\x0B\f\r]+') END AS words,
  list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS lines FROM t),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, sum(least(8, i - p)) AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS p FROM dup) GROUP BY rid),
l AS (SELECT rid, host, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[ \t\x0B\f\r]+', ' ', 'g')) AS line,
  len(regexp_split_to_array(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \t\x0B\f\r]+')) AS n FROM (SELECT rid, host, text, unnest(lines) AS line FROM w)),
often AS (SELECT host, line FROM l GROUP BY host, line HAVING count(DISTINCT text) > 20
  AND count(DISTINCT text) * 100 > 5 * (SELECT count(DISTINCT text) FROM d WHERE d.host IS NOT DISTINCT FROM l.host)),
gone AS (SELECT rid, sum(n) AS n FROM l JOIN often o ON l.line = o.line AND l.host IS NOT DISTINCT FROM o.host GROUP BY rid),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_removed_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_removed_words) >= 50 * n_words AS kept FROM s
"""
