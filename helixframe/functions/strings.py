"""DNA, CIGAR and text functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from ..types import CIGAR
from .util import ColumnOrName, col

#: IUPAC codes with their complements; anything else stays as it is.
_CODES, _COMPLEMENTS = "ATCGURYKMBDHVatcgurykmbdhv", "TAGCAYRMKVHDBtagcayrmkvhdb"
#: CIGAR operations by what they do.
CIGAR_KINDS = {
    "aligned": "M=X", "t_insert": "DN", "t_delete": "I", "q_insert": "I", "q_delete": "DN", "intron": "N", "match": "=", "mismatch": "X",
    "soft_clip": "S", "hard_clip": "H", "consumes_query": "MIS=X", "consumes_query_hard": "MISH=X", "consumes_target": "MDN=X",
}
_OPS = "MIDNSHP=X"


def complement(dna: ColumnOrName) -> Column:
    return F.translate(col(dna), _CODES, _COMPLEMENTS)


def reverse_complement(dna: ColumnOrName) -> Column:
    """Case is kept; unknown characters stay."""
    return F.reverse(complement(dna))


def is_valid_base(base: ColumnOrName) -> Column:
    """One of the IUPAC codes that the complement knows."""
    return col(base).rlike("^[ATCGRYKMBDHVatcgrykmbdhv]$")


def drop_unique_suffix(name: ColumnOrName) -> Column:
    """`name-N` or `name-N.M` without what made it unique."""
    return F.regexp_replace(col(name), r"-[0-9]+(\.[0-9]+)*$", "")


def parse_cigar(text: ColumnOrName) -> Column:
    """Runs array<struct<op,count>>: spaces are dropped, letters upper-cased, a missing count is 1; other text is an error."""
    s = F.upper(F.replace(col(text), F.lit(" "), F.lit("")))
    run = rf"([0-9]*)([{_OPS}])"
    parts = F.regexp_extract_all(s, F.lit(run), F.lit(0))
    runs = F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.coalesce(F.substring(p, F.lit(1), F.length(p) - 1).try_cast("int"), F.lit(1)).alias("count")))
    return F.when(s.rlike(rf"^(?:[0-9]*[{_OPS}])*$"), runs.cast(CIGAR)).when(s.isNull(), F.lit(None).cast(CIGAR)).otherwise(F.raise_error(F.concat(F.lit("invalid CIGAR: "), col(text))).cast(CIGAR))


def format_cigar(runs: ColumnOrName, ones: bool = False) -> Column:
    """The text of runs; counts of 1 are left out unless asked for."""
    count = lambda r: r["count"].cast("string") if ones else F.when(r["count"] == 1, "").otherwise(r["count"].cast("string"))
    return F.array_join(F.transform(col(runs), lambda r: F.concat(count(r), r["op"])), "")


def cigar_is(run: Column, kind: str) -> Column:
    """Whether a run is of a kind of CIGAR_KINDS."""
    return run["op"].isin(*CIGAR_KINDS[kind])


def cigar_length(runs: ColumnOrName, kind: str) -> Column:
    """Bases in the runs of a kind."""
    return F.aggregate(F.filter(col(runs), lambda r: cigar_is(r, kind)), F.lit(0).cast("bigint"), lambda acc, r: acc + r["count"])


def has_spaces(s: ColumnOrName) -> Column:
    return col(s).rlike(r"\s")


def split_at_spaces(s: ColumnOrName) -> Column:
    return F.filter(F.split(F.trim(col(s)), r"\s+"), lambda w: w != "")


def repeated(n: ColumnOrName, s: ColumnOrName) -> Column:
    return F.repeat(col(s), col(n))


def empty_or_null(s: ColumnOrName) -> Column:
    return col(s).isNull() | (col(s) == "")


def empty_for_null(s: ColumnOrName) -> Column:
    return F.coalesce(col(s), F.lit(""))


def null_for_empty(s: ColumnOrName) -> Column:
    return F.nullif(col(s), F.lit(""))


def percent_encode(s: ColumnOrName, when: str) -> Column:
    """RFC 3986 encoding with / kept, of texts in which the pattern `when` is found; others stay."""
    s = col(s)
    encoded = F.url_encode(s)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return F.when(s.rlike(when), encoded).otherwise(s)


def encode_column(s: ColumnOrName) -> Column:
    """A GFF3 column: encoded if it has a blank, a control character, % or >."""
    return percent_encode(s, r"[\x00-\x20%\x7f]|^>")


def encode_attribute(s: ColumnOrName) -> Column:
    """A GFF3 attribute: also for ; = & and comma."""
    return percent_encode(s, r"[;=%&,\x00-\x1f\x7f]")


def percent_decode(s: ColumnOrName) -> Column:
    """Percent escapes resolved; + stays +."""
    return F.url_decode(F.replace(col(s), F.lit("+"), F.lit("%2B")))


def strip_tags(html: ColumnOrName) -> Column:
    """Text without tags, the five XML entities and the hard blank resolved."""
    out = F.regexp_replace(col(html), "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def to_number(s: ColumnOrName) -> Column:
    """A number, thousands separators dropped, or null."""
    return F.replace(F.trim(col(s)), F.lit(","), F.lit("")).try_cast("double")


def to_identifier(s: ColumnOrName) -> Column:
    """A header as an identifier: other characters than letters, digits and _ to _, and _ in front of a digit."""
    plain = F.regexp_replace(F.trim(col(s)), r"[^A-Za-z0-9_]", "_")
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def quote_setting(s: ColumnOrName) -> Column:
    return F.replace(col(s), F.lit(" "), F.lit("_"))


def browser_url(base: str, db: ColumnOrName, position: Column, extra: str = "") -> Column:
    """A browser link to a position."""
    return F.concat(F.lit(f"{base}?db="), col(db), F.lit("&position="), F.url_encode(position), F.lit(f"&{extra}" if extra else ""))


def anchor(url: Column, text: Column, target: str = "browser") -> Column:
    return F.concat(F.lit('<a href="'), url, F.lit(f'" target="{target}">'), text, F.lit("</a>"))


def to_ascii(s: ColumnOrName) -> Column:
    """Letters without their marks and common ligatures spelled out; other non-ASCII characters become ?."""
    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        import unicodedata

        spelled = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."}

        def one(t: str | None) -> str | None:
            if t is None or t.isascii():
                return t
            marked = unicodedata.normalize("NFKD", "".join(spelled.get(c, c) for c in t))
            return "".join(c if c.isascii() else "" if unicodedata.combining(c) else "?" for c in marked)

        return texts.map(one)

    return plain(col(s))
