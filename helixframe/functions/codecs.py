"""Column codecs: comma lists, spelled booleans, enumerations, attribute maps, nullable values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from .strings import encode_attribute, percent_decode
from .util import ColumnOrName, col

#: Spellings of true and false by kind of column.
BOOLEANS = {"yes_no": ("y", "n"), "stat": ("ok", "err"), "start_stop": ("ok", "no"), "nmd": ("ok", "nmd"), "on_off": ("on", "off"), "digit": ("1", "0")}


def split_list(text: ColumnOrName, kind: str = "string") -> Column:
    """A comma list, with a comma at its end or without, as an array; empty text is an empty array."""
    s = F.regexp_replace(col(text), ",$", "")
    return F.when(s == "", F.array().cast(f"array<{kind}>")).otherwise(F.split(s, ",").cast(f"array<{kind}>"))


def join_list(items: ColumnOrName, trailing: bool = True) -> Column:
    """An array as a comma list; nothing for an empty one."""
    joined = F.array_join(col(items).cast("array<string>"), ",")
    return F.when(F.size(col(items)) == 0, "").otherwise(F.concat(joined, F.lit("," if trailing else "")))


def parse_boolean(text: ColumnOrName, kind: str) -> Column:
    """True or false by the spellings of BOOLEANS; null stays, other text is an error."""
    yes, no = BOOLEANS[kind]
    s = col(text)
    return F.when(s == yes, True).when(s == no, False).when(s.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit(f"expected {yes} or {no}: "), s)).cast("boolean"))


def format_boolean(value: ColumnOrName, kind: str) -> Column:
    yes, no = BOOLEANS[kind]
    return F.when(col(value), yes).when(~col(value), no)


def nullable(text: ColumnOrName, kind: str, null: str = "") -> Column:
    """The text as a value of a type, null for the given spelling; other text that doesn't convert is an error."""
    return F.nullif(col(text), F.lit(null)).cast(kind)


def format_nullable(value: ColumnOrName, null: str = "") -> Column:
    return F.coalesce(col(value).cast("string"), F.lit(null))


def enum_ordinal(value: ColumnOrName, names: Sequence[str], external: Mapping[str, str] | None = None) -> Column:
    """The place of a symbolic value among names; external gives other spellings of names. Unknown values are an error."""
    numbers = {n: k for k, n in enumerate(names)} | {e: list(names).index(n) for e, n in (external or {}).items()}
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(numbers.items())))
    found = F.try_element_at(table, col(value))
    return F.when(found.isNotNull() | col(value).isNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), col(value))))


def enum_name(ordinal: ColumnOrName, names: Sequence[str], external: Mapping[str, str] | None = None) -> Column:
    """The spelling of a place; of several external ones the first."""
    spelled = list(names)
    for e, n in reversed(list((external or {}).items())):
        spelled[list(names).index(n)] = e
    return F.get(F.array(*(F.lit(s) for s in spelled)), col(ordinal))


def parse_attributes(text: ColumnOrName) -> Column:
    """`name=value,value;...` as map<string,array<string>>, escapes resolved; a name given twice is an error."""
    s = F.regexp_replace(F.trim(col(text)), r";\s*$", "")
    pairs = F.filter(F.split(s, r"\s*;\s*"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(percent_decode(F.substring_index(p, "=", 1)).alias("k"), F.transform(F.split(F.substring(p, F.instr(p, "=") + 1, F.length(p)), ","), percent_decode).alias("v")))
    return F.when(col(text) == ".", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))).otherwise(F.map_from_entries(entries))


def format_attributes(attributes: ColumnOrName) -> Column:
    """Names in order, values joined by commas, escaped; `.` for none."""
    a = col(attributes)
    part = lambda k: F.concat(encode_attribute(k), F.lit("="), F.array_join(F.transform(F.element_at(a, k), encode_attribute), ","))
    return F.when(F.size(a) == 0, ".").otherwise(F.array_join(F.transform(F.array_sort(F.map_keys(a)), part), ";"))


def attribute(attributes: ColumnOrName, name: str, default: str | None = None) -> Column:
    """The value of a single-valued attribute, or the default; several values are an error."""
    values = F.try_element_at(col(attributes), F.lit(name))
    return F.when(F.size(values) > 1, F.raise_error(f"attribute {name} has several values")).otherwise(F.coalesce(F.get(values, F.lit(0)), F.lit(default)))


def required_attribute(attributes: ColumnOrName, name: str) -> Column:
    """The values of an attribute; its absence is an error."""
    values = F.try_element_at(col(attributes), F.lit(name))
    return F.when(values.isNotNull(), values).otherwise(F.raise_error(f"attribute {name} is missing").cast("array<string>"))


def first_attribute(attributes: ColumnOrName, names: Sequence[str]) -> Column:
    """The first value of the first of several names that is there."""
    return F.coalesce(*(F.get(F.try_element_at(col(attributes), F.lit(n)), F.lit(0)) for n in names))


def prefixed_value(values: ColumnOrName, prefix: str) -> Column:
    """What follows `prefix:` in the first of an array's values that has it."""
    return F.regexp_replace(F.get(F.filter(col(values), lambda v: v.startswith(prefix + ":")), F.lit(0)), f"^{prefix}:", "")
