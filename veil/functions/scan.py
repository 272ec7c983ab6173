"""Pattern scans that keep offsets, and replacements that depend on the match.

Patterns get ``(?U)``, so that ``\\w``, ``\\b``, ``\\s`` and ``\\d`` know all of Unicode. Offsets are code points,
as Spark's ``length`` and ``substring`` count them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string>>"
PLACEHOLDER = r"\[[A-Z_]+_\d+\]"


def unicode(pattern: str) -> str:
    return "(?U)" + pattern


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Non-overlapping matches as structs ``start, end, text``; a null text has none.

    What lies between the matches tells their offsets. The cheap test for any match comes first, as the
    fold over matches is interpreted.
    """
    literal = F.lit(unicode(pattern))
    return F.when(F.rlike(text, literal), placed(F.split(text, unicode(pattern), -1), F.regexp_extract_all(text, literal, F.lit(group)))).otherwise(F.array().cast(MATCH))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine, kind: str) -> Column:
    """For each value its combination with all before it; ``combine`` is associative and takes the earlier one first.

    Each pass combines a value with the one twice as far before it, so that an array is passed as often as its
    length has binary digits, and no array grows step by step.
    """
    distances = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int")), lambda k: F.power(F.lit(2), k).cast("int"))
    one = lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, combine(F.try_element_at(acc, F.greatest(i + 1 - d, F.lit(1))), x)).otherwise(x))
    return F.when(F.size(values) > 1, F.aggregate(distances, values.cast(kind), one)).otherwise(values.cast(kind))


def sums(numbers: Column) -> Column:
    """For each of an array of integers the sum of those before it."""
    upto = running(numbers, lambda a, b: a + b, "array<int>")
    return F.zip_with(upto, numbers, lambda u, x: u - x)


def placed(gaps: Column, found: Column) -> Column:
    """Matches with their places, given what lies between them and the matches."""

    def of(parts):
        before = sums(F.transform(parts, lambda p: p["gap"] + F.length(p["text"])))
        start = lambda b, p: b + p["gap"]
        made = lambda b, p: F.struct(start(b, p).alias("start"), (start(b, p) + F.length(p["text"])).alias("end"), p["text"].alias("text"))
        return F.zip_with(before, parts, made)

    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))
    return let(F.filter(parts, lambda p: p["text"].isNotNull()), of).cast(MATCH)


def words(text: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def replace_all(text: Column, pattern: Column, replacement) -> Column:
    """One pass from left to right: each match ``m`` becomes ``replacement(m)``, or stays where that is null.

    ``pattern`` may differ from row to row. Replaced text is not scanned again.
    """
    parts = F.arrays_zip(F.split(text, pattern, F.lit(-1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("text"))
    pieces = F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(replacement(x["text"]), x["text"], F.lit(""))))
    return F.when(F.rlike(text, pattern), F.array_join(pieces, "")).otherwise(text)


def escaped(value: Column) -> Column:
    """The value as a pattern that matches it alone."""
    return F.regexp_replace(value, r"([^\p{L}\p{N}_])", r"\\$1")


def values_pattern(values: Column) -> Column:
    """Alternation of literal values, longest first, not inside a word; null for no values."""
    order = F.array_sort(F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    body = F.array_join(F.transform(order, lambda s: escaped(s["v"])), "|")
    return F.when(F.size(values) > 0, F.concat(F.lit(r"(?U)(?<!\w)(?:"), body, F.lit(r")(?!\w)")))


def surface(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def between(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``, empty if the range is."""
    return F.when(end > start, F.substring(text, start + 1, end - start)).otherwise(F.lit(""))


#: Code points in a block of ``blocks``.
BLOCK = 1024


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, for ``cut_out``: finding a place in a long text means to walk there from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut_out(parts: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` of a text given by its ``blocks``; only those are read in which the range lies."""
    block = lambda at: F.floor(at / BLOCK).cast("int")
    joined = F.array_join(F.slice(parts, block(start) + 1, block(end - 1) - block(start) + 1), "")
    return F.when(end > start, F.substring(joined, start - block(start) * BLOCK + 1, end - start)).otherwise(F.lit(""))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def vault_key(value: Column) -> Column:
    """Runs of white space become one space and none is left at the ends; letters stay as they are."""
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "))


def placeholder_type(placeholder: Column) -> Column:
    """``PERSON`` for ``[PERSON_3]``; null if the value is no placeholder."""
    return F.nullif(F.regexp_extract(placeholder, r"^\[([A-Z_]+)_\d+\]$", 1), F.lit(""))


def exploded(rows: DataFrame, array: Column, name: str) -> DataFrame:
    """``rows`` with a row for each element ``name`` of a computed array; null elements have none.

    ``explode`` would have Catalyst infer a filter on the array, which evaluates it, and all it is computed
    from, once more for each condition.
    """
    return rows.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a computed column that is evaluated once, whoever reads it.

    A filter on a plain column would be pushed below the steps that compute it, and evaluate all of them again.
    """
    return rows.withColumn(name, F.explode_outer(F.array(value)))
