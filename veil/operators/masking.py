"""Masking and restoring: placeholders in, originals out, offsets kept in step."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.scan import PLACEHOLDER, blocks, cut_out, find_all, let, once, placed, placeholder_type, replace_all, running, surface, values_pattern
from veil.operators.spans import STANDARD, same_persons

ENTRY = "struct<entity_type:string,start:int,end:int,score:double,raw_entity_type:string,original:string,placeholder:string,key:string>"
ENTRIES = f"array<{ENTRY}>"


def standard_type(kind: Column, types: dict[str, str] = STANDARD) -> Column:
    out = kind
    for raw, name in types.items():
        if raw != name:
            out = F.when(kind == raw, F.lit(name)).otherwise(out)
    return out


def number(df: DataFrame, name: str, spans: str, text: Column, coreference: bool = False) -> DataFrame:
    """``df`` with column ``name``: the accepted spans of column ``spans`` with their placeholders.

    Values are numbered by first occurrence within their type; one seen before has its placeholder
    whatever its type. With ``coreference`` a bare surname has the placeholder of the one full name in the text that
    ends with it. Equal values, and then equal types, are brought together by sorting, so the work does not
    grow with the square of a text's spans. Each step is a column of its own, as in ``spans.select``.
    """
    at = lambda x, i: F.element_at(x, i + 1)
    kept = lambda x, field, value: running(F.transform(x, lambda v, i: F.when((i == 0) | (F.try_element_at(x, F.greatest(i, F.lit(1)))[field] != v[field]), value(v, i))), lambda a, b: F.coalesce(b, a), "array<int>")
    shown = lambda parts: F.transform(F.col(spans), lambda s: cut_out(parts, s["start"], s["end"]))
    full = same_persons(F.col(spans), text) if coreference else F.transform(spans, lambda s: F.lit(None).cast("string"))
    kind = lambda s, i: standard_type(s["entity_type"]).alias("kind")
    x, by_key, first, kinds, begin, numbers, rank = (F.col(f"__n{k}") for k in range(7))
    steps = [
        F.zip_with(let(blocks(text), shown), full, lambda v, n: F.struct(v.alias("value"), F.coalesce(n, v).alias("key"))),
        F.array_sort(F.zip_with(x, F.transform(spans, lambda s, i: F.struct(i.alias("i"), kind(s, i))), lambda v, s: F.struct(v["key"].alias("key"), s["i"].alias("i"), s["kind"].alias("kind")))),
        # For each span, in the order of the text, the place of the first one with its key.
        F.transform(F.array_sort(F.zip_with(by_key, kept(by_key, "key", lambda v, i: v["i"]), lambda v, f: F.struct(v["i"].alias("i"), f.alias("f")))), lambda v: v["f"]),
        # Firsts in the order of their types; a type's number is the distance from its begin.
        F.array_sort(F.transform(F.filter(by_key, lambda v: at(first, v["i"]) == v["i"]), lambda v: F.struct(v["kind"].alias("kind"), v["i"].alias("i")))),
        kept(kinds, "kind", lambda v, i: i),
        F.array_sort(F.transform(kinds, lambda v, i: F.struct(v["i"].alias("i"), (i + 1 - at(begin, i)).alias("n"), v["kind"].alias("kind")))),
        running(F.transform(first, lambda f, i: (f == i).cast("int")), lambda a, b: a + b, "array<int>"),
    ]
    for k, step in enumerate(steps):
        df = df.withColumn(f"__n{k}", F.when(F.size(spans) > 0, step))

    def entry(s, i):
        made, own = F.element_at(numbers, at(rank, at(first, i))), at(x, i)
        return F.struct(
            kind(s, i).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["entity_type"].alias("raw_entity_type"),
            own["value"].alias("original"), F.concat(F.lit("["), made["kind"], F.lit("_"), made["n"].cast("string"), F.lit("]")).alias("placeholder"), own["key"].alias("key"),
        )

    out = once(df, name, F.when(F.size(spans) > 0, F.transform(spans, entry).cast(ENTRIES)).otherwise(F.array().cast(ENTRIES)))
    return out.drop(*(f"__n{k}" for k in range(7)))


def splice(text: Column, entries: Column) -> Column:
    """The text with each entry's range replaced by its placeholder; ranges are sorted and apart."""

    def spliced(parts):
        before = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at(entries, i)["end"])
        pieces = F.transform(entries, lambda e, i: F.concat(cut_out(parts, before(i), e["start"]), e["placeholder"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.try_element_at(entries, F.lit(-1))["end"] + 1, F.length(text)))

    return F.when(F.size(entries) > 0, let(blocks(text), spliced)).otherwise(text)


def forward_map(entries: Column) -> Column:
    """Original (or full name) to placeholder."""
    pairs = F.transform(entries, lambda e: F.struct(e["key"], e["placeholder"]))
    return F.map_from_entries(F.array_distinct(pairs))


def reverse_map(entries: Column) -> Column:
    pairs = F.transform(entries, lambda e: F.struct(e["placeholder"], e["key"]))
    return F.map_from_entries(F.array_distinct(pairs))


def remask(text: Column, forward: Column) -> Column:
    """Every literal occurrence of a known value outside a longer word becomes its placeholder, longest first."""
    pattern = values_pattern(F.map_keys(forward))
    return F.when(pattern.isNull() | text.isNull(), text).otherwise(replace_all(text, pattern, lambda m: F.try_element_at(forward, m)))


def remask_spans(text: Column, forward: Column) -> Column:
    """What ``remask`` replaces: ``start, end`` in the original, ``original, placeholder, entity_type``."""
    pattern = values_pattern(F.map_keys(forward))
    kind = "array<struct<start:int,end:int,original:string,placeholder:string,entity_type:string>>"

    def made(m):
        held = F.try_element_at(forward, m["text"])
        return F.struct(m["start"], m["end"], m["text"].alias("original"), held.alias("placeholder"), placeholder_type(held).alias("entity_type"))

    found = F.transform(placed(F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0))), made)
    return F.when(pattern.isNotNull() & F.rlike(text, pattern), found.cast(kind)).otherwise(F.array().cast(kind))


def original_offset(position: Column, spans: Column) -> Column:
    """A place in the remasked text as a place in the original; null inside a placeholder."""
    # ``shift`` is how much longer the remasked text is before a span, ``own`` before the position.
    def step(acc, s):
        size, width = F.length(s["placeholder"]), s["end"] - s["start"]
        low = s["start"] + acc["shift"]
        inside = (position > low) & (position < low + size)
        passed = position >= low + size
        return F.struct((acc["shift"] + size - width).alias("shift"), (acc["inside"] | inside).alias("inside"), F.when(passed, acc["shift"] + size - width).otherwise(acc["own"]).alias("own"))

    begin = F.struct(F.lit(0).alias("shift"), F.lit(False).alias("inside"), F.lit(0).alias("own"))
    return F.aggregate(spans, begin, step, lambda a: F.when(~a["inside"], position - a["own"]))


def restore(text: Column, reverse: Column, active: Column | None = None) -> Column:
    """Struct of ``text``, with known placeholders replaced by their originals in one pass, and the sorted
    lists ``restored`` and ``unknown`` of placeholders. Without a map, or where not ``active``, nothing is
    replaced or reported."""
    pattern = F.lit("(?U)" + PLACEHOLDER)
    active = F.size(F.map_keys(reverse)) > 0 if active is None else active
    known = F.coalesce(active, F.lit(False)) & (F.length(text) > 0)
    found = F.array_sort(F.array_distinct(F.transform(find_all(text, PLACEHOLDER), lambda m: m["text"])))
    empty = F.array().cast("array<string>")
    has = lambda p: F.map_contains_key(reverse, p)
    return F.struct(
        F.when(known, replace_all(text, pattern, lambda m: F.try_element_at(reverse, m))).otherwise(text).alias("text"),
        F.when(known, F.filter(found, has)).otherwise(empty).alias("restored"),
        F.when(known, F.filter(found, lambda p: ~has(p))).otherwise(empty).alias("unknown"),
    )


def card(entries: Column) -> Column:
    """What may be shown of detections: type and range."""
    return F.transform(entries, lambda e: F.struct(e["entity_type"].alias("type"), e["start"], e["end"]))
