"""Span algebra inside the row: a detection is a struct, a text's detections an array.

``ord`` makes explicit what the order of a list would say: ties in score go to the smaller ``ord``.
Arrays of a text are small (detections, not words), so folds over them stay in the row and nothing is shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.config import EngineConfig
from veil.functions.language import window_language
from veil.functions.scan import PLACEHOLDER, between, find_all, let, once, running, strip, surface

SPAN_FIELDS = "struct<entity_type:string,start:int,end:int,score:double,ord:int>"
SPANS = f"array<{SPAN_FIELDS}>"
CITY = "ADDRESS_CITY"
#: Detector or national types that win ties, and the renamings of the others. Fixed values.
CUSTOM_TYPES = ("HR_OIB", "HR_JMBG", "HR_IBAN", "IE_PPSN", "IE_IBAN", "RO_CNP", "RO_IBAN", "UK_NINO", "UK_UTR", "GB_IBAN", "US_SSN", "US_EIN")
OTHER_TYPES = ("PERSON", "ADDRESS", "USERNAME", "IP_ADDRESS", "SECRET", "CREDIT_CARD", "UK_NHS", "IBAN_CODE")
STANDARD = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE"} | {t: t for t in OTHER_TYPES + CUSTOM_TYPES}
#: Types whose spans are dropped if the language around them is another than the analyzer's.
LANGUAGE_BOUND = ("PERSON", "LOCATION", "NRP")
ADJACENT_GAP, CITY_GAP = 3, 12
#: What says that eleven digits are a telephone number, at the end of the text before them. Fixed values.
PHONE_BEFORE = (
    r"phone\s*[:=]?\s*$",
    r"tel(?:ephone)?\s*[:=]?\s*$",
    r"mob(?:ile)?\s*[:=]?\s*$",
    r"mobitel\s*[:=]?\s*$",
    r"telefon\s*[:=]?\s*$",
    r"\+1[-.\s]?$",
    r"\+385[-.\s]?$",
    r"\+49[-.\s]?$",
    r"\(\d{3}\)\s*$",
    r"\d{3}[-.\s]?\d{3}[-.\s]?$",
)
OIB_BEFORE = r"(?iU)\boib\b|osobni identifikacijski broj|osobni broj"


def span(entity_type, start, end, score, ord_=0) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (as_col(entity_type), as_col(start), as_col(end), as_col(score), as_col(ord_))
    kinds = (("entity_type", "string"), ("start", "int"), ("end", "int"), ("score", "double"), ("ord", "int"))
    return F.struct(*(v.cast(k).alias(n) for v, (n, k) in zip(values, kinds, strict=True)))


def none() -> Column:
    return F.array().cast(SPANS)


def by(spans: Column, *keys) -> Column:
    """Spans in the order of the keys, functions of a span; the whole span breaks ties."""
    wrap = lambda s: F.struct(*(k(s).alias(f"k{i}") for i, k in enumerate(keys)), s["ord"].alias("ord"), s.alias("span"))
    return F.transform(F.array_sort(F.transform(spans, wrap)), lambda w: w["span"])


def _last(acc: Column) -> Column:
    return F.try_element_at(acc, F.lit(-1))


def _but_last(acc: Column) -> Column:
    return F.slice(acc, 1, F.size(acc) - 1)


def collapse_contained(spans: Column) -> Column:
    """Drop spans inside a span of their own type; equal spans become one, partial overlaps stay."""
    ordered = by(spans, lambda s: s["entity_type"], lambda s: s["start"], lambda s: s["start"] - s["end"])

    def step(acc, s):
        last = _last(acc)
        # Kept spans of a type end later and later, so the last one has the furthest end.
        inside = (last["entity_type"] == s["entity_type"]) & (s["end"] <= last["end"])
        return F.when(F.coalesce(inside, F.lit(False)), acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, none(), step)


def merge_adjacent(spans: Column, text: Column, gap: int = ADJACENT_GAP) -> Column:
    """Join neighbours of one type with at most ``gap`` characters of white space between; the best score counts."""
    ordered = by(spans, lambda s: s["entity_type"], lambda s: s["start"])

    def step(acc, s):
        last = _last(acc)
        space = between(text, last["end"], s["start"])
        joins = (last["entity_type"] == s["entity_type"]) & (s["start"] >= last["end"]) & (s["start"] - last["end"] <= gap) & space.rlike(r"(?U)^\s*$")
        both = span(s["entity_type"], last["start"], F.greatest(last["end"], s["end"]), F.greatest(last["score"], s["score"]), last["ord"])
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(_but_last(acc), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, none(), step)


def resolve_cities(spans: Column, text: Column, gap: int = CITY_GAP) -> Column:
    """A city next to an address becomes part of it; a city alone is dropped. Other types pass.

    Between the parts of an address stand at most ``gap`` white spaces, commas, points, hyphens or digits.
    """
    address = lambda s: s["entity_type"].isin("ADDRESS", CITY)
    ordered = by(F.filter(spans, address), lambda s: s["start"], lambda s: s["end"])

    def step(acc, s):
        last = _last(acc)
        joins = (s["start"] - last["end"] <= gap) & between(text, last["end"], s["start"]).rlike(r"^[ \t\n\r\f\x0B,.0-9-]*$")
        kind = F.when((last["entity_type"] == "ADDRESS") | (s["entity_type"] == "ADDRESS"), "ADDRESS").otherwise(CITY)
        both = span(kind, F.least(last["start"], s["start"]), F.greatest(last["end"], s["end"]), F.greatest(last["score"], s["score"]), last["ord"])
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(_but_last(acc), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    merged = F.filter(F.aggregate(ordered, none(), step), lambda s: s["entity_type"] == "ADDRESS")
    return F.concat(F.filter(spans, lambda s: ~address(s)), merged)


def outside_placeholders(spans: Column, text: Column) -> Column:
    """Spans that touch no placeholder already in the text, so masking twice changes nothing."""
    touches = lambda held: F.filter(spans, lambda s: ~F.exists(held, lambda p: (s["start"] < p["end"]) & (s["end"] > p["start"])))
    return let(find_all(text, PLACEHOLDER), lambda held: F.when(F.size(held) > 0, touches(held)).otherwise(spans))


def whitelisted(spans: Column, types: dict[str, str] = STANDARD) -> Column:
    return F.filter(spans, lambda s: s["entity_type"].isin(*types))


def without_denied(spans: Column, text: Column, deny: tuple[str, ...], exact: tuple[str, ...]) -> Column:
    """Persons whose text is a denied word, or begins with an entry of ``deny`` and a space, are none."""

    def denied(s):
        value = strip(F.lower(surface(text, s)))
        bad = value.isin(*deny, *exact)
        # The beginning before each space, so that many entries cost one lookup and not one test each.
        starts = F.filter(F.transform(F.split(value, " "), lambda w, i: F.array_join(F.slice(F.split(value, " "), F.lit(1), i), " ")), lambda p: p.isin(*deny))
        return (s["entity_type"] == "PERSON") & (bad | (F.size(starts) > 0))

    return F.filter(spans, lambda s: ~denied(s)) if deny or exact else spans


def strip_trailing(spans: Column, text: Column, tokens: tuple[str, ...]) -> Column:
    """Cut punctuation and then one last word in ``tokens`` off persons; drop what is left empty."""
    if not tokens:
        return spans

    def shortened(s):
        clean = F.regexp_replace(surface(text, s), r"[.,;!?:()]+$", "")
        word = F.regexp_extract(clean, r"(?U)(\S+)\s*$", 1)
        cut = F.regexp_replace(clean, r"(?U)\s*\S+\s*$", "")
        value = F.when(F.lower(word).isin(*tokens), cut).otherwise(clean)
        end = s["start"] + F.length(value)
        return F.when(s["entity_type"] == "PERSON", span(s["entity_type"], s["start"], end, s["score"], s["ord"])).otherwise(s)

    return F.filter(F.transform(spans, shortened), lambda s: (s["entity_type"] != "PERSON") | (s["end"] > s["start"]))


def without_phones(spans: Column, text: Column, window: int) -> Column:
    """Drop an HR_OIB that the text before it calls a telephone number, unless it is called an OIB there."""
    if window <= 0:
        return spans
    phone = "(?iU)" + "|".join(PHONE_BEFORE)

    def bad(s):
        before = between(text, F.greatest(F.lit(0), s["start"] - window), s["start"])
        return (s["entity_type"] == "HR_OIB") & ~before.rlike(OIB_BEFORE) & before.rlike(phone)

    return F.filter(spans, lambda s: ~bad(s))


def without_overlaps(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the best of overlapping spans in ``name``: by score, then custom types, then start, then ``ord``; sorted by start.

    Only spans that hang together by overlaps are compared, so the work grows with a text's spans, not with their square.
    """
    custom = lambda s: F.when(s["entity_type"].isin(*CUSTOM_TYPES), 0).otherwise(1)

    def step(acc, s):
        clash = F.exists(acc, lambda a: (s["end"] > a["start"]) & (a["end"] > s["start"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(s)))

    def best(island):
        ordered = by(island, lambda s: -s["score"], custom, lambda s: s["start"])
        return F.when(F.size(island) > 1, by(F.aggregate(ordered, none(), step), lambda s: s["start"])).otherwise(island)

    spans, furthest, starts, islands = (F.col(f"__o{k}") for k in range(4))
    apart = lambda i: (i == 1) | (F.element_at(spans, i)["start"] >= F.try_element_at(furthest, F.greatest(i - 1, F.lit(1))))
    steps = [
        by(F.filter(name, lambda s: s["start"] < s["end"]), lambda s: s["start"]),
        running(F.transform(spans, lambda s: s["end"]), F.greatest, "array<int>"),
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1))), apart),
        F.transform(starts, lambda a, i: F.slice(spans, a, F.coalesce(F.try_element_at(starts, i + 2), F.size(spans) + 1) - a)),
    ]
    for k, step_ in enumerate(steps):
        df = df.withColumn(f"__o{k}", F.when(F.size(spans if k else name) > 0, step_))
    return once(df, name, F.coalesce(F.flatten(F.transform(islands, best)), none())).drop(*(f"__o{k}" for k in range(4)))


def select(df: DataFrame, name: str, spans: Column, text: Column, config: EngineConfig | None = None) -> DataFrame:
    """``df`` with column ``name``: the spans that are masked, of all detections in ``spans``.

    Without a config the steps that need lists or a window are left out. Each step is a column of its own:
    a step that reads its input twice would otherwise have Spark evaluate all steps before it twice.
    """
    steps = [lambda s: outside_placeholders(s, text), lambda s: whitelisted(resolve_cities(s, text))]
    if config:
        steps += [
            lambda s: without_denied(s, text, config.deny, config.exact_deny),
            lambda s: strip_trailing(s, text, config.trailing),
            lambda s: without_phones(s, text, config.oib_phone_window),
        ]
    steps.append(lambda s: F.when(F.length(text) > 0, s).otherwise(none()))
    out = once(df, "__spans", spans)
    for step in steps:
        now = F.col("__spans")
        out = out.withColumn("__spans", F.when(F.size(now) > 0, step(now)).otherwise(none()))
    return without_overlaps(out, "__spans").withColumn(name, F.col("__spans")).drop("__spans")


def merge_analyzers(croatian: Column, english: Column, text: Column, first: int = 0) -> Column:
    """Struct of ``spans``, the union of two analyzers' spans, and ``dropped``, the number of persons and
    places of the other language. Of equal spans the Croatian one stays unless the English one scores more.
    ``ord`` counts from ``first``: what finds spans before the analyzers, such as recognizers, wins ties with them."""
    fits = lambda lang: lambda s: ~s["entity_type"].isin(*LANGUAGE_BOUND) | (window_language(text, s["start"], s["end"]) == lang)
    left, right = F.filter(croatian, fits("hr")), F.filter(english, fits("en"))
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity_type"] == b["entity_type"])

    def step(acc, s):
        at = F.array_position(F.transform(acc, lambda a: same(a, s)), True).cast("int")
        better = F.try_element_at(acc, F.nullif(at, F.lit(0)))["score"] < s["score"]
        swapped = F.transform(acc, lambda a: F.when(same(a, s), s).otherwise(a))
        return F.when(at == 0, F.concat(acc, F.array(s))).when(better, swapped).otherwise(acc)

    merged = F.aggregate(F.concat(left, right), none(), step)
    numbered = F.transform(merged, lambda s, i: span(s["entity_type"], s["start"], s["end"], s["score"], i + first))
    dropped = F.size(croatian) + F.size(english) - F.size(left) - F.size(right)
    return F.struct(numbered.alias("spans"), dropped.alias("dropped"))


def without_subsumed(entries: Column) -> Column:
    """Entries with ``value`` and ``placeholder``, less those whose value is part of another of the placeholder."""
    return F.filter(
        entries,
        lambda e: ~F.exists(entries, lambda o: (o["value"] != e["value"]) & (o["placeholder"] == e["placeholder"]) & F.contains(o["value"], e["value"])),
    )


def same_persons(spans: Column, text: Column) -> Column:
    """For each span the full name that a bare surname stands for, else null.

    A one-word person is the full name whose last word it is, if there is exactly one such name in the text.
    """
    person = lambda s: s["entity_type"] == "PERSON"
    words = lambda v: F.split(strip(v), r"(?U)\s+")
    raw = F.transform(F.filter(spans, person), lambda s: surface(text, s))
    full = F.array_distinct(F.filter(raw, lambda v: F.size(words(v)) >= 2))

    def name_of(s, names):
        value = surface(text, s)
        found = F.filter(names, lambda n: F.lower(F.try_element_at(words(n), F.lit(-1))) == F.lower(strip(value)))
        alone = person(s) & (F.size(words(value)) == 1) & (strip(value) != "")
        return F.when(alone & (F.size(found) == 1), F.try_element_at(found, F.lit(1)))

    return let(full, lambda names: F.transform(spans, lambda s: name_of(s, names)))
