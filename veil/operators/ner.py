"""Model detectors: overlapping windows of text, a pluggable function per window, one span for each finding."""

import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.scan import exploded, find_all
from veil.operators.spans import SPANS, collapse_contained, span
from veil.sources import ship

WINDOW, OVERLAP = 1024, 256
#: Labels of a model and the types they stand for. Fixed values.
LABELS = {
    "person": "PERSON",
    "first name": "PERSON",
    "last name": "PERSON",
    "address": "ADDRESS",
    "street address": "ADDRESS",
    "city": "ADDRESS_CITY",
    "postal code": "ADDRESS",
    "username": "USERNAME",
    "ip address": "IP_ADDRESS",
    "api key": "SECRET",
    "password": "SECRET",
    "access token": "SECRET",
}
#: A finding of a model: label, its text, start and end in the window, and a score or None.
Finding = tuple[str, str, int, int, float | None]


def windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Structs of ``offset`` and ``text``; any stretch of at most ``overlap`` characters is whole in one of them."""
    if size <= 0 or not 0 < overlap < size:
        raise ValueError("0 < overlap < size")
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * stride).alias("offset"), F.substring(text, i * stride + 1, F.lit(size)).alias("text")))


def place(window: str, value: str, start: int, end: int) -> tuple[int, int] | None:
    """Where a finding really is: as said, else the nearest copy from a little before, else any, else nowhere."""
    if 0 <= start < end and window[start:end] == value:
        return start, end
    at = window.find(value, max(0, start - 5)) if value else -1
    at = window.find(value) if at < 0 and value else at
    return (at, at + len(value)) if at >= 0 else None


def model_spans(
    texts: DataFrame,
    load: Callable[[], Callable[[str], list[Finding]]],
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    labels: dict[str, str] | None = None,
    size: int = WINDOW,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``id_col`` and ``spans`` for texts in which the model finds something.

    ``load`` runs once a task and returns the model. A window on which it fails is skipped and told on the
    task's standard error; where all windows of a task fail, so does the task. Findings of
    unmapped labels or below the threshold are dropped; one without a score has the threshold's. Of equal
    findings in overlapping windows the best score stays. Filter ``texts`` before the call: a Python
    function runs for every row that reaches it.
    """
    ship(texts.sparkSession)
    types = LABELS if labels is None else labels
    cut = exploded(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t")), windows(F.col("__t"), size, overlap), "w").select("id", "w.offset", "w.text")

    def run(frames):
        model = load()
        tried = failed = 0
        for frame in frames:
            rows = []
            for who, offset, window in zip(frame["id"], frame["offset"], frame["text"], strict=True):
                tried += 1
                try:
                    found = model(window)
                except Exception as e:  # noqa: BLE001  one bad window must not lose the others
                    failed, last = failed + 1, e
                    print(f"model failed on a window: {type(e).__name__}", file=sys.stderr)
                    continue
                for label, value, start, end, score in found:
                    at, kind = place(window, value, start, end), types.get(label)
                    score = threshold if score is None else float(score)
                    if at and kind and score >= threshold:
                        rows.append((who, kind, offset + at[0], offset + at[1], score))
            yield pd.DataFrame(rows, columns=["id", "entity_type", "start", "end", "score"])
        if failed > 1 and failed == tried:
            raise RuntimeError("the model failed on every window") from last

    schema = cut.select("id", F.lit("").alias("entity_type"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score")).schema
    best = cut.mapInPandas(run, schema).groupBy("id", "entity_type", "start", "end").agg(F.max("score").alias("score"))
    made = span(F.col("entity_type"), F.col("start"), F.col("end"), F.col("score"), 1000)
    return best.groupBy("id").agg(collapse_contained(F.array_sort(F.collect_list(made)).cast(SPANS)).alias("spans")).withColumnRenamed("id", id_col)


def gazetteer(text: Column, names: dict[str, str], score: float = 0.9, ord_: int = 1000) -> Column:
    """Spans of listed names (name to type), whole words only: a detector without a model or Python."""
    out = []
    for kind in sorted(set(names.values())):
        body = "|".join(sorted((r"\Q" + n.replace(r"\E", "") + r"\E" for n, k in names.items() if k == kind), key=lambda n: (-len(n), n)))
        out.append(_listed(text, body, kind, score, ord_))
    return F.concat(*out) if out else F.array().cast(SPANS)


def _listed(text: Column, body: str, kind: str, score: float, ord_: int) -> Column:
    return F.transform(find_all(text, rf"(?<!\w)(?:{body})(?!\w)"), lambda m: span(kind, m["start"], m["end"], score, ord_))

