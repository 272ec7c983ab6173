"""Pieces of the SQL that recomputes queries."""

from veil.operators.recognizers import REGISTRY, Recognizer

WORD = r"[\p{L}\p{N}_]+"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def matches(name: str, source: str, pattern: str, keys: str) -> str:
    """CTE ``name`` with a row a match: keys, ``t``, number ``i``, text ``v``, range ``s`` to ``e``, and ``gap`` before it."""
    p = quoted(pattern)
    return f"""{name}_m AS (SELECT {keys}, t, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM ({source})),
{name}_s AS (
  SELECT {keys}, t, i, m[i] AS v, p[i] AS gap, len(m) AS n, p[len(m) + 1] AS rest, CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS s
  FROM {name}_m, unnest(range(1, len(m) + 1)) AS u(i)),
{name} AS (SELECT *, CAST(s + length(v) AS INT) AS e FROM {name}_s)"""


def recognizer(kind: str) -> Recognizer:
    return next(r for r in REGISTRY if r.entity_type == kind)


def luhn(v: str) -> str:
    """Whether the digits of ``v`` pass the Luhn check."""
    d = f"list_reverse(list_transform(string_split(regexp_replace({v}, '[ -]', '', 'g'), ''), lambda c: CAST(c AS INT)))"
    return f"list_sum(list_transform({d}, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0"


def weighted(v: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"CAST(substr({v}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"
