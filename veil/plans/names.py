"""Listed names of a table that grows with the documents: words that open a document, looked for in all of them."""

from pyspark.sql import functions as F

from veil.functions.scan import exploded
from veil.operators.names import listed_spans
from veil.plans import sql
from veil.sources import read_table

#: A document names its first two words, its first three or its second and third, by the remainder of its number by three.
OPENINGS = (r"(?U)^\W*(\w+\W+\w+)", r"(?U)^\W*(\w+\W+\w+\W+\w+)", r"(?U)^\W*\w+\W+(\w+\W+\w+)")
_TEXT = "SELECT doc_id, coalesce(text, '') AS t FROM documents"
_SPACE = r"regexp_replace(lead(gap, {0}) OVER w, '\s+', ' ', 'g')"
SQL = f"""WITH {sql.matches("f", _TEXT, sql.WORD, "doc_id")},
g AS (SELECT doc_id, i, s, v, {", ".join(f"lead(v, {k}) OVER w AS v{k}, lead(e, {k}) OVER w AS e{k}, {_SPACE.format(k)} AS g{k}" for k in (1, 2))}
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT doc_id, i, s, e1 AS e, v || g1 || v1 AS name, 2 AS k FROM g WHERE v1 IS NOT NULL
  UNION ALL SELECT doc_id, i, s, e2, v || g1 || v1 || g2 || v2, 3 FROM g WHERE v2 IS NOT NULL),
names AS (SELECT name, min(CASE WHEN doc_id % 2 = 0 THEN 'PERSON' ELSE 'USERNAME' END) AS y FROM q
  WHERE (doc_id % 3 = 0 AND i = 1 AND k = 2) OR (doc_id % 3 = 1 AND i = 1 AND k = 3) OR (doc_id % 3 = 2 AND i = 2 AND k = 2) GROUP BY 1),
m AS (SELECT doc_id, s, max(e) AS e, arg_max(y, e) AS y FROM q JOIN names USING (name) GROUP BY 1, 2),
l AS (SELECT doc_id, list([{{'y': y, 's': s, 'e': e}}] ORDER BY s) AS x FROM m GROUP BY 1),
r AS (SELECT doc_id, unnest(list_reduce(x, lambda a, b: CASE WHEN b[1].s >= a[-1].e THEN list_concat(a, b) ELSE a END)) AS z FROM l)
SELECT doc_id, z.y AS entity_type, z.s AS start, CAST(z.e AS INT) AS "end" FROM r"""


def listed_names(spark, sf_dir):
    """Names that documents open with, found in all documents: the longest from the left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    opening = F.coalesce(*(F.when(F.col("doc_id") % 3 == r, F.regexp_extract("text", p, 1)) for r, p in enumerate(OPENINGS)))
    kind = F.when(F.col("doc_id") % 2 == 0, "PERSON").otherwise("USERNAME")
    names = docs.select(opening.alias("name"), kind.alias("entity_type"))
    found = exploded(listed_spans(docs, names), F.col("spans"), "s")
    return found.select("doc_id", "s.entity_type", "s.start", "s.end")


QUERIES, ORACLE_SQL = {"listed_names": listed_names}, {"listed_names": SQL}
