"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.names import spare
from veil.sources import materialize, read_table

SEED = 17
#: A Poisson draw of a larger mean is the sum of independent draws of at most this mean each.
PART = 16.0
#: Rows of the table of rates up to which it is broadcast (under 100 bytes each).
BROADCAST_ROWS = 100_000


def hashed(*parts: Column) -> Column:
    """First 13 hexadecimal digits (52 bits) of the MD5 of the joined parts, as a long."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def poisson(u: Column, mean: Column) -> Column:
    """Smallest k whose cumulative Poisson probability exceeds ``u``, for a mean of at most PART.

    The fold ends where the rest of the distribution is far below the 2**-52 steps of ``u``.
    """
    most = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    none = F.exp(-mean)
    start = F.struct(none.alias("p"), none.alias("sum"), F.lit(0).alias("k"))

    def step(s, i):
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.when(u >= s["sum"], i).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source`` and ``rate``: mean copies of its documents, so that characters come in proportion to the weights.

    Sources that ``weights`` does not name weigh 1. ``total`` is the number of characters wanted, by
    default as many as there are. A null source is a source of its own; one without characters has rate 1.
    """
    size = F.sum(F.length(F.coalesce(text_col, F.lit("")))).alias("size")
    sizes = materialize(docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(size))
    named = list((weights or {}).items())
    weight = F.lit(1.0)
    if named:
        table = F.create_map(*(F.lit(x) for pair in named for x in (pair[0], float(pair[1]))))
        weight = F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))), F.lit(1.0))
    weighed = sizes.withColumn("weight", weight)
    row = weighed.where("size > 0").agg(F.sum("weight"), F.sum("size")).first()
    all_weight, wanted = row[0] or 1.0, float(total if total is not None else row[1] or 0)
    rate = F.col("weight") * F.lit(wanted) / (F.lit(all_weight) * F.col("size"))
    return weighed.select("source", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with each row as often as a Poisson draw seeded by its id says, in a random global order.

    Adds ``copy`` (from 1) and ``shuffle_key`` (random long); columns of these names are replaced. Rows are
    dealt out by the key and sorted by it within each partition. The draw depends on seed and id alone, so
    a lost task gives the same rows again, and rows with equal ids have equal counts. A null id counts as
    the string ``null``. Null and empty texts take part. Only the table of rates, one row a source, is
    joined: it is broadcast if it has at most BROADCAST_ROWS rows, and otherwise left to Spark.
    """
    table = materialize(rates(docs, weights, total, source_col, text_col))
    small = table.count() <= BROADCAST_ROWS
    kept = docs.drop(*(c for c in ("copy", "shuffle_key") if c in docs.columns))
    source, rate, number = spare(kept, "source", "rate", "copies")
    table = table.select(F.col("source").alias(source), F.col("rate").alias(rate))
    both = kept.join(F.broadcast(table) if small else table, kept[source_col].cast("string").eqNullSafe(F.col(source)))
    parts = F.greatest(F.lit(1), F.ceil(F.col(rate) / PART)).cast("int")
    key, mean = F.col(id_col), F.col(rate) / parts
    draw = lambda part: poisson(hashed(F.lit(seed), key, part) / F.lit(float(1 << 52)), mean)
    copies = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, part: n + draw(part))
    made = both.withColumn(number, copies).where(F.col(number) > 0).drop(source, rate)
    made = made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(number)))).drop(number)
    made = made.withColumn("shuffle_key", hashed(F.lit(seed), key, F.lit("order"), F.col("copy")))
    return made.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


SQL = """
WITH sizes AS (SELECT CAST(source AS VARCHAR) AS source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY 1),
sums AS (SELECT count(*) AS w, sum(size) AS size FROM sizes WHERE size > 0),
rated AS (
  SELECT sizes.source, CASE WHEN sizes.size > 0 THEN CAST(sums.size AS DOUBLE) / (CAST(sums.w AS DOUBLE) * sizes.size) ELSE 1.0 END AS rate
  FROM sizes, sums),
parts AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 16.0)) AS INT) AS m FROM rated),
pmf AS (
  SELECT source, m, k, exp(-rate / m + k * ln(rate / m) - lgamma(k + 1)) AS p
  FROM parts, unnest(range(0, 100)) AS t(k)),
cdf AS (SELECT source, m, list(c ORDER BY k) AS c FROM (
  SELECT source, m, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf) GROUP BY 1, 2),
draws AS (
  SELECT d.*, list_sum(list_transform(range(1, m + 1), lambda j: len(list_filter(c, lambda x: x <= CAST(CAST(
    '0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))) AS n
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, CAST('0x' || substr(md5(
  '17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':order:' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM draws, unnest(range(1, CAST(n AS BIGINT) + 1)) AS t(copy)
"""
QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL = {"op3_mixing": SQL}
