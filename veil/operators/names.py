"""A detector of listed names: a table of any size against the word sequences of texts, by a join."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.scan import let, once, sums
from veil.operators.spans import SPANS, span

WORD = r"\w+"
#: Names whose hashes are sent to all workers at most.
HASHES = 1 << 21


def _sequence(size: int) -> str:
    """Pattern that finds nothing but a place: of the first of ``size`` words in a row, which are its group."""
    return r"(?U)\b(?=(\w++" + r"\W++\w++" * (size - 1) + "))"


def _starts(text: Column) -> Column:
    """Places of the words of a text."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)^\W++|\w++\W*+"), F.lit(0)), F.length)
    whole = let(F.when(F.rlike(text, F.lit(r"(?U)^\W")), sizes).otherwise(F.concat(F.array(F.lit(0)), sizes)), sums)
    return F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 1, F.lit(0)))


def _plain(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def name_table(names: DataFrame, name_col: str = "name", type_col: str = "entity_type") -> DataFrame:
    """``name, entity_type, size``, a row for each name from its first word to its last, ``size`` words in all.

    Runs of white space count as one space. Null names, those without words and those without a type are left out;
    a name with several types has the first by alphabet.
    """
    whole = _plain(F.regexp_extract("name", r"(?Us)\w(?:.*\w)?", 0))
    source = names.select(F.col(name_col).alias("name"), F.col(type_col).alias("entity_type")).where("name is not null and entity_type is not null")
    source = source.select(whole.alias("name"), "entity_type", F.size(F.regexp_extract_all("name", F.lit(f"(?U){WORD}"), F.lit(0))).alias("size"))
    return source.where("size > 0").groupBy("name", "size").agg(F.min("entity_type").alias("entity_type"))


def listed_spans(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", score: float = 0.9, ord_: int = 1000, name_col: str = "name", type_col: str = "entity_type") -> DataFrame:
    """``id_col`` and ``spans`` of the texts in which a listed name stands: from the left, the longest at each place.

    Names are whole words and case counts; white space may differ. A name that overlaps an earlier one that was taken is
    not. ``id_col`` tells texts apart: rows of one id and equal text count once, and an id with several texts gives the
    names of each, taken by themselves. Null and empty texts, and an empty table of names, give no rows. Other columns
    are not looked at.

    Each word begins one sequence for each size that names have, which a pattern finds. Sequences whose hash no name has are
    left out where they are found, as long as the names are at most HASHES, whose hashes are broadcast; beyond, they are shuffled. Those
    that are left meet the names by a join on their text. Texts themselves are not shuffled. The driver sees the number of names
    of each size, as many as there are different numbers of words in a name.
    """
    listed = name_table(names, name_col, type_col)
    sizes = {r[0]: r[1] for r in listed.groupBy("size").count().collect()}
    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t")).where("__t is not null")
    empty = source.select("id", F.array().cast(SPANS).alias("spans")).withColumnRenamed("id", id_col).limit(0)
    if not sizes:
        return empty
    # Of texts that share an id, each has its own hash, so that their words do not mix.
    found = F.array(*(F.regexp_extract_all("__t", F.lit(_sequence(k)), F.lit(1)) for k in sorted(sizes)))
    source = once(source.select("id", F.xxhash64("__t", F.length("__t")).alias("__of"), "__t"), "__at", _starts(F.col("__t")))
    source = source.select("id", "__of", "__at", F.explode_outer(found).alias("__s"))
    start = F.get("__at", F.col("__i"))
    sequences = source.select("id", "__of", "__at", F.posexplode_outer("__s").alias("__i", "__n")).where("__n is not null")
    sequences = sequences.select("id", "__of", start.alias("start"), (start + F.length("__n")).alias("end"), _plain(F.col("__n")).alias("name"))
    hashes = listed.select(F.xxhash64("name").alias("__h")).distinct()
    known = sequences.withColumn("__h", F.xxhash64("name")).join(F.broadcast(hashes) if sum(sizes.values()) <= HASHES else hashes, "__h", "left_semi")
    met = known.join(listed.select("name", "entity_type"), "name").select("id", "__of", "start", "end", "entity_type").distinct()
    order = Window.partitionBy("id", "__of").orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))
    islands = met.withColumn("__new", apart).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = F.transform(
        F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "entity_type"))),
        lambda s: span(s["entity_type"], s["start"], -s["back"], score, ord_),
    )

    def take(kept, s):
        free = F.coalesce(s["start"] >= F.try_element_at(kept, F.lit(-1))["end"], F.lit(True))
        return F.when(free, F.concat(kept, F.array(s))).otherwise(kept)

    taken = islands.groupBy("id", "__of", "__island").agg(found.alias("__all"))
    taken = taken.select("id", F.explode(F.aggregate("__all", F.array().cast(SPANS), take)).alias("s"))
    return taken.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.end", "s"))).alias("__s")).select(F.col("id").alias(id_col), F.col("__s.s").alias("spans"))
