"""The vault: which placeholder stands for which value in a conversation, until when.

It is two tables. ``mappings``: ``chat_id, entity_type, original_value, lookup_hash, placeholder, counter_index,
created_at, expires_at``; a value is known by the keyed hash of its normalised form, and the first literal
form stays. ``counters``: ``chat_id, entity_type, next_value, expires_at``; a number that was given out in a
conversation is not given out again while its counter lives, whether its value still does or not.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.functions.crypto import blind_index, decrypt, encrypt
from veil.functions.scan import vault_key, words
from veil.sources import drop_table, materialize

TTL_SECONDS = 86_400
SCHEMA = (
    "chat_id string, entity_type string, original_value string, lookup_hash binary, placeholder string, "
    "counter_index int, created_at timestamp, expires_at timestamp"
)
COUNTERS = "chat_id string, entity_type string, next_value int, expires_at timestamp"
#: Values of a conversation that are kept with each of its texts; those of larger ones are joined by words.
MOST_VALUES = 1000


class Vault(NamedTuple):
    mappings: DataFrame
    counters: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "Vault":
        return cls(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], COUNTERS))

    def materialize(self) -> "Vault":
        return Vault(*map(materialize, self))

    def drop(self) -> None:
        """Delete what ``materialize`` wrote."""
        for table in self:
            drop_table(table)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``row_number`` within ``group`` by ``order`` (unique in a group), also where one group is most of the rows.

    Rows are sorted over all tasks by range, numbered within each range, and moved up by the rows of their
    group in the ranges before: only those counts, one a group and range, are joined.
    """
    ranged = rows.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged)  # ranges are drawn by sampling and must not be drawn again
    here = Window.partitionBy("__range", *group).orderBy(*order)
    local = ranged.withColumn(name, F.row_number().over(here))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__range", *group).count()
    moved = counts.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return local.join(moved, ["__range", *group]).withColumn(name, (F.col(name) + F.col("__before")).cast("int")).drop("__range", "__before")


def keyed(mentions: DataFrame, key: bytes | None) -> DataFrame:
    """``mentions`` with ``key``, the normal form of ``value``, and ``lookup_hash``; there is none without a key of 32 bytes."""
    if key is None or len(key) != 32:
        raise ValueError("a vault needs a blind index key of 32 bytes")
    plain = vault_key(F.col("value"))
    return mentions.withColumn("key", plain).withColumn("lookup_hash", blind_index(key, F.col("chat_id"), F.col("entity_type"), plain))


def mint(mentions: DataFrame, order: list[str], mode: str = "dense") -> DataFrame:
    """One row for each distinct value of a chat: ``chat_id, entity_type, key, original_value, placeholder, counter_index, calls``.

    ``mentions`` has ``chat_id, entity_type, value`` and the columns of ``order``, which order a chat's
    mentions. ``dense`` numbers the values of a type without gaps; ``gap`` as a counter that each mention
    moves; ``untyped`` knows a value by its key alone, so equal values share a placeholder of the type
    that came first. Values are combined before they are numbered, and a chat may be of any size. ``calls``
    is how often a value is mentioned.
    """
    place = F.struct(*order)
    source = mentions.withColumn("key", vault_key(F.col("value")))
    calls = F.count("*").alias("calls")
    if mode == "gap":
        source = numbered(source, ["chat_id", "entity_type"], order, "call")
        first = F.min(F.struct(place.alias("at"), F.col("value").alias("value"), F.col("call").alias("call"))).alias("first")
        out = source.groupBy("chat_id", "entity_type", "key").agg(first, calls)
        value, number = F.col("first.value").alias("original_value"), F.col("first.call").alias("counter_index")
        out = out.select("chat_id", "entity_type", "key", value, number, "calls")
    elif mode in ("dense", "untyped"):
        keys = ["chat_id", "key"] if mode == "untyped" else ["chat_id", "entity_type", "key"]
        first = F.min(F.struct(place.alias("at"), F.col("value").alias("value"), F.col("entity_type").alias("kind"))).alias("first")
        out = source.groupBy(*keys).agg(first, calls)
        kind, value = F.col("first.kind").alias("entity_type"), F.col("first.value").alias("original_value")
        out = out.select("chat_id", kind, "key", value, "calls", *(F.col(f"first.at.{c}").alias(f"__{c}") for c in order))
        out = numbered(out, ["chat_id", "entity_type"], [f"__{c}" for c in order], "counter_index").drop(*(f"__{c}" for c in order))
    else:
        raise ValueError("mode: dense, gap or untyped")
    return out.withColumn("placeholder", placeholder())


def placeholder() -> Column:
    return F.concat(F.lit("["), "entity_type", F.lit("_"), "counter_index", F.lit("]"))


def live(table: DataFrame, now: Column) -> DataFrame:
    """The rows of a vault's table that have not expired."""
    return table.where(F.col("expires_at") > now)


def purge(table: DataFrame, now: Column, chats: DataFrame | None = None) -> DataFrame:
    """A vault's table without expired rows (of the given chats only, if any are given)."""
    if chats is None:
        return live(table, now)
    touched = chats.select("chat_id").distinct().withColumn("__hit", F.lit(True))
    return table.join(touched, "chat_id", "left").where(F.col("__hit").isNull() | (F.col("expires_at") > now)).drop("__hit")


def _ends(now: Column, ttl: int | Column) -> Column:
    return (now + F.make_dt_interval(secs=ttl if isinstance(ttl, Column) else F.lit(ttl))).cast("timestamp")


def upsert(
    vault: Vault, mentions: DataFrame, order: list[str], now: Column, key: bytes, ttl: int | Column = TTL_SECONDS, secret: bytes | None = None,
    key_id: int = 1, mode: str = "dense",
) -> Vault:
    """The vault after ``mentions``: known live values are renewed, new ones numbered on from their type's counter.

    ``ttl`` may depend on ``chat_id``. In the mode ``gap`` each mention moves the counter, of a known value too.
    """
    kept, numbers = purge(vault.mappings, now, mentions), purge(vault.counters, now, mentions)
    match = ["chat_id", "entity_type", "lookup_hash"]
    fresh = keyed(mentions, key)
    seen = fresh.select(*match).distinct().withColumn("__hit", F.lit(True))
    renewed = kept.join(seen, match, "left")
    renewed = renewed.withColumn("expires_at", F.when(F.col("__hit"), _ends(now, ttl)).otherwise(F.col("expires_at"))).drop("__hit")
    unknown = fresh if mode == "gap" else fresh.join(kept.select(*match), match, "left_anti")
    made = keyed(mint(unknown.drop("key", "lookup_hash"), order, mode).withColumnRenamed("original_value", "value"), key).withColumnRenamed("value", "original_value")
    # A table without counters, written by other means, goes on from its largest number.
    of_type = ["chat_id", "entity_type"]
    last = numbers.select(*of_type, (F.col("next_value") - 1).alias("last")).unionByName(kept.select(*of_type, F.col("counter_index").alias("last")))
    last = last.groupBy(*of_type).agg(F.max("last").alias("last"))
    made = made.join(last, of_type, "left").withColumn("counter_index", (F.col("counter_index") + F.coalesce("last", F.lit(0))).cast("int"))
    moved = made.groupBy(*of_type).agg(F.count("*").alias("new"), F.sum("calls").alias("calls"))
    touched = mentions.select(*of_type).distinct().withColumn("__hit", F.lit(True))
    steps = F.coalesce("calls" if mode == "gap" else "new", F.lit(0))
    after = numbers.join(last.join(touched, of_type, "full").join(moved, of_type, "full"), of_type, "full").select(
        *of_type,
        (F.greatest(F.coalesce("next_value", F.lit(1)), F.coalesce("last", F.lit(0)) + 1) + steps).cast("int").alias("next_value"),
        F.coalesce(F.when(F.col("__hit"), _ends(now, ttl)), "expires_at", _ends(now, ttl)).alias("expires_at"),
    )
    value = encrypt(F.col("original_value"), secret, key_id) if secret else F.col("original_value")
    new = made.join(kept.select(*match), match, "left_anti") if mode == "gap" else made
    columns = ["chat_id", "entity_type", value.alias("original_value"), "lookup_hash", placeholder().alias("placeholder"), "counter_index"]
    new = new.select(*columns, now.cast("timestamp").alias("created_at"), _ends(now, ttl).alias("expires_at"))
    return Vault(renewed.select(*vault.mappings.columns).unionByName(new), after)


def opened(mappings: DataFrame, now: Column, secret: bytes | None = None, strict: bool = False) -> DataFrame:
    """Live rows with the plain ``value``; rows that do not decrypt are left out."""
    value = decrypt(F.col("original_value"), secret, strict) if secret else F.col("original_value")
    return live(mappings, now).withColumn("value", value).where("value is not null")


def _by_value(rows: DataFrame) -> DataFrame:
    """``chat_id, value, placeholder, created_at``: of equal values of two types that of the smaller number, then type."""
    first = F.min(F.struct("counter_index", "entity_type", "placeholder", "created_at")).alias("m")
    return rows.groupBy("chat_id", "value").agg(first).select("chat_id", "value", "m.placeholder", "m.created_at")


def snapshot(vault: Vault, now: Column, secret: bytes | None = None, strict: bool = False) -> DataFrame:
    """``chat_id, forward, reverse``: the live values of each chat as maps, to be published with its messages.

    A row is as large as its conversation's vault. Masking and restoring do not read it; they use
    ``known_in`` and ``look_up``, which bring to a text only what stands in it.
    """
    rows = opened(vault.mappings, now, secret, strict)
    pairs = lambda *names: F.map_from_entries(F.array_sort(F.collect_list(F.struct(*names))))
    forward = _by_value(rows).groupBy("chat_id").agg(pairs("value", "placeholder").alias("forward"))
    return forward.join(rows.groupBy("chat_id").agg(pairs("placeholder", "value").alias("reverse")), "chat_id")


def known_in(
    texts: DataFrame, vault: Vault, now: Column, keys: list[str], text_col: str = "text", before: str | None = None,
    secret: bytes | None = None, strict: bool = False, most: int = MOST_VALUES,
) -> DataFrame:
    """``texts``, whose rows ``keys`` tell apart, with the map ``forward`` from known values to placeholders.

    With ``before``, a column of ``texts``, only values created before that time count. The values of a
    conversation with at most ``most`` of them come with each of its texts. In a larger one a text meets
    only the values whose first word stands in it, joined by conversation and word, so that no row holds
    all values and no task all pairs.
    """
    rows = _by_value(opened(vault.mappings, now, secret, strict))
    many = rows.groupBy("chat_id").count().where(F.col("count") > most).select("chat_id")
    pair = F.struct("value", "placeholder", "created_at")
    few = rows.join(many, "chat_id", "left_anti").groupBy("chat_id").agg(F.array_sort(F.collect_list(pair)).alias("__few"))
    first = F.try_element_at(words(F.col("value")), F.lit(1))
    large = rows.join(many, "chat_id", "left_semi").withColumn("__word", F.coalesce(first, F.lit("")))
    columns = [*dict.fromkeys(["chat_id", *keys, *([before] if before else [])])]
    asked = texts.join(many, "chat_id", "left_semi").select(*columns, F.explode_outer(F.array_distinct(F.concat(words(F.col(text_col)), F.array(F.lit(""))))).alias("__word"))
    met = asked.join(large, ["chat_id", "__word"])
    if before:
        met = met.where(F.col("created_at") < F.col(before))
    met = met.groupBy(*[*dict.fromkeys(["chat_id", *keys])]).agg(F.array_sort(F.collect_list(pair)).alias("__met"))
    out = texts.join(few, "chat_id", "left").join(met, [*dict.fromkeys(["chat_id", *keys])], "left")
    found = F.coalesce("__met", "__few", F.array().cast("array<struct<value:string,placeholder:string,created_at:timestamp>>"))
    if before:
        found = F.filter(found, lambda p: p["created_at"] < F.col(before))
    forward = F.map_from_entries(F.transform(found, lambda p: F.struct(p["value"], p["placeholder"])))
    return out.withColumn("forward", forward).drop("__few", "__met")


def renew(table: DataFrame, touched: DataFrame, now: Column, ttl: int | Column = TTL_SECONDS, on: tuple[str, ...] = ("chat_id",)) -> DataFrame:
    """Live rows that ``touched`` names live on from now; expired rows are never brought back."""
    hit = touched.select(*on).distinct().withColumn("__hit", F.lit(True))
    ends = F.when(F.col("__hit") & (F.col("expires_at") > now), _ends(now, ttl)).otherwise(F.col("expires_at"))
    return table.join(hit, list(on), "left").withColumn("expires_at", ends).drop("__hit").select(*table.columns)


def renew_chats(vault: Vault, chats: DataFrame, now: Column, ttl: int | Column = TTL_SECONDS) -> Vault:
    """Mappings and counters of the chats that are spoken in live on."""
    return Vault(*(renew(table, chats, now, ttl) for table in vault))


def look_up(requests: DataFrame, mappings: DataFrame, now: Column, secret: bytes | None = None, strict: bool = False) -> DataFrame:
    """``requests`` (``chat_id, placeholder``, ...) with ``original``: null where unknown or expired.

    What is found lives on by ``renew(mappings, requests, now, on=("chat_id", "placeholder"))``.
    """
    value = decrypt(F.col("original_value"), secret, strict) if secret else F.col("original_value")
    return requests.join(live(mappings, now).select("chat_id", "placeholder", value.alias("original")), ["chat_id", "placeholder"], "left")
