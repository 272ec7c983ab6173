"""The vault as a stream over the conversations, from a vault that a batch has made."""

import uuid

from pyspark.sql import functions as F

from veil.functions.scan import exploded, find_all
from veil.operators.vault import Vault, upsert
from veil.plans.threads import _F, _NUMBER, _VALUE, KEY, ORDER, mentions
from veil.sources import read_table, shared_dir
from veil.streaming import vault_stream

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Placeholders that every conversation asks for.
ASKED = ("[PERSON_1]", "[PERSON_2]", "[USERNAME_1]", "[EMAIL_1]")
_HELD = "concat('[', y, '_', CAST(c AS VARCHAR), ']')"
SQL = f"""WITH {_F}, {_NUMBER},
a AS (SELECT DISTINCT conv_id, p FROM conversations, unnest([{", ".join(f"'{p}'" for p in ASKED)}]) AS u(p))
SELECT CAST(k.conv_id AS VARCHAR) AS chat_id, 'mask' AS action, CAST(k.turn AS BIGINT) AS turn, CAST(k.s AS BIGINT) AS start, k.y AS entity_type, k.v AS value, {_HELD.replace("y", "n.y")} AS placeholder
FROM k JOIN n ON n.conv_id = k.conv_id AND n.y = k.y AND n.v = k.v
UNION ALL SELECT CAST(a.conv_id AS VARCHAR), 'restore', 0, 0, n.y, n.v, a.p FROM a LEFT JOIN n ON n.conv_id = a.conv_id AND {_HELD.replace("y", "n.y")} = a.p"""


def stream(spark, sf_dir):
    """Mentions of all turns, read as a stream upon a vault with those of the first turns, and look-ups in each conversation."""
    known = upsert(Vault.empty(spark), mentions(spark, sf_dir).where("turn = 0"), ORDER, F.current_timestamp(), KEY).materialize()
    schema = read_table(spark, sf_dir, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")  # a stream takes a single file only by a glob
    turns = turns.select(F.col("conv_id").cast("string").alias("chat_id"), "turn", F.coalesce("text", F.lit("")).alias("t"))
    none = F.lit(None).cast("string")
    kind = F.when(F.length("m.text") % 2 == 0, "PERSON").otherwise("USERNAME")
    said = exploded(turns, find_all(F.col("t"), _VALUE), "m").select("chat_id", F.lit("mask").alias("action"), "turn", "m.start", kind.alias("entity_type"), F.col("m.text").alias("value"), none.alias("placeholder"))
    asked = turns.where("turn = 0").select("chat_id", F.lit("restore").alias("action"), F.lit(0).alias("turn"), F.lit(0).alias("start"), none.alias("entity_type"), none.alias("value"), F.explode(F.array(*map(F.lit, ASKED))).alias("placeholder"))
    folder = f"{shared_dir(spark)}/veil-stream-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        made = vault_stream(said.unionByName(asked), KEY, initial=known)
        sink = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
        sink.start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    known.drop()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


QUERIES, ORACLE_SQL = {"vault_stream": stream}, {"vault_stream": SQL}
