"""Shapes of chat requests: messages, parts, roles, scope, tasks, toggles and cards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.scan import strip

PART = "struct<type:string,text:string>"
BODY = "struct<chat_id:string,messages:array<struct<role:string,content:string>>,metadata:struct<chat_id:string,task:string>,choices:array<struct<message:struct<role:string,content:string>,delta:string>>>"
SPOKEN = ("user", "assistant")
#: Beginning of the ids of requests without one.
EPHEMERAL = "ephemeral:"


def read_bodies(bodies: DataFrame, column: str = "body") -> DataFrame:
    """One row a message of each JSON body: ``chat_id, task, msg_idx, role, parts``.

    A body without a list of messages has none; ``passed`` has these.
    """
    rows = bodies.withColumn("__b", F.from_json(column, BODY)).withColumn("__v", F.try_parse_json(column))
    rows = rows.select("*", F.posexplode_outer("__b.messages").alias("msg_idx", "__m")).where("msg_idx is not null")
    content = F.try_variant_get("__v", F.concat(F.lit("$.messages["), "msg_idx", F.lit("].content")), "variant")
    listed = F.startswith(F.schema_of_variant(content), F.lit("ARRAY"))
    chat, task = chat_id(F.col("__b.chat_id"), F.col("__b.metadata.chat_id")), F.nullif(F.col("__b.metadata.task"), F.lit(""))
    # Items of a list may be anything; only texts that are strings count.
    field = lambda v, name: F.try_variant_get(v, F.lit(f"$.{name}"), "variant")
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, F.lit("$"), "string"))
    item = lambda v: F.struct(string(field(v, "type")).alias("type"), string(field(v, "text")).alias("text"))
    items = F.transform(F.try_variant_get(content, F.lit("$"), "array<variant>"), item)
    made = F.when(listed, items).otherwise(parts(F.col("__m.content")))
    return rows.select(*bodies.columns, chat.alias("chat_id"), task.alias("task"), "msg_idx", F.col("__m.role").alias("role"), made.alias("parts"))


def passed(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Bodies that pass unchanged, as they have no list of messages."""
    return bodies.where(F.coalesce(F.size(F.from_json(column, BODY)["messages"]), F.lit(0)) <= 0)


def parts(text: Column) -> Column:
    """A plain text as its one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast(f"array<{PART}>")


def is_text(part: Column) -> Column:
    return F.coalesce((part["type"] == "text") & (strip(part["text"]) != ""), F.lit(False))


def explode_parts(messages: DataFrame) -> DataFrame:
    """One row a text part that is not blank, with ``part_idx`` and ``text``."""
    rows = messages.select("*", F.posexplode_outer("parts").alias("part_idx", "__p"))
    return rows.where(is_text(F.col("__p"))).withColumn("text", F.col("__p.text")).drop("__p", "parts")


def write_back(parts_: Column, texts: Column) -> Column:
    """Parts with the texts of a map from part number to new text; other parts stay as they are."""
    return F.transform(parts_, lambda p, i: F.struct(p["type"].alias("type"), F.coalesce(F.try_element_at(texts, i), p["text"]).alias("text")))


def single_text(parts_: Column) -> Column:
    return F.size(F.filter(parts_, lambda p: p["type"] == "text")) == 1


def chat_id(top: Column, nested: Column, ephemeral: bool = False) -> Column:
    """The id of the thread: an empty one counts as none. ``ephemeral`` gives a random one where there is none."""
    found = F.coalesce(F.nullif(top, F.lit("")), F.nullif(nested, F.lit("")))
    return F.coalesce(found, F.concat(F.lit(EPHEMERAL), F.uuid())) if ephemeral else found


def in_scope(messages: DataFrame, most: int = 20, scope: bool = True, chat: str = "chat_id", order: str = "msg_idx") -> DataFrame:
    """The last ``most`` spoken messages of each chat; without scope, or for 0, its last user message."""
    if not scope or most == 0:
        messages, most = messages.where(F.col("role") == "user"), 1
    last = Window.partitionBy(chat).orderBy(F.desc(order))
    return messages.where(F.col("role").isin(*SPOKEN)).withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most).drop("__n")


def last_of(messages: DataFrame, role: str, chat: str = "chat_id", order: str = "msg_idx") -> DataFrame:
    """Place of the last message of a role in each chat, -1 if it has none."""
    place = F.max(F.when(F.col("role") == role, F.col(order)))
    return messages.groupBy(chat).agg(F.coalesce(place, F.lit(-1)).alias(f"last_{role}"))


def detected(messages: DataFrame, known: DataFrame | None, skip_tasks: tuple[str, ...] = (), chat: str = "chat_id", order: str = "msg_idx") -> DataFrame:
    """Adds ``detect``: whether a message is searched anew, or only known values are masked in it.

    In a chat with known values (``known`` has its ``chat_id``) only the last user and assistant messages
    are searched, and none for the tasks in ``skip_tasks``. Elsewhere all are.
    """
    of_chat = Window.partitionBy(chat)
    at = lambda role: F.max(F.when(F.col("role") == role, F.col(order))).over(of_chat)
    recent = (F.col(order) == at("user")) | (F.col(order) == at("assistant"))
    if known is None:
        return messages.withColumn("detect", F.lit(True))
    flagged = messages.join(known.select(F.col("chat_id").alias(chat)).distinct().withColumn("__known", F.lit(True)), chat, "left")
    skipped = F.coalesce(F.col("task").isin(*skip_tasks), F.lit(False)) if skip_tasks and "task" in messages.columns else F.lit(False)
    return flagged.withColumn("detect", F.col("__known").isNull() | (recent & ~skipped)).drop("__known")


def toggled(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``masking``: the user's own switch (``users``: ``user_id, pii_masking_enabled``), on where there is none.

    A user with several rows has it off only if none says on.
    """
    wanted = users.groupBy("user_id").agg(F.bool_or(F.coalesce(F.col("pii_masking_enabled").try_cast("boolean"), F.lit(True))).alias("__on"))
    return messages.join(wanted, "user_id", "left").withColumn("masking", F.coalesce("__on", F.lit(True))).drop("__on")


def answer(body: Column) -> Column:
    """The assistant's text in a parsed response: the first choice's message, else a last assistant message."""
    choice = F.try_element_at(body["choices"], F.lit(1))
    chosen = F.when(choice["delta"].isNull(), choice["message"])
    last = F.try_element_at(body["messages"], F.lit(-1))
    pick = F.coalesce(F.when(chosen["role"] == "assistant", chosen), F.when(choice.isNull() & (last["role"] == "assistant"), last))
    return F.nullif(pick["content"], F.lit(""))


def card_rows(detections: DataFrame, messages: DataFrame, chat: str = "chat_id", order: str = "msg_idx") -> DataFrame:
    """Type and range of detections in the last message, if that is a user's and has one text part."""
    end = messages.groupBy(chat).agg(F.max_by(F.struct(order, "role", single_text(F.col("parts")).alias("single")), order).alias("m"))
    shown = end.where((F.col("m.role") == "user") & F.col("m.single")).select(chat, F.col(f"m.{order}").alias(order))
    return detections.join(shown, [chat, order], "left_semi").select(chat, F.col("entity_type").alias("type"), "start", "end")
