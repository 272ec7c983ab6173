"""Masking of documents, and of conversations with a vault; restoring of answers."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.config import EngineConfig
from veil.functions.scan import PLACEHOLDER, surface
from veil.operators import chat, masking, ner, spans, vault
from veil.operators.recognizers import REGISTRY, Recognizer, detect
from veil.operators.vault import Vault
from veil.sources import materialize

PART = ["chat_id", "msg_idx", "part_idx"]
FOUND = "chat_id string, msg_idx int, part_idx int, entity_type string, start int, end int, score double, original string, placeholder string"
MAPS = "chat_id string, forward map<string,string>, reverse map<string,string>"
SUMMARY = "chat_id string, n_messages long, n_detections long, n_masked long, n_dropped long"
#: What finds spans in a text beside the recognizers: a function from the text to an array of spans.
Analyzer = Callable[[Column], Column]


class Masked(NamedTuple):
    """Messages, the spans found in them, the vault afterwards, its maps of the chats, and counts of each chat."""

    messages: DataFrame
    detections: DataFrame
    vault: Vault
    maps: DataFrame
    summary: DataFrame


class Restored(NamedTuple):
    messages: DataFrame
    vault: Vault


def mask_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recognizers: tuple[Recognizer, ...] = REGISTRY, config: EngineConfig | None = None) -> DataFrame:
    """``id_col, masked_text, n_spans, entries``: each text masked by itself, placeholders numbered within it.

    Nothing is shuffled. A null text stays null and has no spans.
    """
    text = F.col("__text")
    rows = docs.select(id_col, F.col(text_col).alias("__text"))
    rows = spans.select(rows, "__found", detect(text, recognizers), text, config)
    rows = masking.number(rows, "entries", "__found", text, config.coreference if config else False)
    return rows.select(id_col, masking.splice(text, F.col("entries")).alias("masked_text"), F.size("entries").alias("n_spans"), "entries")


def restore_documents(masked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The texts of ``mask_documents`` with their originals."""
    back = masking.restore(F.col("masked_text"), masking.reverse_map(F.col("entries")))
    return masked.select(id_col, back["text"].alias("text"))


def detections(docs: DataFrame, recognizers: tuple[Recognizer, ...] = REGISTRY, config: EngineConfig | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row a selected span: the columns ``keep`` and ``entity_type, start, end, score, original``."""
    text = F.col("__text")
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    # An inner explode would have Spark infer a filter on the array and evaluate all steps once more for each.
    rows = spans.select(rows, "__s", detect(text, recognizers), text, config).withColumn("__s", F.explode_outer("__s")).where("__s is not null")
    kind = masking.standard_type(F.col("__s.entity_type")).alias("entity_type")
    return rows.select(*keep, kind, "__s.start", "__s.end", "__s.score", surface(text, F.col("__s")).alias("original"))


def ttl(config: EngineConfig) -> Column:
    """Seconds that the values of a chat live, by its id."""
    short = F.startswith("chat_id", F.lit(chat.EPHEMERAL))
    return F.when(short, config.ephemeral_ttl_seconds).otherwise(config.thread_ttl_seconds)


def _sealing(config: EngineConfig, secret: bytes | None) -> bytes | None:
    """The key for stored values, or None; a key that is due and missing, or given and not used, is refused."""
    if config.encryption_enabled != (secret is not None):
        raise ValueError("encryption_enabled and a secret of 32 bytes go together")
    if secret is not None and len(secret) != 32:
        raise ValueError("the secret must have 32 bytes")
    return secret


def _analyzed(texts: DataFrame, text: Column, config: EngineConfig, recognizers, analyzers, model) -> DataFrame:
    """``texts`` with ``found``, all spans of recognizers, analyzers and model, and ``dropped``, those of another language.

    Recognizers of several languages give equal spans, of which one stays: each is evaluated once.
    """
    chosen = tuple(r for r in recognizers if set(r.languages) & set(config.languages))
    both = spans.merge_analyzers(*((analyzers[x](text) if x in analyzers and x in config.languages else spans.none()) for x in ("hr", "en")), text, len(chosen))
    none = F.struct(spans.none().alias("spans"), F.lit(0).alias("dropped"))
    rows = texts.withColumn("__both", F.when(F.col("detect"), both).otherwise(none) if analyzers else none)
    parts = [F.when(F.col("detect"), detect(text, chosen)).otherwise(spans.none()), F.col("__both.spans")]
    if model:
        asked = texts.where("detect").select(F.struct(*PART).alias("id"), text.alias("text"))
        more = ner.model_spans(asked, model, "id", "text", config.detector_threshold)
        more = more.select(*(F.col(f"id.{c}").alias(c) for c in PART), F.col("spans").alias("__model"))
        rows = rows.join(more, PART, "left")
        last = F.lit(len(chosen)) + F.size("__both.spans")  # the model comes after all others
        parts.append(F.transform(F.coalesce("__model", spans.none()), lambda s, i: s.withField("ord", (last + i).cast("int"))))
    return rows.withColumn("found", F.concat(*parts)).withColumn("dropped", F.col("__both.dropped")).drop("__both", "__model")


def mask_messages(
    messages: DataFrame,
    known: Vault,
    now: Column,
    config: EngineConfig | None = None,
    recognizers: tuple[Recognizer, ...] = REGISTRY,
    key: bytes | None = None,
    secret: bytes | None = None,
    analyzers: dict[str, Analyzer] | None = None,
    model: Callable[[], Callable] | None = None,
    vault_healthy: bool = True,
    hold: Callable[[DataFrame], DataFrame] = materialize,
    keep: Callable[[Vault], Vault] = Vault.materialize,
) -> Masked:
    """One request of each chat: its masked messages, what was found, and the vault afterwards.

    ``messages`` has ``chat_id, msg_idx, role, parts`` and may have ``task`` and ``masking``; ``known`` is the
    vault before, best a table, as it is read several times. The values of the chats live on from ``now``. Messages in scope have known values masked
    first; in those that are searched, what is left is detected, minted and masked wherever it stands in
    the part. Other messages pass unchanged. Surface forms are what is masked, the literal or full name is
    stored, its normal form is the identity.

    ``analyzers`` (``hr`` and ``en``) and ``model`` (see ``ner.model_spans``) find spans beside the recognizers; of two
    analyzers' persons and places those in text of the other's language are dropped. Detections have the
    places in the original text; known values that stand in searched messages are among them, with score 1.
    ``maps`` is what is published with the messages of each chat. Without detection only it is made.

    Without the vault (``vault_enabled`` off, or not ``vault_healthy`` and degradation to ``passthrough``) values are
    numbered within the request, a value of two types once, and ``known`` comes back as it was. An
    unhealthy vault is an error otherwise.

    All results read the spans found and the vault afterwards, so these pass through ``hold`` and ``keep``: tables
    in the shared folder, written now, which end the lineage and keep plans short. ``hold`` has texts in the clear.
    ``keep`` may put the vault elsewhere (see ``vault_store``) and returns it as it is read from there.
    """
    config = (config or EngineConfig()).validate()
    spark = messages.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    if not config.enabled:
        return Masked(messages, empty(FOUND), known, empty(MAPS), empty(SUMMARY))
    if not vault_healthy and not config.passes_through:
        raise RuntimeError("the vault is not healthy, and degradation_mode is block")
    stored = config.vault_enabled and vault_healthy
    wanted = messages.where("masking") if "masking" in messages.columns else messages
    lives = ttl(config)
    if stored:
        sealing = _sealing(config, secret)
        # Renewal moves the ends of live values only, so known values are looked up in the vault as it came.
        renewed = vault.renew_chats(known, wanted.select("chat_id"), now, lives)
    published = lambda table, chats: vault.snapshot(table, now, sealing, config.encryption_strict).join(chats, "chat_id", "left_semi")
    if not config.detection_enabled:
        after = keep(renewed) if stored else known
        return Masked(messages, empty(FOUND), after, published(after, wanted) if stored else empty(MAPS), empty(SUMMARY))
    spoken = chat.in_scope(wanted, config.history_messages, config.history_scope)
    spoken = chat.detected(spoken, vault.live(known.mappings, now) if stored else None, config.skip_tasks)
    texts = chat.explode_parts(spoken).select(*PART, "text", "detect")
    if stored:
        texts = vault.known_in(texts, known, now, PART[1:], secret=sealing, strict=config.encryption_strict)
    else:
        texts = texts.withColumn("forward", F.create_map().cast("map<string,string>"))
    texts = texts.withColumn("analyzed", masking.remask(F.col("text"), F.col("forward")))
    text = F.col("analyzed")
    texts = _analyzed(texts, text, config, recognizers, analyzers or {}, model)
    texts = spans.select(texts, "spans", F.col("found"), text, config).drop("found")
    texts = hold(texts.withColumn("spans", spans.by(spans.merge_adjacent(F.col("spans"), text), lambda s: s["start"])))
    mentioned, order = _mentions(texts, text, config), ["msg_idx", "part_idx", "span_idx"]
    asked = mentioned.select("chat_id", "entity_type", "value", *order)
    if stored:
        after = keep(vault.upsert(renewed, asked, order, now, key, lives, sealing, config.key_id))
        match = ["chat_id", "entity_type", "lookup_hash"]
        named = vault.keyed(mentioned, key).join(after.mappings.select(*match, "placeholder"), match)
        maps = published(after, texts)
    else:
        after, made = known, vault.mint(asked, order, "untyped")
        named = mentioned.withColumn("key", vault.vault_key(F.col("value"))).join(made.select("chat_id", "key", "placeholder"), ["chat_id", "key"])
        pairs = lambda *names: F.map_from_entries(F.array_sort(F.collect_set(F.struct(*names))))
        maps = made.groupBy("chat_id").agg(pairs("original_value", "placeholder").alias("forward"), pairs("placeholder", "original_value").alias("reverse"))
    own = named.groupBy(*PART).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("surface", "placeholder")))).alias("own"))
    done = texts.join(own, PART, "left")
    done = done.withColumn("out", F.when(F.col("own").isNull(), text).otherwise(masking.remask(text, F.col("own"))))
    back = done.groupBy("chat_id", "msg_idx").agg(F.map_from_entries(F.collect_list(F.struct("part_idx", "out"))).alias("outs"))
    masked = messages.join(back, ["chat_id", "msg_idx"], "left")
    masked = masked.withColumn("parts", F.when(F.col("outs").isNull(), F.col("parts")).otherwise(chat.write_back(F.col("parts"), F.col("outs")))).drop("outs")
    found = _enriched(named, texts)
    return Masked(masked, found, after, maps, _summary(texts, found, maps))


def _mentions(texts: DataFrame, text: Column, config: EngineConfig) -> DataFrame:
    """A row a span: ``span_idx``, its ``entity_type``, ``surface`` and ``value``, a full name for a bare surname."""
    names = spans.same_persons(F.col("spans"), text) if config.coreference else F.transform("spans", lambda s: F.lit(None).cast("string"))
    rows = texts.withColumn("names", names).select(*PART, "text", "analyzed", "forward", F.posexplode_outer(F.arrays_zip("spans", "names")).alias("span_idx", "m"))
    value = surface(text, F.col("m.spans"))
    kind = masking.standard_type(F.col("m.spans.entity_type")).alias("entity_type")
    return rows.where("m is not null").select("*", kind, value.alias("surface"), F.coalesce("m.names", value).alias("value"))


def _enriched(named: DataFrame, texts: DataFrame) -> DataFrame:
    """Detections with their places in the original texts.

    A span whose text is part of another one of its placeholder in the same part is told by that one.
    """
    of_part = F.collect_set(F.struct("surface", "placeholder")).over(Window.partitionBy(*PART))
    larger = lambda o: (o["surface"] != F.col("surface")) & (o["placeholder"] == F.col("placeholder")) & F.contains(o["surface"], F.col("surface"))
    rows = named.withColumn("all", of_part).where(~F.exists("all", larger))
    shifts = masking.remask_spans(F.col("text"), F.col("forward"))
    rows = rows.withColumn("start", masking.original_offset(F.col("m.spans.start"), shifts)).where("start is not null")
    end = F.col("start") + F.col("m.spans.end") - F.col("m.spans.start")
    new = rows.select(*PART, "entity_type", "start", end.alias("end"), F.col("m.spans.score").alias("score"), F.col("surface").alias("original"), "placeholder")
    hit = texts.where("detect").select(*PART, F.explode_outer(shifts).alias("s")).where("s.entity_type is not null")
    return new.unionByName(hit.select(*PART, "s.entity_type", "s.start", "s.end", F.lit(1.0).alias("score"), "s.original", "s.placeholder"))


def _summary(texts: DataFrame, found: DataFrame, maps: DataFrame) -> DataFrame:
    """Messages looked at, detections, values in the vault and spans of another language, of each chat."""
    chats = texts.groupBy("chat_id").agg(F.count_distinct("msg_idx").alias("n_messages"), F.sum("dropped").alias("n_dropped"))
    counts = chats.join(found.groupBy("chat_id").agg(F.count("*").alias("n")), "chat_id", "left").join(maps.select("chat_id", F.size("forward").alias("m")), "chat_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return counts.select("chat_id", "n_messages", zero("n").alias("n_detections"), zero("m").alias("n_masked"), zero("n_dropped").alias("n_dropped"))


def guarded(masked: DataFrame, healthy: Column, config: EngineConfig, original: str = "parts") -> DataFrame:
    """``masked`` with ``status``: where the vault is not healthy, parts are null if blocked, else as they came."""
    passed = F.col(original) if config.passes_through else F.lit(None).cast(masked.schema[original].dataType)
    status = F.when(healthy, "ok").otherwise("passthrough" if config.passes_through else "blocked")
    return masked.withColumn("status", status).withColumn("parts", F.when(healthy, F.col("parts")).otherwise(passed))


def restore_messages(messages: DataFrame, known: Vault, now: Column, config: EngineConfig | None = None, secret: bytes | None = None) -> Restored:
    """``messages`` (``chat_id``, ``text``) with originals in ``text``, and the lists ``restored`` and ``unknown``; and the vault.

    A column ``reverse``, the map that was published with the request, comes first where it is not empty.
    Otherwise the placeholders of a text are looked up in the vault, all values of which live on in the
    chats that are asked for. A chat without live values has nothing replaced or reported, and nothing is
    ever raised for a row.
    """
    config = (config or EngineConfig()).validate()
    lists = [F.array().cast("array<string>").alias(name) for name in ("restored", "unknown")]
    if not config.enabled:
        return Restored(messages.select("*", *lists), known)
    given = F.col("reverse") if "reverse" in messages.columns else F.lit(None).cast("map<string,string>")
    rows = messages.withColumn("__given", F.when(F.size(given) > 0, given)).withColumn("__key", F.unhex(F.md5(F.col("text").cast("binary"))))
    after = known
    if config.vault_enabled:
        sealing = _sealing(config, secret)
        open_ = rows.where("__given is null")
        after = vault.renew_chats(known, open_.select("chat_id"), now, ttl(config))
        places = F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit("(?U)" + PLACEHOLDER), F.lit(0))))
        asked = open_.select("chat_id", "__key", places.alias("placeholder")).where("placeholder is not null").distinct()
        found = vault.look_up(asked, known.mappings, now, sealing, config.encryption_strict).where("original is not null")
        found = found.groupBy("chat_id", "__key").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("__found"))
        alive = vault.opened(known.mappings, now, sealing, config.encryption_strict).select("chat_id").distinct().withColumn("__alive", F.lit(True))
        rows = rows.join(alive, "chat_id", "left").join(found, ["chat_id", "__key"], "left")
    else:
        rows = rows.withColumn("__alive", F.lit(None).cast("boolean")).withColumn("__found", F.lit(None).cast("map<string,string>"))
    reverse = F.coalesce("__given", "__found", F.create_map().cast("map<string,string>"))
    active = F.col("__given").isNotNull() | F.coalesce("__alive", F.lit(False))
    rows = rows.withColumn("__r", masking.restore(F.col("text"), reverse, active))
    out = rows.withColumn("text", F.col("__r.text")).withColumn("restored", F.col("__r.restored")).withColumn("unknown", F.col("__r.unknown"))
    return Restored(out.select(*messages.columns, "restored", "unknown"), after)
