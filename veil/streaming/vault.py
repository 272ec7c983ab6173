"""The vault as state of a stream: placeholders minted and looked up. A chat is in one bucket, and a bucket is one key, so there are no races."""

import json
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veil.functions.crypto import decrypt, encrypt
from veil.operators.vault import TTL_SECONDS, Vault, keyed
from veil.sources import ship

COLUMNS = ["chat_id", "action", "turn", "start", "entity_type", "sealed", "placeholder"]
OUTPUT = "chat_id string, action string, turn long, start long, entity_type string, sealed string, placeholder string"
#: Rows of an output frame, and rows that wait in memory before the state store takes them.
STEP = 10_000
#: Buckets that chats are dealt to. A checkpoint holds for the number it was made with.
BUCKETS = 4096
#: Entries of a page of the state, on average at most, and pages that are held in memory between two rows.
PAGE, PAGES = 64, 1000


def _keeper(ttl_seconds: int) -> StatefulProcessor:
    """A class of its own for each call: it travels to the workers whole and needs no library there."""
    ttl = ttl_seconds * 1000

    class Keeper(StatefulProcessor):
        """Values by keyed hash, values by placeholder and the next number of each type, each with the time it lives until.

        A call to the state store takes longer than all that is done with an entry, so entries are kept in pages. A chat
        has a ``head`` with its number of pages, its number of entries and the next numbers, pages ``values``, the
        placeholders by hash and type, and pages ``held``, what stands for each placeholder. Names go to pages by their
        checksum; a chat that outgrows its pages gets twice as many, so a page stays small in a chat of any size.

        Rows are taken frame by frame. What depends on values that are new in this batch waits, beyond STEP rows in the
        state store; only the new values themselves, a hash and a place each, are held.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.pages = handle.getMapState("pages", "chat string, part string, page int", "entries string")
            self.waiting = handle.getListState("waiting", "chat string, action string, turn long, start long, entity_type string, hash string, sealed string, placeholder string")
            self.bucket, self.cached, self.changed = None, {}, set()

        def handleInitialState(self, key, frame: pd.DataFrame, timer_values) -> None:  # noqa: N802
            now = timer_values.getCurrentProcessingTimeInMs()
            self._open(key)
            for chat, kind, hashed, sealed, placeholder, number, until in zip(*(frame[c] for c in frame.columns[1:]), strict=True):
                if until <= now:
                    continue
                n, least = self._number(chat, kind, now)
                self._set_number(chat, kind, max(n, int(number)), max(least, int(until)))
                if hashed is not None:
                    self._keep(chat, kind, hashed, placeholder, sealed, int(until))
                self._relieve()
            self._wake(now)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
            now = timer_values.getCurrentProcessingTimeInMs()
            self._open(key)
            fresh: dict[tuple, tuple] = {}
            numbers: dict[tuple, int] = {}
            out, wait, stored = [], [], False
            for row in chain.from_iterable(map(self._plain, rows)):
                chat, action, turn, start, kind, hashed, sealed, placeholder = row
                if action == "restore":
                    known = self._renewed(chat, placeholder, now)
                else:
                    if (chat, kind) not in numbers:
                        numbers[chat, kind] = self._number(chat, kind, now)[0]
                    known = None if (chat, kind, hashed) in fresh else self._renewed_value(chat, kind, hashed, now)
                    if not known:
                        fresh[chat, kind, hashed] = min(fresh.get((chat, kind, hashed), (turn, start, sealed)), (turn, start, sealed))
                if known:
                    out.append(self._answer(row, known))
                else:
                    wait.append(row)
                if len(out) == STEP:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
                if len(wait) == STEP:
                    self.waiting.appendList(wait)
                    wait, stored = [], True
                self._relieve()
            for (chat, kind, hashed), (_, _, sealed) in sorted(fresh.items(), key=lambda x: (str(x[0][0]), x[1], x[0][1:])):
                placeholder = f"[{kind}_{numbers[chat, kind]}]"
                numbers[chat, kind] += 1
                self._keep(chat, kind, hashed, placeholder, sealed, now + ttl)
                fresh[chat, kind, hashed] = placeholder, sealed, kind
                self._relieve()
            for (chat, kind), n in numbers.items():
                self._set_number(chat, kind, n, now + ttl)
                self._relieve()
            for row in chain(self.waiting.get() if stored else (), wait):
                chat, action, _, _, kind, hashed, _, placeholder = row
                out.append(self._answer(row, self._renewed(chat, placeholder, now) if action == "restore" else fresh[chat, kind, hashed]))
                if len(out) == STEP:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
                self._relieve()
            if stored:
                self.waiting.clear()
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
            self._wake(now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            now = timerValues.getCurrentProcessingTimeInMs()
            self._open(key)
            # The names of all pages with something that has expired; the state is not changed while it is walked.
            old = [tuple(k) for k, v in self.pages.iterator() if self._expired(k[1], json.loads(v[0]), now)]
            for chat, part, number in old:
                page = self._page(chat, part, number, change=True)
                if part == "head":
                    page["next"] = {kind: x for kind, x in page["next"].items() if x[1] > now}
                else:
                    for placeholder in [p for p, entry in page.items() if entry[3] <= now]:
                        _, kind, hashed, _ = page.pop(placeholder)
                        self._head(chat, change=True)["size"] -= 1
                        values = self._page_of(chat, "values", f"{hashed} {kind}", change=True)
                        if values.get(f"{hashed} {kind}") == placeholder:
                            del values[f"{hashed} {kind}"]
                self._relieve()
            self._wake(now)
            yield pd.DataFrame(columns=COLUMNS)

        def close(self) -> None:
            pass

        @staticmethod
        def _plain(frame):
            text = lambda c: frame[c].astype(object).where(frame[c].notna(), None)
            return zip(text("chat_id"), text("action"), frame["turn"].tolist(), frame["start"].tolist(), *map(text, ("entity_type", "hash", "sealed", "placeholder")), strict=True)

        def _open(self, bucket):
            """Pages in memory are those of one bucket; what changed in them is stored by the end of each call."""
            if bucket != self.bucket:
                self.cached.clear()
                self.bucket = bucket

        def _page(self, chat, part, number, change=False):
            name = chat, part, number
            if name not in self.cached:
                found = self.pages.getValue(name)
                self.cached[name] = json.loads(found[0]) if found else {}
            if change:
                self.changed.add(name)
            return self.cached[name]

        def _head(self, chat, change=False):
            head = self._page(chat, "head", 0, change)
            if not head:
                head.update(pages=1, size=0, next={})
            return head

        def _page_of(self, chat, part, name, change=False):
            return self._page(chat, part, crc32(name.encode("utf-8", "surrogatepass")) % self._head(chat)["pages"], change)

        def _store(self):
            """Write what changed; empty pages are removed."""
            for name in self.changed:
                page = self.cached[name]
                if page and (name[1] != "head" or page["size"] or page["next"]):
                    self.pages.updateValue(name, (json.dumps(page, ensure_ascii=False, separators=(",", ":")),))
                else:
                    self.pages.removeKey(name)
            self.changed.clear()

        def _relieve(self):
            """Between two rows, when no page is in use, memory is freed if many are held."""
            if len(self.cached) > PAGES:
                self._store()
                self.cached.clear()

        def _number(self, chat, kind, now):
            """A type's next number, and until when it is remembered."""
            n, until = self._head(chat)["next"].get(kind, (1, 0))
            return (n, until) if until > now else (1, 0)

        def _set_number(self, chat, kind, n, until):
            self._head(chat, change=True)["next"][kind] = n, until

        def _keep(self, chat, kind, hashed, placeholder, sealed, until):
            name = f"{hashed} {kind}"
            self._page_of(chat, "values", name, change=True)[name] = placeholder
            held, head = self._page_of(chat, "held", placeholder, change=True), self._head(chat, change=True)
            head["size"] += placeholder not in held
            held[placeholder] = sealed, kind, hashed, until
            if head["size"] > PAGE * head["pages"]:
                self._spread(chat, head["pages"])

        def _spread(self, chat, n):
            """Twice the pages: each keeps a half of its entries and gives the other to the page ``n`` further on."""
            for part in ("values", "held"):
                for number in range(n):
                    page = self._page(chat, part, number, change=True)
                    away = [x for x in page if crc32(x.encode("utf-8", "surrogatepass")) % (2 * n) != number]
                    self._page(chat, part, number + n, change=True).update((x, page.pop(x)) for x in away)
                    self._relieve()
            self._head(chat, change=True)["pages"] = 2 * n

        def _renewed(self, chat, placeholder, now, value=None):
            """Placeholder, value and type of what lives, by its placeholder (and if it stands for ``value``); it then lives on."""
            entry = self._page_of(chat, "held", placeholder).get(placeholder)
            if not entry or entry[3] <= now or value and (entry[1], entry[2]) != value:
                return None
            if entry[3] < now + ttl:
                self._page_of(chat, "held", placeholder, change=True)[placeholder] = *entry[:3], now + ttl
            return placeholder, entry[0], entry[1]

        def _renewed_value(self, chat, kind, hashed, now):
            """The same by type and hash."""
            name = f"{hashed} {kind}"
            placeholder = self._page_of(chat, "values", name).get(name)
            return placeholder and self._renewed(chat, placeholder, now, (kind, hashed))

        @staticmethod
        def _expired(part, page, now):
            if part == "head":
                return any(until <= now for _, until in page["next"].values())
            return part == "held" and any(entry[3] <= now for entry in page.values())

        @staticmethod
        def _answer(row, known):
            """A look-up gets the value, or none; a mention keeps its own form and gets the placeholder."""
            chat, action, turn, start, kind, _, sealed, placeholder = row
            if action == "restore":
                return chat, action, turn, start, known and known[2], known and known[1], placeholder
            return chat, action, turn, start, kind, sealed, known and known[0]

        def _wake(self, now):
            """Store what changed; one timer a bucket, as long as it has anything that will expire."""
            self._store()
            if not any(t > now for t in self.handle.listTimers()) and self.pages.exists():
                self.handle.registerTimer(now + ttl)

    return Keeper()


def vault_stream(rows: DataFrame, key: bytes, ttl_seconds: int = TTL_SECONDS, secret: bytes | None = None, initial: Vault | None = None, key_id: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Mentions get placeholders and placeholders their values, from the state of a chat.

    ``rows``, a stream, has ``chat_id``, ``action`` (``mask``, or ``restore`` for a look-up), ``turn``, ``start``,
    ``entity_type``, ``value`` and ``placeholder``; a mention has type and value, a look-up a placeholder. The same columns come
    back, filled in; ``value`` is null where a placeholder is unknown or expired. A mention without type or value is left
    out. New values of a batch are numbered by turn and start, as ``vault.mint`` numbers them, and look-ups come after the
    mentions of their batch. With ``initial``, a vault made by batches, numbers go on from its counters and its values
    live as long as they would have there; it is read once, when the stream first starts. Values are known by the hash
    keyed with ``key``; with ``secret`` they are stored encrypted, and only so pass through Python. Chats are dealt to
    ``buckets``, each of which passes through Python at once; all runs from one checkpoint need the same number.

    Needs the RocksDB state store. With an availableNow trigger, set spark.sql.streaming.noDataMicroBatches.enabled to
    false: timers would otherwise ask for one batch without data after another.
    """
    ship(rows.sparkSession)
    seal = lambda c: encrypt(F.col(c), secret, key_id) if secret else F.col(c)
    is_mask = F.col("action") == "mask"
    wanted = (is_mask & F.col("entity_type").isNotNull() & F.col("value").isNotNull()) | ((F.col("action") == "restore") & F.col("placeholder").isNotNull())
    place = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("turn", "start")]
    hashed = F.when(is_mask, F.hex("lookup_hash")).alias("hash")
    bucket = F.pmod(F.xxhash64("chat_id"), F.lit(buckets)).cast("int").alias("bucket")
    source = keyed(rows.where(wanted), key).select(bucket, "chat_id", "action", *place, "entity_type", hashed, F.when(is_mask, seal("value")).alias("sealed"), "placeholder")
    state = None
    if initial is not None:
        until = F.unix_millis("expires_at").alias("until")
        known = initial.mappings.select("chat_id", "entity_type", F.hex("lookup_hash").alias("hash"), F.col("original_value").alias("sealed"), "placeholder", (F.col("counter_index") + 1).alias("n"), until)
        none = lambda c: F.lit(None).cast("string").alias(c)
        numbers = initial.counters.select("chat_id", "entity_type", none("hash"), none("sealed"), none("placeholder"), F.col("next_value").alias("n"), until)
        state = known.unionByName(numbers).select(bucket, "*").groupBy("bucket")
    out = source.groupBy("bucket").transformWithStateInPandas(_keeper(ttl_seconds), OUTPUT, "Append", "ProcessingTime", initialState=state)
    value = decrypt(F.col("sealed"), secret) if secret else F.col("sealed")
    return out.select("chat_id", "action", "turn", "start", "entity_type", value.alias("value"), "placeholder")


def mint_stream(mentions: DataFrame, key: bytes, ttl_seconds: int = TTL_SECONDS, secret: bytes | None = None, initial: Vault | None = None) -> DataFrame:
    """A stream of ``chat_id, turn, entity_type, value`` (and ``start``, if it has one) with its placeholders; see ``vault_stream``."""
    start = F.col("start") if "start" in mentions.columns else F.lit(0)
    rows = mentions.select("chat_id", F.lit("mask").alias("action"), "turn", start.alias("start"), "entity_type", "value", F.lit(None).cast("string").alias("placeholder"))
    return vault_stream(rows, key, ttl_seconds, secret, initial).select("chat_id", "turn", "start", "entity_type", "value", "placeholder")
