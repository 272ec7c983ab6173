"""A vault that outlives a request: mappings and counters in buckets of chats, of which a request touches only its own."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from veil.operators import engine, vault
from veil.operators.vault import COUNTERS, SCHEMA, TTL_SECONDS, Vault
from veil.sources.buckets import Buckets, Snapshot

SCHEMAS = {"mappings": SCHEMA, "counters": COUNTERS}


class VaultStore:
    """The vault under ``path``. All rows of a chat are in one bucket, so a chat is changed as a whole or not at all.

    Writers do not wait for each other. Where two change a bucket at once, the first one's change stays, and
    the other makes its own anew upon it: it then finds the values that the first one has numbered.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.buckets = Buckets(spark, path, SCHEMAS, "chat_id", buckets)

    def read(self, chats: DataFrame | None = None) -> Vault:
        """The vault, or the buckets of some chats."""
        return _vault(self.buckets.read(None if chats is None else self.buckets.touched(chats)))

    def change(self, rows: DataFrame, step: Callable[[Vault, DataFrame], Vault], before: Snapshot | None = None) -> Vault:
        """The buckets of the chats of ``rows`` after ``step``, a function from a vault and the rows whose chats it has.

        ``before`` is what a writer has read already; it is read now otherwise.
        """
        which = self.buckets.touched(rows)
        left = which
        while left:
            before = before or self.buckets.read(left)
            after = step(_vault(before), self.buckets.of(rows, list(before.versions)))
            left, before = self.buckets.commit(after._asdict(), before), None
        return _vault(self.buckets.read(which))

    def upsert(self, mentions: DataFrame, order: list[str], now: Column, key: bytes, ttl: int | Column = TTL_SECONDS, secret: bytes | None = None, key_id: int = 1, mode: str = "dense", before: Snapshot | None = None) -> Vault:
        """See ``vault.upsert``."""
        return self.change(mentions, lambda known, part: vault.upsert(known, part, order, now, key, ttl, secret, key_id, mode), before)

    def purge(self, chats: DataFrame, now: Column) -> Vault:
        """Expired rows of some chats go."""
        return self.change(chats, lambda known, part: Vault(*(vault.purge(table, now, part) for table in known)))

    def renew(self, chats: DataFrame, now: Column, ttl: int | Column = TTL_SECONDS) -> Vault:
        """What lives of some chats lives on from now."""
        return self.change(chats, lambda known, part: vault.renew_chats(known, part, now, ttl))

    def mask(self, messages: DataFrame, now: Column, **options) -> engine.Masked:
        """``engine.mask_messages`` upon the store: chats whose bucket another request has changed meanwhile are masked anew.

        The result's vault has the buckets of the request's chats. A chat's messages are masked with the
        placeholders that its committed bucket has.
        """
        which = self.buckets.touched(messages)
        left, parts = which, []
        while left or not parts:
            before = self.buckets.read(left)
            part = self.buckets.of(messages, left)
            lost: list[int] = []

            def keep(after: Vault, before=before, lost=lost) -> Vault:
                lost += self.buckets.commit(after._asdict(), before)
                return _vault(self.buckets.read(list(before.versions)))

            made = engine.mask_messages(part, _vault(before), now, keep=keep, **options)
            done = [b for b in left if b not in lost]
            parts.append(made._replace(vault=made.vault, **{name: self.buckets.of(getattr(made, name), done) for name in ("messages", "detections", "maps", "summary")}))
            left = lost
        first, *others = parts
        for other in others:
            first = first._replace(**{name: getattr(first, name).unionByName(getattr(other, name)) for name in ("messages", "detections", "maps", "summary")})
        return first._replace(vault=_vault(self.buckets.read(which)))


def _vault(at: Snapshot) -> Vault:
    return Vault(at.tables["mappings"], at.tables["counters"])
