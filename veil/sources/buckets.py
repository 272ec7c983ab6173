"""Tables in buckets by the hash of a key: a change reads and writes only the buckets of its keys, and no other writer's change is lost."""

import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


class Snapshot(NamedTuple):
    """Some buckets at one time: ``versions`` has the number of each one's last change, ``tables`` their rows by name."""

    versions: dict[int, int]
    tables: dict[str, DataFrame]


class Buckets:
    """Tables of ``schemas`` (all with the column ``key``) under ``path``, a folder that the driver and all executors share.

    ``log/<bucket>/<version>`` names the folder that has a bucket's rows since that change. Folders are
    written once and never changed. A change is made when its file takes its name in the log, which only one writer
    can do: the folder must be on a store that renames atomically and not over another file, as HDFS does.
    The number of buckets is fixed by the first writer and kept in ``log/buckets``.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], key: str, buckets: int = 64):
        self.spark, self.path, self.schemas, self.key = spark, path.rstrip("/"), schemas, key
        jvm = spark._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._name("log/buckets", str(buckets))
        self.buckets = int(self._content("log/buckets"))

    def _name(self, name: str, content: str) -> bool:
        """Whether a file with ``content`` could take ``name``; nobody ever sees it in part."""
        draft = self._jpath(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(content.encode())
        out.close()
        target = self._jpath(f"{self.path}/{name}")
        self._fs.mkdirs(target.getParent())
        try:
            self._context.rename(draft, target, self._none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def _content(self, name: str) -> str:
        data = self._fs.open(self._jpath(f"{self.path}/{name}"))
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of ``rows``: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def of(self, rows: DataFrame, which: list[int]) -> DataFrame:
        """Rows whose keys are in some of the buckets."""
        return rows if len(which) == self.buckets else rows.where(self.bucket().isin(which))

    def _last(self, bucket: int) -> tuple[int, str | None]:
        folder = self._jpath(f"{self.path}/log/{bucket:05d}")
        if not self._fs.exists(folder):
            return 0, None
        version = max(int(f.getPath().getName()) for f in self._fs.listStatus(folder))
        return version, self._content(f"log/{bucket:05d}/{version:010d}")

    def read(self, which: list[int] | None = None) -> Snapshot:
        """Some buckets, or all, as they are now; later changes do not show in the tables."""
        which = list(range(self.buckets)) if which is None else which
        last = {b: self._last(b) for b in which}
        tables = {}
        for name, schema in self.schemas.items():
            paths = (f"{self.path}/data/{folder}/{name}/{BUCKET}={b}" for b, (_, folder) in last.items() if folder)
            paths = [p for p in paths if self._fs.exists(self._jpath(p))]  # a bucket without rows has no folder
            tables[name] = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return Snapshot({b: version for b, (version, _) in last.items()}, tables)

    def commit(self, tables: dict[str, DataFrame], before: Snapshot) -> list[int]:
        """Put ``tables`` in place of what ``before`` had; returns the buckets that another writer has changed since, which stay as they are."""
        folder = uuid.uuid4().hex
        for name, rows in tables.items():
            kept = rows.select(*(f.name for f in self.spark.createDataFrame([], self.schemas[name]).schema), self.bucket().alias(BUCKET))
            kept.repartition(min(self.buckets, max(1, len(before.versions))), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}/{name}")
        return [b for b, version in before.versions.items() if not self._name(f"log/{b:05d}/{version + 1:010d}", folder)]

    def vacuum(self) -> int:
        """Delete folders that no bucket's last change names, once no reader of earlier ones is left; returns how many."""
        used = {self._last(b)[1] for b in range(self.buckets)}
        data = self._jpath(f"{self.path}/data")
        gone = [f.getPath() for f in self._fs.listStatus(data) if f.getPath().getName() not in used] if self._fs.exists(data) else []
        return sum(bool(self._fs.delete(p, True)) for p in gone)
