"""URL filter: rules by host and path, and a likelihood ratio of two character language models for the rest."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.counts import HOLD, POOLS, bounded, rows_of, summed, table
from veil.sources import drop_table, materialize, read_table, ship

#: (host, path, verdict). Fixed values of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Longest context of the character models.
ORDER = 4
#: Symbols in their contexts that are sent to the workers; all others are joined.
MOST = 1 << 20
#: Parts of a nat in which values are summed.
SCALE = 1 << 24
#: Pseudo-count by which a longer context leans on the next shorter one.
LEAN = 2.0
#: Steps of the calibration's histogram over log-likelihood differences a character, from -REACH to REACH.
STEPS, REACH = 2000, 5.0
#: One labelled URL in this many, by the CRC-32 of the URL, calibrates and does not train.
FOLDS = 5
STEP_BYTES = 1 << 20


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def codes(urls: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of (context, symbol) and of the context alone, one row for each order, and the URL of each symbol.

    A URL is its bytes and an end, line feed, with line feeds before the first byte.
    """
    pad = b"\n" * order
    stream = np.frombuffer(b"".join(pad + u + b"\n" for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 + order for u in urls])
    owner = np.repeat(np.arange(len(urls)), sizes)
    keep = np.arange(len(stream)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= order
    context = np.zeros(len(stream), np.int64)
    nodes, contexts = [], []
    for o in range(order + 1):
        if o:
            context = context.copy()
            context[o:] |= stream[:-o] << (8 * (o - 1))
        contexts.append((context | (o << 40))[keep])
        nodes.append(((context << 8) | stream | ((8 + o) << 40))[keep])
    return np.stack(nodes), np.stack(contexts), owner[keep]


class CharModel:
    """Counts of two variable-order Markov models: ``counts[row, class]`` (see ``counts.rows_of``), allow and block."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, distinct: int, order: int = ORDER):
        self.keys, self.order = keys, order
        # A pool's count is shared by those that may be in it.
        self.counts = counts
        self.counts[len(keys) :] /= max(1.0, (distinct - len(keys)) / POOLS)

    def difference(self, urls: list[bytes]) -> np.ndarray:
        """Log-likelihood of each URL as accepted less that as rejected, a character."""
        if not urls:
            return np.zeros(0)
        nodes, contexts, owner = codes(urls, self.order)
        p = np.full((nodes.shape[1], 2), 1 / 256)
        for node, context in zip(nodes, contexts, strict=True):
            p = (self.counts[rows_of(self.keys, node)] + LEAN * p) / (self.counts[rows_of(self.keys, context)] + LEAN)
        logs = np.log(np.maximum(p, 1e-12))
        total = [np.bincount(owner, logs[:, k], len(urls)) for k in range(2)]
        return (total[0] - total[1]) / (np.array(list(map(len, urls))) + 1)


def _pieces(urls: list[bytes]):
    """Slices of a list of about STEP_BYTES each."""
    start, size = 0, 0
    for i, u in enumerate(urls):
        size += len(u)
        if size >= STEP_BYTES:
            yield urls[start : i + 1]
            start, size = i + 1, 0
    if start < len(urls):
        yield urls[start:]


def counted(labelled: DataFrame) -> DataFrame:
    """``key, k, n``: the contexts and symbols of all URLs of ``labelled`` (``url`` binary, ``block`` boolean); tasks count before anything is shuffled."""

    def run(batches):
        held: list[list[tuple]] = [[], []]

        def emit():
            for k, parts in enumerate(held):
                if parts:
                    key, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), k, np.int32)), pa.array(n)], names=["key", "k", "n"])
                parts.clear()

        for batch in batches:
            urls, block = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in (0, 1):
                for piece in _pieces([u for u, b in zip(urls, block, strict=True) if b == bool(k)]):
                    nodes, contexts, _ = codes(piece)
                    held[k].append(summed(np.r_[nodes.ravel(), contexts.ravel()], np.ones(2 * nodes.size, np.int64)))
                if sum(len(x) for x, _ in held[k]) > HOLD:
                    held[k] = [summed(*(np.concatenate(x) for x in zip(*held[k], strict=True)))]
            if sum(len(x) for parts in held for x, _ in parts) > HOLD:
                yield from emit()
        yield from emit()

    return labelled.select("url", "block").mapInArrow(run, "key long, k int, n long").groupBy("key", "k").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, most: int = MOST) -> CharModel:
    """A model for one process. Beyond ``most`` keys the rarest are pooled; ``judge`` does not use it and has no such bound."""
    counts = materialize(counted(labelled))
    got, distinct = bounded(counts, most).select("key", "k", "n").toArrow(), counts.select("key").distinct().count()
    drop_table(counts)
    return CharModel(*table(*(got.column(c).to_numpy() for c in ("key", "k", "n")), 2), distinct)


def values(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``code, value, n``: for each context of ORDER bytes and symbol that stands in ``urls`` (``raw`` binary), its log-likelihood
    as accepted less that as rejected in parts of 1 / SCALE, and how often it stands there. All counts are joined, none is pooled."""

    def run(batches):
        held = []

        def emit():
            code, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for piece in _pieces(batch.column(0).to_pylist()):
                node = codes(piece)[0][-1]
                held.append(summed(node, np.ones(len(node), np.int64)))
            if sum(len(x) for x, _ in held) > HOLD:
                yield emit()
        if held:
            yield emit()

    # A code's key of each order: the symbol with the last bytes of its context, and those bytes alone.
    symbol, context = F.col("code") % 256, F.shiftright(F.col("code"), 8) % F.lit(1 << 32)
    last = [context % F.lit(1 << (8 * o)) for o in range(ORDER + 1)]
    asked = [x for o, c in enumerate(last) for x in (c * 256 + symbol + F.lit((8 + o) << 40), c + F.lit(o << 40))]
    found = urls.select("raw").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    wide = counts.groupBy("key").agg(*(F.sum(F.when(F.col("k") == k, F.col("n"))).alias(f"n{k}") for k in (0, 1)))
    met = found.select("code", "n", F.posexplode(F.array(*asked)).alias("o", "key")).join(wide, "key", "left")
    of = lambda o, k: F.coalesce(F.sum(F.when(F.col("o") == o, F.col(f"n{k}"))), F.lit(0)).alias(f"c{k}_{o}")
    rows = met.groupBy("code").agg(F.first("n").alias("n"), *(of(o, k) for o in range(2 * ORDER + 2) for k in (0, 1)))
    for k in (0, 1):
        rows = rows.withColumn(f"p{k}", F.lit(1 / 256))
        for o in range(ORDER + 1):
            rows = rows.withColumn(f"p{k}", (F.col(f"c{k}_{2 * o}") + LEAN * F.col(f"p{k}")) / (F.col(f"c{k}_{2 * o + 1}") + LEAN))
    log = [F.log(F.greatest(F.col(f"p{k}"), F.lit(1e-12))) for k in (0, 1)]
    return rows.select("code", F.round((log[0] - log[1]) * SCALE).cast("long").alias("value"), "n")


def _scores(rows: DataFrame, known: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` with column ``llr``; their column ``raw`` is the URL in binary, and ``known`` the ``values`` of their codes.

    The ``most`` most frequent codes are a table in each worker, all others are joined. Sums are of integers, so that no bound and no order changes them.
    """
    got = known.orderBy(F.desc("n"), "code").limit(most).select("code", "value").toArrow()
    code, value = (got.column(c).to_numpy().astype(np.int64) for c in ("code", "value"))
    order = np.argsort(code)
    sent = rows.sparkSession.sparkContext.broadcast((code[order], value[order]))
    schema = rows.select("*", F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("rest")).schema
    at = rows.columns.index("raw")

    def run(batches):
        keys, held = sent.value
        for batch in batches:
            sums, rest = [], []
            for piece in _pieces(batch.column(at).to_pylist()):
                nodes, _, owner = codes(piece)
                place = np.minimum(np.searchsorted(keys, nodes[-1]), max(len(keys) - 1, 0))
                hit = keys[place] == nodes[-1] if len(keys) else np.zeros(len(owner), bool)
                total = np.zeros(len(piece), np.int64)
                np.add.at(total, owner[hit], held[place[hit]])
                sums.append(total)
                ends = np.cumsum(np.bincount(owner[~hit], minlength=len(piece)))[:-1]
                rest += [x.tolist() for x in np.split(nodes[-1][~hit], ends)]
            made = [pa.array(np.concatenate([*sums, np.zeros(0, np.int64)])), pa.array(rest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    scored = rows.mapInArrow(run, schema)
    # What is not in the table is summed by URL; where all is, this join has no rows.
    cold = scored.where(F.size("rest") > 0).select("raw", "rest").dropDuplicates(["raw"])
    more = cold.select("raw", F.explode("rest").alias("code")).join(known, "code").groupBy("raw").agg(F.sum("value").alias("more"))
    total = F.col("sum") + F.coalesce("more", F.lit(0))
    return scored.join(more, "raw", "left").withColumn("llr", total / SCALE / (F.length("raw") + 1)).select(*rows.columns, "llr")


def calibrate(scored: DataFrame) -> float:
    """Threshold of ``llr`` with the best mean of both classes' accuracies, from a histogram of fixed size."""
    at = F.floor((F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("llr"))) + REACH) * (STEPS / (2 * REACH))).cast("int")
    n = np.zeros((2, STEPS + 1))
    for k, block, c in scored.groupBy(at.alias("k"), "block").count().collect():
        n[int(block), k] += c
    if not n.sum(axis=1).all():
        return 0.0
    below = np.cumsum(n, axis=1) - n  # what lies below each edge is blocked
    share = (1 - below[0] / n[0].sum() + below[1] / n[1].sum()) / 2
    best = np.flatnonzero(share >= share.max() - 1e-12)
    return float(best[len(best) // 2] * 2 * REACH / STEPS - REACH)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, most: int = MOST) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, llr``.

    The longest fitting rule decides. URLs that fit a rule are the labelled ones: four in five train the
    two models, one in five (by CRC-32) sets the threshold; all others get the models' verdict. A null URL
    or one without ``://`` has an empty host and path and is judged by its characters (none, if null).
    Without training URLs everything unruled is allowed. Repeated rows give repeated rows, and other columns
    are not looked at. Each symbol's value is exact at any size: counts are joined with the different symbols in
    their contexts, and never pooled.
    """
    ship(pages.sparkSession)
    url = F.col("url")
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    source = source.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = source.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    labelled = ruled.where("found is not null").select(url.cast("binary").alias("url"), (F.col("found.verdict") == "block").alias("block"))
    calibrates = F.pmod(F.crc32("url"), F.lit(FOLDS)) == 0
    counts = materialize(counted(labelled.where(~calibrates)))
    raw = ruled.select(F.coalesce(url, F.lit("")).cast("binary").alias("raw"), "page_id", "host", "path", "found")
    known = materialize(values(raw, counts))
    drop_table(counts)
    threshold = calibrate(_scores(labelled.where(calibrates).withColumnRenamed("url", "raw"), known, most))
    verdict = F.coalesce("found.verdict", F.when(F.col("llr") < threshold, "block").otherwise("allow"))
    return _scores(raw, known, most).select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "llr")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages")).drop("llr")


QUERIES = {"op7_urls": op7_urls}
ORACLE_SQL: dict[str, str] = {}
