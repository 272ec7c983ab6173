"""Secret scans over a ledger of content-addressed texts, in DataFrame functions only."""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.scan import placed
from veil.llm.names import spare
from veil.sources import read_table, shared_dir

#: (kind, pattern, group whose length counts, least length), in the order of ties. Fixed values of the contract.
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Spans that the method adds.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
#: A private key to its END line; without one, its header lines and the base64 lines after them, the last
#: of which may be short. Quotes, comment signs and escaped line feeds may stand between the lines.
_BETWEEN = r"""[\s"'>|#*,+\\]*+"""
WHOLE_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BETWEEN}[A-Z][A-Za-z0-9]*+-[A-Za-z0-9-]++:[^\n\\]*+)*+(?:{_BETWEEN}[A-Za-z0-9+/]{{16,}}+=*+)*+"
    rf"(?:(?<=[A-Za-z0-9+/]{{16}}){_BETWEEN}(?:[A-Za-z0-9+/]{{1,15}}+={{1,2}}|(?<=[\n\\])n?[A-Za-z0-9+/]{{1,15}}+(?![^\s\"'\\])(?=[\x20\t\"',]*(?:[\r\n\\]|$))))?)"
)
#: What is cut out of texts: the kind pem of RULES, which the SQL of op5_secrets fixes, ends with its header line.
REDACTED = tuple((kind, WHOLE_PEM if kind == "pem" else pattern, *more) for kind, pattern, *more in RULES)
#: Spans that may be broadcast to the documents; where there are more, they are joined.
MOST_SPANS = 200_000
#: Pieces into which the copies of a text are dealt where its spans are joined to them.
SALTS = 16
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, rank: int, rule: tuple) -> Column:
    """Matches of one rule with offsets in code points.

    There is no function for offsets, but the text between the matches gives them: a match starts where
    the one before ended, plus the length of what lies between. ``length`` counts code points.
    """
    kind, pattern, group, least = rule
    literal = F.lit(pattern)
    matches = F.regexp_extract_all(text, literal, F.lit(0))
    counted = F.regexp_extract_all(text, literal, F.lit(group)) if group else matches
    found = F.zip_with(placed(F.split(text, pattern, -1), matches), counted, lambda m, c: F.struct(m["start"], m["end"], F.length(c).alias("n")))
    long_enough = F.filter(found, lambda s: s["n"] >= least)
    made = F.transform(long_enough, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.when(F.rlike(text, literal), made).otherwise(F.array().cast(SPAN))


def find_spans(text: Column, rules: tuple = RULES) -> Column:
    """All spans of all rules in a text, by start and then by the order of the rules."""
    return F.array_sort(F.concat(*(_spans(text, k, r) for k, r in enumerate(rules))).cast(SPAN))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def version_of(rules: tuple) -> str:
    """Part of the ledger's key: a change of rules scans every text again."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def update_ledger(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Scan the texts that the ledger has not seen under these rules, append them, return its rows.

    The ledger is a Parquet folder of ``blob`` (SHA-256 of the text), ``version`` (of the rules) and ``spans``; a
    text without findings has a row too, so that it is never read again. Copies of a text, however many,
    are one blob and are combined before the shuffle. A blob that two writers added at once counts once.
    """
    spark, version = docs.sparkSession, version_of(rules)
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    blobs = texts.withColumn("blob", blob_id(F.col("text"))).dropDuplicates(["blob"])
    known = _exists(spark, ledger)
    if known:
        seen = spark.read.parquet(ledger).where(F.col("version") == version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    scanned = blobs.select("blob", F.lit(version).alias("version"), find_spans(F.col("text"), rules).alias("spans"))
    scanned.write.mode("append").parquet(ledger)
    rows = spark.read.parquet(ledger).where(F.col("version") == version).select("blob", "spans")
    return rows.dropDuplicates(["blob"]) if known else rows


def new_ledger(spark: SparkSession) -> str:
    """A path for a ledger that lives as long as the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/veil-ledger-{uuid.uuid4().hex}"


def _with_spans(docs: DataFrame, ledger: str | None, text_col: str, rules: tuple = RULES) -> tuple[DataFrame, str]:
    """``docs`` with the spans of each text, and the name of that column.

    The texts with findings are few as a rule and are sent to where the documents are. Where they have more
    than MOST_SPANS spans, they are joined, with the documents of one text dealt to SALTS tasks.
    """
    blob, spans, salt = spare(docs, "blob", "spans", "salt")
    found = update_ledger(docs, ledger or new_ledger(docs.sparkSession), text_col, rules).where(F.size("spans") > 0)
    many = (found.agg(F.sum(F.size("spans"))).first()[0] or 0) > MOST_SPANS
    found = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    keyed = docs.withColumn(blob, blob_id(F.col(text_col)))
    if many:
        others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
        keyed = keyed.withColumn(salt, F.pmod(F.xxhash64(*others), F.lit(SALTS)) if others else F.lit(0).cast("long"))
        found = found.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined_back = keyed.join(found, [blob, salt], "left").drop(blob, salt)
    else:
        joined_back = keyed.join(F.broadcast(found), blob, "left").drop(blob)
    return joined_back.withColumn(spans, F.coalesce(spans, F.array().cast(SPAN))), spans


def scan_secrets(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``secrets``, its spans as an array of structs.

    A null text counts as empty and has no spans. Repeated rows give repeated rows, an empty table an
    empty result; other columns are not looked at. Without ``ledger`` every text counts as unseen.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, spans = _with_spans(source, ledger, "text")
    return rows.select("doc_id", F.col(spans).alias("secrets"))


def redact(docs: DataFrame, ledger: str | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``, private keys whole; overlapping spans are one.

    Null and empty texts, and texts without a secret, stay as they are, as do all other columns; repeated
    rows give repeated rows and an empty table an empty one.
    """
    rows, spans = _with_spans(docs, ledger, text_col, REDACTED)
    found, text = F.col(spans), F.col(text_col)

    def cut(acc, s):
        ahead = s["start"] >= acc["at"]
        piece = F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(found, start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size(found) > 0, whole).otherwise(text)).select(*docs.columns)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    s = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(s, lambda x: x["rank"] < len(BASE_RULES))
    return found.select("doc_id", *(count(r[0]) for r in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"))


def _sql() -> str:
    ctes, lists = [], []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        quoted = pattern.replace("'", "''")
        ctes.append(f"""
m{k} AS (
  SELECT r, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS g,
    string_split_regex(t, '{quoted}') AS p FROM d),
s{k} AS (
  SELECT r, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      's': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
      'k': {k}, 'n': length(g[i]), 'l': length(m[i])}}), lambda x: x.n >= {least}) AS s{k} FROM m{k})""")
        lists.append(f"list_transform(s{k}, lambda x: {{'s': CAST(x.s AS BIGINT), 'k': x.k, 'e': CAST(x.s + x.l AS BIGINT)}})")
    names = "[" + ", ".join(f"'{r[0]}'" for r in RULES) + "]"
    uses = " ".join(f"JOIN s{k} USING (r)" for k in range(len(RULES)))
    show = f"lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e"
    counts = ", ".join(f"CAST(len(s{k}) AS BIGINT) AS n_{r[0]}" for k, r in enumerate(BASE_RULES))
    all_of = lambda n: "list_sort(" + " || ".join(lists[:n]) + ")"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), {",".join(ctes)}
SELECT doc_id, {counts},
  sha256(array_to_string(list_transform({all_of(len(BASE_RULES))}, {show}), ',')) AS base_sha256,
  array_to_string(list_transform({all_of(len(RULES))}, {show}), ',') AS spans
FROM d {uses}"""


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL = {"op5_secrets": _sql()}
