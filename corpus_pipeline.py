"""From raw documents to a training mixture: five stages, each one operator of ``veil.llm``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import op1_simhash, op3_mixing, op5_secrets, op8_langid, op9_decontaminate
from veil.sources import drop_table, materialize, read_table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a language that the labelled documents teach; texts without letters or without a main language go.

    Null and empty texts have no letters. Repeated rows stay or go together; other columns pass; an empty table gives an empty one.
    """
    return op8_langid.keep_identified(docs, op8_langid.train(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id.

    Null and empty texts are one group. Of repeated rows one stays; other columns pass; an empty table gives an empty one.
    """
    return op1_simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with benchmark passages.

    Null and empty texts stay, as do repeated rows that are clean; other columns pass; an empty table gives an empty one.
    """
    return op9_decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays, with its new length where ``n_chars`` is a column.

    A null text stays null and has a null length. Repeated rows stay repeated; other columns pass; an empty table gives an empty one.
    """
    out = op5_secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin out documents so that all sources bring as many characters, in a random order.

    Null sources are one source. Null and empty texts take part with their source's rate, which is 1 where a source has no
    characters. Repeated rows have equal counts; other columns pass; an empty table gives an empty one.
    """
    return op3_mixing.mix(docs)


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]
#: The stages need a trained model and hashes that SQL does not have; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again.

    A stage's table is deleted once that of the next one is written; the last one is read by the result.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            if before is not None:
                drop_table(before)
            before = docs
    return docs
