import pytest
from pyspark.sql import functions as F

from veil.functions import checksums as c
from veil.operators.recognizers import REGISTRY, Recognizer, detect, iban, registry

CASES = {
    "oib": (c.oib, "12345678903 98765432106 00000000001", "12345678901 00000000000 11111111111 12345678900 1234567890x"),
    "jmbg": (c.jmbg, "0101990123455 1505867100235", "0101990500006 1234567890123 0000000000001 999999999999X 12345678"),
    "iban": (
        c.mod97,
        "HR1210010051863000160 HR6023600001101234567 IE26AAAA11111111111111 RO76AAAA1111111111111111 GB53AAAA11111111111111 DE89370400440532013000",
        "HR0000000000000000000 HR9912345678901234567 HR1110010051863000160 IE00AAAA11111111111111 GB00AAAA11111111111111 IE99XXXX222222222222222222",
    ),
    "ppsn": (c.ppsn, "1234567T 9876543H 1234567FA 9876543CB", "1234567A 9999999A 1234567TZ ABC4567T"),
    "cnp": (c.cnp, "1990515012343 2851220401232", "9990515012340 1991315012343 1990532012344 1990515992345 1990515012349"),
    "nino": (c.nino, "AB123456C JR876543A", "BG123456C GB123456A DA123456A AO123456A AB12345C"),
    "utr": (c.utr, "1234567890 0000000000", "12345 12345678901 abcdefghij"),
    "ssn": (c.ssn, "123-45-6789 001-01-0001 665-99-9999", "000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000"),
    "ein": (c.ein, "12-3456789 98-7654321", "123-456789 1-23456789 12-345678 ab-3456789"),
    "nhs": (c.nhs, "9434765919", "9434765918"),
    "luhn": (c.luhn, "4111111111111111", "4111111111111112"),
}


@pytest.mark.parametrize("name", CASES)
def test_validator(spark, name):
    check, good, bad = CASES[name]
    values = [(v, True) for v in good.split()] + [(v, False) for v in bad.split()] + [("", False), (None, False)]
    df = spark.createDataFrame(values, "v string, want boolean").select("v", "want", check(F.col("v")).alias("ok"))
    assert [(r.v, r.ok) for r in df.collect()] == values


def found(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(detect(F.col("t")).alias("s"))
    return {(s.entity_type, text[s.start : s.end]) for s in df.first().s}


def test_utr_span_is_without_its_keyword(spark):
    assert ("UK_UTR", "1234567890") in found(spark, "Reference: UTR 1234567890 due")


def test_grouped_iban_and_spaced_nino(spark):
    assert ("HR_IBAN", "HR12 1001 0051 8630 0016 0") in found(spark, "račun HR12 1001 0051 8630 0016 0.")
    assert ("UK_NINO", "AB 12 34 56 C") in found(spark, "NI AB 12 34 56 C")


def test_unicode_word_edges(spark):
    assert found(spark, "č12345678903") == set()
    assert ("HR_OIB", "12345678903") in found(spark, "😀 12345678903č?".replace("č", ""))


def test_registry_by_language():
    assert "UK_NHS" not in {r.entity_type for r in registry("hr")}
    assert len(registry("en")) == len(REGISTRY)
    assert iban("DE", 18, "DE_IBAN").pattern.endswith(r"\s?[A-Z0-9]{2}\b")


def test_context_raises_an_unchecked_score(spark):
    """A recognizer without check digits; one that has them scores 1 with and without context."""
    ticket = (Recognizer("TICKET", r"\bT-[0-9]{4}\b", 0.45, context=("ticket",)),)
    df = spark.createDataFrame([("ticket T-1234",), ("x T-1234",)], "t string").select(detect(F.col("t"), ticket).alias("s"))
    assert [[s.score for s in r.s] for r in df.collect()] == [[0.65], [0.45]]
    df = spark.createDataFrame([("EIN 12-3456789",), ("x 12-3456789",)], "t string").select(detect(F.col("t")).alias("s"))
    assert [[s.score for s in r.s if s.entity_type == "US_EIN"] for r in df.collect()] == [[1.0], [1.0]]
