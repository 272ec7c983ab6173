from pyspark.sql import functions as F

from veil.functions.scan import placeholder_type, vault_key
from veil.operators import masking, report

MAP = {"Robert Plant": "[PERSON_1]", "Plant": "[PERSON_2]", "+385 91 234 5678": "[PHONE_1]", "@jdoe": "[USERNAME_1]", "a.b*c\\E": "[SECRET_1]"}


def remask(spark, text, known=None):
    df = spark.createDataFrame([(text, MAP if known is None else known)], "t string, m map<string,string>")
    row = df.select(masking.remask(F.col("t"), F.col("m")).alias("out"), masking.remask_spans(F.col("t"), F.col("m")).alias("s")).first()
    return row.out, [(s.start, s.end, s.placeholder, s.entity_type) for s in row.s]


def test_remask_longest_first_and_whole_words(spark):
    out, spans = remask(spark, "😀 Robert Plant, Plantation, Plant @jdoe +385 91 234 5678 plant")
    assert out == "😀 [PERSON_1], Plantation, [PERSON_2] [USERNAME_1] [PHONE_1] plant"
    assert spans[0] == (2, 14, "[PERSON_1]", "PERSON")


def test_remask_escapes_and_edges(spark):
    assert remask(spark, "x a.b*c\\E y")[0] == "x [SECRET_1] y"
    assert remask(spark, "čPlant Plant")[0] == "čPlant [PERSON_2]"
    assert remask(spark, "Plant", {}) == ("Plant", [])


def test_offsets_go_back(spark):
    text = "Ana Kos and Robert Plant met @jdoe here"
    masked, _ = remask(spark, text)
    df = spark.createDataFrame([(text, MAP, i) for i in range(len(masked))], "t string, m map<string,string>, i int")
    got = [r.o for r in df.orderBy("i").select(masking.original_offset(F.col("i"), masking.remask_spans(F.col("t"), F.col("m"))).alias("o")).collect()]
    for place in ("Ana", "and", "met", "here"):
        assert got[masked.index(place)] == text.index(place)
    assert got[masked.index("PERSON_1")] is None


def restore(spark, text, known):
    df = spark.createDataFrame([(text, known)], "t string, m map<string,string>")
    return df.select(masking.restore(F.col("t"), F.col("m")).alias("r")).first().r.asDict()


def test_restore_is_one_pass(spark):
    got = restore(spark, "[A_1] [B_2] [A_1] [C_9]", {"[A_1]": "x [B_2]", "[B_2]": "y"})
    assert got == {"text": "x [B_2] y x [B_2] [C_9]", "restored": ["[A_1]", "[B_2]"], "unknown": ["[C_9]"]}


def test_restore_without_a_map_reports_nothing(spark):
    assert restore(spark, "[C_9]", {}) == {"text": "[C_9]", "restored": [], "unknown": []}
    assert restore(spark, "[C_9]", None)["text"] == "[C_9]"
    assert restore(spark, None, {"[A_1]": "x"})["text"] is None


def test_vault_key_and_type(spark):
    values = ["45 Baggot Street Lower,\nDublin 2", " a  b\t c\r\nd ", "x y", "Éa", "Éa"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(vault_key(F.col("v")).alias("k"))
    assert [r.k for r in df.collect()] == ["45 Baggot Street Lower, Dublin 2", "a b c d", "x y", "Éa", "Éa"]
    df = spark.createDataFrame([("[HR_OIB_12]",), ("PERSON",)], "p string").select(placeholder_type(F.col("p")).alias("t"))
    assert [r.t for r in df.collect()] == ["HR_OIB", None]


def test_report_leaves_out_parts_of_longer_values(spark):
    rows = [("Ana Kos and Kos and Ana Kos", [("PERSON", 0, 7, 1.0, "PERSON", "Ana Kos", "[PERSON_1]", "Ana Kos"), ("PERSON", 12, 15, 1.0, "PERSON", "Kos", "[PERSON_1]", "Ana Kos")])]
    df = spark.createDataFrame(rows, f"t string, e {masking.ENTRIES}").select(report.mask_report(F.col("t"), F.col("e")).alias("r"))
    assert [(r.value, r.n, r.first) for r in df.first().r] == [("Ana Kos", 2, 0)]
