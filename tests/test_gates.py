"""Gates against the recognizers without them."""

import random
import re

from pyspark.sql import functions as F

from veil.operators.recognizers import DIGITS, LONG, REGISTRY, detect, recognize


def test_gates_lose_nothing_and_are_looked_for_once(spark):
    rng = random.Random(3)
    parts = ["79927398713", "4539 1488 0343 6467", "10.0.0.1", "٣.٣.٣.٣", "1::2", "::1", "fe80:1:2:3:4:5:6:7", "943 476 5919", "AB123456C", "1234567TW", "HR1210010051863000160", "a@b.co", "token=abcdef12", "+385 91 234 5678", "123-45-6789", "12-3456789", "UTR 1234567890", "šđčćžšđ", "x", "19.99"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "-", ", "]) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = F.coalesce(F.concat(*(recognize(F.col("text"), r, k) for k, r in enumerate(REGISTRY))), F.array())
    rows = docs.select("doc_id", detect(F.col("text")).alias("got"), every.alias("want")).collect()
    assert all(r.got == r.want for r in rows) and sum(len(r.got) for r in rows) > 300
    plan = docs.select(detect(F.col("text")))._jdf.queryExecution().analyzed().toString()
    looked = re.findall(r"RLIKE\(text#\d+, (.*?)\)(?= |,|\)|$)", plan, re.I)
    assert all(len(re.findall(rf"RLIKE\(text#\d+, {re.escape(g)}\)", plan, re.I)) == 1 for g in {DIGITS, *LONG}), looked[:20]
