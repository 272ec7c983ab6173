"""The rollup of detections over documents with values of every kind."""

from veil.plans import QUERIES


def test_rollup_counts_addresses_of_version_4(spark, tmp_path):
    texts = ["host 10.0.0.1 and 192.168.1.20", "a@b.example or ::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", None, ""]
    rows = [(i, t, "web" if i else "mail") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.entity_type): r.n_detections for r in QUERIES["pii_rollup"](spark, str(tmp_path)).collect()}
    want = {("mail", "IP_ADDRESS"): 2, ("web", "IP_ADDRESS"): 2, ("web", "EMAIL"): 1, ("mail", None): 2, ("web", None): 3, (None, None): 5}
    assert got == want
