"""Owners and documents for each owner decide whether an opaque token is live."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthmatch.llm.secret_scan import MOST_DOCUMENTS, redact_secrets, scan_secrets


def test_owners_and_documents(spark):
    example, leaked, two = "Ab1Cd2Ef3Gh4Ij5Kl6Mn", "Zx9Kq2Lm8Wp4Rt6Yv1Nb", "Qa7Ws8Ed9Rf1Tg2Yh3Uj"
    rows = [(k, f"see {example} here", "hot") for k in range(3000)]
    rows += [(5000 + k, f"mine {leaked}", f"s{k}") for k in range(3)]
    rows += [(6000 + k, f"ours {two}", f"s{k}") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = {r.doc_id: r.spans for r in scan_secrets(df).collect()}
    clean = {r.doc_id: r.text for r in redact_secrets(df).collect()}
    # In many documents of one source: an example, in all of them.
    assert all(spans[k] == "" and clean[k] == f"see {example} here" for k in range(3000))
    # In three documents of three sources: copied. Two sources: live.
    assert all(spans[5000 + k] == "" and clean[5000 + k] == f"mine {leaked}" for k in range(3))
    assert all(spans[6000 + k] == "opaque:5:25" and clean[6000 + k] == "ours [secret]" for k in range(2))


def test_limit_of_documents(spark):
    within, beyond = "Ab1Cd2Ef3Gh4Ij5Kl6Mn", "Zx9Kq2Lm8Wp4Rt6Yv1Nb"
    # The limit is for each owner; repeated rows and repeated tokens are one document.
    rows = [(k, f"{within} {within}", f"s{k % 2}") for k in range(2 * MOST_DOCUMENTS)] * 2
    rows += [(1000 + k, beyond, f"s{k % 2}") for k in range(2 * MOST_DOCUMENTS + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = scan_secrets(df).collect()
    assert len(got) == len(rows)
    assert all(r.spans == ("opaque:0:20,opaque:21:41" if r.doc_id < 1000 else "") for r in got)


def test_odd_columns(spark):
    df = spark.createDataFrame([(1, "token=abcdef", "s", 5, "x")], "doc_id long, text string, source string, owner int, `a.b` string")
    row = scan_secrets(df.withColumn("secret_spans", F.lit(0))).first()
    assert row["owner"] == 5 and row["a.b"] == "x" and row["spans"] == "assign:0:12"
