"""Small hand-made records."""

from monthmatch.fixed_values import hash_fields


def record(number, date, balance="1000", kind="IND", code="CP", order=None, seq=None, **fields):
    row = {
        "SubscriberCode": code,
        "SubmissionType": kind,
        "FacilityAccNum": f"F{number}",
        "CustomerID": f"C{number}",
        "DisbursementDate": date,
        "CurBal": balance,
        "CreditFacilityType": "LOAN",
        **{f: fields.get(f, "") for f in hash_fields(kind)},
        "RowOrder": order if order is not None else 0,
    }
    if seq is not None:
        row["SequenceNumber"] = seq
    return row


def frame(spark, rows, kind="IND", seq=False):
    columns = (
        "SubscriberCode SubmissionType FacilityAccNum CustomerID DisbursementDate CurBal"
        " CreditFacilityType"
    ).split() + list(hash_fields(kind))
    schema = ", ".join(f"{c} STRING" for c in columns) + ", RowOrder BIGINT"
    if seq:
        schema += ", SequenceNumber BIGINT"
    names = [part.split()[0] for part in schema.split(", ")]
    numbered = [
        {**row, "RowOrder": row["RowOrder"] or position} for position, row in enumerate(rows, 1)
    ]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in numbered], schema)


def unl(spark, keys, kind="IND"):
    rows = [("CP", kind, f"F{n}", f"C{n}", resolved) for n, resolved in keys]
    return spark.createDataFrame(
        rows,
        "SubscriberCode STRING, SubmissionType STRING, FacilityAccNum STRING, CustomerID STRING,"
        " Resolved BOOLEAN",
    )
