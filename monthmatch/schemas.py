"""Schemas of the registry datasets.

Each dataset is a folder of Parquet files that is only ever appended to. All
carry ``BatchID``, and rows count once that batch is listed in ``commits``.
"""

from __future__ import annotations

_KEY = "SubscriberCode STRING, SubmissionType STRING, FacilityAccNum STRING, CustomerID STRING"
_FILE_ORDER = "PartName STRING, BlockStart BIGINT, RowIndex BIGINT"

DATASETS: dict[str, tuple[str, tuple[str, ...]]] = {
    # name: (columns, partition columns)
    "subscribers": (
        "SubscriberID BIGINT, SubscriberCode STRING, SubscriberName STRING, BatchID STRING",
        (),
    ),
    "submissions": (
        "SubmissionID BIGINT, SubscriberID BIGINT, ReportingPeriod STRING, SubmissionType STRING,"
        " SequenceNumber BIGINT, FileName STRING, RecordCount BIGINT, UploadedAt TIMESTAMP,"
        " BatchID STRING",
        (),
    ),
    # Rows as they came, with ids and parsed values: written straight from the
    # files without a shuffle. The wide payload stays here.
    "submitted": (
        f"RawRecordID STRING, SubmissionID BIGINT, SubscriberID BIGINT, {_KEY}, IdentityKey STRING,"
        f" SequenceNumber BIGINT, {_FILE_ORDER}, DisbursementDate STRING, CurBal STRING,"
        " BranchCode STRING, CreditFacilityType STRING, IdentityFields MAP<STRING, STRING>,"
        " ContentHash STRING, RawPayload STRING, Malformed BOOLEAN, ReportingPeriod STRING,"
        " BatchID STRING",
        ("SubmissionType", "ReportingPeriod", "BatchID"),
    ),
    # The same rows, narrow, with what reconciliation found.
    "raw": (
        f"RawRecordID STRING, SubmissionID BIGINT, SubscriberID BIGINT, {_KEY}, IdentityKey STRING,"
        f" SequenceNumber BIGINT, {_FILE_ORDER}, DisbursementDate DATE, DateText STRING,"
        " CurBal DECIMAL(18,2), BranchCode STRING, CreditFacilityType STRING,"
        " IdentityFields MAP<STRING, STRING>, ContentHash STRING, IsDuplicate BOOLEAN,"
        " DedupReason STRING, KeptOverThisRecordID STRING, ThisRowBalance DOUBLE,"
        " KeptBalance DOUBLE, CompositeKey STRING, MatchFlag STRING, Rearranged BOOLEAN,"
        " FieldDifferences STRING, AddedFields STRING, ChangedFields STRING, RemovedFields STRING,"
        " PreviousDate DATE, CurrentDate DATE, DateChanged BOOLEAN, InClean BOOLEAN,"
        " InOpenUnl BOOLEAN, Route STRING, ExceptionCategory STRING, Source STRING,"
        " PublishedFields MAP<STRING, STRING>, CreatedAt TIMESTAMP, ReportingPeriod STRING,"
        " BatchID STRING",
        ("SubmissionType", "ReportingPeriod", "BatchID"),
    ),
    "clean": (
        f"CleanRecordID STRING, {_KEY}, IdentityKey STRING, SourceRawRecordID STRING,"
        f" IdentityFields MAP<STRING, STRING>, MatchCategory STRING, Status STRING,"
        f" SequenceNumber BIGINT, {_FILE_ORDER}, CreatedAt TIMESTAMP, ReportingPeriod STRING,"
        " BatchID STRING",
        ("SubmissionType", "ReportingPeriod", "BatchID"),
    ),
    "unl": (
        f"UNLRecordID STRING, RawRecordID STRING, {_KEY}, IdentityKey STRING,"
        " ExceptionCategory STRING, Details STRING, Resolved BOOLEAN, ResolvedInPeriod STRING,"
        " CreatedAt TIMESTAMP, ReportingPeriod STRING, BatchID STRING",
        ("SubmissionType", "ReportingPeriod", "BatchID"),
    ),
    "date_log": (
        f"DateChangeID STRING, {_KEY}, IdentityKey STRING, PreviousDate DATE, CurrentDate DATE,"
        " CreditFacilityType STRING, CreatedAt TIMESTAMP, ReportingPeriod STRING, BatchID STRING",
        ("SubmissionType", "ReportingPeriod", "BatchID"),
    ),
    # Distinct keys of open exceptions as of a batch, and the batches that such a snapshot covers.
    "open_keys": (f"{_KEY}, BatchID STRING", ("SubmissionType", "BatchID")),
    "open_covered": (
        "Covered STRING, SubmissionType STRING, BatchID STRING",
        ("SubmissionType", "BatchID"),
    ),
    # One row per finished batch, written last.
    "commits": ("BatchID STRING, CommittedAt TIMESTAMP", ()),
}
