"""Names, labels and formats that are part of the data contract.

Everything here is a fixed value: files, registry tables and reports are
exchanged under exactly these names, so they are stated once, in full.
"""

# -- fixed values: columns every submission file carries ---------------------
FILE_FACILITY = "Credit FacilityAccNum"
FACILITY = "FacilityAccNum"  # the registry name of FILE_FACILITY
CUSTOMER = "CustomerID"
DATE = "DisbursementDate"
BRANCH = "BranchCode"
FACILITY_TYPE = "CreditFacilityType"
BALANCE = "CurBal"

# -- fixed values: identity and contact fields per submission type -----------
IDENTITY_FIELDS = {
    "IND": (
        "NatIDNum",
        "VotersIDNum",
        "DriverLicNum",
        "PassportNum",
        "SSNum",
        "EzwichNum",
        "OtherIDType",
        "OtherIDNum",
        "TINum",
    ),
    "BUS": ("BusRegNum", "PrevRegNum", "TINum"),
}
CONTACT_FIELDS = {
    "IND": ("HomeTel", "MobileTel1", "MobileTel2", "WorkTel"),
    "BUS": ("OfficeTel1", "OfficeTel2", "OfficeFaxNum"),
}
SUBMISSION_TYPES = ("IND", "BUS")

# -- fixed values: text formats ----------------------------------------------
DELIMITER = "|"
# subscriber, month, year, type, sequence
FILE_NAME_PATTERN = (
    r"(?i)^([A-Za-z0-9]+?)(0[1-9]|1[0-2])(\d{2})_(IND|BUS)(?:_(\d+))?(?:\.[^.]*)?$"
)
NULL_AMOUNT_WORDS = ("nan", "none")
# Forms of dates; a time of day may follow all but the first. Between month
# first and day first, month first is tried first. Years of two digits stand
# for 1976 to 2075.
DATE_COMPACT = r"^\d{8}$"
_TIME = r"(?:[T ](?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?)?$"
_MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_YEAR = r"(?:\d{4}|\d{2})"
DATE_YEAR_FIRST = r"^\d{4}([-/.])\d{1,2}\1\d{1,2}" + _TIME
DATE_YEAR_LAST = r"^\d{1,2}([-/.])\d{1,2}\1" + _YEAR + _TIME
DATE_DAY_NAMED_MONTH = r"(?i)^\d{1,2}[-/. ]" + _MONTH + r"(?:[-/ ]|[.,] ?)" + _YEAR + _TIME
DATE_NAMED_MONTH_DAY = r"(?i)^" + _MONTH + r"(?:[-/ ]|\. ?)\d{1,2}(?:[-/. ]|, ?)" + _YEAR + _TIME
DATE_YEAR_NAMED_MONTH = r"(?i)^\d{4}[-/. ]" + _MONTH + r"[-/. ]\d{1,2}" + _TIME
LAST_CENTURY_FROM = 76
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# -- fixed values: match flags, in report order ------------------------------
EXACT = "Exact match"
REARRANGED = "Rearranged"
ENRICHED = "Enriched"
DIFFERENT = "Different"
NO_MATCH = "No previous-month match"

# -- fixed values: exception categories --------------------------------------
CATEGORY_DIFFERENT = "Different hash"
CATEGORY_NO_MATCH = "No previous-month match"
CATEGORY_EXACT_NOT_FOUND = "Same hash, not found in cleaned file"
CATEGORY_REARRANGED_NOT_FOUND = "Rearranged, not found in cleaned file"
CATEGORY_CARRYOVER = "Matched in Raw History - Previously Routed to UNL, Never Resolved in Clean"

# -- fixed values: provenance texts ------------------------------------------
SOURCE_CARRIED = "Carried forward from previous cleaned file"
SOURCE_REARRANGED = "Auto-processed: same ID values, different field order"
SOURCE_ENRICHED = "Auto-processed: new identity data added, no conflicts"
DEDUP_REASON = "Duplicate key — higher or tied balance, not kept"

# -- fixed values: clean registry categories, later ones win a tie -----------
CLEAN_SEED = "Seed"
CLEAN_EXACT = "Exact"
CLEAN_REARRANGED = "Rearranged"
CLEAN_ENRICHED = "Enriched"
CLEAN_STATUS = "Clean"

# -- fixed values: the six outputs and the titles they are reported under ----
OUTPUT_TITLES = {
    "dedup_log": "Dedup Log",
    "date_change_log": "Date Changes (Info)",
    "cleaned_output": "Cleaned Output",
    "rearranged_output": "Rearranged (Auto)",
    "enriched_output": "Enriched (Auto)",
    "unl_output": "UNL",
}

# -- fixed values: summary metrics, in report order --------------------------
METRICS = (
    "Input records",
    "Duplicates removed",
    "After dedup",
    "Date changes logged (informational)",
    "Exact match",
    "Rearranged (auto-processed)",
    "Enriched (auto-processed)",
    "Different (needs review)",
    "No previous-month match",
    "Eligible for carry-forward (exact)",
    "Eligible for carry-forward (rearranged)",
    "Same hash, not found in cleaned file",
    "Rearranged, not found in cleaned file",
    "Previously UNL'd, still unresolved (carryover)",
)

# -- fixed values: column headings used in the exported files ----------------
REPORT_HEADINGS = {
    "FacilityAccNum": "Credit FacilityAccNum",
    "CompositeKey": "Composite Key (3-key)",
    "ThisRowBalance": "This Row Balance",
    "KeptBalance": "Kept Balance",
    "DedupReason": "Dedup Reason",
    "MatchFlag": "Match Flag",
    "FieldDifferences": "Field Differences",
    "AddedFields": "Added Fields",
    "ChangedFields": "Changed Fields",
    "RemovedFields": "Removed Fields",
    "ExceptionCategory": "Exception Category",
}
PREVIEW_ROWS = 200
HISTORY_ROWS = 24

# Where a row stood in the files of a batch, beside the submitted columns.
FILE_PLACE = "FilePlace"

# Columns that make up the identity of a record, in key order. They stay four
# separate columns in every table so that joins and windows share one
# distribution; the delimited text form is for display.
IDENTITY_KEY = ("SubscriberCode", "SubmissionType", FACILITY, CUSTOMER)
# The same within one submission type, which is how records are matched. The
# most selective column comes first: sorting compares it first, by its prefix.
MATCH_KEY = (FACILITY, CUSTOMER, "SubscriberCode")
# Facility, customer and date make the key of a same-month duplicate.
RECORD_KEY = (FACILITY, CUSTOMER, DATE)


def hash_fields(submission_type: str) -> tuple[str, ...]:
    """Identity then contact fields; the order is part of the content hash."""
    return IDENTITY_FIELDS[submission_type] + CONTACT_FIELDS[submission_type]


def required_columns(submission_type: str) -> tuple[str, ...]:
    """Columns a submission file must have, by the names used in files."""
    return (FILE_FACILITY, CUSTOMER, DATE, *hash_fields(submission_type), BALANCE)
