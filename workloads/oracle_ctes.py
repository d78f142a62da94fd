"""SQL building blocks: the fixture and its reconciliation as common table expressions."""

from __future__ import annotations

from monthmatch.fixed_values import CONTACT_FIELDS, IDENTITY_FIELDS, hash_fields
from workloads.fixture import SOURCES

FIELDS = hash_fields("IND")
GROUP = IDENTITY_FIELDS["IND"]
CONTACT = CONTACT_FIELDS["IND"]
KEYS = '"SubscriberCode", "SubmissionType", "FacilityAccNum", "CustomerID"'
IDENTITY = """concat_ws('|', "SubscriberCode", "SubmissionType", "FacilityAccNum", "CustomerID")"""


def _record(source: str, day: str, balance: str, where: str = "TRUE", **values: str) -> str:
    base = {
        "NatIDNum": "'GHA-' || k",
        "DriverLicNum": "'DL-' || k",
        "TINum": "'TIN-' || k",
        "MobileTel1": "'020' || k",
    }
    fields = ", ".join(f'{values.get(f, base.get(f, chr(39) * 2))} AS "{f}"' for f in FIELDS)
    return f"""SELECT code AS "SubscriberCode", 'IND' AS "SubmissionType",
        'F' || k AS "FacilityAccNum", 'C' || k AS "CustomerID",
        '202601' || lpad(CAST({day} AS VARCHAR), 2, '0') AS "DisbursementDate",
        'LOAN' AS "CreditFacilityType", CAST({balance} AS VARCHAR) AS "CurBal",
        {fields}, k * 2 + n AS "RowOrder", cls, k
        FROM {source} WHERE {where}"""


def fixture(table: str = "customer", code: str | None = None) -> str:
    """``cur``, ``prior``, ``clean`` and ``open`` as derived from a table."""
    key, balance, subscriber, prefix = SOURCES[table]
    code = f"'{code}'" if code else f"'{prefix}' || CAST({subscriber} AS VARCHAR)"
    current = _record(
        "src, (VALUES (0), (1)) AS v(n)",
        "CASE WHEN cls = 9 THEN 2 ELSE 1 END + k % 28",
        "CAST(bal + 100 * n AS DECIMAL(18,2))",
        "n = 0 OR cls = 9",
        NatIDNum="CASE WHEN cls = 3 THEN 'GHX-' ELSE 'GHA-' END || k",
        DriverLicNum="CASE WHEN cls IN (4, 7) THEN '' WHEN cls = 6 THEN 'TIN-' || k ELSE 'DL-' || k END",
        PassportNum="CASE WHEN cls = 5 THEN 'PP-' || k WHEN cls = 7 THEN 'DL-' || k ELSE '' END",
        TINum="CASE WHEN cls = 6 THEN 'DL-' || k ELSE 'TIN-' || k END",
    )
    one = "(SELECT *, 0 AS n FROM src) AS s"
    prior = _record(one, "1 + k % 28", "bal", "cls <> 8")
    verified = _record(
        one, "1 + k % 28", "bal", "cls IN (0, 3, 4, 6, 9)", NatIDNum="'GHA-' || k || '-CLEAN'"
    )
    still_open = _record(one, "1 + k % 28", "bal", "cls = 2 OR (cls = 7 AND (k // 10) % 2 = 0)")
    return f"""src AS (
        SELECT {key} AS k, CAST({balance} AS DECIMAL(18,2)) AS bal, {code} AS code,
               {key} % 10 AS cls FROM {table}),
    cur AS ({current}),
    prior AS ({prior}),
    clean AS ({verified}),
    open AS ({still_open})"""


def _names(condition) -> str:
    return (
        "concat_ws(', ', " + ", ".join(f"CASE WHEN {condition(f)} THEN '{f}' END" for f in FIELDS) + ")"
    )


def _old(f: str) -> str:
    return f'p."{f}"'


def _new(f: str) -> str:
    return f'c."{f}"'


def reconciled(
    name: str, cur: str = "cur", prior: str = "prior", clean: str = "clean", open_: str = "open"
) -> str:
    """``name``: the rows of ``cur`` tagged by comparing them with the other tables.

    The lookups have one row per identity each; ``cur`` is one file.
    """
    differs = {f: f"{_new(f)} <> {_old(f)}" for f in FIELDS}
    text = ", ".join(
        f"CASE WHEN {differs[f]} THEN '{f}: ''' || {_old(f)} || ''' -> ''' || {_new(f)} || '''' END"
        for f in FIELDS
    )
    group_now = ", ".join(_new(f) for f in GROUP)
    group_old = ", ".join(_old(f) for f in GROUP)
    any_group = " OR ".join(differs[f] for f in GROUP)
    no_contact = " AND ".join(f"NOT ({differs[f]})" for f in CONTACT)
    any_field = " OR ".join(differs.values())
    prior_fields = ", ".join(f'p."{f}" AS "old_{f}"' for f in FIELDS)
    clean_fields = ", ".join(f'v."{f}" AS "clean_{f}"' for f in FIELDS)
    published = ", ".join(
        f"""CASE WHEN "Route" IN ('cleaned_output', 'rearranged_output') THEN coalesce("clean_{f}", "{f}")
        WHEN "Route" = 'enriched_output' THEN "{f}" END AS "pub_{f}\""""
        for f in FIELDS
    )
    return f"""{name}_ranked AS (
        SELECT *, row_number() OVER w AS rn, first_value(amount) OVER w AS kept_amount,
               first_value("RowOrder") OVER w AS kept_order
        FROM (SELECT *, CAST("CurBal" AS DOUBLE) AS amount FROM {cur}) AS a
        WINDOW w AS (PARTITION BY {KEYS}, "DisbursementDate" ORDER BY amount ASC NULLS LAST, "RowOrder")),
    {name}_joined AS (
        SELECT c.*, {IDENTITY.replace('"S', 'c."S').replace('"F', 'c."F').replace('"C', 'c."C')} AS "IdentityKey",
            p.k IS NOT NULL AS matched, v.k IS NOT NULL AS in_clean, o.k IS NOT NULL AS in_open,
            strptime(p."DisbursementDate", '%Y%m%d')::DATE AS "PreviousDate",
            strptime(c."DisbursementDate", '%Y%m%d')::DATE AS "CurrentDate",
            {prior_fields}, {clean_fields},
            {any_field} AS differs,
            ({any_group}) AND {no_contact}
                AND list_sort([{group_now}]) = list_sort([{group_old}]) AS moved,
            {_names(lambda f: differs[f])} AS differing,
            {_names(lambda f: f"{_old(f)} = '' AND {_new(f)} <> ''")} AS added,
            {_names(lambda f: f"{_old(f)} <> '' AND {_new(f)} <> '' AND {differs[f]}")} AS changed,
            {_names(lambda f: f"{_old(f)} <> '' AND {_new(f)} = ''")} AS removed,
            concat_ws('; ', {text}) AS difference_text
        FROM {name}_ranked AS c
        LEFT JOIN {prior} AS p USING ({KEYS})
        LEFT JOIN {clean} AS v USING ({KEYS})
        LEFT JOIN {open_} AS o USING ({KEYS})),
    {name}_flagged AS (
        SELECT *, CASE
            WHEN rn > 1 THEN NULL
            WHEN NOT matched THEN 'No previous-month match'
            WHEN NOT differs THEN 'Exact match'
            WHEN moved THEN 'Rearranged'
            WHEN added <> '' AND changed = '' AND removed = '' THEN 'Enriched'
            ELSE 'Different' END AS "MatchFlag",
            rn = 1 AND matched AND "PreviousDate" <> "CurrentDate" AS "DateChanged"
        FROM {name}_joined),
    {name}_routed AS (
        SELECT *, CASE
            WHEN rn > 1 THEN 'dedup_log'
            WHEN "MatchFlag" = 'Enriched' THEN 'enriched_output'
            WHEN "MatchFlag" = 'Exact match' AND in_clean THEN 'cleaned_output'
            WHEN "MatchFlag" = 'Rearranged' AND in_clean THEN 'rearranged_output'
            ELSE 'unl_output' END AS "Route",
            CASE
            WHEN "MatchFlag" = 'Different' THEN 'Different hash'
            WHEN "MatchFlag" = 'No previous-month match' THEN 'No previous-month match'
            WHEN "MatchFlag" IN ('Exact match', 'Rearranged') AND NOT in_clean THEN
                CASE WHEN in_open THEN 'Matched in Raw History - Previously Routed to UNL, Never Resolved in Clean'
                     WHEN "MatchFlag" = 'Exact match' THEN 'Same hash, not found in cleaned file'
                     ELSE 'Rearranged, not found in cleaned file' END END AS "ExceptionCategory"
        FROM {name}_flagged),
    {name} AS (
        SELECT *, CASE "Route"
            WHEN 'cleaned_output' THEN 'Carried forward from previous cleaned file'
            WHEN 'rearranged_output' THEN 'Auto-processed: same ID values, different field order'
            WHEN 'enriched_output' THEN 'Auto-processed: new identity data added, no conflicts' END AS "Source",
            CASE WHEN rn = 1 AND matched AND differs THEN difference_text ELSE '' END AS "FieldDifferences",
            CASE WHEN rn = 1 AND matched AND differs THEN added ELSE '' END AS "AddedFields",
            CASE WHEN rn = 1 AND matched AND differs THEN changed ELSE '' END AS "ChangedFields",
            CASE WHEN rn = 1 AND matched AND differs THEN removed ELSE '' END AS "RemovedFields",
            {published}
        FROM {name}_routed)"""


def tagged(table: str = "customer") -> str:
    return f"WITH {fixture(table)}, {reconciled('tag')}"


COUNTS = {
    "Input records": "count(*)",
    "Duplicates removed": "count(*) FILTER (rn > 1)",
    "After dedup": "count(*) FILTER (rn = 1)",
    "Date changes logged (informational)": 'count(*) FILTER ("DateChanged")',
    "Exact match": "count(*) FILTER (\"MatchFlag\" = 'Exact match')",
    "Rearranged (auto-processed)": "count(*) FILTER (\"MatchFlag\" = 'Rearranged')",
    "Enriched (auto-processed)": "count(*) FILTER (\"MatchFlag\" = 'Enriched')",
    "Different (needs review)": "count(*) FILTER (\"MatchFlag\" = 'Different')",
    "No previous-month match": "count(*) FILTER (\"MatchFlag\" = 'No previous-month match')",
    "Eligible for carry-forward (exact)": "count(*) FILTER (\"Route\" = 'cleaned_output')",
    "Eligible for carry-forward (rearranged)": "count(*) FILTER (\"Route\" = 'rearranged_output')",
    "Same hash, not found in cleaned file": (
        "count(*) FILTER (\"ExceptionCategory\" = 'Same hash, not found in cleaned file')"
    ),
    "Rearranged, not found in cleaned file": (
        "count(*) FILTER (\"ExceptionCategory\" = 'Rearranged, not found in cleaned file')"
    ),
    "Previously UNL'd, still unresolved (carryover)": (
        "count(*) FILTER (\"ExceptionCategory\" LIKE 'Matched in Raw History%')"
    ),
}


def summary(source: str) -> str:
    """(Metric, Count) rows over one tagged table."""
    rows = [
        f"SELECT '{metric.replace(chr(39), chr(39) * 2)}' AS \"Metric\", {count} AS \"Count\" FROM {source}"
        for metric, count in COUNTS.items()
    ]
    return " UNION ALL ".join(rows)


def history() -> str:
    """``may``, ``june`` and ``july`` as the backfilled files give them, with clean states."""
    fields = ", ".join(f'"{f}"' for f in FIELDS)
    published = ", ".join(f'"pub_{f}" AS "{f}"' for f in FIELDS)
    keep = f'{KEYS}, "DisbursementDate", "CurBal", {fields}, "RowOrder", cls, k'

    def published_of(month: str) -> str:
        return (
            f'SELECT {KEYS}, {published}, k, "MatchFlag", "RowOrder" FROM {month}'
            " WHERE \"Route\" IN ('cleaned_output', 'rearranged_output', 'enriched_output')"
        )

    return f"""WITH {fixture("customer", "CP")},
    nothing AS (SELECT * FROM prior WHERE FALSE),
    {reconciled("may", "prior", "nothing", "clean", "nothing")},
    may_raw AS (SELECT {keep} FROM may WHERE rn = 1),
    may_open AS (SELECT DISTINCT {KEYS}, k FROM may WHERE "Route" = 'unl_output'),
    {reconciled("june", "cur", "may_raw", "clean", "may_open")},
    june_raw AS (SELECT {keep} FROM june WHERE rn = 1),
    june_clean AS ({published_of("june")}),
    june_open AS (SELECT DISTINCT {KEYS}, k FROM june WHERE "Route" = 'unl_output'
                  UNION SELECT {KEYS}, k FROM may_open),
    {reconciled("july", "cur", "june_raw", "june_clean", "june_open")},
    july_clean AS ({published_of("july")})"""
