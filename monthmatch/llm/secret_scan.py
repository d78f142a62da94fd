"""Secret scan: regular candidates, and opaque tokens judged by how many own them.

Three regular kinds are found by their patterns alone. Any other long opaque
token is only a candidate: the corpus decides. Candidate hashes are counted by
distinct documents and owners; a value that many owners have, or that few
owners have in many documents each, is a copied example. Any other value looks
live and is reported, wherever it stands. Texts are matched once, in a pass that
writes what it finds to the shared folder. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import new_folder, saved, text_or_empty

# Kinds in the order in which equal starts are listed, their
# patterns, and the least length of what the group of that number matches.
ASSIGN = (
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Added kind: runs of letters and digits of at least this length, with a
#: digit, an upper-case and a lower-case letter among them.
OPAQUE = "opaque"
OPAQUE_PATTERN = r"[A-Za-z0-9_-]{20,}"
#: Values of more owners than this are copied examples.
MOST_OWNERS = 2
#: So are values in more distinct documents than this for each of their owners.
MOST_DOCUMENTS = 50

# Marks around matches. Where a text has them itself, a character that no
# pattern matches stands in, so that positions stay.
_OPEN, _CLOSE, _STAND_IN = "\x01", "\x02", "\x03"


#: Parts of a text that are walked at a time; even, so that each begins between matches.
_PARTS = 1000
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def marked_parts(text: Column, pattern: str) -> Column:
    """The text cut around the pattern's leftmost matches: between, match, between, ..."""
    clean = F.translate(text, _OPEN + _CLOSE, _STAND_IN * 2)
    marked = F.regexp_replace(clean, F.lit(pattern), F.lit(_OPEN + "$0" + _CLOSE))
    return F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)


def spans_of(parts: Column, pattern: str, group: int, least: int) -> Column:
    """Start, end and text of the matches among the parts whose ``group`` is long enough.

    Matches are found first and short ones dropped then. The lengths of the
    parts give positions in code points. ``parts`` must be a column, not an
    expression, as it is looked at many times.
    """
    none = F.array().cast(_SPANS)

    def walk(some: Column) -> Column:
        return F.aggregate(
            some,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("inside"), none.alias("found")),
            lambda state, part: F.struct(
                (state["at"] + F.length(part)).alias("at"),
                (~state["inside"]).alias("inside"),
                F.when(
                    state["inside"] & (F.length(_group(part, pattern, group)) >= least),
                    F.concat(
                        state["found"],
                        F.array(
                            F.struct(
                                state["at"].alias("start"),
                                (state["at"] + F.length(part)).alias("end"),
                                _group(part, pattern, group).alias("value"),
                            )
                        ),
                    ),
                )
                .otherwise(state["found"])
                .alias("found"),
            ),
        )

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _PARTS).cast("int")),
        lambda c: walk(F.slice(parts, c * _PARTS + 1, _PARTS)),
    )
    whole = F.aggregate(
        chunks,
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found")),
        lambda state, chunk: F.struct(
            (state["at"] + chunk["at"]).alias("at"),
            F.concat(
                state["found"],
                F.transform(
                    chunk["found"],
                    lambda s: F.struct(
                        (s["start"] + state["at"]).alias("start"),
                        (s["end"] + state["at"]).alias("end"),
                        s["value"].alias("value"),
                    ),
                ),
            ).alias("found"),
        ),
    )
    return F.when(F.size(parts) > 1, whole["found"]).otherwise(none)


def _group(match: Column, pattern: str, group: int) -> Column:
    return match if group == 0 else F.regexp_extract(match, pattern, group)


def _parts_where(text: Column, hint: str, pattern: str) -> Column:
    """Parts, cut only in texts that can have a match."""
    return F.when(text.rlike(hint), marked_parts(text, pattern)).otherwise(F.array().cast("array<string>"))


def _opaque(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of each span."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _ranked(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )


def secret_spans(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    document: str = "doc_id",
    most_owners: int = MOST_OWNERS,
    most_documents: int = MOST_DOCUMENTS,
) -> DataFrame:
    """Append ``base_spans`` and ``secret_spans``, sorted arrays of (start, rank, kind, end).

    Positions are code points, ends exclusive. ``secret_spans`` has the base
    spans and those of opaque tokens that at most ``most_owners`` owners have, in
    at most ``most_documents`` distinct documents (by id and text) for each of
    them; an opaque token that overlaps a base span is not repeated. Null texts
    are empty and have no spans; a null owner is the owner '', a null document
    the document ''. Repeated rows get equal results. Columns of the two names are
    replaced; all other columns and all rows stay.
    """
    body = text_or_empty(text)
    hints = {"assign": r"[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}"}
    parts = {f"__{kind}": _parts_where(body, hints[kind], pattern) for kind, pattern, _, _ in BASE}
    base = {
        f"__{kind}": spans_of(F.col(f"__{kind}"), pattern, group, least) for kind, pattern, group, least in BASE
    }
    # Rows with the same id and text have the same spans, so they may share them.
    row = F.xxhash64(F.coalesce(F.col(document).cast("string"), F.lit("")), body)
    found = docs.withColumns(parts).withColumns(base).withColumns(
        {
            "__row": row,
            "__base": F.concat(*[_ranked(F.col(f"__{kind}"), kind, i) for i, (kind, *_) in enumerate(BASE)]),
        }
    )
    opaque = F.filter(
        spans_of(F.col("__parts"), OPAQUE_PATTERN, 0, 20),
        lambda s: _opaque(s["value"])
        & ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])),
    )
    hashed = F.transform(
        opaque, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value"))
    )
    kept = [c for c in docs.columns if c not in ("base_spans", "secret_spans")]
    quoted = [F.col(f"`{c}`") for c in kept]
    found = saved(
        found.withColumn("__parts", _parts_where(body, OPAQUE_PATTERN, OPAQUE_PATTERN)).select(
            F.struct(*quoted).alias("doc"),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
            "__row",
            "__base",
            hashed.alias("__opaque"),
        ),
        new_folder(docs.sparkSession),
        "matches",
    )
    candidates = found.filter(F.size("__opaque") > 0).select("__row", "owner", F.inline("__opaque"))
    # Documents are counted per owner first, so that a value in a third of all
    # documents is one row per owner when owners are counted.
    live = (
        ownership(candidates)
        .filter((F.col("owners") <= most_owners) & (F.col("documents") <= F.col("owners") * most_documents))
        .select("value")
    )
    added = (
        candidates.join(live, "value")
        .groupBy("__row")
        .agg(
            F.collect_set(
                F.struct("start", F.lit(len(BASE)).alias("rank"), F.lit(OPAQUE).alias("kind"), "end")
            ).alias("__added")
        )
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return found.join(added, "__row", "left").select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        F.array_sort("__base").alias("base_spans"),
        F.array_sort(F.concat("__base", F.coalesce("__added", none))).alias("secret_spans"),
    )


def scan_secrets(docs: DataFrame, **options) -> DataFrame:
    """The digest of ``secret_spans``: ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``."""
    found = secret_spans(docs, **options)
    counts = [_count(kind).alias(f"n_{kind}") for kind, *_ in BASE]
    names = [f"n_{kind}" for kind, *_ in BASE] + ["base_sha256", "spans"]
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in names],
        *counts,
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("secret_spans")).alias("spans"),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")


def redact_secrets(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with every secret in their text replaced; a null text stays null.

    The work on a text grows with its length times its secrets.
    """
    found = secret_spans(docs, text=text, **options)
    return found.withColumn(
        text, F.when(F.col(text).isNotNull(), redacted(F.col(text), F.col("secret_spans")))
    ).drop("base_spans", "secret_spans")


def ownership(candidates: DataFrame) -> DataFrame:
    """For each candidate ``value`` the number of ``documents`` and of distinct ``owners``."""
    return (
        candidates.groupBy("value", "owner")
        .agg(F.countDistinct("__row").alias("documents"))
        .groupBy("value")
        .agg(F.sum("documents").alias("documents"), F.count("*").alias("owners"))
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans (start, rank, kind, end; sorted) replaced by ``mark``."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda state, s: F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= state["at"],
                F.concat(
                    state["out"],
                    F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")),
                    F.lit(mark),
                ),
            )
            .otherwise(state["out"])
            .alias("out"),
        ),
    )
    rest = F.substring(text, (walked["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(walked["out"], rest)).otherwise(text)
