"""Declarative scan of intent tables: one schema table drives reading, casts, defaults and rejects.

``FIELDS`` names every column of the file, the column it becomes, its kind and
its default. A row whose value does not parse is rejected with the column's
name, a row whose fields do not fit the header as malformed; ``mode`` says
which rows are intents at all. Rejected rows stay in the table, marked, so
that a caller can keep them apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .generate import INT_RE, _strip

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Field:
    header: str
    column: str
    kind: str  # text, flag, count, number; a count that is needed may not be blank
    default: float = 0
    needed: bool = False


# FIXED VALUES: the file's headers in its order
FIELDS = (
    Field("action_rank", "action_rank", "count", needed=True),
    Field("rank_in_action", "rank_in_action", "count", needed=True),
    Field("Reliable", "reliable", "flag"),
    Field("Inv_Quality", "inv_quality", "flag"),
    Field("Inv_Retention", "inv_retention", "flag"),
    Field("Unreliable", "unreliable", "flag"),
    Field("Action", "action", "text"),
    Field("Object", "object", "text"),
    Field("Subject", "subject", "text"),
    Field("Output", "output", "text"),
    Field("%_Users", "pct_users", "text"),
    Field("UserCount", "user_count", "text"),
    Field("%_Impressions", "pct_impressions", "text"),
    Field("ImpressionCount", "impression_count", "text"),
    Field("SatRate", "sat_rate", "text"),
    Field("FeedbackCount", "feedback_count", "count"),
    Field("ApologyRate", "apology_rate", "text"),
    Field("NoCitationRate", "no_citation_rate", "text"),
    *(Field(f"Active_Weeks_p{p}", f"active_weeks_p{p}", "number", 1.0) for p in (75, 90, 95, 99)),
    *(Field(f"%_Active_weeks_p{p}", f"pct_active_weeks_p{p}", "text") for p in (75, 90, 95, 99)),
    *(Field(f"Active_Days_p{p}", f"active_days_p{p}", "number", 1.0) for p in (75, 90, 95, 99)),
    *(Field(f"Focus_Days_p{p}", f"focus_days_p{p}", "text") for p in (75, 90, 95, 99)),
    Field("TenantCount", "tenant_count", "count"),
    Field("ConversationCount", "conversation_count", "number", 0.0),
    Field("DayCount", "day_count", "text"),
    Field("WeekCount", "week_count", "text"),
    Field("ThumbsUpCountClipped", "thumbs_up_count", "count"),
    Field("ThumbsDownCountClipped", "thumbs_down_count", "count"),
)

#: What makes a row an intent: anything; action and object not blank; nor a question mark.
MODES = ("any", "named", "known")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV as strings, by its own header, with the text of rows that do not fit it."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    return spark.read.options(**options, columnNameOfCorruptRecord=CORRUPT).schema(schema).csv(path)


def _value(field: Field, raw: Column) -> tuple[Column, Column]:
    """(typed value, it does not parse)."""
    s = F.coalesce(_strip(raw), F.lit(""))
    if field.kind == "text":
        return s, F.lit(False)
    if field.kind == "flag":
        return F.upper(F.coalesce(raw, F.lit("FALSE"))) == "TRUE", F.lit(False)
    blank = s == ""
    value = s.try_cast("bigint" if field.kind == "count" else "double")
    wrong = ~s.rlike(INT_RE) if field.kind == "count" else value.isNull()
    typed = F.when(blank, F.lit(field.default).cast("bigint" if field.kind == "count" else "double")).when(~wrong, value)
    return typed, (blank & F.lit(field.needed)) | (~blank & wrong)


def scan(raw: DataFrame, mode: str = "known", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of ``FIELDS`` (a column that the file lacks has its default) and
    ``reject``: null, or why the row is no intent. ``keep`` passes columns through."""
    if mode not in MODES:
        raise ValueError(f"not a mode: {mode!r}")
    by_header = {c.strip().lower(): c for c in raw.columns}
    typed, wrong = {}, []
    for f in FIELDS:
        there = by_header.get(f.header.lower())
        source = F.col(f"`{there}`") if there else F.lit(str(int(f.default)) if f.needed else None).cast("string")
        typed[f.column], bad = _value(f, source)
        wrong.append(F.when(bad, F.lit(f"bad {f.column}")))
    unfit = F.lit(False)
    for c in ("action", "object"):
        unfit = unfit | (F.lit(mode != "any") & (typed[c] == "")) | (F.lit(mode == "known") & (typed[c] == "?"))
    corrupt = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed row")) if CORRUPT in raw.columns else F.lit(None).cast("string")
    reject = F.coalesce(corrupt, F.when(unfit, F.lit("missing action or object")), *wrong)
    return raw.select(*[F.col(f"`{k}`") for k in keep], *[v.alias(k) for k, v in typed.items()], reject.alias("reject"))


def records(generated: DataFrame, intents: DataFrame, key: str = "intent_id") -> DataFrame:
    """Generated rows with every intent column; a name that both hold is the intent's. Neither
    side is broadcast: both grow with the intents, whatever size is guessed for them."""
    names = [f.column for f in FIELDS]
    own = generated.select(*[c for c in generated.columns if c not in names])
    return own.hint("merge").join(intents.where(F.col("reject").isNull()).select(key, *names), key)
