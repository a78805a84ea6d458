"""Text normalisation and matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separator controls
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def normalize_filter_text(c: Column) -> Column:
    """Null to '', trimmed, lower case, runs of white space to one space."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))), _SPACE, " ")


def normalize_text(c: Column) -> Column:
    """As `normalize_filter_text`, then trailing dots go; the text is not trimmed again."""
    return F.regexp_replace(normalize_filter_text(c), r"[.]+$", "")


def contains_ci(c: Column, part: str) -> Column:
    return F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))


def any_word_ci(c: Column, words: Sequence[str]) -> Column:
    """True if any of the words (regular expressions) occurs, in any case."""
    return F.coalesce(c.rlike(f"(?i)({'|'.join(words)})"), F.lit(False))


def equals_ci(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()


def first_word_ci(c: Column, words: Sequence[str]) -> Column:
    """The first of the words found in the text, as written there; null if none."""
    return F.nullif(F.regexp_extract(c, f"(?i)({'|'.join(words)})", 1), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit("")) == ""


def any_prefix(codes: Column, prefix: str) -> Column:
    """True if any element starts with the prefix."""
    return F.coalesce(F.exists(codes, lambda code: F.coalesce(code.startswith(prefix), F.lit(False))), F.lit(False))


def is_empty_list(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def present_names(tests: Sequence[tuple[str, Column]]) -> Column:
    """Names whose test holds, in the given order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def row_json(*columns: str | Column) -> Column:
    """The columns as one JSON object; nulls are written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


# ---- describing a claim and reading a reply about it --------------------------------

# The line layout of a claim description. {name:default} is a column.
DESCRIPTION_LINES = (
    "Patient: {age:Unknown} years old, {gender:Unknown}, {ethnicity:Unknown}",
    "Insurance: {insurance_type:Unknown} via {insurance_provider:Unknown}",
    "Payment Method: {payment_method:Unknown}",
    "Visit Type: {visit_type:Unknown} in {department:Unknown}",
    "Reason for Visit: {reason_for_visit:Unknown}",
    "Diagnosis Code: {diagnosis_code:Unknown}",
    "Admission Type: {admission_type:N/A}",
    "Billed Amount: ${billed_amount:0.00}",
    "Length of Stay: {length_of_stay:N/A} days",
    "Provider Specialty: {specialty:Unknown} ({years_experience:Unknown} years experience)",
    "Procedures: {proc_count:0}, Diagnoses: {diag_count:0}, Labs: {lab_count:0}, Medications: {med_count:0}",
)

# The request text around a claim description.
PROMPT_HEAD = """You are a healthcare claims denial prediction expert. Analyze the denial risk for this claim.

Provide:
1. 2-3 specific reasons this claim might be DENIED (consider: insurance coverage issues, medical necessity, prior authorization requirements, billing errors, timely filing)
2. 2-3 specific reasons this claim might be APPROVED (consider: appropriate coverage, medical necessity documentation, proper coding)
3. An overall risk assessment: LOW, MEDIUM, or HIGH

Format your response as a JSON object:
{"denial_reasons": ["reason1", "reason2"], "approval_reasons": ["reason1", "reason2"], "risk_level": "MEDIUM", "reasoning_summary": "Brief 1-2 sentence summary of key risk factors"}

Claim to analyze:

"""
PROMPT_TAIL = "\n\nRespond ONLY with the JSON object, no other text."

# What stands in for a reply that cannot be read.
DEFAULT_REASONS = ("Unable to analyze",)
DEFAULT_RISK = "MEDIUM"
DEFAULT_SUMMARY = "Analysis failed - using default assessment"
UNAVAILABLE = "Denial risk: MEDIUM. Analysis unavailable due to API error."

REPLY_SCHEMA = (
    "denial_reasons array<string>, approval_reasons array<string>, risk_level string, reasoning_summary string"
)


def claim_description(columns: Sequence[str]) -> Column:
    """The description as one text column; a column that is absent or null prints its default."""
    pieces: list[Column] = []
    for n, line in enumerate(DESCRIPTION_LINES):
        text = ("\n" if n else "") + line
        while "{" in text:
            before, _, rest = text.partition("{")
            slot, _, text = rest.partition("}")
            name, _, default = slot.partition(":")
            value = F.lit(None).cast("string")
            if name in columns:
                value = F.format_string("%.2f", F.col(name)) if name == "billed_amount" else F.col(name).cast("string")
                value = F.when(F.col(name).isNotNull(), value)
            pieces += [F.lit(before), F.coalesce(value, F.lit(default))]
        pieces.append(F.lit(text))
    return F.concat(*pieces)


def claim_prompt(description: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), description, F.lit(PROMPT_TAIL))


def unfence(reply: Column) -> Column:
    """Trim, and drop a leading code fence line and its closing line if there is one."""
    text = strip(reply)
    body = F.regexp_replace(text, r"^```[^\n]*(\n|$)", "")
    closed = F.regexp_replace(body, r"(^|\n)[^\S\n]*```[^\S\n]*$", "")
    return F.when(text.startswith("```"), closed).otherwise(text)


def parse_reply(reply: Column) -> Column:
    """The reply as a struct of four fields. Text that is not JSON gives the default record.

    A JSON object with a field missing keeps that field null. JSON that is not an object
    is null as a whole.
    """
    text = unfence(reply)
    is_json = F.try_parse_json(text).isNotNull() & (text != "")
    is_object = F.ltrim(text).startswith("{")
    words = F.array(*[F.lit(r) for r in DEFAULT_REASONS])
    default = F.struct(
        words.alias("denial_reasons"),
        words.alias("approval_reasons"),
        F.lit(DEFAULT_RISK).alias("risk_level"),
        F.lit(DEFAULT_SUMMARY).alias("reasoning_summary"),
    )
    parsed = F.from_json(text, REPLY_SCHEMA)
    return F.when(~F.coalesce(is_json, F.lit(False)), default).when(is_object, parsed)


def reasoning_text(reply: Column) -> Column:
    """One sentence per part; a field that is missing prints its own default."""
    unknown = F.array(F.lit("Unknown"))
    return F.when(reply.isNull(), F.lit(UNAVAILABLE)).otherwise(
        F.concat(
            F.lit("Denial risk: "),
            F.coalesce(reply["risk_level"], F.lit("MEDIUM")),
            F.lit(". Denial factors: "),
            F.array_join(F.coalesce(reply["denial_reasons"], unknown), "; "),
            F.lit(". Approval factors: "),
            F.array_join(F.coalesce(reply["approval_reasons"], unknown), "; "),
            F.lit(". Summary: "),
            F.coalesce(reply["reasoning_summary"], F.lit("")),
        )
    )
