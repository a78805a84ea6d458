"""Scalar functions against the rows where they could go wrong."""

import datetime

from pyspark.sql import functions as F

from claimspark.functions import text as X
from claimspark.functions import values as V
from claimspark.functions.denials import appeal, denial_date, denial_id


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_dates(spark):
    values = ["31-12-2024", "2024-01-05", "13/02/2024", "bad", "", None]
    assert column(spark, values, V.parse_date) == [datetime.date(2024, 12, 31), None, None, None, None, None]
    assert column(spark, values, lambda c: V.format_date(V.parse_date(c)))[:2] == ["31-12-2024", ""]


def test_text(spark):
    values = ["A  b .", "\tX ", None, "…Done..", " Self  Pay "]
    assert column(spark, values, X.normalize_text) == ["a b ", "x", "", "…done", "self pay"]
    assert column(spark, values, X.normalize_filter_text)[3] == "…done.."
    assert column(spark, ["  ", None, "x", " "], X.is_blank) == [True, True, False, True]
    assert column(spark, [None, "Big Medicare"], lambda c: X.contains_ci(c, "medicare")) == [False, True]


def test_numbers(spark):
    assert column(spark, ["abc", None, "0", "1.5", "NaN"], V.to_number) == [None, None, 0.0, 1.5, None]
    assert column(spark, [25.0, 75.0, 125.0, None], V.bucket_50, "double") == [0.0, 100.0, 100.0, None]
    assert column(spark, [0.5], lambda c: V.relative_difference(c, F.lit(0.1)), "double") == [0.4]
    assert column(spark, ["true", "FALSE", "yes", None], V.to_flag) == [True, False, None, None]


def test_bucket_edges_are_right_closed(spark):
    labels = column(spark, [1, 2, 3, 9, None], lambda c: V.bucket_label(c, [2.0, 2.0, 5.0]), "int")
    assert labels == ["bin_0", "bin_0", "bin_1", "bin_2", "nan"]


def test_prefix_and_lists(spark):
    lists = [["A1", None], ["Z2"], [None], [], None]
    assert column(spark, lists, lambda c: X.any_prefix(c, "Z"), "array<string>") == [False, True, False, False, False]
    assert column(spark, lists, X.is_empty_list, "array<string>") == [False, False, False, True, True]


def test_replies(spark):
    good = '{"denial_reasons": ["a", "b"], "approval_reasons": ["c"], "risk_level": "LOW", "reasoning_summary": "s"}'
    values = [good, f"```json\n{good}\n```", f"```\n{good}", "no json", "[1, 2]", '{"risk_level": "HIGH"}', None]
    said = column(spark, values, lambda c: X.reasoning_text(X.parse_reply(c)))
    full = "Denial risk: LOW. Denial factors: a; b. Approval factors: c. Summary: s"
    assert said[:3] == [full] * 3
    assert said[3].startswith("Denial risk: MEDIUM. Denial factors: Unable to analyze.")
    assert said[4] == X.UNAVAILABLE
    assert said[5] == "Denial risk: HIGH. Denial factors: Unknown. Approval factors: Unknown. Summary: "


def test_description_defaults(spark):
    df = spark.createDataFrame([("1", None, 12.5)], "claim_id string, gender string, billed_amount double")
    text = df.select(X.claim_description(df.columns)).collect()[0][0].split("\n")
    assert text[0] == "Patient: Unknown years old, Unknown, Unknown"
    assert text[7] == "Billed Amount: $12.50"
    assert text[10] == "Procedures: 0, Diagnoses: 0, Labs: 0, Medications: 0"


def test_new_denials(spark):
    assert column(spark, [7, 99999, 100000], denial_id, "int") == ["DEN00007", "DEN99999", "DEN100000"]
    base = F.lit("2024-01-01").cast("date")
    keys = [str(i) for i in range(200)]
    start = datetime.date(2024, 1, 1)
    for code, low, high in (("CO18", 3, 4), ("CO29", 0, 1), ("CO197", 5, 12), ("CO22", 7, 21)):
        days = {(d - start).days for d in column(spark, keys, lambda c, code=code: denial_date(base, F.lit(code), c))}
        assert days == set(range(low, high))
    won = column(spark, keys, lambda c: appeal(F.lit("appeal_mix"), base, c))
    assert 0.15 < sum(r["appeal_status"] == "Approved" for r in won) / 200 < 0.45
    none = column(spark, ["1"], lambda c: appeal(F.lit("no_appeal_hard"), base, c))[0]
    assert tuple(none) == ("No", "", None, "Written off")


def test_fill_missing(spark):
    df = spark.createDataFrame([(None, None, None)], "diag_count string, amount double, name string")
    assert tuple(V.fill_missing(df).collect()[0]) == (0, 0.0, "")
