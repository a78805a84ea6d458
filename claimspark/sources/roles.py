"""The star-schema test tables in the roles of the nine claims tables.

Only projections, one join or one aggregate each; `catalog.roles_sql` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.sources.tables import ClaimTables

KEYWORDS = ("anvil", "gizmo")
DEPARTMENTS = ("asia",)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _text(name: str):
    return F.col(name).cast("string")


def _denied():
    """About a tenth of the orders play denied claims: those of three days of each month."""
    return F.dayofmonth("o_orderdate").isin(1, 11, 21)


def claims(spark: SparkSession, folder: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    denied = _denied()
    status = (
        F.when(key % 89 == 0, F.lit(None).cast("string"))
        .when(denied, "Denied")
        .when(F.dayofmonth("o_orderdate").isin(2, 12), "Pending")
        .when(F.dayofmonth("o_orderdate") == 22, "denied ")
        .when(F.dayofmonth("o_orderdate").isin(3, 13), " Paid ")
        .otherwise("Paid")
    )
    return read(spark, folder, "orders").select(
        _text("o_orderkey").alias("claim_id"),
        F.when(key % 97 != 0, _text("o_orderkey")).alias("encounter_id"),
        F.when(key % 101 != 0, _text("o_custkey")).alias("patient_id"),
        F.concat(F.lit("B"), _text("o_orderkey")).alias("billing_id"),
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("claim_billing_date"),
        F.when(key % 103 != 0, F.col("o_totalprice")).alias("billed_amount"),
        F.when(denied, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("paid_amount"),
        status.alias("claim_status"),
        F.when(denied & (cust % 9 != 0), F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("."))).alias(
            "denial_reason"
        ),
        F.when(F.col("o_orderpriority") == "5-LOW", "Self-Pay").otherwise("Insurance").alias("payment_method"),
        F.when(cust % 11 == 0, " Self  Pay ").otherwise(F.concat(F.lit("Payer "), (cust % 7).cast("string"))).alias(
            "insurance_provider"
        ),
    )


def claims_with_resubmissions(spark: SparkSession, folder: str) -> DataFrame:
    """Pending claims come a second time with a higher amount; `row_no` is the file order."""
    once = claims(spark, folder)
    again = once.where(F.col("claim_status") == "Pending").withColumn("billed_amount", F.col("billed_amount") + 1)
    return once.withColumn("row_no", F.lit(0)).unionByName(again.withColumn("row_no", F.lit(1)))


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    lines = (
        read(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("supp"),
            F.min("l_shipdate").cast("date").alias("first"),
            F.max("l_shipdate").cast("date").alias("last"),
        )
    )
    regions = (
        read(spark, folder, "customer")
        .join(F.broadcast(read(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
        .join(F.broadcast(read(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
        .select("c_custkey", "r_name")
    )
    orders = read(spark, folder, "orders")
    return (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
        .join(regions, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            _text("o_orderkey").alias("encounter_id"),
            _text("o_custkey").alias("patient_id"),
            _text("supp").alias("provider_id"),
            F.date_format("first", "dd-MM-yyyy").alias("visit_date"),
            F.date_format("last", "dd-MM-yyyy").alias("discharge_date"),
            F.when(F.col("o_orderkey") % 10 == 0, "Inpatient Stay").otherwise("Outpatient").alias("visit_type"),
            F.col("r_name").alias("department"),
            F.col("o_orderstatus").alias("reason_for_visit"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Elective").otherwise("Emergency").alias("admission_type"),
            F.datediff("last", "first").cast("double").alias("length_of_stay"),
        )
    )


def _child_key():
    """Some child rows have lost their encounter."""
    lost = (F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 7)
    return F.when(~lost, _text("l_orderkey")).alias("encounter_id")


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        _child_key(),
        F.when(
            F.col("l_linenumber") != 6,
            F.concat(F.when(F.col("l_returnflag") == "R", "Z").otherwise(F.col("l_returnflag")), F.col("l_linestatus")),
        ).alias("diagnosis_code"),
        F.concat(F.lit("Finding "), F.col("l_returnflag")).alias("diagnosis_description"),
        (F.col("l_linenumber") == 1).alias("primary_flag"),
        F.when(F.col("l_linestatus") == "O", True).when(F.col("l_linenumber") < 5, False).alias("chronic_flag"),
    )


def procedures(spark: SparkSession, folder: str) -> DataFrame:
    lines, parts = read(spark, folder, "lineitem"), read(spark, folder, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left").select(
        _child_key(),
        F.when(F.col("l_linenumber") != 5, F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"))).alias(
            "procedure_id"
        ),
        F.concat(F.lit("P"), _text("l_partkey")).alias("procedure_code"),
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")).alias("procedure_description"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("procedure_cost"),
    )


def lab_tests(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        _child_key(),
        F.concat(F.lit("L"), _text("l_linenumber")).alias("test_code"),
        F.when(F.col("l_linenumber") == 2, "  ")
        .otherwise(F.concat(F.lit("Panel "), _text("l_linenumber")))
        .alias("test_name"),
    )


def medications(spark: SparkSession, folder: str) -> DataFrame:
    lines, parts = read(spark, folder, "lineitem"), read(spark, folder, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left").select(
        _child_key(), F.col("p_brand").alias("drug_name")
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    nation = F.broadcast(read(spark, folder, "nation"))  # 25 rows
    return read(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        _text("c_custkey").alias("patient_id"),
        F.lit("Pat").alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.when(key % 17 != 0, (18 + key % 70).cast("double")).alias("age"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.concat(F.lit("E"), (key % 5).cast("string")).alias("ethnicity"),
        F.concat(F.lit("S"), (key % 3).cast("string")).alias("marital_status"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Medicare Advantage")
        .when((F.col("c_mktsegment") == "BUILDING") & (key % 3 == 0), F.lit(None).cast("string"))
        .otherwise(F.col("c_mktsegment"))
        .alias("insurance_type"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("555-"), _text("c_custkey"))).alias("phone"),
        F.when(key % 19 == 0, "  ").otherwise(F.concat(F.lit("p"), _text("c_custkey"), F.lit("@x.org"))).alias("email"),
        F.when(key % 23 != 0, F.concat(_text("c_custkey"), F.lit(" Main St"))).alias("address"),
        F.col("n_name").alias("city"),
        F.lit("CA").alias("state"),
        F.concat(F.lit("9"), _text("c_custkey")).alias("zip"),
        F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), (key % 365).cast("int")), "dd-MM-yyyy").alias(
            "registration_date"
        ),
    )


def providers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, folder, "supplier").select(
        _text("s_suppkey").alias("provider_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("D"), (key % 8).cast("string")).alias("department"),
        F.concat(F.lit("Specialty "), (key % 6).cast("string")).alias("specialty"),
        (key % 40).cast("double").alias("years_experience"),
        F.concat(F.lit("N"), _text("s_suppkey")).alias("npi"),
        F.concat(F.lit("Site "), (key % 4).cast("string")).alias("location"),
        F.concat(F.lit("d"), _text("s_suppkey"), F.lit("@x.org")).alias("email"),
        F.lit("call").alias("contact_info"),
    )


def denials(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders, cust = (read(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return (
        lines.where(F.col("l_returnflag") == "R")
        .join(orders.where(_denied()), key == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            _text("l_orderkey").alias("claim_id"),
            F.when(line == 4, F.concat(F.lit("XDEN"), _text("l_orderkey")))
            .otherwise(F.format_string("DEN%05d", key * 10 + line))
            .alias("denial_id"),
            F.concat(F.lit("CO"), _text("l_linenumber")).alias("denial_reason_code"),
            F.when(line != 7, F.concat(F.lower("c_mktsegment"), F.lit(" ..."))).alias("denial_reason_description"),
            F.when(line != 3, F.col("l_extendedprice")).alias("denied_amount"),
            F.date_format("l_shipdate", "dd-MM-yyyy").alias("denial_date"),
            F.when(line % 2 == 0, " YES ").otherwise("No").alias("appeal_filed"),
            F.when(line % 2 == 0, "Approved").otherwise("").alias("appeal_status"),
            F.when(line % 2 == 0, F.date_format(F.date_add("l_shipdate", 9), "dd-MM-yyyy")).alias(
                "appeal_resolution_date"
            ),
            F.when(line % 2 == 0, "Paid").otherwise("Written off").alias("final_outcome"),
        )
    )


def load(spark: SparkSession, folder: str) -> ClaimTables:
    return ClaimTables(
        claims=claims(spark, folder),
        denials=denials(spark, folder),
        encounters=encounters(spark, folder),
        diagnoses=diagnoses(spark, folder),
        procedures=procedures(spark, folder),
        lab_tests=lab_tests(spark, folder),
        medications=medications(spark, folder),
        patients=patients(spark, folder),
        providers=providers(spark, folder),
    )
