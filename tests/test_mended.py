"""Inputs that used to break: null keys, a file's own order column, cells over several lines, many distinct values."""

import pytest
from pyspark.sql import functions as F

from claimspark.operators.joins import key_mask, perhaps_among
from claimspark.operators.sampling import downsample_negatives, sample_exact, split_by_group
from claimspark.plans import enrichment as E
from claimspark.plans import knowledge_base
from claimspark.plans import training as M
from claimspark.plans.knowledge_base import clinical_side, split_holdout
from claimspark.sources import sinks, tables
from claimspark.sources.tables import ClaimTables


def claims(spark, n=200):
    rows = [(f"C{i}", "Denied" if i % 10 == 0 else "Paid") for i in range(n)] + [(None, "Paid")]
    return spark.createDataFrame(rows, "claim_id string, claim_status string")


def test_a_null_key_is_one_key(spark):
    df = claims(spark)
    assert sample_exact(df, 50, "claim_id").count() == 50
    assert sample_exact(df, 201, "claim_id").count() == 201
    kept = downsample_negatives(df, F.col("claim_status") == "Denied", "claim_id", 0.5)
    assert kept.where("claim_status = 'Denied'").count() == 20 and kept.count() == 40
    held, rest = split_holdout(df, 20)
    assert held.count() == 20 and rest.count() == 181
    parts = split_by_group(df, "claim_id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"eval": 41, "train": 160}


def test_a_table_read_from_csv_can_be_written_and_read_again(spark, tmp_path):
    source = spark.createDataFrame([("C1", "e"), ("C2", "f")], "claim_id string, encounter_id string")
    first, second = f"{tmp_path}/a", f"{tmp_path}/b"
    sinks.write_table(source, first, "csv")
    read = tables.read_csv_table(spark, first, "claims_and_billing", tables.read_header(spark, first))
    assert "_order" in read.columns
    sinks.write_table(read, second, "csv")
    assert tables.read_header(spark, second) == ("claim_id", "encounter_id")
    again = tables.read_csv_table(spark, second, "claims_and_billing", tables.read_header(spark, second))
    assert sorted(r.claim_id for r in again.collect()) == ["C1", "C2"]


def test_an_order_column_in_a_file_is_left_out(spark, tmp_path):
    (tmp_path / "c.csv").write_text('claim_id,_order\nC1,"{""line"":1}"\n')
    path = str(tmp_path / "c.csv")
    row = tables.read_csv_table(spark, path, "claims_and_billing", tables.read_header(spark, path)).first()
    assert row.claim_id == "C1" and row._order.line >= 0


def test_cells_over_several_lines(spark, tmp_path):
    (tmp_path / "d.csv").write_text('claim_id,denial_reason\nC1,"two\nlines"\nC2,one\n')
    path = str(tmp_path / "d.csv")
    read = tables.read_csv_table(spark, path, "claims_and_billing", ("claim_id", "denial_reason"), multi_line=True)
    assert {r.claim_id: r.denial_reason for r in read.collect()} == {"C1": "two\nlines", "C2": "one"}
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_csv_table(spark, path, "claims_and_billing", ("claim_id", "denial_reason")).collect()


@pytest.mark.parametrize("values", [20, 400])
def test_one_encoding_at_every_size(spark, values):
    rows = [(f"c{i}", f"p{i}", f"v{i % values}", float(i % 7), int(i % 3 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "claim_id string, patient_id string, code string, amount double, label_denied int")
    for encoding, size in (("one_hot", M.HASH_WIDTH + 1), ("target", 2)):
        model = M.fit_model(df, M.TreeConfig(2, 3, 0.3, encoding=encoding))
        assert [type(s).__name__ for s in model.pipeline.stages][-1] == "GBTClassificationModel"
        assert model.pipeline.stages[-1].numFeatures == size
        scored = model.score(df)
        assert scored.columns == [*df.columns, "score"] and scored.where("score between 0 and 1").count() == 800
        assert {r.code for r in scored.select("code").distinct().collect()} == {f"v{i}" for i in range(values)}


def test_rates_are_smoothed_and_unseen_values_get_the_overall_rate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1)], "code string, label_denied int")
    rates = M.value_rates(M._numbered(df), ["code"], "label_denied")
    assert rates.base == 0.75 and {r.value: (sum(r.positives), sum(r.rows)) for r in rates.table.collect()} == {"a": (2, 2), "b": (1, 2)}
    new = spark.createDataFrame([("z",), ("a",), ("b",)], "code string")
    found = {r.code: r.code_rate for r in M.with_rates(M._numbered(new), rates, ["code"], leave_out=False).collect()}
    assert found == {"z": 0.75, "a": (2 + 0.75) / 3, "b": (1 + 0.75) / 3}


def test_embeddings_have_the_scale_of_the_training_texts(spark):
    train = spark.createDataFrame([("1", "late late claim"), ("2", "claim paid")], "claim_id string, reasoning string")
    other = spark.createDataFrame([("1", "late late claim"), ("9", "late")], "claim_id string, reasoning string")
    embedder = E.fit_embedder(train, dims=8)
    vector = lambda df: {r.claim_id: r.embedding for r in E.hashed_embeddings(df, embedder).collect()}
    assert vector(train)["1"] == vector(other)["1"]


def test_a_vector_column_is_a_feature(spark):
    rows = [(f"c{i}", f"p{i}", f"v{i % 5}", float(i % 7), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "claim_id string, patient_id string, code string, amount double, label_denied int")
    vectors = df.where("amount > 0").select("claim_id", F.array(F.col("amount"), F.lit(1.0)).alias("embedding"))
    joined = E.with_embedding_vector(df, vectors, 2)
    for encoding, size in (("target", 4), ("one_hot", M.HASH_WIDTH + 3)):
        model = M.fit_model(joined, M.TreeConfig(2, 3, 0.3, encoding=encoding))
        assert model.pipeline.stages[-1].numFeatures == size and model.score(joined).count() == 120


def test_knowledge_base_reads_only_the_encounters_of_its_claims(spark):
    """other encounters and their children leave before anything is shuffled; none that is wanted does, the null one included."""
    keys = [*[f"e{i}" for i in range(40)], None]

    def table(columns):
        return spark.createDataFrame([(k, *[f"{c}{k}" for c in columns]) for k in keys], ", ".join(f"{c} string" for c in ["encounter_id", *columns]))

    nothing = spark.createDataFrame([], "claim_id string")
    tables = ClaimTables(
        claims=nothing, denials=nothing, patients=nothing, providers=nothing,
        encounters=table(["provider_id"]), diagnoses=table(["diagnosis_code", "diagnosis_description"]),
        procedures=table(["procedure_code", "procedure_description"]), lab_tests=table(["test_code", "test_name"]), medications=table(["drug_name"]),
    )
    claims = spark.createDataFrame([("e3",), ("e3",), (None,), ("e39",), ("lost",)], "encounter_id string")
    found = {r["encounter_id"]: r for r in clinical_side(tables, claims).collect()}
    assert set(found) == {"e3", "e39", None}
    assert all(r["provider_id"] == f"provider_id{k}" and r["diag_codes"] == f"diagnosis_code{k}" and r["med_names"] == f"drug_name{k}" for k, r in found.items())
    assert clinical_side(tables).count() == 41
    assert perhaps_among(tables.encounters, "encounter_id", key_mask(claims, "encounter_id")).count() < 10


def test_long_lists_of_the_null_encounter_are_not_moved_with_the_claims(spark, monkeypatch):
    """the children's lists are joined last, with the claims without encounter spread over tasks; names and order stay."""

    def table(names, *rows):
        return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))

    made = ClaimTables(
        claims=table("claim_id encounter_id patient_id claim_status email", ("a", "e1", "p1", "Denied", "c@"), ("b", None, "p1", "denied ", "c@"), ("c", "e1", None, "Paid", "c@")),
        denials=table("claim_id denied_amount appeal_filed denial_id denial_reason_code denial_reason_description denial_date appeal_status appeal_resolution_date final_outcome", ("a", "5", "yes", "D1", *["x"] * 6)),
        encounters=table("encounter_id provider_id email", ("e1", "v1", "e@"), (None, "v2", "n@")),
        diagnoses=table("encounter_id diagnosis_code diagnosis_description", ("e1", "A", "one"), *[(None, f"N{i}", "many") for i in range(9)]),
        procedures=table("encounter_id procedure_code procedure_description", ("e1", "P", "cut")), lab_tests=table("encounter_id test_code test_name", ("e1", "L", "lab")),
        medications=table("encounter_id drug_name", (None, "pill")), patients=table("patient_id insurance_type email diag_codes", ("p1", "x", "p@", "own")),
        providers=table("provider_id name email", ("v1", "one", "v@"), ("v2", "two", "v@")),
    )
    calls, join = [], knowledge_base.lookup_join

    def noted(left, right, on, *rest, **more):
        calls.append((left.columns, right.columns, more.get("hot")))
        return join(left, right, on, *rest, **more)

    monkeypatch.setattr(knowledge_base, "lookup_join", noted)
    kb = knowledge_base.build_knowledge_base(made)
    assert [c for left, _, _ in calls for c in left if c == "diag_descriptions"] == []
    assert "diag_descriptions" in calls[-1][1] and [tuple(r) for r in calls[-1][2].collect()] == [(None,)]
    assert kb.columns[:10] == ["claim_id", "encounter_id", "patient_id", "claim_status", "email", "insurance_type", "provider_id", "email_enc", "diag_count", "diag_distinct"]
    found = {r["claim_id"]: r for r in kb.collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"]["diag_codes"], found["a"]["diag_codes_pat"], found["a"]["name"], found["a"]["proc_codes"]) == ("A", "own", "one", "P")
    assert (found["b"]["diag_codes"], found["b"]["name"], found["b"]["med_names"]) == ("|".join(f"N{i}" for i in range(9)), "two", "pill")
