import json

from pyspark.sql import functions as F

from cohortspark.operators.evaluation import latest_records, without_prompts
from cohortspark.sources import readers, sinks
from cohortspark.streaming import ingest


def test_json_arrays(spark, tmp_path):
    path = tmp_path / "master.json"
    path.write_text(json.dumps([{"brand_name": "Z", "canonical_molecule": "E", "is_fdc": False, "constituent_strengths_mg": {"E": 0.5}}]))
    row = readers.medicine_master(spark, str(path)).first()
    assert row.brand_name == "Z" and row.constituent_strengths_mg == {"E": 0.5}
    other = tmp_path / "master2.json"
    other.write_text("[]")
    assert readers.newest_file(spark, str(tmp_path / "master*.json")).endswith(".json")


def test_source_names(spark):
    raw = spark.createDataFrame([("DT1", "05/03/2024", "x")], ["Case No", "Visit Date", "Visit Reason"])
    row = readers.normalized(raw).first()
    assert (row.case_no, str(row.visit_date), row.visit_reason) == ("DT1", "2024-03-05", "x")


def test_case_shapes(spark):
    a = spark.read.json(spark.sparkContext.parallelize([json.dumps({"caseNo": 1, "symptoms": [{"term": "x"}], "diagnosis": [], "medication": ["m"], "patient": {"age": {"year": 30}, "gender": "f"}, "date": "2024-01-01", "visitReason": "new"})]))
    row = readers.cases_view(a).first()
    assert row.symptoms[0].term == "x" and row.medications == ["m"] and row.age == 30.0 and row.gender == "f" and row.visit_date_raw == "2024-01-01"


def test_stream_upserts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k long, name string, n long"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.stream_upserts(spark.readStream.schema(schema).parquet(source), target, ["k"], "n", str(tmp_path / "ck"))
    query = run()
    query.awaitTermination()
    assert {(r.k, r.name) for r in spark.read.parquet(target).collect()} == {(1, "b"), (2, "c")}
    spark.createDataFrame([(2, "C", 4), (3, "d", 5)], schema).coalesce(1).write.mode("append").parquet(source)
    query = run()
    query.awaitTermination()
    assert {(r.k, r.name) for r in spark.read.parquet(target).collect()} == {(1, "b"), (2, "C"), (3, "d")}
    assert ingest.status(query)["running"] is False


def test_sinks(spark, tmp_path):
    frame = spark.range(3).withColumn("x", F.lit("y"))
    path = str(tmp_path / "t")
    sinks.append(frame, path)
    sinks.append(frame, path)
    assert spark.read.parquet(path).count() == 6
    sinks.swap_in(spark, spark.read.parquet(path).limit(2), path)
    assert spark.read.parquet(path).count() == 2
    sinks.json_lines(frame, str(tmp_path / "j"))
    sinks.csv_report(frame, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3 and spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "x"]


def test_result_records(spark):
    records = spark.createDataFrame([(1, 1, "r", {"a": "x"}), (1, 2, "s", {"a": "y"})], "caseNo int, n int, runId string, prompts map<string,string>").withColumn("res", F.struct(F.lit("p").alias("prompt"), F.lit("e").alias("explanation")))
    light, audit = without_prompts(records)
    assert light.schema["res"].dataType.fieldNames() == ["explanation"] and audit.columns == ["runId", "caseNo", "prompts", "prompt"]
    assert latest_records(records.drop("res", "prompts"), "caseNo", "n").first().runId == "s"
