from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.numeric import to_double
from ebbtide.operators import crm, payloads
from ebbtide.plans.accounts import align_rows, profile
from ebbtide.sources import files, html
from ebbtide.sources.common_schema import COMMON_COLUMNS, empty_common, to_common, union_sources


def test_csv_with_declared_and_inferred_types(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿ id , amount ,name\n1, 2.5 ,x\n2,,y\n", encoding="utf-8")
    inferred = files.read_csv(spark, str(path))
    assert inferred.columns == ["id", "amount", "name"]
    declared = files.read_csv(spark, str(path), "id int, amount string, name string")
    assert declared.schema["id"].dataType == T.IntegerType()
    text = files.read_csv_text(spark, str(path))
    got = text.select(to_double("amount").alias("a"), "name").orderBy("name").collect()
    assert [r["a"] for r in got] == [2.5, None]


def test_csv_scan_reads_only_the_needed_columns(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a,b,c\n1,2,3\n")
    plan = files.read_csv(spark, str(tmp_path / "b.csv"), "a int, b int, c int").where("a > 0").select("a")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:int>" in text and "GreaterThan(a,0)" in text


def test_headerless_tsv_plain_and_zipped(spark, tmp_path):
    line = "\t".join(["BG", "1000", "София/Sofia", "", "", "", "", "", "", "42.7", "23.3", "4"])
    (tmp_path / "BG.txt").write_text(line + "\n", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "BG.zip", "w") as archive:
        archive.write(tmp_path / "BG.txt", "BG.txt")
    plain = files.read_tsv(spark, str(tmp_path / "BG.txt"))
    zipped = files.read_zipped_tsv(spark, str(tmp_path / "BG.zip"), "BG.txt")
    assert plain.columns == list(files.GAZETTEER_COLUMNS) == zipped.columns
    assert plain.first()["postal_code"] == zipped.first()["postal_code"] == "1000"
    assert zipped.first()["admin_name1"] is None


def test_optional_source_and_empty_union(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    missing = files.read_optional(spark, str(tmp_path / "none"), schema)
    assert missing.count() == 0 and missing.schema == schema
    rows = to_common(spark.createDataFrame([(1.0, 0)], "v double, churn int"), {"arpu": "v", "dataset_code": "3"}, keep=["churn"])
    both = union_sources([rows, empty_common(spark)])
    assert both.count() == 1 and set(both.columns) == {*COMMON_COLUMNS, "churn"}
    with pytest.raises(ValueError):
        to_common(rows, {"no_such_column": "1"})


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "d1"), (2, "ü", "d2")], "k int, v string, log_day string")
    files.write_parquet(rows, str(tmp_path / "p"))
    files.write_csv(rows, str(tmp_path / "c"))
    files.append_log(rows, str(tmp_path / "log"))
    files.append_log(rows.where("k = 2"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert {r["v"] for r in files.read_csv(spark, str(tmp_path / "c")).collect()} == {"x", "ü"}
    assert spark.read.parquet(str(tmp_path / "log")).where("log_day = 'd2'").count() == 2


def test_profile_sink(spark, tmp_path):
    built = spark.createDataFrame([(1, 1, "a", 1, None), (2, 0, None, None, 1)], "entity_id int, is_churn int, city string, has_usage int, has_member int")
    files.write_profile(profile(built), built.columns, str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("*.json")).read_text()
    got = json.loads(text)
    assert got["rows"] == 2 and got["churn_rate"] == 0.5 and got["columns"] == built.columns


def test_policy_file(spark, tmp_path, monkeypatch):
    (tmp_path / "policy.json").write_text('{\n "best": {"threshold": 0.31}\n}')
    policy = files.read_policy(spark, str(tmp_path / "policy.json"))
    assert policy.select(payloads.policy_threshold(F.col("policy"))).first()[0] == 0.31
    assert files.read_policy(spark, str(tmp_path / "none.json")).count() == 0
    monkeypatch.setenv("CHURN_THRESHOLD", "0.6")
    override = F.lit(files.policy_override())
    assert policy.select(payloads.policy_threshold(F.col("policy"), override)).first()[0] == 0.6


def test_html_table_and_items(spark):
    page = ("<p>x</p><table class='t'><tr><th>Area</th><th>Total</th></tr>\n<tr><td> <b>Sofia</b> </td><td>1 234,5</td></tr></table>"
            "<table><tr><td>other</td></tr></table><ul><li>one</li><li><a href='#'>two</a></li></ul>")
    pages = spark.createDataFrame([(1, page), (2, "no table")], "id int, html string")
    rows = html.table_rows(pages, "id").orderBy("row_no").collect()
    assert [r["cells"] for r in rows] == [["Area", "Total"], ["Sofia", "1 234,5"]]
    assert [r["item"] for r in html.list_items(pages, "id").orderBy("position").collect()] == ["one", "two"]
    assert html.flat_header(["Total", "Urban"], ["", "men"]) == ["Total", "Urban_men"]


def test_unaligned_rows_are_an_error(spark):
    data = spark.createDataFrame([(1, 2.0), (2, 3.0)], "row_id int, v double")
    labels = spark.createDataFrame([(1, 1)], "row_id int, y int")
    with pytest.raises(Exception, match="unmatched row 2"):
        align_rows(data, labels, "row_id").collect()


def test_headers_temporal_columns_and_leaks(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4)], ["Call  Failure", " Charge Amount", "arpu_8", "Usage_Drop"])
    tidy = crm.tidy_header(frame)
    assert tidy.columns == ["Call_Failure", "Charge_Amount", "arpu_8", "Usage_Drop"]
    assert crm.temporal_columns(tidy) == ["arpu_8", "Usage_Drop"]
    for bad in ("PID", "crm_pid_value", "CHURN"):
        with pytest.raises(ValueError):
            crm.assert_no_ids(["arpu", bad])


def test_validation_splits(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (1.5, -1.0), (None, None)], "p double, c double")
    checked = rows.withColumn("errors", payloads.validation_errors({"p": F.col("p").between(0, 1), "c": F.col("c") >= 0}))
    good, bad = payloads.split_valid(checked)
    assert good.count() == 2 and bad.first()["errors"] == ["p", "c"]


def test_payload_shapes(spark):
    bodies = spark.createDataFrame([
        ('{"customer_id": "a", "total_subs": "2", "TotalRevenue": 10, "history_arpu": [1, 2.5]}',),
        ('[{"PID": 7, "Total_SUBs": 4.0}]',), ("[]",), ("text",), ('{"arpu": "bad"}',)], "body string")
    got = payloads.with_request(bodies, "body").select("customer_id", "total_subs", "arpu", "crm_segment", "history_arpu", "raw_body").collect()
    assert (got[0]["customer_id"], got[0]["total_subs"], got[0]["arpu"], got[0]["history_arpu"]) == ("a", 2.0, 5.0, [1.0, 2.5])
    assert (got[1]["customer_id"], got[1]["total_subs"]) == ("7", 4.0)
    assert got[3]["raw_body"] == "text" and got[4]["arpu"] == 0.0 and got[4]["crm_segment"] == "Unknown"
