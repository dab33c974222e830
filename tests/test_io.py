"""Sources, sinks and small schema-level operators."""

import json

from pyspark.sql import functions as F

from tabforge.operators.profile import dtype_histogram
from tabforge.sources import io as IO


def test_read_formats(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("a,b,c\n1,x,2.5\n2,y,\n")
    df = IO.read_table(spark, str(csv))
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "double"} and df.count() == 2
    arr = tmp_path / "t.json"
    arr.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], indent=2))
    assert IO.read_table(spark, str(arr)).count() == 2
    lines = tmp_path / "l.json"
    lines.write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert IO.read_table(spark, str(lines)).count() == 3
    mem = spark.range(3)
    assert IO.read_table(spark, "/does/not/matter.csv", df=mem) is mem


def test_json_is_read_alike_by_file_folder_and_uri(spark, tmp_path):
    def ways(name, text):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "t.json").write_text(text)
        return [str(folder / "t.json"), str(folder), f"file://{folder}/t.json", f"file://{folder}"]
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}, {"a": 3, "b": "z"}]
    for name, text in {"array": json.dumps(rows, indent=2), "open": "\n[" + ",\n".join(map(json.dumps, rows)) + "]",
                       "lines": "\n".join(map(json.dumps, rows)), "arrays": "\n".join(json.dumps([r]) for r in rows),
                       "long": "\n".join(json.dumps(r | {"c": "c" * 5000}) for r in rows)}.items():
        for path in ways(name, text):
            df = IO.read_table(spark, path, fmt="json")
            assert sorted(r.a for r in df.collect()) == [1, 2, 3] and "_corrupt_record" not in df.columns
    for path in ways("one", '{"a": "' + "c" * 5000 + '",\n "b": 7}'):
        assert [r.b for r in IO.read_table(spark, path, fmt="json").collect()] == [7]
        assert "_corrupt_record" in IO.read_table(spark, path, fmt="json", multi_line=False).columns


def test_report_json_cuts_arrays(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(250)).alias("xs"), F.lit("r").alias("name"))
    doc = json.loads(IO.report_json(df).first()["json"])
    assert len(doc["xs"]) == 100 and doc["name"] == "r"


def test_write_outputs_and_dtypes(spark, tmp_path):
    from tabforge.plans.score import ScoreResult, write_outputs
    preds = spark.range(5).withColumn("prediction", F.col("id") * 2.0)
    checks = spark.createDataFrame([("passed", "pass", "0")], "check string, status string, value string")
    write_outputs(ScoreResult(preds, None, checks, None), str(tmp_path / "out"), "csv")
    assert IO.read_table(spark, str(tmp_path / "out" / "predictions"), fmt="csv").count() == 5
    h = {r["dtype"]: r["n_columns"] for r in dtype_histogram(preds).collect()}
    assert h == {"bigint": 1, "double": 1}


def test_top_models(spark):
    from tabforge.plans.train import rank_best, top_models
    board = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.9), ("c", 2, 0.9), ("d", 3, None)],
                                  "model string, model_order int, r2 double")
    ranked = rank_best(board, "r2")
    assert [r["model"] for r in top_models(ranked, 3).collect()] == ["b", "c", "a"]
