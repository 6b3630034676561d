import json

from pyspark.sql import functions as F

from webloom import cli
from webloom.streaming.hostmemo import host_memo


def test_host_memo_stream(spark, tmp_path):
    schema = "domain string, silent boolean"
    source = tmp_path / "in"
    for i, rows in enumerate(([("a", True), ("b", True)], [("a", True), ("b", False)], [("a", True), ("b", True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = host_memo(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), 2)
    q = stream.writeStream.outputMode("update").format("memory").queryName("memo").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("memo").groupBy("domain").agg(F.max("n_silent").alias("n"), F.max("written_off").alias("off"), F.max("answered").alias("answered"))
    assert {r["domain"]: (r["n"], r["answered"]) for r in last.collect()} == {"a": (3, False), "b": (2, True)}
    assert {r["domain"]: r["off"] for r in last.collect()}["a"] is True


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame([("http://a.com/", "<p>privacy</p><a href='/b'>b</a>"), ("http://a.com/b", "<p>other</p>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    goal = tmp_path / "goal.txt"
    goal.write_text(" privacy \n")
    args = ["extract", "http://a.com/", "--schema", "sources array<string>", "--criteria", f"@{goal}", "--pages", str(tmp_path / "pages"), "--no-cache"]
    assert cli.main(args) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["path"] == ["http://a.com/", "http://a.com/b"] and out["data"] == {"sources": ["http://a.com/"]}
    assert cli.main([*args[:5], "nothing-there", *args[6:]]) == 2
    schema = tmp_path / "s.py"
    schema.write_text("Items = 'items array<string>'\n")
    assert cli.load_schema(f"{schema}:Items") == "items array<string>"
