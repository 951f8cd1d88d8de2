"""Sources, upserts and the streaming edge detector."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators.devices import session_documents
from gridloom.operators.edges import sharp_edges
from gridloom.sources import ingest
from gridloom.sources.tables import as_raw
from gridloom.streaming.edges import streaming_edges


def test_fetch_ranges_are_half_open_weeks(spark):
    latest = spark.createDataFrame([("h", dt.datetime(2024, 1, 1)), ("late", dt.datetime(2025, 1, 1))], "house_id string, ts timestamp")
    got = [(r["from"].day, r["to"].day) for r in ingest.fetch_ranges(latest, "2024-01-17").orderBy("from").collect()]
    assert got == [(1, 8), (8, 15), (15, 17)]


def test_responses(spark):
    body = json.dumps({"sums": {"1": {"60000": "5.5", "120000": "undef"}, "2": {"60000": "7"}, "3": {}}})
    raw = spark.createDataFrame([("h", body), ("h", "no json"), ("h", None)], "house_id string, body string")
    got = ingest.parse_responses(raw).orderBy("ts").collect()
    assert [(r.w1, r.w2, r.w3) for r in got] == [(5.5, 7.0, None), (None, None, None)]


def test_stored_rows_win(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert {(r.k, r.v) for r in ingest.upsert(old, new, ["k"], ["v"]).collect()} == {(1, "old"), (2, "a")}


def test_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Token\n1, '=abc \n2,nan\n3,x\n")
    (tmp_path / "b.csv").write_text("ID,Token\n3,y\n")
    got = {r.house_id: r.token for r in ingest.tokens(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).collect()}
    assert got == {"1": "abc", "3": "y"}


def test_match_log(spark):
    lines = [("x REJECTED: negative min=-12.5",), ("REJECTED negative min=-7.5",), ("Matched a",), ("other",)]
    got = {r.reason: (r.n, r.n_values, r.avg_value) for r in ingest.parse_match_log(spark.createDataFrame(lines, "value string")).collect()}
    assert got["negative"] == (2, 2, -10.0) and got["Matched"][0] == 1 and "other" not in got


def test_months_are_replaced_alone(spark, tmp_path):
    rows = lambda m, w: spark.createDataFrame([(1, m, w)], "house_id long, month string, watts double")
    for m, w in (("2024-01", 1.0), ("2024-02", 2.0), ("2024-02", 3.0)):
        ingest.write_months(rows(m, w), str(tmp_path / "t"))
    assert {(r.month, r.watts) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("2024-01", 1.0), ("2024-02", 3.0)}


@pytest.mark.parametrize("files", [1, 3])
def test_stream_finds_the_edges_of_the_batch(spark, tmp_path, files):
    watts = [100, 2100, 2100, 300, 300, 1900, 100, 2500, 100]
    rows = [(1, "w1", i, dt.datetime(2024, 1, 1, 0, i), float(w)) for i, w in enumerate(watts)]
    frame = spark.createDataFrame(rows, "house_id long, phase string, event_id long, ts timestamp, watts double")
    step = -(-len(rows) // files)
    for k in range(files):
        part = frame.where(F.col("event_id").between(k * step, (k + 1) * step - 1)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"edges{files}"
    q = streaming_edges(live, 1500).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.event, r.ts.minute) for r in spark.table(name).collect()}
    runs = sharp_edges(frame, 1500).collect()
    assert got == {("on" if d > 0 else "off", i) for i, d in ((1, 1), (3, -1), (5, 1), (6, -1), (7, 1), (8, -1))} and len(runs) == 6


def test_tables_of_any_form_are_raw_again(spark):
    raw = spark.createDataFrame([(1, 0, 1.0, float("nan"), 3.0, 4.0)], "house_id long, m int, `1` double, `2` double, `3` double, sum double")
    assert [tuple(r) for r in as_raw(raw).collect()] == [(1, 0, 1.0, None, 3.0)] and as_raw(raw).columns == ["house_id", "m", "w1", "w2", "w3"]
    done = spark.createDataFrame([(1, 0, 9.0, 5.0, 8.0)], "house_id long, m int, original_w1 double, remaining_w1 double, short_duration_w1 double")
    assert [tuple(r) for r in as_raw(done).collect()] == [(1, 0, 5.0)]


def test_session_documents_hold_the_sessions(spark):
    rows = [(1, 5, 2, 1.005, float("nan")), (1, 2, 3, float("inf"), 2.0), (2, 40 * 86400, 1, 1.0, 1.0)]
    stats = spark.createDataFrame(rows, "house_id long, start long, n long, size double, cv double")
    got = {(r.house_id, r.month): json.loads(r.document)["sessions"] for r in session_documents(stats).collect()}
    assert [s["start"] for s in got[1, "1970-01"]] == [2, 5] and got[2, "1970-02"][0]["n"] == 1
    assert "size" not in got[1, "1970-01"][0] and "cv" not in got[1, "1970-01"][1] and got[1, "1970-01"][0]["cv"] == 2.0
