from __future__ import annotations

import json

from tessera.operators.folds import circuit_states
from tessera.sources.logs import read_log, stream_log
from tessera.streaming import runs


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_run_states(spark, tmp_path):
    schema = "run_id long, sequence long, status string"
    first = [(1, 1, "created"), (1, 2, "running"), (2, 1, "running"), (3, 1, "created"), (3, 2, "succeeded")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, 3, "succeeded"), (1, 5, "running"), (1, 2, "paused")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drain(runs.run_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "run_states").collect()
    rules = {(r.run_id, r.sequence): r.rule for r in got if r.rule}
    assert rules[(2, 1)] == "first_not_created" and rules[(3, 2)] == "transition" and rules[(1, 5)] in ("not_contiguous", "transition")


def test_circuits_agree_with_the_batch(spark, tmp_path):
    schema = "provider string, at double, ordinal long, outcome string, retry_after double, epoch int"
    calls = [("p", float(i), i, o, None, None) for i, o in enumerate(["transport", "transport", "success", "transport", "transport", "transport", "success", "quota"])]
    df = spark.createDataFrame(calls, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, circuit_states(df).collect()))
    got = drain(runs.circuits(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "circuits")
    assert sorted(map(tuple, got.collect())) == want


def test_logs(spark, tmp_path):
    row = {"schema_version": "v1", "run_id": "a", "sequence": 1, "event_id": "x", "emitted_at": "t", "event": "e", "data": "{}"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(row) + "\n{bad\n" + json.dumps(row | {"sequence": 2}) + '\n{"run_id": "a", "seq')
    assert [r.sequence for r in read_log(spark, f"{tmp_path}/in").orderBy("sequence").collect()] == [1, 2]
    assert drain(stream_log(spark, f"{tmp_path}/in"), "logs").count() == 2


def test_activity(spark, tmp_path):
    schema = "loop long, role string, worker long, at long, kind string"
    spark.createDataFrame([(1, "r", 1, 1, "started"), (1, "r", 1, 2, "finished"), (1, "r", 2, 3, "started")], schema).write.parquet(f"{tmp_path}/in")
    got = drain(runs.activity(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "activity", "complete").collect()
    assert {(r.worker, r.kind) for r in got} == {(1, "finished"), (2, "started")}
