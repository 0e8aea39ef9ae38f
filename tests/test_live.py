"""Live logs: batches, restarts, repeats and silence give the summaries of the whole logs."""

import pytest

from strataforge.operators.progress import monotony_errors, progress_summary
from strataforge.streaming.logs import STATE_STORE, SUMMARY, live_summaries, newest

KIND = "file string, line long, terminated boolean, processed long, total long, elapsed_seconds double, last_id string, item_seconds double, phase string, error string"


@pytest.fixture
def live(spark, tmp_path):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)

    def run(rows, **more):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
        put = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={epoch}")
        live_summaries(stream, **more).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(SUMMARY).parquet(f"{tmp_path}/out")

    yield run
    for k in STATE_STORE:
        spark.conf.unset(k)


def row(file, line, processed=None, elapsed=None, seconds=None, error=None, terminated=True):
    return (file, line, terminated, line if processed is None else processed, 100, float(line if elapsed is None else elapsed), f"i{line}", seconds, "p", error)


def test_batches_equal_the_whole(spark, live):
    batches = [
        [row("good", 2, seconds=3.0), row("good", 1, seconds=9.0), row("falls", 1, processed=5), row("bad", 1), row("cut", 1, seconds=1.0), row("even", 1, seconds=4.0)],
        [row("good", 3, seconds=9.0), row("falls", 2, processed=4), row("falls", 3), row("bad", 2, error="invalid_total"), row("bad", 3), row("cut", 2, error="invalid_json", terminated=False), row("even", 2, seconds=1.0)],
        [row("good", 4), row("only", 1, error="invalid_json", terminated=False)],
    ]
    for batch in batches:
        found = live(batch)
    again = live([*batches[0], row("good", 3, processed=0, error="invalid_total")])  # lines that came before change nothing
    whole = spark.createDataFrame([r for b in batches for r in b], KIND)
    columns = ["file", "status", "reason", "records", "line", "processed", "total", "reported_elapsed_seconds", "last_id", "last_item_seconds", "phase", "truncated_final_line", "timed_items", "median_item_seconds", "slowest_item_seconds", "slowest_id"]
    want = sorted(map(repr, progress_summary(monotony_errors(whole)).select(*columns).collect()))
    for rows in (found, again):
        assert sorted(map(repr, newest(rows).select(*columns).collect())) == want
    assert {r.file: r.status for r in newest(again).collect()} == {"good": "valid", "falls": "invalid", "bad": "invalid", "cut": "partial", "even": "valid", "only": "partial"}
