"""Steps whose work must not gather in one task or one value."""

import base64
import hashlib
import random
from statistics import median

from pyspark.sql import Row
from pyspark.sql import functions as F
import pytest

from strataforge.operators import contracts, lifecycle
from strataforge.streaming.logs import LiveLog


def test_pairs_of_a_large_key_are_dealt_out(spark):
    rows = lambda n, name: spark.range(0, n, 1, 1).select(F.col("id").alias(name), F.when(F.col("id") % 10 == 0, "few").alias("k"), F.lit(1).alias("j"))
    pairs = lifecycle.identity_pairs(rows(9000, "a"), rows(3000, "b"), ["k", "j"])
    assert pairs.columns == ["a", "k", "j", "b"]
    per = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 8100 * 2700 + 900 * 300 and max(per) < sum(per) * 0.7
    assert pairs.where("(a % 10 = 0) <> (b % 10 = 0)").isEmpty() and pairs.where("a < 40").distinct().count() == 4 * 300 + 36 * 2700


class States:
    """States of one log in memory, with the number of calls for them."""

    def __init__(self):
        self.calls, self.value, self.parts = 0, None, {}

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.parts

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.parts[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls, self.parts[key] = self.calls + 1, value


@pytest.mark.parametrize("expire", [None, 60.0])
def test_a_live_log_calls_for_its_state_by_parts(expire):
    states, log, times = States(), LiveLog(None, expire), [random.Random(7).choice((k % 500, k, -k)) / 7 for k in range(12_000)]
    random.Random(5).shuffle(times)
    log.init(states)
    for end in (1, 3000, 3001, 12_000):
        start, before = {1: 0, 3000: 1, 3001: 3000, 12_000: 3001}[end], states.calls
        rows = [Row(file="f", line=k, terminated=True, processed=k, total=None, elapsed_seconds=float(k), last_id=str(k), item_seconds=times[k], phase="p", error=None) for k in range(start, end)]
        (got,) = log.handleInputRows(("f",), iter(rows[::-1]), None)
        assert got.records == got.timed_items == end and got.median_item_seconds == median(times[:end]) and got.slowest_item_seconds == max(times[:end])
        assert states.calls - before < 60


def test_stored_files_are_decoded_once(spark):
    raw = random.Random(3).randbytes(300_000)
    text = base64.encodebytes(raw).decode()
    rows = spark.createDataFrame([("file", "base64", t, None) for t in (text, text.replace("=", "") + "=-=", text + "é", "=" + text)], "type string, encoding string, content string, sha string")
    found = contracts.decoded_files(rows.withColumn("sha", contracts.blob_id_of_bytes(F.lit(raw)))).select("error", "raw")
    assert [(r.error, r.raw and bytes(r.raw)) for r in found.collect()] == [(None, raw), (None, raw), ("expected_base64_file", None), (None, raw)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("unbase64(") == 1


def test_base_sources_are_dealt_out_once(spark):
    a, b, gone = "a" * 40, "b" * 40, "c" * 40
    folder = f"{contracts.MATERIALIZED}/bt-1/"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    changes = [(k, folder + n) for k in (a, b, None, "bt") for n in ("BUNDLE_SOURCE.json", "run_task.py", "m.py")] + [(b, None)]
    declared = [(k, n, sha(n)) for k in (a, b, None, "bt", gone) for n in ("run_task.py", "m.py")] * 2
    contents = [(k, folder + n, bytearray(n.encode())) for k in (a, b, "bt", gone) for n in ("run_task.py", "m.py", "more.py")]
    heads = [(k, contracts.SOURCE_SCHEMAS[0], "bt-1") for k in (a, b, None, "bt")]
    frames = [spark.createDataFrame(rows, f"commit string, {more}") for rows, more in ((changes, "path string"), (declared, "name string, sha256 string"), (heads, "schema string, bundle_id string"), (contents, "path string, content binary"))]
    found = contracts.base_sources(*frames)
    assert {r.commit: (r.bundle_id, r.error) for r in found.collect()} == {a: ("bt-1", None), b: ("bt-1", "base_source_commit_scope_mismatch"), None: ("bt-1", "invalid_base_source_ref"), "bt": ("bt-1", "invalid_base_source_ref")}
    assert {r.error for r in contracts.base_sources(*frames[:2]).where("commit is null").collect()} == {"invalid_base_source_files"}
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 2  # the rows, and the heads
