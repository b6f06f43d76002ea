"""The queue of uploads: order, repeats, outcomes; streams equal tables."""

from datetime import datetime, timedelta

import pytest

from quillgraph.streaming import uploads

T0 = datetime(2024, 1, 1)
UPLOADS = "document_id long, text string, created_at timestamp"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, tmp_path, batches, schema=uploads.EVENTS):
    """The changes that the stream makes of the batches, one after the other, with restarts between them."""
    source, out = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = uploads.changes(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    return out


def up(d, text, minutes):
    return (d, "upload", at(minutes), text, None)


def test_newest_upload_counts(rocks, tmp_path):
    """A, B, A ends with A; what comes late and older is dropped; a repeated delivery changes nothing."""
    got = run(rocks, tmp_path, [[up(1, "A", 0), up(2, "x", 5)], [up(1, "B", 1)], [up(1, "A", 2), up(2, "older", 4)], [up(1, "A", 2), up(1, "B", 1), up(3, None, 0)]])
    assert [(r.document_id, r.text) for r in got if r.document_id == 1] == [(1, "A"), (1, "B"), (1, "A")]
    assert [(r.document_id, r.text) for r in got if r.document_id != 1] == [(2, "x"), (3, None)] and {r.status for r in got} == {"pending"}


def test_outcomes_go_forward_and_are_about_the_newest_upload(rocks, tmp_path):
    tell = lambda d, kind, minutes, error=None: (d, kind, at(minutes), None, error)
    batches = [[up(1, "A", 0)], [tell(1, "processing", 0)], [up(1, "B", 1), tell(1, "complete", 0)], [tell(1, "complete", 1), tell(1, "processing", 1)], [tell(1, "processing", 1), tell(1, "error", 1, "late")], [tell(9, "complete", 0)]]
    got = [(r.status, r.at.minute, r.text, r.error_message) for r in run(rocks, tmp_path, batches)]
    assert got == [("pending", 0, "A", None), ("processing", 0, None, None), ("pending", 1, "B", None), ("processing", 1, None, None), ("complete", 1, None, None)]


def test_stream_equals_table(rocks, tmp_path):
    """Whatever the order and the cut into batches, the last change of a document is its newest upload."""
    import random

    rng = random.Random(3)
    rows = [(d, f"text {rng.randint(0, 3)}", at(rng.randint(0, 9))) for d in range(6) for _ in range(5)]
    want = {r.document_id: (r.text, r.at) for r in uploads.newest(rocks.createDataFrame(rows, UPLOADS)).collect()}
    rng.shuffle(rows)
    got = {}
    for r in run(rocks, tmp_path, [[up(d, t, (w - T0).seconds // 60) for d, t, w in rows[i : i + 8]] for i in range(0, len(rows), 8)]):
        got[r.document_id] = (r.text, r.at)
    assert got == want
