"""The streams of the monitor log, drained into tables."""

import pytest

from foliant.plans import literature_queries as lq
from foliant.streaming import monitor as mo

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def log(spark, at, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{at}/parts")
    part = next(at.glob("parts/part-*.parquet"))
    part.rename(at / "events.parquet")
    return str(at)


@pytest.mark.parametrize("n", [0, 50])
def test_stream_dedup_is_kept_in_files(spark, tmp_path, n):
    """Rows of an appending stream go to the shared folder, not to a table in the driver's memory; the session's state store stays."""
    import datetime as dt

    rows = [(i % 40, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 40 + 7, "view", 1.0, None) for i in range(n)]
    before = spark.conf.get(mo.STATE, None)
    found = lq.q2_stream_dedup(spark, log(spark, tmp_path, rows))
    assert found.columns == ["event_id", "user_id"]
    assert sorted(tuple(r) for r in found.collect()) == [(i, i + 7) for i in range(min(n, 40))]
    assert found.inputFiles() and all("/shared/" in f for f in found.inputFiles())
    assert spark.conf.get(mo.STATE, None) == before
