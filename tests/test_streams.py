"""Windows that the watermark closes: written once, forgotten, and late rows counted."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.streaming.windows import closed_windows

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, value double"


def test_state_stays_flat_and_late_rows_are_counted(spark, tmp_path):
    source, folder, held, late = f"{tmp_path}/in", f"{tmp_path}/out", [], 0
    start, written = datetime(2024, 1, 1), []

    def feed(n, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return closed_windows(stream, folder)

    for day in range(12):
        rows = [(day * 10 + k, k, start + timedelta(days=day, hours=2 * k), "click" if k % 2 else "view", float(k)) for k in range(6)]
        written += rows
        if day == 8:  # a week late: its window is closed
            rows = [*rows, (999, 0, start + timedelta(days=1), "view", 1e9)]
        told = feed(day, rows)
        late += told["late"]
        held.append(told["held"])
    assert late == 1 and max(held[3:]) <= max(held[:4]) <= 8  # days within the delay, two kinds each
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/rows").select(F.timestamp_micros("start_us"), "event_type", "n", "total").collect())
    last = max(r[2] for r in written) - timedelta(days=1)
    want = {}
    for _, _, ts, kind, value in written:
        day = datetime(ts.year, ts.month, ts.day)
        if day + timedelta(days=1) <= last:
            n, total = want.get((day, kind), (0, 0.0))
            want[day, kind] = n + 1, total + value
    assert got == sorted((*k, *v) for k, v in want.items()) and len(got) == 20
