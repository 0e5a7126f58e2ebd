"""First elements by their times, whatever order a batch brings them in."""

from datetime import datetime, timedelta

from altloom.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp"


def test_the_earliest_counts_in_any_order(spark, tmp_path):
    place, root, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arriving = [
        [("a", 9), ("a", 2), ("b", 3), ("a", 0), ("a", 5), ("a", 4)],  # a: 0 and 5 stay, 9 lies within 5's horizon
        [("b", 6), ("a", 11), ("c", 12), ("a", 10), ("b", 8)],  # b: 3 holds 6, 8 is its horizon's end; a: 10
        [("a", 14), ("c", 11), ("d", 5), ("d", 16)],  # c came before; d's first is late
    ]
    for rows in arriving:
        days = [(k, START + timedelta(days=n)) for k, n in rows]
        spark.createDataFrame(days, SCHEMA).coalesce(1).write.mode("append").parquet(place)
        jobs.stream_dedupe(spark.readStream.schema(SCHEMA).parquet(place), "k", "ts", "5 days", root, state).awaitTermination()
    got = sorted((r.k, (r.ts - START).days) for r in spark.read.parquet(root).collect())
    assert got == [("a", 0), ("a", 5), ("a", 10), ("b", 3), ("b", 8), ("c", 12), ("d", 16)]
