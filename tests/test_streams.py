import datetime

import numpy as np
import pytest

from tidecast.functions import nets
from tidecast.streaming import events


def drained(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return stream.sparkSession.table(name)


def test_events_become_steps_and_late_ones_are_left_out(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=m)
    schema = "kind string, ts timestamp, v double"
    files = [
        [("a", at(0, 5), 1.0), ("a", at(0, 50), 2.0), ("b", at(0, 10), 5.0), ("a", at(1, 1), None), (None, at(0, 1), 9.0), ("a", None, 9.0)],
        [("a", at(3, 30), 4.0), ("b", at(2, 10), 1.0)],
        [("b", at(3, 40), 2.0)],
        [("a", at(1, 30), 7.0), ("a", at(0, 59), 100.0), ("a", at(8, 0), 1.0)],  # the second is behind the watermark of the files before: late
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {(r.series_id, r.ts.hour): (r.t, r.y) for r in drained(events.steps(stream, "kind", "ts", "v", "hour", "2 hours"), tmp_path, "steps").collect()}
    zero = int(at(0).replace(tzinfo=datetime.timezone.utc).timestamp()) // 3600
    assert got == {("a", 0): (zero, 3.0), ("b", 0): (zero, 5.0), ("a", 1): (zero + 1, 7.0), ("b", 2): (zero + 2, 1.0), ("a", 3): (zero + 3, 4.0), ("b", 3): (zero + 3, 2.0)}
    with pytest.raises(ValueError):
        events.steps(stream, "kind", "ts", "v", "fortnight", "2 hours")


@pytest.mark.parametrize("hidden", [0, 2])
def test_followed_weights_are_the_exact_weighted_least_squares(spark, tmp_path, hidden):
    rng = np.random.default_rng(5)
    y, forget, ridge = 5 + rng.normal(size=60).cumsum(), 0.97, 1e-2
    gone = {20, 21, 40}
    rows = [("a", t, float(v)) for t, v in enumerate(y) if t not in gone] + [("b", t, float(t)) for t in range(5)] + [("no plan", 1, 1.0)]
    for k, part in enumerate((rows[:30], rows[25:50], rows[50:])):
        spark.createDataFrame(part, "series_id string, t long, y double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema("series_id string, t long, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    plans = spark.createDataFrame([("a", [1, 3], -20.0, 30.0), ("b", [8], 0.0, 9.0)], "series_id string, lags array<int>, low double, high double")
    got = drained(events.follow(stream, plans, hidden, 2, forget, ridge, "last"), tmp_path, f"followed{hidden}").orderBy("series_id", "t").collect()
    mine = [r for r in got if r.series_id == "a"]
    full = y.copy()
    for t in sorted(gone):
        full[t] = full[t - 1]
    assert [r.t for r in mine] == list(range(60)) and np.allclose([r.y for r in mine], full) and {r.t for r in mine if r.filled} == gone
    import zlib

    z = 1.6 * (full + 20) / 50 - 0.8
    layer = nets.random_layer(2, hidden, False, np.random.default_rng([42, zlib.crc32(b"a")])) if hidden else None
    f = np.array([events.features(np.array([z[t - 1], z[t - 3]]), layer) for t in range(3, 60)])
    for t in range(3, 60):
        n = t - 3  # steps learned from before this one
        weight = forget ** np.arange(n - 1, -1, -1)
        w = np.linalg.solve((f[:n].T * weight) @ f[:n] + ridge * forget**n * np.eye(f.shape[1]), (f[:n].T * weight) @ z[3 : 3 + n]) if n else np.zeros(f.shape[1])
        assert np.isclose(mine[t].expected, (w @ f[n] + 0.8) / 1.6 * 50 - 20, atol=1e-6), t
    assert all(r.expected is None for r in mine[:3]) and mine[2].ahead is not None and all(r.ahead is None for r in got if r.series_id == "b")
