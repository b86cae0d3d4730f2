"""Streams over two files with a duplicate and a late row equal their batch form."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from agrispark import schemas
from agrispark.operators import alerts, latest, sequences
from agrispark.sources.telemetry import readings_from_events
from agrispark.streaming import readings as sr

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Readings as JSON lines in two files; the second repeats one row and holds one from before the first file ends."""
    path = tmp_path_factory.mktemp("readings")
    rows = readings_from_events(spark, SF).orderBy("ts", "event_id").toPandas()
    half = len(rows) // 2
    late = rows.iloc[[half - 30]]
    first = rows.iloc[:half].drop(rows.index[half - 30])
    second = pd.concat([rows.iloc[half:], rows.iloc[[half + 5]], late])
    for name, part, stamp in (("a.json", first, 1), ("b.json", second, 2)):
        part.to_json(path / name, orient="records", lines=True, date_format="iso", date_unit="us")
        os.utime(path / name, (stamp, stamp))
    return str(path)


def batch(spark, folder):
    return spark.read.schema(schemas.TELEMETRY).json(folder)


def test_alerts(spark, folder, tmp_path):
    got = sr.run_to_end(sr.alert_stream(sr.reading_stream(spark, folder, max_files=1)), str(tmp_path))
    expected = alerts.threshold_alerts(batch(spark, folder))
    assert sorted(r["alert_id"] for r in got.collect()) == sorted(r["alert_id"] for r in expected.collect())


def test_latest(spark, folder, tmp_path):
    got = sr.run_latest_to_end(sr.latest_stream(sr.reading_stream(spark, folder, max_files=1)), str(tmp_path))
    expected = latest.latest_per_node(batch(spark, folder))
    pairs = lambda f: {(r["node_id"], r["event_id"]) for r in f.collect()}
    assert pairs(got) == pairs(expected)


def test_duplicates_pass_once(spark, folder, tmp_path):
    got = sr.run_to_end(sr.deduplicated(sr.reading_stream(spark, folder)), str(tmp_path))
    assert got.count() == got.select("event_id").distinct().count() == batch(spark, folder).select("event_id").distinct().count()


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    """Spark compares a row with the watermark of the batch before, so the late row comes in the third file."""
    rows = readings_from_events(spark, SF).orderBy("ts", "event_id").toPandas()
    third = len(rows) // 3
    late = rows.iloc[[0]].assign(event_id=-1)
    source = tmp_path / "in"
    source.mkdir()
    for i, part in enumerate([rows.iloc[:third], rows.iloc[third:2 * third], pd.concat([rows.iloc[2 * third:], late])]):
        part.to_json(source / f"{i}.json", orient="records", lines=True, date_format="iso", date_unit="us")
        os.utime(source / f"{i}.json", (i + 1, i + 1))
    got = sr.run_to_end(sr.deduplicated(sr.reading_stream(spark, str(source), max_files=1)), str(tmp_path / "out"))
    assert got.count() == len(rows) and got.where("event_id = -1").count() == 0


@pytest.mark.parametrize("files", [100, 1])
def test_windows_equal_the_batch_behind_the_watermark(spark, tmp_path, files):
    """Readings out of order across files, each late by less than the watermark, and one replayed."""
    start = dt.datetime(2024, 1, 1)
    order = [0, 1, 4, 3, 2, 5, 6, 9, 8, 7, 10, 11]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(0, 12, 3):
        rows = [{"event_id": i, "ts": (start + dt.timedelta(minutes=i)).isoformat(), "node_id": "n", "moisture_pct": float(i)} for i in [*order[k:k + 3], *([1] if k == 3 else [])]]
        pd.DataFrame(rows).to_json(source / f"{k}.json", orient="records", lines=True)
        os.utime(source / f"{k}.json", (k + 1, k + 1))
    stream = sr.reading_stream(spark, str(source), max_files=files)
    got = sr.run_to_end(sr.rolling_windows(stream, "5 minutes", length=4), str(tmp_path / "out")).collect()
    moisture = {r["event_id"]: [s[3] for s in r["window"]] for r in got}
    assert len(got) == len(moisture)
    assert moisture == {i: [float(j) for j in range(i - 3, i + 1)] for i in range(3, 7)}


def write_in_turn(source, parts):
    source.mkdir(exist_ok=True)
    for k, rows in enumerate(parts):
        pd.DataFrame(rows).to_json(source / f"{k:03d}.json", orient="records", lines=True)
        os.utime(source / f"{k:03d}.json", (k + 1, k + 1))


def minute(i):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)).isoformat()


def test_windows_go_on_after_a_restart(spark, tmp_path):
    """Late, shuffled and replayed readings of two nodes, the query stopped and started again in the middle."""
    order = [0, 2, 1, 3, 5, 4, 7, 6, 8, 9, 11, 10, 12, 13, 15, 14, 17, 16, 19, 18]
    row = lambda i, n: {"event_id": 100 * (n == "m") + i, "ts": minute(i), "node_id": n, "moisture_pct": float(i)}
    parts = [[row(i, n) for i in [*order[k:k + 4], *order[max(0, k - 2):k]] for n in "nm"] for k in range(0, 20, 4)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    write_in_turn(source, parts[:3])
    run = lambda: sr.run_to_end(sr.rolling_windows(sr.reading_stream(spark, str(source), max_files=1), "5 minutes", length=4), out)
    first = run().count()
    write_in_turn(source, parts)
    rows = run().collect()
    assert 0 < first < len(rows) == len({r["event_id"] for r in rows})
    wanted = {100 * (n == "m") + i: [float(j) for j in range(i - 3, i + 1)] for n in "nm" for i in range(3, 15)}
    assert {r["event_id"]: [s[3] for s in r["window"]] for r in rows} == wanted


@pytest.mark.parametrize("files", [1, 100])
def test_silence_and_return(spark, tmp_path, files):
    """What is told is the same however the readings are dealt to batches; a gap that is just met is no silence."""
    times = {"quiet": [0], "busy": [0, 50, 100, 160, 200, 300, 390, 450], "late": [0, 30, 61, 200]}
    rows = [{"event_id": k, "ts": minute(i), "node_id": n} for k, (i, n) in enumerate(sorted((i, n) for n, t in times.items() for i in t))]
    shuffled = [rows[k] for j in range(0, len(rows), 4) for k in sorted(range(j, min(j + 4, len(rows))), reverse=True)]
    write_in_turn(tmp_path / "in", [shuffled[k:k + 4] for k in range(0, len(rows), 4)])
    stream = sr.silence_stream(sr.reading_stream(spark, str(tmp_path / "in"), max_files=files), 3600, "150 minutes")
    got = sr.run_to_end(stream, str(tmp_path / "out")).collect()
    stamp = lambda i: dt.datetime.fromisoformat(minute(i))
    wanted = set()
    for n, t in times.items():
        for a, b in zip(t, [*t[1:], None]):
            if b is None or b - a > 60:
                wanted |= {(n, "silent", stamp(a + 60), stamp(a))} | ({(n, "back", stamp(b), stamp(a))} if b is not None else set())
    assert {(r["node_id"], r["event"], r["at"], r["last_seen"]) for r in got} == {w for w in wanted if w[2] <= stamp(450 - 150)}
    assert len(got) == len({tuple(r) for r in got})


def test_latest_state_is_read_while_the_query_goes_on(spark, folder, tmp_path):
    stream = sr.latest_stream(sr.reading_stream(spark, folder, max_files=1))
    query = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path)).start()
    try:
        query.processAllAvailable()
        got = sr.latest_from_state(spark, str(tmp_path)).select("node_id", "event_id").collect()
    finally:
        query.stop()
    expected = latest.latest_per_node(batch(spark, folder)).select("node_id", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


class CountedState:
    """Value, list, map and timers of one key in memory; every call is counted."""

    def __init__(self, counter):
        self.counter, self.rows, self.value, self.timers = counter, [], None, []

    def __getattr__(self, name):
        calls = {
            "get": lambda: self.value if self.value is not None else iter(list(self.rows)), "update": lambda v: setattr(self, "value", v),
            "appendValue": self.rows.append, "put": lambda rows: setattr(self, "rows", list(rows)), "clear": self.rows.clear,
            "listTimers": lambda: iter(self.timers), "registerTimer": self.timers.append, "deleteTimer": self.timers.remove,
        }

        def call(*given):
            self.counter.append(name)
            return calls[name](*given)

        return call


class CountedHandle(CountedState):
    def getListState(self, name, schema):
        return CountedState(self.counter)

    def getValueState(self, name, schema):
        state = CountedState(self.counter)
        state.__dict__["get"] = lambda: (self.counter.append("get"), state.value)[1]
        return state


@pytest.mark.parametrize("processor", [sr.RollingWindows(4, ["moisture_pct"]), sr.Silence(3600)])
def test_state_is_called_by_batch_and_not_by_reading(processor):
    """A thousand readings of a node in two frames, passed in one go, cost a handful of calls."""
    calls = []
    processor.init(CountedHandle(calls))
    stamps = pd.date_range("2024-01-01", periods=1000, freq="1min")
    frame = pd.DataFrame({"ts": stamps, "event_id": range(1000), "moisture_pct": [float(i) for i in range(1000)]})
    list(processor.handleInputRows(("n",), iter([frame[500:], frame[:500]]), None))
    timer = type("Timer", (), {"getCurrentWatermarkInMs": lambda self: int(stamps[899].value // 1_000_000)})()
    out = list(processor.handleExpiredTimer(("n",), timer, None))
    assert len(calls) < 15
    if isinstance(processor, sr.RollingWindows):
        told = pd.concat(out)
        assert told["event_id"].tolist() == list(range(3, 900))
        assert [[s[0] for s in w] for w in told["window"]] == [[float(j) for j in range(i - 3, i + 1)] for i in range(3, 900)]


def test_windows_of_readings_without_an_id(spark, tmp_path):
    """A reading without an id comes before those of its time that have one, and has no id in the result either."""
    rows = [{"event_id": None if i % 2 else i, "ts": minute(i // 2 * 2), "node_id": "n", "moisture_pct": float(i)} for i in range(8)]
    later = [{"event_id": 99, "ts": minute(60), "node_id": "n", "moisture_pct": 0.0}]
    (tmp_path / "in").mkdir()
    for k, part in enumerate([rows, later]):
        pd.DataFrame(part).astype({"event_id": "Int64"}).to_json(tmp_path / "in" / f"{k}.json", orient="records", lines=True)
        os.utime(tmp_path / "in" / f"{k}.json", (k + 1, k + 1))
    stream = sr.reading_stream(spark, str(tmp_path / "in"), max_files=1)
    got = sr.run_to_end(sr.rolling_windows(stream, "5 minutes", length=2), str(tmp_path / "out")).collect()
    order = [1, 0, 3, 2, 5, 4, 7, 6]
    assert sorted((r["event_id"], [s[3] for s in r["window"]]) for r in got if r["event_id"] is not None) == [
        (i, [float(order[k - 1]), float(i)]) for k, i in enumerate(order) if k and i % 2 == 0
    ]
    assert len(got) == 7 and sum(r["event_id"] is None for r in got) == 3
