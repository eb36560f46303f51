from collections import Counter
from pathlib import Path

from bitstreams import PACKET_SCHEMA, packets, split, stream, streams

import pytest
from pyspark.sql import functions as F

from lockstep.plans.recording import lock_percent
from lockstep.streaming.tracker import late_packets, latest_samples, lock_tracker, read_packets_stream, run_available
from lockstep.workload import live


@pytest.fixture(autouse=True)
def one_state_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def flushed(spark, source, config, tmp_path, delay="10 days", ticks=(4000,)):
    """A run over what is there, then one more per clock row: everything is due once the clock has passed it."""
    spark.createDataFrame([], "clock timestamp").write.mode("append").parquet(f"{tmp_path}/ticks/first")
    rows = None
    for i, days in enumerate((None, *ticks)):
        if days is not None:
            spark.sql(f"SELECT timestamp_seconds({days * 86400}) AS clock").write.parquet(f"{tmp_path}/ticks/{i}")
        clock = spark.readStream.schema("clock timestamp").parquet(f"{tmp_path}/ticks/*")
        rows = run_available(lock_tracker(source, config, delay, clock), f"{tmp_path}/out", f"{tmp_path}/cp")
    return rows


def test_stream_equals_batch(spark, tmp_path):
    gap = [(stream(1, 4), 1000.0), (stream(5, 6, 7)[4:], 1100.0)]
    parts = {"a": split(stream(1, 4) + "0" * 30 + "1001" + stream(5, 6)[4:], 7, 1000.0), "b": gap, "c": split(stream(1, 4, 5, 6, 7, 15), 7, 1000.0)}
    table, config = packets(spark, parts), streams(spark, list(parts))
    for i in range(3):
        table.where(f"ord div 8 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = read_packets_stream(spark, f"{tmp_path}/in/*", PACKET_SCHEMA)
    rows = flushed(spark, source, config, tmp_path)
    batch = {(r.stream_id, r.window_idx): r for r in lock_percent(table, config).collect()}
    got = latest_samples(rows).select(*next(iter(batch.values())).__fields__).collect()
    assert len(got) == len(batch)  # the last window of each stream included
    for r in got:
        assert r == batch[(r.stream_id, r.window_idx)]
    assert late_packets(rows).count() == 0 and rows.where("kind = 'silent'").select("stream_id").distinct().count() == 3


def test_shuffled_deliveries_equal_batch(spark, tmp_path):
    """Packets within the delay are placed in whatever order and trigger they come."""
    parts = {"a": split(stream(1, 4) + "0" * 30 + "1001" + stream(5, 6)[4:], 7, 1000.0), "b": split(stream(1, 4, 5, 6, 7, 15), 7, 1003.0)}
    table, config = packets(spark, parts), streams(spark, list(parts))
    for i in range(3):
        table.where(f"(ord * 7 + 3) % 3 = {i}").orderBy("n_bits", F.desc("ord")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    rows = flushed(spark, read_packets_stream(spark, f"{tmp_path}/in/*", PACKET_SCHEMA), config, tmp_path)
    batch = lock_percent(table, config)
    assert sorted(map(tuple, latest_samples(rows).select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert late_packets(rows).count() == 0


def test_late_packets_are_counted_by_window_and_change_nothing(spark, tmp_path):
    table, config = packets(spark, {"a": split(stream(1, 4, 5, 6, 7, 15), 7, 1000.0)}), streams(spark, ["a"])
    last = table.agg({"ord": "max"}).first()[0]
    table.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    source = read_packets_stream(spark, f"{tmp_path}/in/*", PACKET_SCHEMA)
    flushed(spark, source, config, tmp_path, "0 seconds", ())
    table.where(f"ord in (0, 2, {last - 1})").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    rows = flushed(spark, read_packets_stream(spark, f"{tmp_path}/in/*", PACKET_SCHEMA), config, tmp_path, "0 seconds")
    period = 15
    assert sorted((r.ord, r.window_idx) for r in late_packets(rows).collect()) == [(o, max(0, -(-7 * o // period) - 1)) for o in (0, 2, last - 1)]
    batch = lock_percent(table, config)
    assert sorted(map(tuple, latest_samples(rows).select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_a_stream_that_stops_gives_out_its_last_window(spark, tmp_path):
    """Stream a stops while b goes on: b's packets move the watermark, and a's last window comes without another packet of a."""
    quiet, busy = split(stream(1, 4), 7, 1000.0), split(stream(*range(1, 15), *range(1, 15)), 7, 1000.0)
    table, config = packets(spark, {"a": quiet, "b": busy}), streams(spark, ["a", "b"])
    table.write.parquet(f"{tmp_path}/in/0")
    rows = run_available(lock_tracker(read_packets_stream(spark, f"{tmp_path}/in/*", PACKET_SCHEMA), config, "5 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = {r.window_idx: r for r in lock_percent(table.where("stream_id = 'a'"), config).collect()}
    got = {r.window_idx: r for r in rows.where("stream_id = 'a' and kind in ('closed', 'silent')").collect()}
    last = max(got)
    assert got[last].kind == "silent" and last >= max(batch)
    assert all((got[w].lock_pct, got[w].missed, got[w].n_frames) == (r.lock_pct, r.missed, r.n_frames) for w, r in batch.items())


def test_payloads_stay_before_the_stream_key(spark, tmp_path):
    table, config = packets(spark, {"a": split(stream(1, 4), 7, 1000.0)}), streams(spark, ["a"])
    table.write.parquet(f"{tmp_path}/in/0")
    tracked = lock_tracker(read_packets_stream(spark, f"{tmp_path}/in/*", PACKET_SCHEMA), config)
    keyed = tracked._jdf.queryExecution().analyzed()
    while "WithState" not in keyed.nodeName():
        keyed = keyed.children().head()
    while keyed.nodeName() != "MapInArrow":
        keyed = keyed.children().head()
        assert "payload" not in keyed.output().toString()


def test_queries_read_folders_of_parts(spark, tmp_path):
    rows = [(i, "en" if i % 3 else "de", f"text {i} of it " * 40, "s", 9) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.stream_id: r.packets for r in live.read_stream(spark, str(tmp_path)).collect()} == {"en": 40, "de": 20}
    top = max(i for i, *_ in rows if i % 2 == 0) - live.DELAY * 10
    want = Counter()
    for s in ("en", "de"):
        given = [i for i, lang, *_ in rows if lang == s and i % 2 == 0 and i <= top]
        want.update((s, max(0, -(-(i - min(given)) // 10) - 1)) for i, lang, *_ in rows if lang == s and i % 2 and i < max(given))
    assert {(r.stream_id, r.window_idx): r.late for r in live.late(spark, str(tmp_path)).collect()} == dict(want)


def test_tracker_joins_its_settings_without_gathering_a_stream(spark, monkeypatch):
    """The packets' join with the settings must not be shuffled: payloads of a busy stream would meet in one task."""
    from lockstep.streaming import tracker

    seen = []
    monkeypatch.setattr(tracker, "per_stream", lambda df: seen.append(tracker.F.broadcast(df)) or seen[-1])
    stream = spark.readStream.format("rate").load().selectExpr(
        "'a' AS stream_id", "value AS chunk", "value AS ord", "8L AS n_bits", "value AS base_ticks", "CAST('x' AS binary) AS payload")
    settings = spark.createDataFrame([("a", False, False)], "stream_id string, swap_bytes boolean, inverted boolean").selectExpr(
        "*", *[f"CAST(1 AS {t.simpleString()}) AS {c}" for c, t in tracker._CONFIG.items()])
    rows = tracker.lock_tracker(stream, settings)
    assert len(seen) == 1 and "strategy=broadcast" in rows._jdf.queryExecution().analyzed().toString()


def test_gaps_of_a_folder_in_any_order_of_files(spark, tmp_path):
    """The files of a table are one delivery: none of its rows is late, whatever file comes first."""
    rows = [(i, i % 3, 1000 * i + (5_000_000 if i > 20 else 0)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ms long").selectExpr("event_id", "user_id", "timestamp_millis(ms) AS ts")
    for i, part in enumerate(("event_id >= 30", "event_id % 2 = 1 AND event_id < 30", "event_id % 2 = 0 AND event_id < 30")):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.source_id, r.file_offset, r.gap_s) for r in live.gap_alerts(spark, str(tmp_path)).collect())
    assert got == sorted((i % 3, i, 3.0 + (5000.0 if 20 < i < 24 else 0.0)) for i in range(3, 60))


class _State:
    """Map and value states as a processor sees them, with their calls counted."""

    def __init__(self):
        self.rows, self.value, self.calls = {}, None, 0

    def __getattr__(self, name):
        self.calls += 1
        return {"containsKey": self.rows.__contains__, "getValue": self.rows.__getitem__, "updateValue": self.rows.__setitem__, "removeKey": self.rows.pop,
                "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v)}[name]


def test_time_gaps_in_memory_and_by_spans(monkeypatch):
    """Few calls of state for many packets; late ones and ones that came twice have no gap; nothing stays in the map."""
    import numpy as np
    import pandas as pd

    from lockstep.streaming import tracker

    rng = np.random.default_rng(2)
    offsets = rng.permutation(4000) * 700
    ticks = {int(o): int(o) * 1000 + (0 if o % 9 else 50_000_000) for o in offsets}

    def run(held):
        monkeypatch.setattr(tracker, "_HELD_TIMES", held)
        work, out = tracker._GapAlerts(), []
        work.last, work.pending = _State(), _State()
        for some in (offsets[offsets < 1_400_000], np.r_[offsets[offsets >= 1_400_000], 700, 2_100_000]):
            frames = [pd.DataFrame({"file_offset": part, "abs_ticks": [ticks[int(o)] for o in part]}) for part in np.array_split(some, 5)]
            for found in work.handleInputRows((7,), iter(frames), None):
                out += [(s, o, None if pd.isna(g) else g) for s, o, g in found.itertuples(index=False)]
        assert not work.pending.rows
        return sorted(out, key=str), work.last.calls + work.pending.calls

    order = sorted(ticks)
    want = [(7, b, (ticks[b] - ticks[a]) / 1e7) for a, b in zip(order, order[1:]) if ticks[b] - ticks[a] > tracker.GAP_TICKS]
    want = sorted([*want, (7, 700, None), (7, 2_100_000, None)], key=str)
    assert run(1 << 16)[0] == run(300)[0] == want
    assert run(1 << 16)[1] < 10 and run(300)[1] < 200


def triggers(spark, run, tmp_path):
    """Triggers that read something when a table of six files is run through ``run``, and its rows."""
    texts = [sync + "x" * 96 for sync in (" den", " of ")]
    rows = [(i, texts[i % 2] * (1 + i % 3), "de" if i % 2 == 0 else "en") for i in range(36)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartitionByRange(6, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    start = live.scratch
    live.scratch = lambda s, name: made.append(start(s, name)) or made[-1]
    try:
        got = run(spark, str(tmp_path)).collect()
    finally:
        live.scratch = start
    state = next(p for p in made if "live-state" in p).removeprefix("file:")
    return len([p for p in Path(state, "sources", "0").iterdir() if p.name.isdigit()]), got


def test_a_delivery_of_many_files_is_one_trigger_of_the_tracker(spark, tmp_path):
    """Each file was a trigger, of seconds each."""
    n, got = triggers(spark, live.tracker, tmp_path)
    assert n == 1 and {r.stream_id for r in got} == {"de", "en"}


def test_a_delivery_of_many_files_is_one_trigger_of_open_windows(spark, tmp_path):
    n, got = triggers(spark, live.open_windows, tmp_path)
    assert n == 1 and {(r.stream_id, r.ord) for r in got} == {("de", 34), ("en", 35)}
