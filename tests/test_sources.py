import re
import struct

from pyspark.sql import functions as F

from lockstep.functions import text
from lockstep.sources.ch10 import PCM, TIME, TMATS, Ch10FilteredReader, Recording, follow_ch10, header_checksum, read_ch10, write_ch10
from lockstep.sources.recording import channel_catalog, pcm_packets, recording_gates, route_packets, time_packets, tmats_attributes
from lockstep.sources.series_csv import read_series_csv
from lockstep.streaming.tracker import run_available
from lockstep.workload import events


def packet(channel: int, kind: int, rel: int, body: bytes) -> bytes:
    length = 24 + len(body)
    head = struct.pack("<HHIIBBBB", 0xEB25, channel, length, len(body), 0, 0, 0, kind) + rel.to_bytes(6, "little")
    return head + struct.pack("<H", header_checksum(head)) + body


def recording() -> list[bytes]:
    tmats = b"\0\0\0\0" + "G\\PN:x;\nR-1\\TK1-1:13;\nR-1\\DSI-1:CH-01;\nR-1\\CDT-1:PCMIN;\nR-1\\CDLN-1:L1;\nR-1\\TK1-2:1;\nR-1\\CDT-2:11;\nP-1\\DLN:L1;\nP-1\\D2:5000000;\n".encode()
    clock = b"\0\0\0\0" + bytes([0x00, 0x05, 0x04, 0x03, 0x02, 0x00])  # day 2, 03:04:05
    out = [packet(0, TMATS, 0, tmats), packet(1, TIME, 1000, clock)]
    return out + [packet(13, PCM, 2000 + i, b"\1\2\3\4" + b"\x25\xeb" * 20 + bytes([i])) for i in range(50)]


def test_ch10(spark, tmp_path):
    packets = recording()
    path = f"{tmp_path}/a.ch10"
    with open(path, "wb") as handle:
        handle.write(b"".join(packets))
    for split in (None, 64, 1000):
        got = read_ch10(spark, path, split).orderBy("file_offset").collect()
        assert len(got) == 52 and bytes(got[-1].payload)[-1] == 49
    table = read_ch10(spark, path)
    assert table.where("data_type = 9 and channel_id = 13").count() == 50
    assert read_ch10(spark, path, 300, channel_ids=[13], data_types=[PCM]).count() == 50
    row = channel_catalog(tmats_attributes(table)).where("channel_id = 13").first()
    assert (row.name, row.type, row.bit_rate_bps) == ("CH-01", "PCMIN", 5e6)
    assert recording_gates(table, tmats_attributes(table)).count() == 0
    times = time_packets(table, spark.createDataFrame([(0, 1)], "source_id int, time_channel_id int"))
    assert times.first().abs_ticks == (86400 + 3 * 3600 + 4 * 60 + 5) * 10_000_000
    routed = pcm_packets(table, spark.createDataFrame([("s", 0, 13)], "stream_id string, source_id int, channel_id int"), times)
    first = routed.orderBy("ord").first()
    assert first.n_bits == 41 * 8 and first.base_ticks == times.first().abs_ticks + 1000
    broken = bytearray(b"".join(packets))
    broken[len(packets[0]) + len(packets[1]) + 5] ^= 0xFF
    with open(f"{tmp_path}/b.ch10", "wb") as handle:
        handle.write(broken)
    assert read_ch10(spark, f"{tmp_path}/b.ch10", 500).count() == 51


def test_two_scans_of_one_recording_keep_their_own_filters(spark, tmp_path):
    with open(f"{tmp_path}/a.ch10", "wb") as handle:
        handle.write(b"".join(recording()))
    source = Recording(spark, f"{tmp_path}/a.ch10", 300)
    both = source.of_type(PCM, [13]).unionByName(source.of_type(TIME)).unionByName(source.scan("channel_id = 0 and file_offset >= 0"))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Filter (") == 1 and "file_offset" in plan  # what the reader takes over is not filtered again
    assert sorted((r.data_type, n) for r, n in ((r, r["count"]) for r in both.groupBy("data_type").count().collect())) == [(1, 1), (9, 50), (17, 1)]
    assert source.headers().where("payload is not null").count() == 0
    assert source.of_type(PCM, []).count() == source.scan("channel_id in (1, 13) and channel_id = 7").count() == source.scan("source_id = 1").count() == 0


def test_bodies_of_other_channels_are_not_read(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    with open(f"{tmp_path}/a.ch10", "wb") as handle:
        handle.write(b"".join(recording()))
    reader = Ch10FilteredReader({"path": f"{tmp_path}/a.ch10"})
    left = list(reader.pushFilters([EqualTo(("data_type",), TIME), GreaterThan(("file_offset",), 3)]))
    assert left == [GreaterThan(("file_offset",), 3)]
    assert [b.num_rows for part in reader.partitions() for b in reader.read(part)] == [1]


def test_a_growing_recording_equals_its_batch(spark, tmp_path):
    """Packets arrive in pieces that end within a packet, a second file appears later, and every run is a restart."""
    whole = b"".join(recording())
    (tmp_path / "in").mkdir()
    cuts = [0, 10, 150, 1000, len(whole) - 3, len(whole)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        with open(f"{tmp_path}/in/b.ch10", "ab") as handle:
            handle.write(whole[a:b])
        if i == 3:
            with open(f"{tmp_path}/in/a.ch10", "wb") as handle:
                handle.write(whole)
        rows = run_available(follow_ch10(spark, f"{tmp_path}/in", 700), f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = read_ch10(spark, [f"{tmp_path}/in/b.ch10", f"{tmp_path}/in/a.ch10"])
    key = lambda frame: sorted((r.source_id, r.file_offset, r.channel_id, r.data_type, r.rel_time_100ns, bytes(r.payload)) for r in frame.collect())
    assert key(rows) == key(batch) and rows.count() == 104


def test_written_recordings_are_read_back(spark, tmp_path):
    rows = [(i % 3, PCM, 5 * i, bytes(range(i))) for i in range(40)]
    write_ch10(spark.createDataFrame(rows, "channel_id int, data_type short, rel_time_100ns long, payload binary").repartition(3), f"{tmp_path}/out")
    files = sorted(str(f) for f in (tmp_path / "out").iterdir())
    assert all(f.rsplit("/", 1)[1].startswith("part-") for f in files)
    got = read_ch10(spark, files, 128).collect()
    assert sorted((r.channel_id, r.data_type, r.rel_time_100ns, bytes(r.payload)) for r in got) == sorted(rows)


def test_csv_import(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfTime (DOY:HH:MM:SS.mmm),A Lock (%),S1| 13 - My Ch L_RCVR2\r\n1:00:00:00.000,50,\r\n   \r\n1:00:00:01.000,60,7\r\n")
    points, files = read_series_csv(spark, f"{tmp_path}/a.csv")
    got = sorted((r.metric, r.name, r.stream_label, r.stream_order, r.receiver, r.source_id, r.elapsed, r.value) for r in points.collect())
    assert got == [("level", "13 - My Ch L_RCVR2", "My Ch", 13, 2, 1, 1.0, 7.0), ("lock", "A", "A", 0, 0, 0, 0.0, 50.0), ("lock", "A", "A", 0, 0, 0, 1.0, 60.0)]
    assert tuple(files.first())[1:] == (True, 1, 1, 0.0, 1.0)


def test_csv_of_either_byte_order_in_one_folder(spark, tmp_path):
    """Characters whose bytes look like a line feed, half a surrogate pair, small splits, three encodings side by side."""
    body = "".join(f"1:00:00:{i:02d}.000,{i},{i + 1}\r\n" for i in range(30))
    names = ["\u0100\u0a05\u010a\u0a00", "\u0a05\u0100 \u000a05".replace("\n", "x"), "\U0001f600 caf\u00e9"]
    kinds = {"le": ("utf-16-le", b"\xff\xfe"), "be": ("utf-16-be", b"\xfe\xff"), "u8": ("utf-8", b"")}
    for kind, (codec, mark) in kinds.items():
        for i, name in enumerate(names):
            data = f"Time (DOY:HH:MM:SS.mmm),{name} Lock (%),B Lock (%)\r\n{body}".encode(codec)
            (tmp_path / f"{kind}{i}.csv").write_bytes(mark + data)
    half = "Time (DOY:HH:MM:SS.mmm),".encode("utf-16-le") + b"\x00\xd8" + "Z Lock (%)\n1:00:00:00.000,4\n".encode("utf-16-le")
    (tmp_path / "half.csv").write_bytes(b"\xff\xfe" + half + b"7")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        points, files = read_series_csv(spark, str(tmp_path))
        got = {}
        for r in points.collect():
            got.setdefault((r.file.rsplit("/", 1)[1], r.series_no), []).append((r.elapsed, r.value, r.name))
        status = {r.file.rsplit("/", 1)[1]: (r.ok, r.skipped) for r in files.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for kind in kinds:
        for i, name in enumerate(names):
            assert sorted(got[f"{kind}{i}.csv", 0]) == [(float(j), float(j), name) for j in range(30)], (kind, name)
            assert sorted(got[f"{kind}{i}.csv", 1]) == [(float(j), float(j + 1), "B") for j in range(30)]
            assert status[f"{kind}{i}.csv"] == (True, 0)
    assert got["half.csv", 0] == [(0.0, 4.0, "\ufffdZ")]


def test_text_rules(spark):
    rows = [("-0.0000004", -4e-7), ("0.5", 0.5), ("0.0078125", 0.0078125), ("0.1234565", 0.1234565)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, v double").select(text.format_fixed6("v")).collect()]
    assert got == ["-0.000000", "0.500000", "0.007813", f"{0.1234565:.6f}"]
    stamps = spark.range(1).select(text.clock_stamp(F.lit(1), F.lit(0.0), F.lit(-1.0)).alias("a"), text.round_millis(F.lit(-0.0625)).alias("b")).first()
    assert (stamps.a, stamps.b) == ("000:23:59:59.000", -63)


def test_csv_rows_by_the_millisecond_and_by_every_type(spark, tmp_path):
    """Of a type's samples in one millisecond the last stays; a null type and types of any name have columns of their own."""
    rows = [(1, 1_000_000, "b", 1.0), (2, 1_000_300, "b", 2.0), (3, 1_000_400, None, 3.0), (4, 1_001_600, "a", 4.0), (5, 2_000_000, "zz", 5.0)]
    spark.createDataFrame(rows, "event_id long, us long, event_type string, value double").selectExpr(
        "event_id", "event_type", "value", "timestamp_micros(us) as ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.ms: r.line for r in events.csv_rows(spark, str(tmp_path)).collect()}
    assert got == {0: "001:00:00:00.000,,2.000000,,3.000000", 2: "001:00:00:00.002,4.000000,,,", 1000: "001:00:00:01.000,,,5.000000,"}


def test_routing_gathers_no_channel_in_one_task(spark):
    """Stream tables made on the driver have no known size: without a word on it, Spark shuffles the packets by channel."""
    streams = spark.createDataFrame([("a", 1), ("b", 1)], "stream_id string, channel_id int")
    packets = spark.range(8).select((F.col("id") % 2).cast("int").alias("channel_id"), "id")
    routed = route_packets(packets, streams, ["channel_id"])
    assert "SortMergeJoin" not in routed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.stream_id, r.id) for r in routed.collect()) == sorted((s, i) for s in "ab" for i in (1, 3, 5, 7))


def test_csv_lines_of_one_file_do_not_meet_in_one_task(spark, tmp_path):
    """An export is one file, whatever its parts: a join of its lines by file would be one task's."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for codec, mark, encoding in (("utf-16-le", b"\xff\xfe", "UTF-16LE"), ("utf-8", b"", "UTF-8")):
            folder = tmp_path / codec
            folder.mkdir()
            (folder / "a.csv").write_bytes(mark + "Time (DOY:HH:MM:SS.mmm),A Lock (%)\r\n1:00:00:00.000,50\r\n1:00:00:01.000,60\r\n".encode(codec))
            points, _ = read_series_csv(spark, str(folder), one_export=True, encoding=encoding)
            plan = points._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"SortMergeJoin \[file#\d+(, (line_at|series_no)#\d+)?\]", plan)
            assert sorted((r.elapsed, r.value) for r in points.collect()) == [(0.0, 50.0), (1.0, 60.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
