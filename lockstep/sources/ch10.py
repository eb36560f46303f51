"""Spark data source for IRIG 106 Chapter 10 recordings: ``format("ch10")`` to read, to follow as they grow, and to write.

A file is split by byte range and every split finds its own first packet, so one large recording is read by many tasks. A packet
belongs to the split its header starts in. A header counts only with its sync word and checksum right; a broken one costs its own
packet, and reading goes on at the next good header.

A growing recording is a stream whose offset is a byte of every file, always the end of a whole packet; what is still being written waits. Files
only grow, so an offset pair names the same packets however often it is read.

Filters on source, channel and type can be pushed down: then other packets' bodies are never read. Spark keeps pushed filters with the
relation, not with the scan, so two differently filtered uses of one frame would share the later one's. `Recording.scan` therefore makes
a relation of its own for every use; frames from `read_ch10` push nothing.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull,
                                    WriterCommitMessage)

# The packet header of the public standard.
SYNC = 0xEB25
SYNC_BYTES = b"\x25\xeb"
HEADER = 24
SECONDARY_HEADER = 12
SECONDARY_FLAG = 0x80
TMATS, PCM, TIME = 0x01, 0x09, 0x11

SCHEMA = ("source_id int, file_offset long, channel_id int, data_type short, flags short, packet_len long, data_len long, "
          "rel_time_100ns long, payload binary")
_WINDOW = 8 << 20
_BATCH_BYTES = 16 << 20


def header_checksum(header: bytes) -> int:
    """Sum of the header's first eleven 16-bit words."""
    return sum(struct.unpack("<11H", header[:22])) & 0xFFFF


def is_header(header: bytes) -> bool:
    if len(header) < HEADER or header[:2] != SYNC_BYTES:
        return False
    length, = struct.unpack_from("<I", header, 4)
    return length >= HEADER and header_checksum(header) == struct.unpack_from("<H", header, 22)[0]


@dataclass
class Split(InputPartition):
    source_id: int
    path: str
    start: int
    end: int
    size: int


class Ch10Source(DataSource):
    """Options: ``path`` (comma-separated files; a stream and a writer take a folder too), ``splitBytes`` (default 128 MiB), ``payload`` (false
    leaves bodies unread), ``channelIds`` and ``dataTypes`` (comma-separated; other packets' bodies are never read), ``firstSourceId``,
    ``pushdown`` (true takes filters of the plan; see `Recording`)."""

    @classmethod
    def name(cls) -> str:
        return "ch10"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushes = {k.lower(): v for k, v in self.options.items()}.get("pushdown", "false").lower() == "true"
        return (Ch10FilteredReader if pushes else Ch10Reader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Ch10StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Ch10Writer(dict(self.options), schema.fieldNames())


class Ch10Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        lowered = {k.lower(): v for k, v in options.items()}
        self.paths = [p for p in lowered["path"].split(",") if p]
        self.split_bytes = int(lowered.get("splitbytes", 128 << 20))
        self.with_payload = lowered.get("payload", "true").lower() != "false"
        self.first_source = int(lowered.get("firstsourceid", 0))
        self.wanted = {name: {int(v) for v in lowered[option].split(",")} for name, option in
                       (("channel_id", "channelids"), ("data_type", "datatypes")) if lowered.get(option)}

    def partitions(self) -> list[Split]:
        out = []
        for i, path in enumerate(self.paths):
            fs, name = _filesystem(path)
            size = fs.get_file_info(name).size
            if self.first_source + i not in self.wanted.get("source_id", {self.first_source + i}):
                continue
            out += [Split(self.first_source + i, path, at, min(at + self.split_bytes, size), size)
                    for at in range(0, size, self.split_bytes)]
        return out

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark reads once even where there is nothing to read
            return
        rows: list[tuple] = []
        held = 0
        for row in self._packets(partition):
            rows.append(row)
            held += len(row[-1] or b"") + 64
            if held > _BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _packets(self, split: Split) -> Iterator[tuple]:
        channels, types = self.wanted.get("channel_id"), self.wanted.get("data_type")
        fs, name = _filesystem(split.path)
        with fs.open_input_file(name) as handle:
            at = _next_header(handle, split.start, split.end, split.size, chained=split.start > 0)
            while at is not None and at < split.end:
                handle.seek(at)
                head = handle.read(HEADER)
                if not is_header(head):
                    at = _next_header(handle, at + 1, split.end, split.size, chained=False)
                    continue
                channel, length, data_len = struct.unpack_from("<HII", head, 2)
                flags, kind = head[14], head[15]
                if (channels is None or channel in channels) and (types is None or kind in types):
                    rel = int.from_bytes(head[16:22], "little")
                    skip = SECONDARY_HEADER if flags & SECONDARY_FLAG else 0
                    body = None
                    if self.with_payload:
                        handle.seek(at + HEADER + skip)
                        room = max(0, length - HEADER - skip)
                        body = handle.read(min(room, data_len) if data_len else room)
                    yield split.source_id, at, channel, kind, flags, length, data_len, rel, body
                at += length


class Ch10FilteredReader(Ch10Reader):
    """A reader that takes filters of the plan. Spark demands ``spark.sql.python.filterPushdown.enabled`` for it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and membership of source, channel and type are taken over; the rest is left to Spark."""
        for given in filters:
            column = given.attribute[0] if hasattr(given, "attribute") and len(given.attribute) == 1 else None
            if column not in ("source_id", "channel_id", "data_type"):
                yield given
            elif isinstance(given, EqualTo | In):
                values = {given.value} if isinstance(given, EqualTo) else set(given.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif not isinstance(given, IsNotNull):  # these columns are never null
                yield given


class Ch10StreamReader(Ch10Reader, DataSourceStreamReader):
    """Files of ``path`` as they grow. The offset lists files in the order they were first seen, which numbers the sources."""

    def __init__(self, options: dict) -> None:
        Ch10Reader.__init__(self, options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        for path, size in sorted(self._files()):
            self.known[path] = _whole_packets(path, self.known.get(path, 0), size)
        return {"files": [[path, upto] for path, upto in self.known.items()]}

    def _files(self) -> Iterator[tuple[str, int]]:
        from pyarrow import fs as arrow

        for path in self.paths:
            fs, name = _filesystem(path)
            info = fs.get_file_info(name)
            found = fs.get_file_info(arrow.FileSelector(name)) if info.type == arrow.FileType.Directory else [info] if info.type == arrow.FileType.File else []
            for file in found:
                if file.type == arrow.FileType.File and not file.base_name.startswith((".", "_")):
                    yield (path.rstrip("/") + "/" + file.base_name if info.type == arrow.FileType.Directory else path), file.size

    def partitions(self, start: dict, end: dict) -> list[Split]:
        begun = dict(map(tuple, start["files"]))
        self.known = {**dict(map(tuple, end["files"])), **self.known}  # after a restart the order and places of before hold
        return [Split(self.first_source + i, path, at, min(at + self.split_bytes, upto), upto)
                for i, (path, upto) in enumerate(end["files"]) for at in range(begun.get(path, 0), upto, self.split_bytes)]

    def commit(self, end: dict) -> None:
        pass


def _whole_packets(path: str, since: int, size: int) -> int:
    """End of the last whole packet of a file that is ``size`` bytes long now, no less than ``since`` (such an end itself)."""
    fs, name = _filesystem(path)
    with fs.open_input_file(name) as handle:
        back = _WINDOW
        while True:
            start = max(since, size - back)
            at = start if start == since and _good_at(handle, start) else _next_header(handle, start, size, size, chained=True)
            end = since
            while at is not None and at + HEADER <= size:
                handle.seek(at)
                head = handle.read(HEADER)
                if not is_header(head):
                    at = _next_header(handle, at + 1, size, size, chained=True)
                    continue
                at += struct.unpack_from("<I", head, 4)[0]
                if at <= size:
                    end = at
            if end > since or start == since:
                return end
            back *= 4  # the last packet is longer than what was searched


@dataclass
class Written(WriterCommitMessage):
    path: str


class Ch10Writer(DataSourceWriter):
    """One file per partition from ``channel_id, data_type, rel_time_100ns, payload`` (other columns are not written), packets in the order
    of the rows. Files appear under their names once the whole write has succeeded."""

    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path = {k.lower(): v for k, v in options.items()}["path"].rstrip("/")
        self.places = [columns.index(c) for c in ("channel_id", "data_type", "rel_time_100ns", "payload")]

    def write(self, iterator) -> Written:
        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"_{uuid.uuid4().hex}.ch10"
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for n, row in enumerate(iterator):
                channel, kind, rel, body = (row[i] for i in self.places)
                body = bytes(body or b"")
                spare = -len(body) % 4  # packets are whole 32-bit words
                head = struct.pack("<HHIIBBBB", SYNC, channel, HEADER + len(body) + spare, len(body), 1, n & 0xFF, 0, kind) + (rel & (2**48 - 1)).to_bytes(6, "little")
                out.write(head + struct.pack("<H", header_checksum(head)) + body + b"\0" * spare)
        return Written(f"{folder}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _filesystem(self.path)
        for place, message in enumerate(messages):
            if message:
                fs.move(message.path, f"{folder}/part-{place:05d}{message.path.rsplit('/_', 1)[1]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _filesystem(self.path)
        for message in messages:
            if message:
                fs.delete_file(message.path)


def _filesystem(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _next_header(handle, start: int, end: int, size: int, chained: bool) -> int | None:
    """Offset of the first good header in ``[start, end)``. Where reading starts in the middle of a file it must also be followed by
    one (or by the file's end), so bytes of a body that look like a header are not taken for one."""
    at = start
    while at < end:
        handle.seek(at)
        block = handle.read(min(_WINDOW, end - at) + HEADER)
        place = block.find(SYNC_BYTES)
        while place >= 0 and at + place < end:
            head = block[place: place + HEADER]
            if is_header(head):
                follow = at + place + struct.unpack_from("<I", head, 4)[0]
                if not chained or follow >= size or _good_at(handle, follow):
                    return at + place
            place = block.find(SYNC_BYTES, place + 1)
        at += _WINDOW
    return None


def _good_at(handle, offset: int) -> bool:
    handle.seek(offset)
    return is_header(handle.read(HEADER))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Ch10Source)


def read_ch10(spark: SparkSession, paths: list[str] | str, split_bytes: int | None = None, payload: bool = True,
              channel_ids: list[int] | None = None, data_types: list[int] | None = None):
    """Packets of one or many recordings; ``source_id`` is the place in ``paths``. Packets of channels and types not asked for are
    skipped by their headers."""
    register(spark)
    reader = spark.read.format("ch10").option("path", paths if isinstance(paths, str) else ",".join(paths))
    if split_bytes:
        reader = reader.option("splitBytes", str(split_bytes))
    for name, values in (("channelIds", channel_ids), ("dataTypes", data_types)):
        if values is not None:
            reader = reader.option(name, ",".join(map(str, values)))
    return reader.option("payload", str(payload).lower()).load()


class Recording:
    """Recordings to be scanned several times, each time with a relation and pushed filters of its own."""

    def __init__(self, spark: SparkSession, paths: list[str] | str, split_bytes: int | None = None):
        register(spark)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.spark, self.paths, self.split_bytes = spark, [paths] if isinstance(paths, str) else list(paths), split_bytes

    def scan(self, where: Column | str | None = None, payload: bool = True) -> DataFrame:
        """Packets under ``where``, bodies unread without ``payload``. Take a scan for every use, rather than filter one in two ways."""
        reader = self.spark.read.format("ch10").option("path", ",".join(self.paths)).option("pushdown", "true").option("payload", str(payload).lower())
        packets = (reader.option("splitBytes", str(self.split_bytes)) if self.split_bytes else reader).load()
        return packets if where is None else packets.where(where)

    def headers(self) -> DataFrame:
        """Every packet without its body."""
        return self.scan(payload=False)

    def of_type(self, data_type: int, channels: list[int] | None = None) -> DataFrame:
        """Packets of one type, of some channels: only their bodies are read."""
        kind = F.col("data_type") == data_type
        return self.scan(kind if channels is None else kind & F.col("channel_id").isin(channels))


def follow_ch10(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Packets of a growing file, or of the files of a folder, as a stream with the columns of `read_ch10`."""
    register(spark)
    reader = spark.readStream.format("ch10").option("path", path)
    return (reader.option("splitBytes", str(split_bytes)) if split_bytes else reader).load()


def write_ch10(packets: DataFrame, path: str) -> None:
    """Append packets (``channel_id, data_type, rel_time_100ns, payload``) to a folder of recordings, one file per partition."""
    register(packets.sparkSession)
    packets.select("channel_id", "data_type", "rel_time_100ns", "payload").write.format("ch10").mode("append").save(path)
