"""Packet captures of any size as a Spark data source, in batch and as a stream.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load(path)        # packets
    spark.readStream.format("capture").load(path)  # packets as files come and grow

A file longer than the option splitBytes is read by several tasks.  Both tasks
at a cut find the same record there by themselves (`capture_records.boundary`),
and the one before has to land on it: a cut that is no record's start stops the
read instead of giving wrong rows.  Sections and interfaces that a block
capture names after its head have to be known to the tasks behind them;
`read_captures` walks the record heads of split files first, as a Spark job,
hands those over, and reads files in one piece where a walk did not land.

A stream's offset is the length of each file, up to which whole records have
been read; the record that a length cuts is read once the file has grown.

Files are opened through pyarrow, so paths are local, or of a store that it
knows (hdfs, s3, gs).  Rows are those of `captures.SCHEMA` with ord, the place
of the packet's record in its file in bytes, and at the end of each file or
part a row without ord that reports (packets, ignored, truncated, error).
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .capture_records import LONGEST, Layout, Paged, Walk, boundary, layout, walk
from .captures import SCHEMA, decode

ROWS = SCHEMA + ", packets long, ignored long, error string"
#: What a walk over record heads tells of one part of a file.
PARTS = "capture string, part int, landed boolean, heads string, error string"
SPLIT_BYTES = 128 << 20
BATCH = 20_000


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def listed(path: str) -> dict[str, int]:
    """Length of each file at a path, of all in a folder, or of those that a pattern in its last part names."""
    from pyarrow import fs

    system, where = opened(path)
    prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
    folder, _, last = where.rpartition("/")
    info = system.get_file_info(where) if "*" not in last else None
    if info is not None and info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info is not None and info.type == fs.FileType.File:
        return {prefix + where: info.size}
    found = system.get_file_info(fs.FileSelector(folder if "*" in last else where))
    return {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and ("*" not in last or fnmatch.fnmatch(f.base_name, last))}


@dataclass
class Part(InputPartition):
    """Part of a file: between nominal cuts, and heads (places of sections and interfaces) that stand before it."""

    path: str
    size: int
    low: int
    cuts: list[int]  # nominal cuts after low, ascending, the last one first taken
    number: int = 0
    heads: list[int] | None = None  # None: none are known but those at the file's head
    exact: bool = False  # low is a record's start


def parts_of(path: str, size: int, split: int, heads: list[int] | None) -> list[Part]:
    """Parts of about split bytes; the last one is at least half as long."""
    cuts = list(range(split, size - split // 2, split)) if split > 0 else []
    return [Part(path, size, low, cuts[k:], k, heads, k == 0) for k, low in enumerate([0, *cuts])]


def _prepared(part: Part, cover: int) -> tuple[Paged, Layout, int | None, int]:
    """(data, layout with the interfaces before the part, its first record or None, where the next part begins)."""
    system, where = opened(part.path)
    data = Paged(system.open_input_file(where), part.size)
    shape = layout(data)
    start = max(part.low, shape.first) if part.exact else boundary(data, shape, part.low, cover)
    stop = next((b for cut in part.cuts if (b := boundary(data, shape, cut, cover)) is not None), part.size)
    if start is not None and start < stop and not shape.classic and start > 0:
        _read_heads(data, shape, start, part.heads)
    return data, shape, start, stop


def _read_heads(data: Paged, shape: Layout, start: int, heads: list[int] | None) -> None:
    """Let the sections and interfaces before start shape what follows: the known ones, or those that open the file."""
    if heads is None:
        at = 0
        while at < start:
            told = Walk(at)
            packets = list(walk(data, shape, at, at + 1, told))
            if packets or told.damaged or not told.heads:
                break
            at = told.at
        return
    for at in heads:
        if at < start:
            list(walk(data, shape, at, at + 1, Walk(at)))


class PacketReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.split, self.cover = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("coverbytes", LONGEST))
        self.walk_only = options.get("mode") == "walk"
        self.plan = json.loads(options.get("plan", "{}"))

    def partitions(self) -> list[Part]:
        out = []
        for path, size in sorted(listed(self.path).items()):
            known = self.plan.get(path, {})
            parts = parts_of(path, size, 0 if known.get("whole") else self.split, known.get("heads"))
            out += parts if not self.walk_only or len(parts) > 1 else []
        return out

    def read(self, part: Part | None) -> Iterator:
        if part is None:  # no files at all
            return
        if not self.walk_only:
            yield from packet_batches(part, self.cover, strict=True)
            return
        try:
            data, shape, start, stop = _prepared(part, self.cover)
        except ValueError as e:
            yield (part.path, part.number, False, "[]", str(e))
            return
        told = Walk(stop)
        if start is not None and start < stop:
            told.at = start
            for _ in walk(data, shape, start, stop, told):
                pass
        # a walk that ends at damage before the file's end would go on in the next part
        landed = (told.at == stop and not told.damaged or stop == part.size) and (start is None or start <= stop)
        yield (part.path, part.number, landed, json.dumps(told.heads), None)


def packet_batches(part: Part, cover: int, strict: bool) -> Iterator:
    """Arrow batches of ROWS of one part; strict: a walk has to end where the next part begins."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ROWS.split(", "))])
    report, rows, held = {"capture": part.path, "packets": 0, "ignored": 0, "truncated": False}, [], None
    try:
        data, shape, start, stop = _prepared(part, cover)
    except ValueError as e:
        if part.number == 0:  # one row a file
            yield pa.RecordBatch.from_pylist([report | {"error": str(e)}], schema=arrow)
        return
    if strict and start is not None and start > stop:
        raise ValueError(f"{part.path}: cuts at {start} and {stop} cross; read it through read_captures, or with splitBytes 0")
    if start is None or start == stop:
        if part.number == 0 and start == part.size:  # nothing behind the head
            yield pa.RecordBatch.from_pylist([report], schema=arrow)
        return
    told, before = Walk(start), len(shape.links)
    for at, time, whole, place, kept in walk(data, shape, start, stop, told):
        if (row := decode(data.read(place, kept))) is None:
            report["ignored"] += 1
            continue
        if held:
            rows.append(held)
        held = {"capture": part.path, "ord": at, "ts_ms": time, "orig_len": whole, "truncated": False} | row
        report["packets"] += 1
        if len(rows) >= BATCH:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows = []
    if strict and stop < part.size:
        if told.at != stop or told.damaged:
            raise ValueError(f"{part.path}: no record starts at {stop}; read it through read_captures, or with splitBytes 0")
        if part.heads is None and told.heads and (start > 0 or len(told.heads) > _opening(data)):
            raise ValueError(f"{part.path}: interfaces are named after its head (known before: {before}); read it through read_captures, or with splitBytes 0")
    report["truncated"] = told.damaged and strict  # a file that grows may yet bring the rest
    if held:
        rows.append(held | {"truncated": report["truncated"]})
    yield pa.RecordBatch.from_pylist([*rows, report], schema=arrow)


def _opening(data: Paged) -> int:
    """Number of sections and interfaces before the first packet."""
    shape, at, n = layout(data), 0, 0
    while at < data.size:
        told = Walk(at)
        if list(walk(data, shape, at, at + 1, told)) or told.damaged or not told.heads:
            break
        at, n = told.at, n + 1
    return n


class PacketStream(DataSourceStreamReader):
    """New bytes of a folder's captures; an offset holds the length of each file."""

    def __init__(self, options: dict):
        self.path, self.cover = options["path"], int(options.get("coverbytes", LONGEST))
        self.ends: dict[tuple[str, int], tuple[int, list[int]]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listed(self.path)

    def _end(self, path: str, size: int) -> tuple[int, list[int]]:
        """End of the last whole record within size bytes, and the heads before it; each byte is walked once while the reader lives."""
        if (path, size) not in self.ends:
            at, heads = max(((a, h) for (p, s), (a, h) in self.ends.items() if p == path and s < size), default=(0, []), key=lambda x: x[0])
            system, where = opened(path)
            data = Paged(system.open_input_file(where), size)
            try:
                shape = layout(data)
            except ValueError:
                return 0, []
            if at:
                _read_heads(data, shape, at, heads)
            told = Walk(max(at, shape.first))
            for _ in walk(data, shape, told.at, size, told):
                pass
            self.ends = {k: v for k, v in self.ends.items() if k[0] != path} | {(path, size): (told.at, heads + told.heads)}
        return self.ends[path, size]

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for path, size in sorted(end.items()):
            if size > (done := start.get(path, 0)):
                at, heads = self._end(path, done) if done else (0, [])
                out.append(Part(path, size, at, [], 0, heads if at else None, True))
        return out

    def read(self, part: Part | None) -> Iterator:
        for batch in [] if part is None else packet_batches(part, self.cover, strict=False):
            keep = batch.filter(batch.column("ord").is_valid())
            yield keep.drop_columns(["packets", "ignored", "error"])

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """Format "capture"; options: path, splitBytes (0: no file is split), coverBytes, plan and mode (set by read_captures)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def _plain(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        options = self._plain()
        return PARTS if options.get("mode") == "walk" else SCHEMA if options.get("stream") == "true" else ROWS

    def reader(self, schema) -> DataSourceReader:
        return PacketReader(self._plain(), schema.names)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PacketStream(self._plain())


def capture_rows(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, cover_bytes: int = LONGEST) -> DataFrame:
    """ROWS of all captures at a path; files above split_bytes are read by several tasks.

    Files of one part need no walk.  Of the others only places of sections and
    interfaces and a flag a part come to the driver.
    """
    spark.dataSource.register(CaptureSource)
    read = lambda **options: spark.read.format("capture").options(path=path, splitBytes=split_bytes, coverBytes=cover_bytes, **options).load()
    walked = read(mode="walk").groupBy("capture").agg(F.min("landed").alias("landed"), F.collect_list(F.when(F.col("heads") != "[]", F.col("heads"))).alias("heads"))
    plan = {r["capture"]: {"heads": sorted(x for h in r["heads"] for x in json.loads(h))} if r["landed"] else {"whole": True} for r in walked.collect()}
    return read(plan=json.dumps(plan))


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, cover_bytes: int = LONGEST) -> DataFrame:
    """SCHEMA: packets of all captures at a path, ord being the place of each in its file."""
    return capture_rows(spark, path, split_bytes, cover_bytes).filter(F.col("ord").isNotNull()).drop("packets", "ignored", "error")


def capture_report(rows: DataFrame) -> DataFrame:
    """(capture, packets, ignored, truncated, error) of each file, from capture_rows."""
    own = rows.filter(F.col("ord").isNull())
    return own.groupBy("capture").agg(F.sum("packets").alias("packets"), F.sum("ignored").alias("ignored"), F.max("truncated").alias("truncated"), F.max("error").alias("error"))


def capture_stream(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA of a folder's captures as a stream, files that grow included."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").options(path=path, stream="true").load()
