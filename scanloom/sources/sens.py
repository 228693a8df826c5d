"""Sensor streams (.sens, version 4) as a Python data source, and their depth images as pixels.

Rows are frames or inertial samples. After the header (fixed values of the format, little-endian) come
frames of a pose, two time stamps, two sizes and two blobs.

    spark.dataSource.register(SensSource)
    spark.read.format("sens").option("table", "frames").option("splits", 16).load(path)

A file is read in `splits` ranges of frames, an input partition each. Where frames begin is known from an
index of offsets (write_index(), once; option "index" names its folder); without one a task finds the
beginning of its range by the sizes alone, and no blob of another range is read. Conditions on scan_id and
frame_id leave out files and parts of ranges before anything is opened, with option "prune" (read() sets
it where spark.sql.python.filterPushdown.enabled lets Spark hand them over). Tables "imu" and "sensors" are a range a file.
With option "parallelism" ranges of small files share a partition (32 MB, or what keeps so many tasks busy), as a
task has its price. Rows leave a task in Arrow batches of a few MB.

Files are found by pyarrow.fs (local, hdfs, s3, gs), below a folder or as one path; a truncated file
is an error. Written once to Parquet, everything else reads that.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

VECTOR = "struct<x:double,y:double,z:double>"
TABLES = {
    "frames": "scan_id string, frame_id int, pose array<float>, ts_color bigint, ts_depth bigint, color binary, depth binary",
    "imu": f"scan_id string, ts bigint, rotation {VECTOR}, acceleration {VECTOR}, magnetic {VECTOR}, attitude {VECTOR}, gravity {VECTOR}",
    "sensors": "scan_id string, name string, k_color array<float>, e_color array<float>, k_depth array<float>, e_depth array<float>, color_compression int, depth_compression int, color_width int, color_height int, depth_width int, depth_height int, depth_shift float, n_frames bigint",
}
#: Fixed values of the format.
VERSION, RAW, ZLIB = 4, 0, 1


def _take(f, form: str) -> tuple:
    data = f.read(struct.calcsize("<" + form))
    return struct.unpack("<" + form, data)


def header(f) -> dict:
    (version,) = _take(f, "I")
    if version != VERSION:
        raise ValueError(f"version {version} of a sensor stream; only {VERSION} is known")
    (n,) = _take(f, "Q")
    out: dict = {"name": f.read(n).decode()}
    for k in ("k_color", "e_color", "k_depth", "e_depth"):
        out[k] = list(_take(f, "16f"))
    out["color_compression"], out["depth_compression"] = _take(f, "ii")
    out["color_width"], out["color_height"], out["depth_width"], out["depth_height"] = _take(f, "IIII")
    (out["depth_shift"],) = _take(f, "f")
    (out["n_frames"],) = _take(f, "Q")
    return out


def _fixed(head: dict) -> int:
    """Where the first frame begins."""
    return 4 + 8 + len(head["name"].encode()) + 4 * 64 + 8 + 16 + 4 + 8


#: Bytes of a frame before its blobs, and of an inertial sample.
FRAME, SAMPLE = 64 + 32, 128
#: Bytes of a batch, of an input partition, and what opening a file costs in bytes.
BATCH, PART, OPEN = 4 << 20, 32 << 20, 256 << 10
IMU = np.dtype([("v", "<f8", 15), ("ts", "<u8")])


def _next(f, at: int) -> int:
    """Where the frame after the one at `at` begins, by its sizes."""
    f.seek(at + FRAME - 16)
    return at + FRAME + sum(_take(f, "QQ"))


def offsets(f) -> np.ndarray:
    """Where each frame begins, and the inertial samples after the last: sizes are read, blobs are not."""
    head = header(f)
    at = [_fixed(head)]
    for _ in range(head["n_frames"]):
        at.append(_next(f, at[-1]))
    return np.array(at, "<i8")


def _files(path: str) -> list[str]:
    return list(_sizes(path))


def _sizes(path: str) -> dict[str, int]:
    """The streams under path in order, with their bytes."""
    uri = path if "://" in path else "file://" + path
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    info = fs.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return {uri: info.size}
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    return {uri.removesuffix(root) + x.path: x.size for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".sens")}


def _scan(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".sens")


def _index_name(folder: str, path: str) -> str:
    """The index of a stream: named by its whole path, so streams of one name do not meet."""
    return f"{folder.rstrip('/')}/{zlib.crc32(path.encode()):08x}-{_scan(path)}.idx"


def write_index(spark, path: str, folder: str) -> int:
    """Writes the offsets of every stream under path to the index folder, files dealt to tasks; their number."""
    found, folder = _files(path), folder if "://" in folder else "file://" + folder
    if not found:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("path").to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as f:
                    at = offsets(f)
                out, to = pyarrow.fs.FileSystem.from_uri(_index_name(folder, uri))
                out.create_dir(to.rpartition("/")[0], recursive=True)
                with out.open_output_stream(to) as f:
                    f.write(at.tobytes())
            yield b

    tasks = min(len(found), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([(x,) for x in found], "path string").repartition(tasks).mapInArrow(run, "path string").count()


class _Range(InputPartition):
    """Range i of n of a file's frames, from frame `first` to before `last` at most."""

    def __init__(self, path: str, i: int, n: int, first: int, last: int, size: int = 0) -> None:
        self.path, self.i, self.n, self.first, self.last, self.size = path, i, n, first, last, size


class _Pack(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[_Range]) -> None:
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, splits: int = 1, index: str | None = None) -> None:
        self.path, self.table, self.splits = path, table, splits if table == "frames" else 1
        self.index = index if index is None or "://" in index else "file://" + index
        self.scans: set[str] | None = None
        self.first, self.last = 0, 1 << 62

    def partitions(self) -> list[InputPartition]:
        found = {x: size for x, size in _sizes(self.path).items() if self.scans is None or _scan(x) in self.scans}
        made = [_Range(x, i, self.splits, self.first, self.last, size // self.splits) for x, size in found.items() for i in range(self.splits)] if self.first < self.last else []
        return made or [_Range("", 0, 1, 0, 0)]

    def _start(self, uri: str, f, first: int, head: dict) -> int:
        """Where frame `first` begins (the one after the last: the inertial samples)."""
        if self.index is not None:
            fs, name = pyarrow.fs.FileSystem.from_uri(_index_name(self.index, uri))
            if fs.get_file_info(name).type == pyarrow.fs.FileType.File:
                with fs.open_input_file(name) as g:
                    g.seek(8 * first)
                    return _take(g, "q")[0]
        at = _fixed(head)
        for _ in range(first):
            at = _next(f, at)
        return at

    def read(self, partition: _Range) -> Iterator[tuple]:
        for b in self.batches(partition):
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def batches(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, name = pyarrow.fs.FileSystem.from_uri(partition.path)
        scan = _scan(name)
        with fs.open_input_file(name) as f:
            h = header(f)
            n = h["n_frames"]
            if self.table == "sensors":
                kinds = [pa.string()] * 2 + [pa.list_(pa.float32())] * 4 + [pa.int32()] * 6 + [pa.float32(), pa.int64()]
                yield _batch(self.table, [pa.array([v], k) for v, k in zip((scan, *h.values()), kinds, strict=True)])
            elif self.table == "imu":
                f.seek(self._start(partition.path, f, n, h))
                (samples,) = _take(f, "Q")
                for done in range(0, samples, BATCH // SAMPLE):
                    yield _samples(partition.path, scan, f.read(SAMPLE * min(BATCH // SAMPLE, samples - done)), min(BATCH // SAMPLE, samples - done))
            else:
                first = max(partition.i * n // partition.n, partition.first)
                last = min((partition.i + 1) * n // partition.n, partition.last)
                if first < last:
                    f.seek(self._start(partition.path, f, first, h))
                fixed, blobs, held = [], [], 0
                for i in range(first, last):
                    fixed.append(f.read(FRAME))
                    if len(fixed[-1]) < FRAME:
                        raise ValueError(f"{partition.path} ends within frame {i}")
                    sizes = struct.unpack_from("<QQ", fixed[-1], FRAME - 16)
                    blobs.append((f.read(sizes[0]), f.read(sizes[1])))
                    if len(blobs[-1][0]) < sizes[0] or len(blobs[-1][1]) < sizes[1]:
                        raise ValueError(f"{partition.path} ends within frame {i}")
                    held += FRAME + sum(sizes)
                    if held >= BATCH or i + 1 == last:
                        yield _frames(scan, i + 1 - len(fixed), fixed, blobs)
                        fixed, blobs, held = [], [], 0


def _batch(table: str, columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TABLES[table].split(", ")])


def _samples(path: str, scan: str, data: bytes, n: int) -> pa.RecordBatch:
    if len(data) < SAMPLE * n:
        raise ValueError(f"{path} ends within its inertial samples")
    rows = np.frombuffer(data, IMU)
    vector = lambda k: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows["v"][:, k + i])) for i in range(3)], ["x", "y", "z"])
    return _batch("imu", [pa.array([scan] * n, pa.string()), pa.array(rows["ts"].astype(np.int64)), *map(vector, range(0, 15, 3))])


def _frames(scan: str, first: int, fixed: list[bytes], blobs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    n = len(fixed)
    rows = np.frombuffer(b"".join(fixed), np.dtype([("pose", "<f4", 16), ("color", "<u8"), ("depth", "<u8"), ("sizes", "<u8", 2)]))
    pose = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.array(np.ascontiguousarray(rows["pose"]).reshape(-1)))
    times = (pa.array(rows[c].astype(np.int64)) for c in ("color", "depth"))
    return _batch("frames", [pa.array([scan] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int32)), pose, *times, *(pa.array([x[k] for x in blobs], pa.binary()) for k in (0, 1))])


class _Pruned(_Reader):
    """A reader that takes conditions over; only allowed where Spark hands them over."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for x in filters:
            of = getattr(x, "attribute", None)
            if of == ("scan_id",) and isinstance(x, EqualTo | In):
                these = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.scans = these if self.scans is None else self.scans & these
            elif of == ("frame_id",) and self.table == "frames" and isinstance(x, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low = {EqualTo: x.value, GreaterThan: x.value + 1, GreaterThanOrEqual: x.value}.get(type(x), 0)
                high = {EqualTo: x.value + 1, LessThan: x.value, LessThanOrEqual: x.value + 1}.get(type(x), 1 << 62)
                self.first, self.last = max(self.first, low), min(self.last, high)
            else:
                yield x


class _Packed:
    """Partitions of several ranges where `parallelism` is set, read as batches."""

    parallelism = 0

    def partitions(self) -> list[InputPartition]:
        ranges = super().partitions()
        most = min(PART, sum(x.size + OPEN for x in ranges) // self.parallelism) if self.parallelism else 0
        packs, held = [], most
        for x in ranges:
            if held + x.size + OPEN > most:
                packs.append(_Pack([]))
                held = 0
            packs[-1].ranges.append(x)
            held += x.size + OPEN
        return packs

    def read(self, partition: _Pack) -> Iterator[pa.RecordBatch]:
        for x in partition.ranges:
            yield from self.batches(x)


class _PackedReader(_Packed, _Reader):
    pass


class _PackedPruned(_Packed, _Pruned):
    pass


class SensSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sens"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "frames")]

    def reader(self, schema) -> DataSourceReader:
        kind = _PackedPruned if self.options.get("prune", "false") == "true" else _PackedReader
        made = kind(self.options["path"], self.options.get("table", "frames"), int(self.options.get("splits", 1)), self.options.get("index"))
        made.parallelism = int(self.options.get("parallelism", 0))
        return made


def stream(head: dict, frames: list[tuple], imu: list[tuple] | np.ndarray = ()) -> bytes:
    """One stream: head as header() gives it, frames (pose, ts_color, ts_depth, color, depth), imu
    (15 numbers, ts), as tuples or an array of IMU."""
    name = head["name"].encode()
    out = [struct.pack("<IQ", VERSION, len(name)) + name, *(struct.pack("<16f", *head[k]) for k in ("k_color", "e_color", "k_depth", "e_depth"))]
    sizes = (head[k] for k in ("color_compression", "depth_compression", "color_width", "color_height", "depth_width", "depth_height", "depth_shift"))
    out.append(struct.pack("<iiIIIIfQ", *sizes, len(frames)))
    for pose, a, b, color, depth in frames:
        out += [struct.pack("<16f4Q", *pose, a, b, len(color), len(depth)), color, depth]
    out += [struct.pack("<Q", len(imu)), *([imu.tobytes()] if isinstance(imu, np.ndarray) else (struct.pack("<15dQ", *v, ts) for v, ts in imu))]
    return b"".join(out)


def write_stream(path: str, head: dict, frames: list[tuple], imu: list[tuple] | np.ndarray = ()) -> None:
    """stream() as a file, wherever pyarrow.fs writes; written again, it is the same file."""
    write_file(path, stream(head, frames, imu))


def write_file(path: str, data: bytes) -> None:
    fs, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(data)


def read(spark, path: str, table: str = "frames", splits: int = 1, index: str | None = None, packed: bool = False) -> DataFrame:
    """A table of the streams under path, files in `splits` ranges of frames, offsets from an index folder.
    packed: many small ranges are few tasks."""
    spark.dataSource.register(SensSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("sens").option("table", table).option("splits", splits).option("prune", prune).option("parallelism", 2 * spark.sparkContext.defaultParallelism if packed else 0)
    return (reader.option("index", index) if index else reader).load(path)


def depth_pixels(frames: DataFrame, width: int, height: int, compression: int = ZLIB, skip: int = 1) -> DataFrame:
    """(scan_id, frame_id, y, x, d) of the depth blobs (16 bits a pixel, raw or zlib) of every skip-th
    frame; a blob of another size gives no pixels."""

    n = width * height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.divmod(np.arange(n, dtype=np.int32), width)
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, (1 << 18) // max(n, 1))):
                b = whole.slice(at, max(1, (1 << 18) // max(n, 1)))
                raw = [zlib.decompress(v) if compression == ZLIB and v else v or b"" for v in b.column("depth").to_pylist()]
                kept = np.flatnonzero([len(v) == 2 * n for v in raw])
                of = pa.array(np.repeat(kept, n))
                d = np.frombuffer(b"".join(raw[i] for i in kept), "<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("scan_id").take(of), b.column("frame_id").take(of), pa.array(np.tile(y, len(kept))), pa.array(np.tile(x, len(kept))), pa.array(d)], ["scan_id", "frame_id", "y", "x", "d"])

    picked = frames.where(f"frame_id % {skip} = 0").select("scan_id", "frame_id", "depth")
    return picked.mapInArrow(run, "scan_id string, frame_id int, y int, x int, d int")


def imported_frames(spark, folder: str) -> DataFrame:
    """(scan_id, frame_id, color, depth, pose): a folder of frame-NNNNNN.{color.*,depth.*,pose.txt} a
    scan, matched by number; what is missing is null."""
    from pyspark.sql import functions as F

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    at = F.regexp_extract("path", r"([^/]+)/frame-(\d+)\.(color|depth|pose)\.[a-z]+$", 0)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/frame-(\d+)\.(color|depth|pose)\.[a-z]+$", i)
    kinds = f.where(at != "").select(part(1).alias("scan_id"), part(2).cast("int").alias("frame_id"), part(3).alias("kind"), "content")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k)
    return kinds.groupBy("scan_id", "frame_id").agg(one("color"), one("depth"), one("pose"))
