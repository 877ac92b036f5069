"""WAV files: a reader of headers (format "wav_headers"), one of sample blocks ("wav_blocks"), and a writer.

The readers seek: a header costs its own bytes and a block the bytes of its frames, whatever the
file's size. The driver opens no file and lists folders only until there are enough of them to deal
out; the folders are walked, and headers read, on the executors. Conditions on path, size and mtime are
pushed into the walk: folders that can't hold what is asked for aren't entered, other files not opened. scan() and blocks() also spread the
listed files, and stretches of long ones, evenly over the cluster.
"""

from __future__ import annotations

import operator
import os
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from reelspark.functions import audio
from reelspark.functions.names import TAKE_NAME
from reelspark.functions.timecode import drops
from reelspark.schema import HEADER

PARSER_VERSION = 1
REMOVED = "_Removed"
BLOCKS = T.StructType([T.StructField("path", T.StringType()), T.StructField("channel", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("start", T.LongType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])
LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), T.StructField("error", T.StringType())])


class NotWav(Exception):
    """Not a file that the reader understands."""


def _listed(folder: str) -> tuple[list[tuple[str, int, float, str]], list[str]]:
    """The audio files in a folder, and the folders in it; one that can't be listed is a row with its error."""
    try:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as e:
        return [(folder, 0, 0.0, str(e))], []
    files, folders = [], []
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            if not e.name.startswith(".") and e.name != REMOVED:
                folders.append(e.path)
        elif e.name.lower().endswith((".wav", ".bwf")) and not e.name.startswith("._"):
            try:
                s = e.stat()
                files.append((e.path, s.st_size, s.st_mtime, ""))
            except OSError as error:  # it went away, or points nowhere
                files.append((e.path, 0, 0.0, str(error)))
    return files, folders


def list_audio(root: str, enter: Callable[[str], bool] = lambda folder: True) -> Iterator[tuple[str, int, float, str]]:
    """(path, size, mtime, error) of audio files below root, in the folders that may be entered."""
    todo = [root]
    while todo:
        files, folders = _listed(todo.pop())
        yield from files
        todo += filter(enter, folders)


def chunks_of(f, size: int) -> list[tuple[str, int, int, bool]]:
    """(id, offset, size, truncated) of each chunk; 64-bit sizes come from ds64."""
    f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64", b"BW64") or head[8:] != b"WAVE":
        raise NotWav("not a WAV file")
    out, at, long_data = [], 12, None
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if not re.fullmatch(rb"[\x20-\x7e]{4}", name):
            break
        if name == b"ds64":
            long_data = struct.unpack("<QQ", f.read(16))[1]
        if name == b"data" and n == 0xFFFFFFFF and long_data is not None:
            n = long_data
        body = at + 8
        out.append((name.decode("ascii"), body, min(n, size - body), body + n > size))
        at = body + n
        if n % 2:
            f.seek(at)
            at += f.read(1) == b"\0" or at == size
    if not any(c[0] == "fmt " for c in out):
        raise NotWav("no fmt chunk")
    return out


def _text(raw: bytes, encoding: str = "latin-1") -> str:
    return raw.split(b"\0")[0].decode(encoding, "replace").strip()


def ixml_root(payload: bytes) -> ET.Element | None:
    """The document of an iXML chunk; what follows a NUL or its end tag is left from an older, longer one."""
    body = payload.split(b"\0")[0].lstrip(b"\xef\xbb\xbf \r\n\t")
    end = body.find(b"</BWFXML>")
    try:
        return ET.fromstring(body if end < 0 else body[: end + 9])
    except (ET.ParseError, LookupError, ValueError):  # also an encoding that isn't known
        return None


def _ixml(payload: bytes) -> tuple[dict[str, str], list[str]]:
    """Flat fields (of repeated ones the first) and track names in interleave order."""
    root = ixml_root(payload)
    if root is None:
        return {}, []
    flat: dict[str, str] = {}
    for e in root:
        for x in [e, *(list(e) if e.tag in ("SPEED", "HISTORY", "FILE_SET") else [])]:
            flat.setdefault(x.tag, (x.text or "").strip())
    tracks = []
    for k, t in enumerate(root.iterfind("./TRACK_LIST/TRACK")):
        place = next((int(v) for tag in ("INTERLEAVE_INDEX", "CHANNEL_INDEX") if (v := (t.findtext(tag) or "").strip()).isdigit()), k + 1)
        tracks.append((place, k, (t.findtext("NAME") or "").strip()))
    return flat, [name for *_, name in sorted(tracks)]


def read_header(path: str, size: int | None = None, mtime: float = 0.0) -> dict:
    """The row of one file; what can't be read is a row with an error."""
    row: dict = {f.name: "" if isinstance(f.dataType, T.StringType) else False if isinstance(f.dataType, T.BooleanType) else [] if isinstance(f.dataType, T.ArrayType) else 0 for f in HEADER.fields}
    row |= {"path": path, "mtime": float(mtime), "time_reference": None, "parser_version": PARSER_VERSION, "size": size or 0}
    try:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size if size is None else size
            row["size"] = size
            found = chunks_of(f, size)
            body = {}
            for name, at, n, truncated in found:
                if name in ("fmt ", "bext", "iXML", "cue ", "LIST") and name not in body and not (truncated and name == "iXML"):
                    f.seek(at)
                    body[name] = f.read(n)
                if name == "data":
                    row["truncated"], data = truncated, n
        tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body["fmt "][:16])
        if tag == 0xFFFE and len(body["fmt "]) >= 26:
            tag = struct.unpack("<H", body["fmt "][24:26])[0]
        row |= {"form": "PCM" if tag == 1 else "float" if tag == 3 else str(tag), "channels": channels, "sample_rate": rate, "bits": bits, "float_samples": tag == 3, "frames": data // align if align else 0}
        bext = body.get("bext", b"")
        fields: dict[str, str] = {}
        if len(bext) >= 346:
            row |= {"has_bext": True, "date": _text(bext[320:330]), "time": _text(bext[330:338]), "recorder": _text(bext[256:288]), "time_reference": struct.unpack("<Q", bext[338:346])[0]}
            for line in _text(bext[:256]).splitlines():
                if m := re.fullmatch(r"[a-z]([A-Z0-9]+)=(.*)", line.strip()):
                    fields.setdefault(m[1], m[2])
        flat, tracks = _ixml(body["iXML"]) if "iXML" in body else ({}, [])
        row["has_ixml"] = bool(flat)
        low, high = (flat.get(f"TIMESTAMP_SAMPLES_SINCE_MIDNIGHT_{x}", "") for x in ("LO", "HI"))
        if row["time_reference"] is None and low.isdecimal() and (high or "0").isdecimal():
            start = (int(high or 0) << 32) + int(low)
            row["time_reference"] = start if start < 1 << 63 else None
        named = {"meta_project": "PROJECT", "scene": "SCENE", "take": "TAKE", "tape": "TAPE", "note": "NOTE", "ubits": "UBITS", "tc_rate": "TIMECODE_RATE", "family": "FAMILY_UID", "original_filename": "ORIGINAL_FILENAME"}
        for column, key in named.items():
            row[column] = flat.get(key) or fields.get(key, "")
        row["tc_rate"] = row["tc_rate"] or fields.get("SPEED", "")
        row["circled"] = (flat.get("CIRCLED") or fields.get("CIRCLED", "")).upper() == "TRUE"
        row["drop_frame"] = drops(flat.get("TIMECODE_FLAG")) or drops(fields.get("SPEED"))
        row["tracks"] = tracks or [v for _, v in sorted((int(k[3:]), v) for k, v in fields.items() if re.fullmatch(r"TRK\d+", k))]
        if not row["scene"] and not row["take"] and (m := re.match(TAKE_NAME, os.path.splitext(os.path.basename(path))[0])):
            row["scene"], row["take"] = m[1], m[2]
        row["chunks"], row["cues"] = found, _cues(path, found)
    except (NotWav, OSError, struct.error, LookupError, ValueError, OverflowError, UnboundLocalError) as e:
        row["error"] = str(e) or type(e).__name__
    return row


def _cues(path: str, found: list[tuple[str, int, int, bool]]) -> list[tuple[int, str]]:
    """(frame, label) by frame; a label chunk is preferred to a note, and a bare point is numbered."""
    points, labels, notes = {}, {}, {}
    with open(path, "rb") as f:
        for name, at, n, _ in found:
            if name == "cue ":
                f.seek(at)
                raw = f.read(n)
                for k in range(min(struct.unpack("<I", raw[:4])[0] if len(raw) >= 4 else 0, (len(raw) - 4) // 24)):
                    ident, *_, offset = struct.unpack("<II4sIII", raw[4 + 24 * k : 28 + 24 * k])
                    points[ident] = offset
            elif name == "LIST":
                f.seek(at)
                raw, k = f.read(n), 4
                while raw[:4] == b"adtl" and k + 12 <= len(raw):
                    kind, m, ident = struct.unpack("<4sII", raw[k : k + 12])
                    {b"labl": labels, b"note": notes}.get(kind, {})[ident] = _text(raw[k + 12 : k + 8 + m], "utf-8")
                    k += 8 + m + m % 2
    ordered = sorted((frame, ident) for ident, frame in points.items())
    return [(frame, labels.get(i) or notes.get(i) or f"Marker {k}") for k, (frame, i) in enumerate(ordered, 1)]


class _Part(InputPartition):
    """Files that the driver met, and folders to be walked."""

    def __init__(self, files: list[tuple], folders: list[str]) -> None:
        self.files, self.folders = files, folders


class _Wanted:
    """Conditions on path, size and mtime that the walk itself applies, and the folders that can hold what meets them."""

    _PLACES = {"path": 0, "size": 1, "mtime": 2}
    _HOLDS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith}

    def __init__(self) -> None:
        self.conditions: list[Filter] = []

    def takes(self, condition: Filter) -> bool:
        mine = type(condition) in self._HOLDS and condition.attribute in [(name,) for name in self._PLACES]
        if mine:
            self.conditions.append(condition)
        return mine

    def row(self, found: tuple) -> bool:
        return all(self._HOLDS[type(c)](found[self._PLACES[c.attribute[0]]], c.value) for c in self.conditions)

    def folder(self, path: str) -> bool:
        """Whether the path of anything in that folder, or the folder's own, can meet the conditions."""
        within = path.rstrip("/") + "/"
        starts = [c.value for c in self.conditions if type(c) is StringStartsWith or (type(c) is EqualTo and c.attribute == ("path",))]
        return all(within.startswith(x) or x.startswith(within) or path == x for x in starts)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.wanted = _Wanted()
        self.root, self.per, self.spread = options["path"], int(options.get("filesPerPartition", 256)), int(options.get("folders", 256))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Those that the walk doesn't apply are left to Spark."""
        return [f for f in filters if not self.wanted.takes(f)]

    def listed(self, partition: _Part) -> Iterator[tuple[str, int, float, str]]:
        yield from partition.files
        for folder in partition.folders:
            yield from filter(self.wanted.row, list_audio(folder, self.wanted.folder))

    def partitions(self) -> list[_Part]:
        """Folders are listed, a level at a time, until there are enough of them; they are then dealt out unlisted."""
        files, level = [], [self.root] if self.wanted.folder(self.root) else []
        while level and len(level) < self.spread:
            below: list[str] = []
            for folder in level:
                found, inside = _listed(folder)
                files += filter(self.wanted.row, found)
                below += filter(self.wanted.folder, inside)
            level = below
        return [_Part(files[k : k + self.per], []) for k in range(0, len(files), self.per)] + [_Part([], [f]) for f in level] or [_Part([], [])]


class _Headers(_Reader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        names = [f.name for f in HEADER.fields]
        for path, size, mtime, error in self.listed(partition):
            if not error:
                row = read_header(path, size, mtime)
                yield tuple(row[n] for n in names)


class _Listing(_Reader):
    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from self.listed(partition)


class _Blocks(_Reader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.frames, self.halo = int(options.get("blockFrames", 48_000)), int(options.get("halo", 0))

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for path, size, _, error in self.listed(partition):
            if not error:
                yield from block_batches(path, size, self.frames, self.halo)


def block_batches(path: str, size: int, frames: int, halo: int = 0, low: int = 0, high: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the blocks of a file whose first frame lies in the bytes [low, high) of its data; none of a file that can't be read."""
    h = read_header(path, size)
    if h["error"] or h["truncated"] or h["form"] not in ("PCM", "float"):
        return
    data = next(c for c in h["chunks"] if c[0] == "data")
    width = h["channels"] * h["bits"] // 8
    first = -(-low // (frames * width))
    last = -(-min(h["frames"] * width, high if high is not None else h["frames"] * width) // (frames * width))
    for block in range(first, last):
        a, b = block * frames - halo, min(h["frames"], (block + 1) * frames) + halo
        x = read_frames(path, data[1], h["frames"], h["channels"], h["bits"], h["float_samples"], a, b)
        n = h["channels"]
        samples = pa.ListArray.from_arrays(pa.array([k * len(x) for k in range(n + 1)], pa.int32()), pa.array(x.T.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array([block] * n, pa.int64()), pa.array([a] * n, pa.int64()), pa.array([h["sample_rate"]] * n, pa.int32()), samples], [f.name for f in BLOCKS.fields])


def read_frames(path: str, at: int, frames: int, channels: int, bits: int, is_float: bool, a: int, b: int):
    """float32 (b - a, channels) of frames [a, b), zero outside the file."""
    import numpy as np

    low, high, width = max(a, 0), min(b, frames), channels * bits // 8
    out = np.zeros((b - a, channels), np.float32)
    if high > low:
        with open(path, "rb") as f:
            f.seek(at + low * width)
            out[low - a : high - a] = audio.decode_pcm(f.read((high - low) * width), bits, channels, is_float)
    return out


class WavHeaders(DataSource):
    """One row of HEADER for each file below the path."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> T.StructType:
        return HEADER

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Headers(self.options)


class AudioListing(DataSource):
    """path, size, mtime and error of files below the path, without opening them."""

    @classmethod
    def name(cls) -> str:
        return "audio_listing"

    def schema(self) -> T.StructType:
        return LISTING

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Listing(self.options)


class WavBlocks(DataSource):
    """Samples by file, channel and block, with options blockFrames and halo (frames on both sides)."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> T.StructType:
        return BLOCKS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Blocks(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known, and lets conditions on path, size and mtime reach their walk."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WavHeaders, AudioListing, WavBlocks):
        spark.dataSource.register(source)


def listing(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.read.format("audio_listing").load(root)


def scan(spark: SparkSession, root: str, under: str = "", since: float | None = None) -> DataFrame:
    """The header rows of all files below root, which are spread evenly once they are listed; of those alone whose
    path begins with under, and which changed at a time since or later. Other folders aren't walked, other files not opened."""
    names = [f.name for f in HEADER.fields]

    def read(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([read_header(*r) for r in zip(pdf["path"], pdf["size"], pdf["mtime"])], columns=names)

    found = listing(spark, root).where("error = ''").select("path", "size", "mtime")
    if under:
        found = found.where(F.startswith("path", F.lit(under)))
    if since is not None:
        found = found.where(F.col("mtime") >= since)
    return found.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInPandas(read, HEADER)


def blocks(spark: SparkSession, root: str, frames: int = 48_000, halo: int = 0, stretch: int = 1 << 26) -> DataFrame:
    """Sample blocks of all files below root; stretches of `stretch` bytes of a file are read apart from each other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, low in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield from block_batches(path, size, frames, halo, low, low + stretch)

    found = listing(spark, root).where("error = ''")
    parts = found.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(stretch).cast("long"))).alias("low"))
    return parts.repartition(spark.sparkContext.defaultParallelism * 4, "path", "low").mapInArrow(read, BLOCKS)


def envelopes(spark: SparkSession, root: str, buckets: int, stretch: int = 1 << 26, frames: int = 1 << 16) -> DataFrame:
    """path, channel, bucket, peak and rms of all files below root, in one reading: samples are decoded and
    reduced block by block where they are read, and only sums by bucket leave the task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for path, size, low in zip(*(batch.column(k).to_pylist() for k in range(3))):
                h = read_header(path, size)
                sums: dict[tuple[int, int], list[float]] = {}
                for block in block_batches(path, size, frames, 0, low, low + stretch):
                    start, c = block.column(3)[0].as_py(), len(block)
                    x = block.column(5).values.to_numpy().reshape(c, -1).astype(np.float64)
                    at = (np.arange(start, start + x.shape[1]) * buckets) // h["frames"]
                    firsts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
                    peak, power, n = np.maximum.reduceat(np.abs(x), firsts, axis=1), np.add.reduceat(x * x, firsts, axis=1), np.diff(np.append(firsts, len(at)))
                    for k in range(c):
                        for b, top, p, m in zip(at[firsts].tolist(), peak[k].tolist(), power[k].tolist(), n.tolist()):
                            held = sums.setdefault((k, b), [0.0, 0.0, 0])
                            held[0], held[1], held[2] = max(held[0], top), held[1] + p, held[2] + m
                if sums:
                    rows = [(path, *key, *v) for key, v in sums.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], ["path", "channel", "bucket", "peak", "power", "n"])

    found = listing(spark, root).where("error = ''")
    parts = found.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(stretch).cast("long"))).alias("low"))
    each = parts.repartition(spark.sparkContext.defaultParallelism * 4, "path", "low").mapInArrow(read, "path string, channel int, bucket long, peak double, power double, n long")
    sums = each.groupBy("path", "channel", "bucket").agg(F.max("peak").alias("peak"), F.sqrt(F.sum("power") / F.sum("n")).alias("rms"))
    return sums.withColumn("rms", F.least("rms", "peak"))


def write_wav(path: str, samples, rate: int, bits: int = 24, is_float: bool = False, ixml: str = "", bext: dict | None = None, cues: list[tuple[int, str]] | None = None) -> None:
    """A WAV file of samples (frames, channels), written to a temporary name and then renamed."""
    channels = samples.shape[1]
    data = audio.encode_pcm(samples, bits, is_float)
    align = channels * bits // 8
    parts = []
    if bext is not None:
        head = bext.get("description", "").encode("latin-1", "replace")[:256].ljust(256, b"\0")
        head += bext.get("originator", "").encode("latin-1", "replace")[:32].ljust(32, b"\0") + bytes(32)
        head += bext.get("date", "").encode()[:10].ljust(10, b"\0") + bext.get("time", "").encode()[:8].ljust(8, b"\0")
        parts.append((b"bext", head + struct.pack("<QH", bext.get("time_reference", 0), 1) + bytes(254)))
    if ixml:
        parts.append((b"iXML", ixml.encode()))
    parts += [(b"fmt ", struct.pack("<HHIIHH", 3 if is_float else 1, channels, rate, rate * align, align, bits)), (b"data", data)]
    if cues:
        parts.append((b"cue ", struct.pack("<I", len(cues)) + b"".join(struct.pack("<II4sIII", k, f, b"data", 0, 0, f) for k, (f, _) in enumerate(cues, 1))))
        labels = b""
        for k, (_, text) in enumerate(cues, 1):
            raw = text.encode("utf-8", "replace") + b"\0"
            labels += struct.pack("<4sII", b"labl", 4 + len(raw), k) + raw + b"\0" * (len(raw) % 2)
        parts.append((b"LIST", b"adtl" + labels))
    body = b"".join(name + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2) for name, raw in parts)
    with open(f"{path}.part", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    os.replace(f"{path}.part", path)
