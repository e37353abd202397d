"""Aligned reads from BAM files as a data source.

A file with an index beside it (``.bai``) is cut at record starts that the index
names, so each partition reads a byte range of its own; a file without one is a
single partition. With a region only the range that the index gives for it is
read. Unmapped and secondary records are left out here, as for SAM text. Files
are opened by any address that Arrow's file systems know, or by a plain path that
all executors share.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scope import Region, normalise_region

SCHEMA = "qname string, flag int, tid int, chrom string, pos bigint, mapq int, cigar array<struct<len:int,op:string>>, seq string, sa string, nm int"
ARROW = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("tid", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))),
    ("seq", pa.string()), ("sa", pa.string()), ("nm", pa.int32()),
])
#: Records of an Arrow batch, and compressed bytes of a partition at least.
BATCH, SPLIT = 2000, 32 << 20
# Fixed values of the format: operations, bases, and sizes of tag values.
OPS, BASES, SIZES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_INTEGER = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


class Blocks:
    """The uncompressed bytes of a blocked gzip file from a virtual offset on (block address << 16 | place in the block)."""

    def __init__(self, file, offset: int = 0):
        self.file, self.next, self.data, self.at, self.block = file, offset >> 16, b"", 0, offset >> 16
        if offset & 0xFFFF:
            self._load()
            self.at = offset & 0xFFFF

    def _load(self) -> bool:
        head = self.file.read_at(12, self.next)
        if len(head) < 12:
            return False
        extra_size = struct.unpack_from("<H", head, 10)[0]
        extra, place, size = self.file.read_at(extra_size, self.next + 12), 0, 0
        while place + 4 <= len(extra):
            length = struct.unpack_from("<H", extra, place + 2)[0]
            if extra[place : place + 2] == b"BC":
                size = struct.unpack_from("<H", extra, place + 4)[0] + 1
            place += 4 + length
        if head[:2] != b"\x1f\x8b" or not size:
            raise ValueError("not a block of a BAM file")
        body = self.file.read_at(size - 12 - extra_size - 8, self.next + 12 + extra_size)
        self.block, self.data, self.at, self.next = self.next, zlib.decompress(body, -15), 0, self.next + size
        return True

    def tell(self) -> int:
        """The virtual offset of the next byte."""
        return self.next << 16 if self.at >= len(self.data) else self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if self.at >= len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def integer(self) -> int:
        return struct.unpack("<i", self.read(4))[0]


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, (contig, length) in order, and the virtual offset of the first record."""
    stream = Blocks(_open(path))
    if stream.read(4) != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    text = stream.read(stream.integer()).rstrip(b"\0").decode()
    contigs = []
    for _ in range(stream.integer()):
        name = stream.read(stream.integer())[:-1].decode()
        contigs.append((name, stream.integer()))
    return text, contigs, stream.tell()


def read_index(path: str) -> list[list[int]] | None:
    """For each contig the virtual offsets of the first record of every 16,384 positions (0 for none); null without an index."""
    try:
        with _open(path + ".bai") as file:
            data = file.read()
    except (FileNotFoundError, OSError):
        return None
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(bins):
            at += 8 + 16 * struct.unpack_from("<i", data, at + 4)[0]
        n = struct.unpack_from("<i", data, at)[0]
        out.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
        at += 4 + 8 * n
    return out


def _tags(data: bytes, at: int) -> tuple[str | None, int | None]:
    """SA and NM of a record's tags."""
    sa = nm = None
    while at + 3 <= len(data):
        name, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            if name == b"SA":
                sa = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + SIZES[chr(data[at])] * struct.unpack_from("<I", data, at + 1)[0]
        else:
            if name == b"NM" and kind in _INTEGER:
                nm = struct.unpack_from(_INTEGER[kind], data, at)[0]
            at += SIZES[kind]
    return sa, nm


def records(path: str, start: int, end: int, contigs: list[str], tid: int = -1, low: int = 0, high: int = -1) -> Iterator[tuple]:
    """Records that begin within [start, end) (virtual offsets, -1 for the file's end); of one contig those that overlap [low, high)."""
    stream = Blocks(_open(path), start)
    while end < 0 or stream.tell() < end:
        head = stream.read(4)
        if len(head) < 4:
            return
        data = stream.read(struct.unpack("<i", head)[0])
        ref, pos, name_size, mapq, _, n_ops, flag, n = struct.unpack_from("<iiBBHHHi", data)
        if tid >= 0 and (ref != tid or (high >= 0 and pos >= high)):
            if ref > tid or ref < 0 or ref == tid:
                return
            continue
        if flag & 0x104 or ref < 0:
            continue
        at = 32 + name_size
        ops = [{"len": x >> 4, "op": OPS[x & 15]} for x in struct.unpack_from(f"<{n_ops}I", data, at)]
        at += 4 * n_ops
        if tid >= 0 and pos + sum(x["len"] for x in ops if x["op"] in "MDN=X") <= low:
            continue
        sequence = "".join([_PAIRS[b] for b in data[at : at + (n + 1) // 2]])[:n]
        sa, nm = _tags(data, at + (n + 1) // 2 + n)
        yield data[32 : 31 + name_size].decode(), flag, ref, contigs[ref], pos, mapq, ops or None, sequence, sa, nm


class _Part(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.region = normalise_region(Region(options["chrom"], int(options.get("start", 0)), int(options.get("end", -1)))) if options.get("chrom") else None
        _, contigs, self.first = read_header(self.path)
        self.contigs = [name for name, _ in contigs]
        self.tid = self.contigs.index(self.region.chrom) if self.region and self.region.chrom in self.contigs else -1

    def partitions(self) -> list[_Part]:
        nothing = [_Part(self.first, self.first)]
        if self.region and self.tid < 0:
            return nothing
        index = read_index(self.path)
        if index is None:
            return [_Part(self.first, -1)]
        windows = index[self.tid] if self.region else [v for contig in index for v in contig]
        if self.region:
            windows = windows[self.region.start >> 14 : None if self.region.end < 0 else (self.region.end >> 14) + 1]
        known = sorted({v for v in windows if v})
        if self.region and not known:
            return nothing
        starts = [known[0] if self.region else self.first]
        for v in known:
            if (v >> 16) - (starts[-1] >> 16) >= self.split:
                starts.append(v)
        return [_Part(a, b) for a, b in zip(starts, [*starts[1:], -1], strict=True)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        region = self.region or Region()
        rows: list[tuple] = []
        for row in records(self.path, partition.start, partition.end, self.contigs, self.tid, region.start, region.end):
            rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW, strict=True)], schema=ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW, strict=True)], schema=ARROW)


class BamSource(DataSource):
    """``spark.read.format("bam")`` with the options path, chrom, start, end and split."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, path: str, region: Region | None = None, split: int = SPLIT) -> DataFrame:
    """Mapped, not secondary records of a BAM file, of a region if one is given."""
    for module in (sys.modules[__name__], sys.modules[Region.__module__]):
        cloudpickle.register_pickle_by_value(module)  # planning workers do not have the package's folder
    spark.dataSource.register(BamSource)
    options = {"path": path, "split": str(split)} | ({"chrom": region.chrom, "start": str(region.start), "end": str(region.end)} if region else {})
    return spark.read.format("bam").options(**options).load()
