"""BAM files written block by block, read whole, in parts and by region."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from locusframe.sources import bam, scope


def _block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _record(name, flag, tid, pos, mapq, cigar, seq, tags):
    code = {b: i for i, b in enumerate(bam.BASES)}
    packed = bytes((code[seq[i]] << 4) | (code[seq[i + 1]] if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
    ops = b"".join(struct.pack("<I", n << 4 | bam.OPS.index(op)) for n, op in cigar)
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + b"\x1e" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def _write(path, size=700):
    """Records over two contigs in small blocks, with the linear index; the expected rows."""
    r = random.Random(4)
    names = [("c1", 200_000), ("c2", 90_000)]
    text = b"@HD\tVN:1.6\n@RG\tID:x\tSM:s9\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", m) for n, m in names)
    rows, parts = [], [head]
    for tid, (chrom, length) in enumerate(names):
        for i, pos in enumerate(sorted(r.randrange(length - 400) for _ in range(150))):
            seq = "".join(r.choice("ACGTN") for _ in range(r.randrange(60, 141)))
            cigar = [(5, "S"), (len(seq) - 15, "M"), (10, "I"), (7, "D")] if i % 2 else [(len(seq), "M")]
            flag = (0, 16, 256, 4, 2048)[i % 5]
            tags = (b"XAAq" if i % 3 else b"XBBs" + struct.pack("<Ihh", 2, 1, 2)) + (b"NMC" + bytes([i % 200]) if i % 4 else b"NMs" + struct.pack("<h", 300)) + (b"SAZc2,5,+,9M,60,0;\0" if i % 7 == 0 else b"")
            parts.append(_record(f"q{tid}_{i}", flag, tid, pos, 60 - i % 60, cigar, seq, tags))
            end = pos + sum(n for n, op in cigar if op in "MD")
            rows.append((f"q{tid}_{i}", flag, tid, chrom, pos, end, 60 - i % 60, "".join(f"{n}{op}" for n, op in cigar), seq, "c2,5,+,9M,60,0;" if i % 7 == 0 else None, i % 200 if i % 4 else 300))
    data = b"".join(parts)
    cuts, out, where = list(range(0, len(data), size)), b"", {}
    for at in cuts:
        where[at] = len(out)
        out += _block(data[at : at + size])
    path.write_bytes(out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
    linear = [[0] * (m // 16_384 + 1) for _, m in names]
    at = len(head)
    for row, part in zip(rows, parts[1:]):
        block = at // size * size
        virtual = where[block] << 16 | (at - block)
        for w in range(row[4] >> 14, (max(row[5], row[4] + 1) - 1 >> 14) + 1):
            linear[row[2]][w] = linear[row[2]][w] or virtual
        at += len(part)
    index = b"BAI\1" + struct.pack("<i", 2) + b"".join(struct.pack("<iIiQQ", 1, 4681, 1, 0, 9) + struct.pack("<i", len(x)) + struct.pack(f"<{len(x)}Q", *x) for x in linear)
    return rows, index


def _got(df):
    cigar = F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return sorted(tuple(r) for r in df.select("qname", "flag", "tid", "chrom", "pos", "mapq", cigar, "seq", F.coalesce("sa", F.lit("")), "nm").collect())


def _want(rows, keep=lambda r: True):
    return sorted((*r[:5], *r[6:9], r[9] or "", r[10]) for r in rows if not r[1] & 0x104 and keep(r))


def test_bam_whole_in_parts_and_by_region(spark, tmp_path):
    path = tmp_path / "x.bam"
    rows, index = _write(path)
    assert _got(bam.read_bam(spark, str(path))) == _want(rows)  # without an index in one partition
    (tmp_path / "x.bam.bai").write_bytes(index)
    parts = bam.read_bam(spark, str(path), split=4000)
    assert parts.rdd.getNumPartitions() > 4 and _got(parts) == _want(rows) and _got(bam.read_bam(spark, f"file://{path}")) == _want(rows)
    for text in ("c1:20001-40000", "c2", "c1:1-5", "c2:89000-90000"):
        region = scope.parse_region(text)
        inside = lambda r: r[3] == region.chrom and r[5] > region.start and (region.end < 0 or r[4] < region.end)  # noqa: B023, E731
        assert _got(bam.read_bam(spark, str(path), region, split=4000)) == _want(rows, inside), text
    assert bam.read_bam(spark, str(path), scope.Region("other")).count() == 0
    text, contigs, _ = bam.read_header(str(path))
    assert contigs == [("c1", 200_000), ("c2", 90_000)] and scope.sample_name(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"), str(path)) == "s9"
    (tmp_path / "bad.bam").write_bytes(b"nothing")
    with pytest.raises(Exception):
        bam.read_bam(spark, str(tmp_path / "bad.bam")).count()
