"""BAM alignments cut into byte ranges, so that one file is read by many tasks.

A range begins anywhere. Its first block is found by the block header, its first record as the first
place from which records follow one another, field by field plausible, to the end of what is looked
at. Two readers share this:

* the data source ``bam`` reads ranges at random: local paths and URIs of stores that Arrow opens
  (``file:``, ``hdfs:``, ``s3:``, ...). A task reads on into the next range to end its last record. With an index,
  regions are read from the ranges of their chunks only.
* ``read_bam`` reads files of any store that Spark opens, as lines that end where a block header stands;
  Spark splits them like any text. What stands before a split's first record and behind its last whole
  one is joined with that of its neighbours, and must then be whole records.

``record`` numbers records in file order: the place of their block, shifted by 16 bits, plus the place in it.

Positions of the format have 31 bits. A longer chromosome is written as sequences of ``STRETCH`` positions each (``chr1``,
``chr1@1073741824``, ...), which both readers put together again. Files with sequences beyond 2^29, the reach of a BAI index,
get a CSI index.
"""

from __future__ import annotations

import binascii
import io
import os
import struct
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from strandloom.workspace import materialize

MAGIC = b"\x1f\x8b\x08\x04"
SEQ, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
COLUMNS = "name string, flag int, chrom string, start long, mapq int, cigar string, seq string, record long"
ARROW = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("start", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("record", pa.int64())])
SPLIT, BATCH, AHEAD = 32 << 20, 4096, 1 << 17
BLOCK = 65_280
STRETCH, LONGEST = 1 << 30, (1 << 31) - 1
SHIFT, DEPTH = 14, 5
_LETTERS = bytes.maketrans(b"0123456789abcdef", SEQ.encode())
_DIGITS = bytes(b"0123456789abcdef"[SEQ.index(chr(c))] if chr(c) in SEQ else b"f"[0] for c in range(256))
_USES = frozenset("MDN=X")


def opened(path: str, mode: str = "rb"):
    """A file by its path, or by a URI that Arrow knows."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        if mode == "wb":
            store.create_dir(at.rpartition("/")[0], recursive=True)
            return store.open_output_stream(at)
        return store.open_input_file(at)
    if mode == "wb":
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return open(path, mode)


def exists(path: str) -> bool:
    if "://" not in path and not path.startswith("file:"):
        return os.path.exists(path)
    try:
        opened(path).close()
    except FileNotFoundError:
        return False
    return True


def stretched(chroms: list[tuple[str, int]], longest: int = LONGEST) -> list[tuple[str, int]]:
    """(name, size) of a file's sequences: a chromosome above ``longest`` begins a new one every ``STRETCH`` positions. What begins in
    one may reach beyond the next one's begin."""
    return [(stretch_name(c, at), min(n - at, longest)) for c, n in chroms for at in (range(0, n, STRETCH) if n > longest else (0,))]


def stretch_name(chrom: str, at: int) -> str:
    return f"{chrom}@{at}" if at else chrom


def located(names: list[str]) -> list[tuple[str, int]]:
    """Chromosome and first position of each sequence; only names that continue those of the same file are stretches."""
    known = set(names)

    def of(name: str) -> tuple[str, int]:
        chrom, _, at = name.rpartition("@")
        if at.isascii() and at.isdigit() and int(at) and int(at) % STRETCH == 0 and all(stretch_name(chrom, x) in known for x in range(0, int(at), STRETCH)):
            return chrom, int(at)
        return name, 0

    return [of(n) for n in names]


# --- blocks -----------------------------------------------------------------------------------------


def block_length(data: bytes, at: int = 0) -> int:
    """Length of the block whose header stands at ``at``; 0 where there is none."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return 0
    p = at + 12
    stop = p + struct.unpack_from("<H", data, at + 10)[0]
    while p + 6 <= min(stop, len(data)):
        tag, n = data[p : p + 2], struct.unpack_from("<H", data, p + 2)[0]
        if tag == b"BC" and n == 2:
            return struct.unpack_from("<H", data, p + 4)[0] + 1
        p += 4 + n
    return 0


def inflated(block: bytes) -> bytes:
    return zlib.decompress(block, 31)


def first_block(f, at: int, size: int) -> int:
    """Place of the first block at or after ``at``; the file's size if there is none."""
    while at < size:
        f.seek(at)
        data = f.read(3 << 16)
        found = data.find(MAGIC)
        while found >= 0:
            n = block_length(data, found)
            if n and (at + found + n == size or block_length(data, found + n)):
                return at + found
            found = data.find(MAGIC, found + 1)
        if at + len(data) >= size:
            return size
        at += 1 << 16
    return size


def _members(f, held: bytes) -> Iterator[bytes]:
    engine = zlib.decompressobj(31)
    while held:
        out = engine.decompress(held)
        if out:
            yield out
        held = b""
        if engine.eof:
            held, engine = engine.unused_data, zlib.decompressobj(31)
        held = held or f.read(1 << 16)


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of each block from the one at ``at`` on; of a file of plain gzip members what is inflated, by its place there."""
    f.seek(at)
    held = f.read(1 << 16)
    if not at and held[:2] == MAGIC[:2] and not block_length(held):
        total = 0
        for data in _members(f, held):
            yield total, data
            total += len(data)
        return
    while True:
        n = block_length(held)
        while not n or len(held) < n:
            more = f.read(1 << 20)
            if not more:
                if held:
                    raise ValueError("truncated BAM file")
                return
            held += more
            n = block_length(held)
            if not n and len(held) > 1 << 16:
                raise ValueError("not a block of a BAM file")
        yield at, inflated(held[:n])
        at, held = at + n, held[n:]


class Stream:
    """Bytes of consecutive blocks, and the place of each in the file."""

    def __init__(self, source: Iterator[tuple[int, bytes]]):
        self.source, self.buf, self.at, self.marks = source, bytearray(), 0, deque()

    def more(self) -> bool:
        block = next(self.source, None)
        if block is None:
            return False
        self.marks.append((len(self.buf), block[0]))
        self.buf += block[1]
        return True

    def has(self, n: int) -> bool:
        while len(self.buf) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes; fewer at the end."""
        self.has(n)
        out = bytes(self.buf[self.at : self.at + n])
        self.at += len(out)
        if self.at > 1 << 20:
            self.place()
            del self.buf[: self.at]
            self.marks = deque((i - self.at, c) for i, c in self.marks)
            self.at = 0
        return out

    def place(self) -> int:
        while len(self.marks) > 1 and self.marks[1][0] <= self.at:
            self.marks.popleft()
        return (self.marks[0][1] << 16) + self.at - self.marks[0][0] if self.marks else 0

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


# --- records ----------------------------------------------------------------------------------------


def _following(data: bytes, at: int, chroms: int) -> int | None:
    """Where the record at ``at`` ends; 0: there is none; None: too little is seen of it."""
    if at + 36 > len(data):
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, ref2, pos2, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < chroms and -1 <= ref2 < chroms and pos >= -1 and pos2 >= -1 and l_name and l_seq >= 0):
        return 0
    if size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(c < 33 or c > 126 for c in name[:-1])):
        return 0
    return at + 4 + size


def record_start(data: bytes, chroms: int, least: int = 4) -> int:
    """The first place from which ``least`` records follow one another, or at least one and then what is seen of the next; -1: none."""
    for begin in range(len(data) - 35):
        at, n = begin, 0
        while n < least:
            following = _following(data, at, chroms)
            if following == 0:
                break
            if following is None or following > len(data):
                if n:
                    return begin
                break
            at, n = following, n + 1
            if at == len(data):
                return begin
        if n >= least:
            return begin
    return -1


def header(stream: Stream) -> list[str]:
    """Names of the sequences; the stream then stands at the first record."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(stream.number())
    chroms = []
    for _ in range(stream.number()):
        chroms.append(stream.take(stream.number())[:-1].decode())
        stream.take(4)
    return chroms


def records(stream: Stream) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of whole records; the stream then stands at what is left."""
    while stream.has(4):
        size = struct.unpack_from("<i", stream.buf, stream.at)[0] + 4
        if not stream.has(size):
            return
        place = stream.place()
        yield place, stream.take(size)


def decoded(place: int, r: bytes, chroms: list[tuple[str, int]]) -> tuple:
    """The columns of a record; ``chroms`` as of ``located``."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", r, 4)
    at = 36 + l_name
    ops = struct.unpack_from(f"<{n_cigar}I", r, at)
    at += 4 * n_cigar
    seq = binascii.hexlify(r[at : at + (l_seq + 1) // 2]).translate(_LETTERS)[:l_seq].decode()
    chrom, first = chroms[ref] if ref >= 0 else (None, 0)
    return r[36 : 35 + l_name].decode(), flag, chrom, first + pos, mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops), seq, place


def span(cigar_ops: tuple[int, ...]) -> int:
    """Bases on the sequence; a placed record without any covers one."""
    return max(1, sum(o >> 4 for o in cigar_ops if OPS[o & 15] in _USES))


def where(r: bytes) -> tuple[int, int, int]:
    """Sequence, begin and end of a record."""
    ref, pos, l_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", r, 4)
    return ref, pos, pos + span(struct.unpack_from(f"<{n_cigar}I", r, 36 + l_name))


def batches_of(rows: Iterator[tuple], schema: pa.Schema = ARROW) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# --- index ------------------------------------------------------------------------------------------


def _first_bin(level: int) -> int:
    return ((1 << 3 * level) - 1) // 7


def bin_of(begin: int, end: int, depth: int = DEPTH, shift: int = SHIFT) -> int:
    """The smallest bin of the index scheme that holds [begin, end)."""
    end -= 1
    for level in range(depth, 0, -1):
        if begin >> shift == end >> shift:
            return _first_bin(level) + (begin >> shift)
        shift += 3
    return 0


def bins_over(begin: int, end: int, depth: int = DEPTH, shift: int = SHIFT) -> set[int]:
    """All bins that meet [begin, end)."""
    out = {0}
    for level in range(depth, 0, -1):
        out.update(range(_first_bin(level) + (begin >> shift), _first_bin(level) + ((end - 1) >> shift) + 1))
        shift += 3
    return out


def depth_of(sizes: list[int]) -> int:
    """Levels below the first that an index of such sequences needs; a BAI index has five."""
    return max(DEPTH, -(-((max(sizes, default=1) - 1).bit_length() - SHIFT) // 3))


@dataclass
class Index:
    """Chunks by bin, and the least place by 16 kb window (in a CSI index that is read: by bin), of each sequence."""

    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    windows: list[list[int]] = field(default_factory=list)
    depth: int = DEPTH
    shift: int = SHIFT
    least: list[dict[int, int]] | None = None

    @classmethod
    def read(cls, path: str) -> "Index":
        with opened(path) as f:
            data = f.read()
        if data[:2] == MAGIC[:2]:
            data = b"".join(d for _, d in blocks(io.BytesIO(data), 0))
        if data[:4] not in (b"BAI\1", b"CSI\1"):
            raise ValueError(f"not a BAM index: {path}")
        at, out, wide = 4, cls(), data[:4] == b"CSI\1"
        if wide:
            out.shift, out.depth, n = struct.unpack_from("<iii", data, at)
            at, out.least = at + 12 + n, []
        count, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(count):
            bins: dict[int, list[tuple[int, int]]] = {}
            least: dict[int, int] = {}
            n_bins, at = struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(n_bins):
                place, low, n = struct.unpack_from("<IQi", data, at) if wide else (*struct.unpack_from("<I", data, at), 0, *struct.unpack_from("<i", data, at + 4))
                at += 16 if wide else 8
                flat = struct.unpack_from(f"<{2 * n}Q", data, at)
                at += 16 * n
                if place < _first_bin(out.depth + 1):  # the bin after the last real one holds counts
                    bins[place], least[place] = list(zip(flat[::2], flat[1::2])), low
            out.bins.append(bins)
            if wide:
                out.least.append(least)
                continue
            n, at = struct.unpack_from("<i", data, at)[0], at + 4
            out.windows.append(list(struct.unpack_from(f"<{n}Q", data, at)))
            at += 8 * n
        return out

    def add(self, ref: int, begin: int, end: int, place: int, after: int) -> None:
        while len(self.bins) <= ref:
            self.bins.append({})
            self.windows.append([])
        chunks = self.bins[ref].setdefault(bin_of(begin, end, self.depth), [])
        if chunks and chunks[-1][1] == place:
            chunks[-1] = (chunks[-1][0], after)
        else:
            chunks.append((place, after))
        windows = self.windows[ref]
        windows += [0] * (((end - 1) >> 14) + 1 - len(windows))
        for w in range(begin >> 14, ((end - 1) >> 14) + 1):
            windows[w] = windows[w] or place

    def content(self, chroms: int) -> bytes:
        """A BAI index, or where more levels are needed a CSI index, in blocks."""
        wide = self.depth > DEPTH
        out = [b"CSI\1" + struct.pack("<iii", SHIFT, self.depth, 0) if wide else b"BAI\1", struct.pack("<i", chroms)]
        for ref in range(chroms):
            bins, windows = (self.bins[ref], self.windows[ref]) if ref < len(self.bins) else ({}, [])
            out.append(struct.pack("<i", len(bins)))
            low = list(accumulate(windows, lambda a, b: b or a))
            for place, chunks in sorted(bins.items()):
                out.append(struct.pack("<IQi", place, low[min(self._window(place), len(low) - 1)], len(chunks)) if wide else struct.pack("<Ii", place, len(chunks)))
                out.append(b"".join(struct.pack("<QQ", *c) for c in chunks))
            if not wide:
                out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
        data = b"".join(out)
        return b"".join(block_of(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK)) + block_of(b"") if wide else data

    def _window(self, place: int) -> int:
        """The first window of a bin."""
        level = next(n for n in range(self.depth, -1, -1) if place >= _first_bin(n))
        return place - _first_bin(level) << 3 * (self.depth - level)

    def _low(self, ref: int, begin: int) -> int:
        """A place before which no record reaches beyond ``begin``."""
        if self.least is None:
            windows = self.windows[ref]
            return windows[begin >> self.shift] if begin >> self.shift < len(windows) else max(windows, default=0)
        low, place = self.least[ref], _first_bin(self.depth) + (begin >> self.shift)
        while place and place not in low:
            place = place - 1 if (place - 1) % 8 else (place - 1) // 8
        return low.get(place, 0)

    def chunks(self, ref: int, begin: int, end: int | None) -> list[tuple[int, int]]:
        """Merged ranges of places that hold all records over [begin, end) of a sequence."""
        most = 1 << self.shift + 3 * self.depth
        if ref >= len(self.bins) or begin >= most:
            return []
        least = self._low(ref, begin)
        out: list[tuple[int, int]] = []
        wanted = bins_over(begin, min(end or most, most), self.depth, self.shift) & self.bins[ref].keys()
        for a, b in sorted(c for k in wanted for c in self.bins[ref][k] if c[1] > least):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


# --- the data source --------------------------------------------------------------------------------


@dataclass
class _Range(InputPartition):
    """Records that begin in [begin, end) of places, 0 being the first record's; ``exact``: one begins at ``begin``; the region is of a sequence."""

    path: str
    begin: int = 0
    end: int = 0
    exact: bool = True
    region: tuple[str, int, int | None] | None = None


def parse_region(text: str) -> tuple[str, int, int | None]:
    """chrom, or chrom:begin-end (0-based, end exclusive)."""
    chrom, colon, rest = text.rpartition(":")
    if not colon:
        return text, 0, None
    begin, end = rest.split("-")
    return chrom, int(begin), int(end)


def _cut(path: str, begin: int, end: int, split: int, region=None) -> Iterator[_Range]:
    """[begin, end) of places in ranges of about ``split`` bytes; a record begins at ``begin``."""
    places = [begin, *(p << 16 for p in range((begin >> 16) + split, end >> 16, split)), end]
    for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
        yield _Range(path, a, b, i == 0, region)


def range_records(part: _Range) -> Iterator[tuple]:
    with opened(part.path) as f:
        first = Stream(blocks(f, 0))
        chroms = header(first)
        if not part.begin:
            stream = first
        elif part.exact:
            stream = Stream(blocks(f, part.begin >> 16))
            stream.take(part.begin & 0xFFFF)
        else:
            size = f.size() if hasattr(f, "size") else f.seek(0, 2)
            at = first_block(f, part.begin >> 16, size)
            if at << 16 >= part.end:
                return
            stream, found, ahead = Stream(blocks(f, at)), -1, AHEAD
            while found < 0:
                whole = not stream.has(ahead)
                found = record_start(bytes(stream.buf), len(chroms))
                if found < 0 and whole:
                    return
                ahead *= 2
            stream.at = found
        ref, places = chroms.index(part.region[0]) if part.region else -2, located(chroms)
        for place, r in records(stream):
            if place >= part.end:
                return
            if part.region:
                at, begin, end = where(r)
                if at != ref or end <= part.region[1] or part.region[2] is not None and begin >= part.region[2]:
                    continue
            yield decoded(place, r, places)
        if stream.has(1):
            raise ValueError(f"truncated BAM file: {part.path}")


def ranges(path: str, regions: list[str], split: int = SPLIT) -> Iterator[_Range]:
    """Ranges that hold all records, or those over ``regions``: then through the index beside the file, if there is one."""
    with opened(path) as f:
        stream = Stream(blocks(f, 0))
        chroms = header(stream)
        stream.has(1)
        begin, size = stream.place(), f.size() if hasattr(f, "size") else f.seek(0, 2)
        f.seek(0)
        if not block_length(f.read(1 << 10)):
            split, size = 1 << 62, 1 << 46
    found = next((i for kind in ("bai", "csi") for i in (f"{path}.{kind}", f"{path.removesuffix('.bam')}.{kind}") if exists(i)), None)
    index = Index.read(found) if found else None
    if not regions:
        # sequences begin at known places
        known = {min(c)[0] for bins in (index.bins if index else []) for c in [[x for k in bins.values() for x in k]] if c}
        cuts = [0, *sorted(p for p in known if p > begin), size << 16]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield from _cut(path, a, b, split)
        return
    places = located(chroms)
    for chrom, low, high in map(parse_region, regions):
        for ref in (i for i, p in enumerate(places) if p[0] == chrom):
            first = places[ref][1]
            region = chroms[ref], max(low - first, 0), None if high is None else high - first
            if first and high is not None and high <= first:
                continue
            for a, b in index.chunks(ref, *region[1:]) if index else [(0, size << 16)]:
                yield from _cut(path, a, b, split, region)


class _BamReader(DataSourceReader):
    def __init__(self, paths: list[str], regions: list[str], split: int):
        self.paths, self.regions, self.split = paths, regions, split

    def partitions(self) -> list[InputPartition]:
        return [r for p in self.paths for r in ranges(p, self.regions, self.split)] or [_Range("")]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from batches_of(range_records(partition))


class _PushingBamReader(_BamReader):
    """Reads the ranges of one sequence where the plan asks for one and the start below a bound."""

    def pushFilters(self, filters) -> Iterator:
        """``chrom = x`` and ``start < y`` become a region; every filter is applied again by Spark."""
        chrom, end = None, None
        for f in filters:
            kind, of = type(f).__name__, getattr(f, "attribute", None)
            if kind == "EqualTo" and of == ("chrom",):
                chrom = f.value
            if kind in ("LessThan", "LessThanOrEqual") and of == ("start",):
                bound = f.value + (kind == "LessThanOrEqual")
                end = bound if end is None else min(end, bound)
            yield f
        if chrom is not None and not self.regions:
            self.regions = [f"{chrom}:0-{max(end, 1)}" if end is not None else f"{chrom}:0-{1 << 62}"]


def block_of(data: bytes) -> bytes:
    """One block."""
    engine = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = engine.compress(data) + engine.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record_of(row, chroms: dict[str, int], long: frozenset[str] = frozenset()) -> bytes:
    """A record of (name, flag, chrom, start, mapq, cigar, seq), without qualities and tags; chromosomes in ``long`` are in stretches."""
    ops, n = [], ""
    for c in row.cigar or "":
        if c.isdigit():
            n += c
        elif c != "*":
            ops.append(int(n) << 4 | OPS.index(c))
            n = ""
    seq = row.seq or ""
    packed = binascii.unhexlify(seq.upper().encode("ascii", "replace").translate(_DIGITS) + b"0" * (len(seq) % 2))
    name = row.name.encode() + b"\0"
    first = row.start // STRETCH * STRETCH if row.chrom in long else 0
    place = chroms[stretch_name(row.chrom, first)] if row.chrom is not None else -1
    start = row.start - first
    begin = max(start, 0)
    kept = bin_of(begin, begin + span(tuple(ops)))
    # the field has no room for bins beyond 2^29, which is why readers do not use it
    body = struct.pack("<iiBBHHHiiii", place, start, len(name), row.mapq, kept if kept < 1 << 16 else 0, len(ops), row.flag, len(seq), -1, -1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _File:
    """A file that is written block by block; records end with their block where they fit one, and are indexed."""

    def __init__(self, path: str, chroms: list[tuple[str, int]], indexed: bool):
        self.path, self.chroms, self.index = path, chroms, Index(depth=depth_of([n for _, n in chroms])) if indexed else None
        self.out, self.buf, self.at = opened(path, "wb"), bytearray(), 0
        order = "\tSO:coordinate" if indexed else ""
        text = f"@HD\tVN:1.6{order}\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in chroms)
        head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(chroms))
        for c, n in chroms:
            head += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
        self.add(head)
        self.flush()

    def flush(self) -> None:
        while self.buf:
            block = block_of(bytes(self.buf[:BLOCK]))
            self.out.write(block)
            self.at += len(block)
            del self.buf[:BLOCK]

    def add(self, data: bytes) -> tuple[int, int]:
        """Places of the first byte and of the one after the last."""
        if len(self.buf) + len(data) > BLOCK:
            self.flush()
        first = self.at << 16 | len(self.buf)
        self.buf += data
        if len(self.buf) >= BLOCK:
            self.flush()
        return first, self.at << 16 | len(self.buf)

    def record(self, data: bytes) -> None:
        first, after = self.add(data)
        ref, begin, end = where(data)
        if self.index is not None and ref >= 0:
            self.index.add(ref, begin, end, first, after)

    def close(self) -> None:
        self.flush()
        self.out.write(block_of(b""))
        self.out.close()
        if self.index is not None:
            with opened(f"{self.path}{index_end(self.chroms)}", "wb") as f:
                f.write(self.index.content(len(self.chroms)))


def index_end(chroms: list[tuple[str, int]]) -> str:
    return ".csi" if depth_of([n for _, n in chroms]) > DEPTH else ".bai"


class _BamWriter(DataSourceWriter):
    def __init__(self, path: str, chroms: list[tuple[str, int]], indexed: bool):
        self.path, self.chroms, self.indexed, self.long = path, stretched(chroms), indexed, frozenset(c for c, n in chroms if n > LONGEST)
        self.ends = ["", index_end(self.chroms)][: 1 + indexed]

    def write(self, iterator) -> WriterCommitMessage:
        number, places = TaskContext.get().partitionId(), {c: i for i, (c, _) in enumerate(self.chroms)}
        files: dict[str, _File] = {}
        for row in iterator:
            folder = f"{self.path}/{row.folder}" if "folder" in row.__fields__ else self.path
            if folder not in files:
                files[folder] = _File(f"{folder}/_part-{number:05d}-{uuid.uuid4().hex}", self.chroms, self.indexed)
            files[folder].record(record_of(row, places, self.long))
        if not files:
            files[self.path] = _File(f"{self.path}/_part-{number:05d}-{uuid.uuid4().hex}", self.chroms, self.indexed)
        for f in files.values():
            f.close()
        return _Written([(f.path, f"{folder}/part-{number:05d}.bam") for folder, f in files.items()])

    def commit(self, messages) -> None:
        for part, final in (x for m in messages for x in m.files):
            for end in self.ends:
                _move(part + end, final + end)

    def abort(self, messages) -> None:
        for part, _ in (x for m in messages if m is not None for x in m.files):
            for end in self.ends:
                if exists(part + end):
                    _move(part + end, None)


def _move(path: str, to: str | None) -> None:
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        if to is None:
            store.delete_file(at)
        else:
            store.move(at, fs.FileSystem.from_uri(to if "://" in to else to.replace("file:", "file://", 1))[1])
    elif to is None:
        os.remove(path)
    else:
        os.replace(path, to)


class Bam(DataSource):
    """(name, flag, chrom, start, mapq, cigar, seq, record) of the files in ``path`` (comma list).

    Files are read in ranges of ``split`` bytes. Option ``regions`` (comma list of chrom or
    chrom:begin-end) reads records that overlap them, through the index where there is one, else through
    the whole file; a record that overlaps two regions comes twice. Without regions all records are
    read, also those without a place, with an index or without. Written tables have the same columns (``record`` is
    not needed) and go to one file a partition below ``path``, a folder that executors share; option
    ``chroms`` (comma list of name:size) names the sequences. Option ``pushdown`` turns filters on chrom and start
    into a region; it needs spark.sql.python.filterPushdown.enabled. A column ``folder`` parts the rows to folders
    below ``path``. With ``indexed`` each file gets an index; its rows must then come sorted by sequence and start.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        regions = self.options.get("regions")
        kind = _PushingBamReader if self.options.get("pushdown", "false").lower() == "true" else _BamReader
        return kind(self.options["path"].split(","), regions.split(",") if regions else [], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BamWriter(self.options["path"], [(c.rpartition(":")[0], int(c.rpartition(":")[2])) for c in self.options["chroms"].split(",")], self.options.get("indexed", "false").lower() == "true")


def write_bams(reads: DataFrame, path: str, chroms: dict[str, int], indexed: bool = False) -> None:
    """Reads with verdict accept below ``path``/good, those with reject below ``path``/bad, in one pass.

    ``indexed``: rows are first sorted by sequence (in the order of ``chroms``), start and name over all
    partitions, so that files follow one another in that order, and each has an index; reads without a place come last.
    """
    folder = F.when(F.col("verdict") == "accept", "good").when(F.col("verdict") == "reject", "bad")
    rows = reads.select("name", "flag", "chrom", "start", "mapq", "cigar", "seq", folder.alias("folder")).where("folder is not null")
    if indexed:
        place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ((c, i) for i, c in enumerate(chroms)) for x in p)), F.col("chrom")), F.lit(len(chroms)))
        rows = rows.withColumn("_o", place).sort("_o", "start", "name", "flag", "cigar").drop("_o")
    rows.write.format("bam").option("chroms", ",".join(f"{c}:{n}" for c, n in chroms.items())).option("indexed", str(indexed).lower()).mode("append").save(path)


# --- any store --------------------------------------------------------------------------------------


def _head(spark: SparkSession, path: str) -> tuple[bytes, list[tuple[str, int]], int]:
    """The block header of a file, its sequences as of ``located``, and the bytes before its first record, through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)

    class File:
        seek = staticmethod(lambda place: None)
        read = staticmethod(lambda n: bytes(stream.readNBytes(n)))

    try:
        got = Stream(blocks(File, 0))
        first = bytearray()
        source = got.source

        def counted():
            for place, data in source:
                first.extend(data)
                yield place, data

        got.source = counted()
        chroms = located(header(got))
        left = len(got.buf) - got.at
        before = len(first) - left
    finally:
        stream.close()
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(16)), chroms, before
    finally:
        stream.close()


def _file_path() -> Column:
    return F.col("_metadata.file_path")


def _splits(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[tuple[str, int, Stream, list[int]]]:
    """Path, begin, blocks and (after they are read) length of each split of a task."""
    lines = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
    for (path, begin), mine in groupby(lines, key=lambda r: r[:2]):
        length = [0]

        def source(mine=mine, length=length) -> Iterator[tuple[int, bytes]]:
            held = b""
            for _, _, value in mine:
                held += (mark if held else b"") + value.as_py()
                if not held:
                    continue
                block = mark + held
                n = block_length(block)
                if not n or len(block) > n:
                    raise ValueError("a block of a BAM file is broken, or its header differs from the first one's")
                if len(block) == n:
                    place, length[0], held = length[0], length[0] + n, b""
                    yield place, inflated(block)
            if held:
                raise ValueError("truncated BAM file")

        yield path, begin, Stream(source()), length


def _lines(files: DataFrame) -> DataFrame:
    return files.select(_file_path().alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("value"))


def _to_first(stream: Stream, begin: int, before: int, chroms: list) -> bytes | None:
    """What stands before the split's first record; None: no record begins there."""
    if not begin:
        stream.take(before)
        return b""
    ahead = AHEAD
    while True:
        whole = not stream.has(ahead)
        found = record_start(bytes(stream.buf), len(chroms))
        if found >= 0:
            return stream.take(found)
        if whole:
            return None
        ahead *= 2


def read_bam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file`` and the columns of the data source ``bam``, from any store that Spark reads, split like text.

    Ends of splits are read in a pass of their own and joined: a file's are met in one task, one row a split.
    Blocks must begin with the same 16 bytes as the file's first one, as the usual writers make them.
    """
    names = [r[0] for r in spark.read.format("binaryFile").load(paths).select(_file_path()).distinct().collect()]
    heads = {p: _head(spark, p) for p in names}
    marks = {h[0] for h in heads.values()}
    if len(marks) > 1:
        raise ValueError("files with different block headers are read one by one")
    if not heads:
        return spark.createDataFrame([], f"file string, {COLUMNS}")
    mark = marks.pop()
    known = spark.sparkContext.broadcast({p: h[1:] for p, h in heads.items()})
    rows = _lines(spark.read.option("lineSep", mark.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths))
    edge_schema = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("length", pa.int64()), ("inner", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary()), ("tail_place", pa.int64())])
    row_schema = pa.schema([("path", pa.string()), ("begin", pa.int64()), *ARROW])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for path, begin, stream, length in _splits(batches, mark):
                chroms, before = known.value[path]
                head = _to_first(stream, begin, before, chroms)
                if head is None:
                    yield path, begin, length[0], False, bytes(stream.buf), b"", 0
                    continue
                for _ in records(stream):
                    pass
                yield path, begin, length[0], True, head, bytes(stream.buf[stream.at :]), stream.place()

        yield from batches_of(each(), edge_schema)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for path, begin, stream, _ in _splits(batches, mark):
                chroms, before = known.value[path]
                if _to_first(stream, begin, before, chroms) is None:
                    continue
                for place, r in records(stream):
                    yield path, begin, *decoded(place, r, chroms)

        yield from batches_of(each(), row_schema)

    def joined(table: pa.Table) -> pa.Table:
        path, out = table["path"][0].as_py(), []
        chroms = known.value[path][0]
        held, place = b"", 0
        for r in sorted(table.to_pylist(), key=lambda r: r["begin"]):
            held += r["head"]
            if not r["inner"]:
                continue
            at = n = 0
            while at < len(held):
                size = struct.unpack_from("<i", held, at)[0] + 4 if at + 4 <= len(held) else 1 << 31
                if at + size > len(held):
                    raise ValueError(f"records of {path} do not meet where it is split")
                out.append((path, r["begin"], *decoded(place + n, held[at : at + size], chroms)))
                at, n = at + size, n + 1
            held, place = r["tail"], (r["base"] << 16) + r["tail_place"]
        if held:
            raise ValueError(f"truncated BAM file: {path}")
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), row_schema)], schema=row_schema) if out else row_schema.empty_table()

    columns = f"path string, begin long, {COLUMNS}"
    ends = materialize(rows.mapInArrow(edges, "path string, begin long, length long, inner boolean, head binary, tail binary, tail_place long"), "bam_edges")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum("length").over(before), F.lit(0)))
    crossing = ends.groupBy("path").applyInArrow(joined, columns)
    whole = rows.mapInArrow(inner, columns).join(ends.select("path", "begin", "base"), ["path", "begin"])
    whole = whole.withColumn("record", F.shiftleft("base", 16) + F.col("record")).drop("base")
    return whole.unionByName(crossing).withColumnRenamed("path", "file").drop("begin")
