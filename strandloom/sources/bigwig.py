"""bigWig tracks: read by chromosome and region, written a file a partition.

Reading goes down the index to the sections that meet the region asked for. A writer task gets
intervals sorted by chromosome and start, packs them into compressed sections, and ends its file with
zoom levels and both trees; tasks with different stretches so write files that hold one signal together.
Positions of the format have 32 bits: longer chromosomes are written as several, as in ``bam``, and read as one.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandloom.sources.bam import STRETCH, _move, exists, located, opened, parse_region, stretch_name, stretched

MAGIC, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
ITEMS, FAN = 1024, 256
ZOOMS = tuple(1 << (10 + 2 * i) for i in range(5))
LAST = 1 << 32
ROWS = 65_536
SCHEMA = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("score", pa.float32())])


class Track:
    """Chromosomes and intervals of a file (its path, a URI that Arrow opens, or its bytes)."""

    def __init__(self, source):
        self.source, self.blocks_read = source, 0
        with self._open() as f:
            head = f.read(64)
            self.order = "<" if struct.unpack("<I", head[:4])[0] == MAGIC else ">"
            if struct.unpack(self.order + "I", head[:4])[0] != MAGIC:
                raise ValueError(f"not a bigWig file: {source if isinstance(source, str) else 'in memory'}")
            tree_at, _, self.index_at = struct.unpack(self.order + "QQQ", head[8:32])
            self.zooms = struct.unpack(self.order + "H", head[6:8])[0]
            self.packed = struct.unpack(self.order + "I", head[52:56])[0] > 0
            f.seek(tree_at)
            key = struct.unpack(self.order + "IIIIQ", f.read(24))[2]
            self.chroms: dict[str, tuple[int, int]] = {}
            self._chroms(f, tree_at + 32, key)

    def _open(self):
        import io

        return io.BytesIO(self.source) if isinstance(self.source, bytes) else opened(self.source)

    def _chroms(self, f, at: int, key: int) -> None:
        f.seek(at)
        leaf, _, n = struct.unpack(self.order + "BBH", f.read(4))
        rows = [(f.read(key).rstrip(b"\0").decode(), f.read(8)) for _ in range(n)]
        for name, value in rows:
            if leaf:
                self.chroms[name] = struct.unpack(self.order + "II", value)
            else:
                self._chroms(f, struct.unpack(self.order + "Q", value)[0], key)

    def blocks(self, ident: int, begin: int = 0, end: int = LAST, index_at: int | None = None) -> list[tuple[int, int]]:
        """Places and lengths of the sections that may meet [begin, end) of a chromosome, in file order."""
        out, todo = [], [(self.index_at if index_at is None else index_at) + 48]
        with self._open() as f:
            while todo:
                f.seek(todo.pop())
                leaf, _, n = struct.unpack(self.order + "BBH", f.read(4))
                size = 32 if leaf else 24
                data = f.read(n * size)
                for i in range(n):
                    c0, b0, c1, b1, place = struct.unpack_from(self.order + "IIIIQ", data, i * size)
                    if (c0, b0) < (ident, end) and (c1, b1) > (ident, begin):
                        if leaf:
                            out.append((place, struct.unpack_from(self.order + "Q", data, i * size + 24)[0]))
                        else:
                            todo.append(place)
        return sorted(out)

    def intervals(self, ident: int, begin: int = 0, end: int = LAST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, ends and values, section by section, cut to [begin, end)."""
        with self._open() as f:
            for place, size in self.blocks(ident, begin, end):
                f.seek(place)
                raw = f.read(size)
                self.blocks_read += 1
                raw = zlib.decompress(raw) if self.packed else raw
                chrom, start, _, step, span, kind, _, n = struct.unpack(self.order + "IIIIIBBH", raw[:24])
                if chrom != ident:
                    continue
                u, v = np.dtype(self.order + "u4"), np.dtype(self.order + "f4")
                if kind == 1:
                    t = np.frombuffer(raw, [("s", u), ("e", u), ("v", v)], n, 24)
                    s, e, x = t["s"].astype(np.int64), t["e"].astype(np.int64), t["v"]
                elif kind == 2:
                    t = np.frombuffer(raw, [("s", u), ("v", v)], n, 24)
                    s, x = t["s"].astype(np.int64), t["v"]
                    e = s + span
                else:
                    x = np.frombuffer(raw, v, n, 24)
                    s = start + step * np.arange(n, dtype=np.int64)
                    e = s + span
                s, e = np.maximum(s, begin), np.minimum(e, end)
                on = s < e
                yield s[on], e[on], x[on].astype(np.float32)

    def positions(self, ident: int, least: float, begin: int = 0, end: int = LAST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and values of at least ``least``; NaN is never read."""
        for s, e, x in self.intervals(ident, begin, end):
            on = x >= least
            s, n, x = s[on], (e - s)[on], x[on]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            for a in range(0, total, ROWS):
                flat = np.arange(a, min(a + ROWS, total))
                i = np.searchsorted(ends, flat, "right")
                yield s[i] + flat - (ends - n)[i], x[i]


@dataclass
class _Part(InputPartition):
    """A stretch of ``sequence``, whose first position is ``first`` of ``chrom``."""

    path: str
    chrom: str
    begin: int = 0
    end: int = LAST
    sequence: str = ""
    first: int = 0


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], least: float, chroms: list[str] | None, regions: list[str]):
        self.paths, self.least, self.chroms, self.regions = paths, least, chroms, [parse_region(r) for r in regions]

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            names = list(Track(path).chroms)
            known = list(zip(names, located(names)))
            wanted = self.regions or [(c, 0, None) for c in dict.fromkeys(c for _, (c, _) in known)]
            for chrom, a, b in wanted:
                if self.chroms is None or chrom in self.chroms:
                    here = [(name, first) for name, (c, first) in known if c == chrom and (not first or b is None or first < b)]
                    out += [_Part(path, chrom, min(max(a - first, 0), LAST), LAST if b is None else min(b - first, LAST), name, first) for name, first in here]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        track = Track(partition.path)
        for pos, x in track.positions(track.chroms[partition.sequence][0], self.least, partition.begin, partition.end):
            yield pa.RecordBatch.from_arrays([pa.array([partition.chrom] * len(pos), pa.string()), pa.array(pos + partition.first), pa.array(x)], schema=SCHEMA)


class _PushingReader(_Reader):
    def pushFilters(self, filters) -> Iterator:
        """``chrom = x`` and bounds of ``pos`` become a region; every filter is applied again by Spark."""
        chrom, begin, end = None, 0, LAST
        for f in filters:
            kind, of = type(f).__name__, getattr(f, "attribute", None)
            if kind == "EqualTo" and of == ("chrom",):
                chrom = f.value
            elif of == ("pos",):
                if kind in ("GreaterThan", "GreaterThanOrEqual"):
                    begin = max(begin, f.value + (kind == "GreaterThan"))
                elif kind in ("LessThan", "LessThanOrEqual"):
                    end = min(end, f.value + (kind == "LessThanOrEqual"))
            yield f
        if chrom is not None and not self.regions:
            self.regions = [(chrom, begin, max(end, 0))]


# --- writing ----------------------------------------------------------------------------------------


def _tree(keys: list[str], ids: dict[str, tuple[int, int]], at: int) -> bytes:
    """The B+ tree of chromosomes, names ascending, from the file place ``at`` on."""
    width = max(len(k.encode()) for k in keys)
    head = struct.pack("<IIIIQQ", TREE, min(FAN, len(keys)), width, 8, len(keys), 0)
    levels = [[(k, struct.pack("<II", *ids[k])) for k in keys]]
    while len(levels[-1]) > FAN:
        levels.append([(g[0][0], b"") for g in _groups(levels[-1])])
    return head + _laid_out([[_groups(level)] for level in levels], at + len(head), lambda item, child: item[0].encode().ljust(width, b"\0") + (item[1] if child is None else struct.pack("<Q", child)))


def _groups(items: list) -> list[list]:
    return [items[i : i + FAN] for i in range(0, len(items), FAN)]


def _laid_out(levels: list, at: int, item_bytes) -> bytes:
    """Nodes of a tree, root first; ``levels`` lists groups of items from the leaves up."""
    nodes = [level[0] for level in levels]
    sizes = [[4 + sum(len(item_bytes(x, None if d == 0 else 0)) for x in g) for g in level] for d, level in enumerate(nodes)]
    place, begins = at, [None] * len(nodes)
    for d in reversed(range(len(nodes))):
        begins[d] = []
        for size in sizes[d]:
            begins[d].append(place)
            place += size
    out = []
    for d in reversed(range(len(nodes))):
        child = iter(begins[d - 1]) if d else None
        for g in nodes[d]:
            out.append(struct.pack("<BBH", d == 0, 0, len(g)) + b"".join(item_bytes(x, next(child) if d else None) for x in g))
    return b"".join(out)


def _index(sections: list[tuple[int, int, int, int, int, int]], at: int, data_end: int) -> bytes:
    """The R tree of sections (chrom, begin, chrom, end, place, size), in order, from the file place ``at`` on."""
    levels = [sections]
    while len(levels[-1]) > FAN:
        levels.append([(*g[0][:2], *max(x[2:4] for x in g), 0, 0) for g in _groups(levels[-1])])
    low, high = (sections[0][:2], max(s[2:4] for s in sections)) if sections else ((0, 0), (0, 0))
    head = struct.pack("<IIQIIIIQII", INDEX, FAN, len(sections), *low, *high, data_end, 1, 0)
    return head + _laid_out([[_groups(level) or [[]]] for level in levels], at + len(head), lambda x, child: struct.pack("<IIII", *x[:4]) + (struct.pack("<QQ", *x[4:6]) if child is None else struct.pack("<Q", child)))


class _Zoom:
    """Summaries of stretches of ``step`` bases, packed as they fill."""

    def __init__(self, step: int):
        self.step, self.held, self.sections, self.packed = step, [], [], []
        self.now: list | None = None

    def add(self, chrom: int, start: int, end: int, value: float) -> None:
        while start < end:
            k = start // self.step
            stop = min(end, (k + 1) * self.step)
            if self.now is None or self.now[0] != chrom or self.now[1] // self.step != k:
                self.close()
                self.now = [chrom, start, stop, 0, value, value, 0.0, 0.0]
            r, n = self.now, stop - start
            r[2], r[3], r[4], r[5], r[6], r[7] = stop, r[3] + n, min(r[4], value), max(r[5], value), r[6] + n * value, r[7] + n * value * value
            start = stop

    def close(self) -> None:
        if self.now is not None:
            if self.held and (len(self.held) >= ITEMS or self.held[0][0] != self.now[0]):
                self.pack()
            self.held.append(self.now)
            self.now = None

    def pack(self) -> None:
        if self.held:
            self.sections.append((self.held[0][0], self.held[0][1], self.held[-1][0], self.held[-1][2]))
            self.packed.append(zlib.compress(b"".join(struct.pack("<IIIIffff", *r) for r in self.held)))
            self.held = []


class File:
    """One file: sections go out as they fill, trees and zoom levels at the end."""

    def __init__(self, path: str, chroms: list[tuple[str, int]]):
        self.path, self.sizes = path, dict(chroms)
        kept = stretched(sorted(chroms), LAST - 1)
        self.names, self.ids = sorted(c for c, _ in kept), {c: (i, n) for i, (c, n) in enumerate(kept)}
        self.body = opened(f"{path}.body", "wb")
        self.sections: list[tuple] = []
        self.held: list[tuple] = []
        self.chrom, self.last, self.reach, self.size, self.most = -1, "", 0, 0, 0
        self.zooms = [_Zoom(z) for z in ZOOMS]
        self.total = [0, float("inf"), float("-inf"), 0.0, 0.0]

    def add(self, chrom: str, start: int, end: int, value: float) -> None:
        size = self.sizes[chrom]
        if chrom < self.last or chrom == self.last and start < self.reach or not 0 <= start < end <= size:
            raise ValueError(f"intervals must come sorted, apart and within their chromosome: {chrom}:{start}-{end}")
        self.last, self.reach = chrom, end
        first = start // STRETCH * STRETCH if size >= LAST else 0
        ident, start, end = self.ids[stretch_name(chrom, first)][0], start - first, end - first
        if ident != self.chrom or len(self.held) >= ITEMS:
            self.pack()
        self.chrom = ident
        self.held.append((start, end, value))
        for z in self.zooms:
            z.add(ident, start, end, value)
        n, t = end - start, self.total
        self.total = [t[0] + n, min(t[1], value), max(t[2], value), t[3] + n * value, t[4] + n * value * value]

    def pack(self) -> None:
        if self.held:
            raw = struct.pack("<IIIIIBBH", self.chrom, self.held[0][0], self.held[-1][1], 0, 0, 1, 0, len(self.held)) + b"".join(struct.pack("<IIf", *x) for x in self.held)
            data = zlib.compress(raw)
            self.body.write(data)
            self.sections.append((self.chrom, self.held[0][0], self.chrom, self.held[-1][1], self.size, len(data)))
            self.size, self.most, self.held = self.size + len(data), max(self.most, len(raw)), []

    def close(self) -> None:
        self.pack()
        self.body.close()
        for z in self.zooms:
            z.close()
            z.pack()
        levels = [z for z in self.zooms if z.sections]
        summary_at = 64 + 24 * len(levels)
        tree_at = summary_at + 40
        tree = _tree(self.names, self.ids, tree_at)
        data_at = tree_at + len(tree)
        begin = data_at + 8
        index_at = begin + self.size
        index = _index([(*s[:4], s[4] + begin, s[5]) for s in self.sections], index_at, index_at)
        at, heads, tail = index_at + len(index), [], []
        for z in levels:
            first = at + 4
            places, p = [], first
            for s, data in zip(z.sections, z.packed):
                places.append((*s, p, len(data)))
                p += len(data)
            tree_of = _index(places, p, p)
            heads.append(struct.pack("<IIQQ", z.step, 0, at, p))
            tail += [struct.pack("<I", sum(1 for _ in z.sections)), *z.packed, tree_of]
            at = p + len(tree_of)
        most = max([self.most, *(32 * ITEMS for _ in levels)])
        total = [self.total[0], *(x if self.total[0] else 0.0 for x in self.total[1:])]
        with opened(self.path, "wb") as out, opened(f"{self.path}.body") as body:
            out.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, len(levels), tree_at, data_at, index_at, 0, 0, 0, summary_at, most, 0))
            out.write(b"".join(heads) + struct.pack("<Qdddd", *total) + tree + struct.pack("<Q", len(self.sections)))
            while data := body.read(1 << 20):
                out.write(data)
            out.write(index + b"".join(tail) + struct.pack("<I", MAGIC))
        _move(f"{self.path}.body", None)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, chroms: list[tuple[str, int]]):
        self.path, self.chroms = path, chroms

    def write(self, iterator) -> WriterCommitMessage:
        number, files = TaskContext.get().partitionId(), {}
        for row in iterator:
            folder = f"{self.path}/{row.folder}" if "folder" in row.__fields__ else self.path
            if folder not in files:
                files[folder] = File(f"{folder}/_part-{number:05d}-{uuid.uuid4().hex}", self.chroms)
            files[folder].add(row.chrom, row.start, row.end, row.score)
        for f in files.values():
            f.close()
        return _Written([(f.path, f"{folder}/part-{number:05d}.bw") for folder, f in files.items()])

    def commit(self, messages) -> None:
        for part, final in (x for m in messages for x in m.files):
            _move(part, final)

    def abort(self, messages) -> None:
        for part, _ in (x for m in messages if m is not None for x in m.files):
            if exists(part):
                _move(part, None)


class BigWig(DataSource):
    """(chrom, pos, score) per base of the files in ``path`` (comma list).

    Options ``min_score`` and ``chroms`` (comma list) cut at the source, ``regions`` (comma list of chrom or
    chrom:begin-end) read the sections that meet them only; a base in two regions comes twice. NaN is never
    read. Option ``pushdown`` turns filters on chrom and pos into a region; it needs
    spark.sql.python.filterPushdown.enabled. Written rows are (chrom, start, end, score), sorted, with option ``chroms``
    (comma list of name:size); they go to one file a partition below ``path``, a folder that executors share.
    A column ``folder`` parts them to folders below ``path``.
    """

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, pos long, score float"

    def reader(self, schema) -> DataSourceReader:
        chroms, regions = self.options.get("chroms"), self.options.get("regions")
        kind = _PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(self.options["path"].split(","), float(self.options.get("min_score", 0.01)), chroms.split(",") if chroms else None, regions.split(",") if regions else [])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [(c.rpartition(":")[0], int(c.rpartition(":")[2])) for c in self.options["chroms"].split(",")])


def write_bigwig(scored: DataFrame, path: str, chroms: dict[str, int]) -> None:
    """(chrom, start, end, score, strand) as bigWig files below ``path``/plus and ``path``/minus, a file a stretch of the sorted rows.

    Intervals of a strand must not overlap; scores are kept in 32 bits. Chromosomes sort by name.
    """
    folder = F.when(F.col("strand") == "-", "minus").otherwise("plus")
    rows = scored.select("chrom", "start", "end", F.col("score").cast("float").alias("score"), folder.alias("folder"))
    rows = rows.repartitionByRange("folder", "chrom", "start").sortWithinPartitions("folder", "chrom", "start")
    rows.write.format("bigwig").option("chroms", ",".join(f"{c}:{n}" for c, n in chroms.items())).mode("append").save(path)


def files_below(path: str) -> str:
    """The bigWig or BAM files of a written folder, as the comma list that the sources take."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        found = [f"file://{i.path}" if store.type_name == "local" else f"{path.partition('://')[0]}://{i.path}" for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True))]
    else:
        found = [f"{path}/{n}" for n in os.listdir(path)] if os.path.isdir(path) else []
    return ",".join(sorted(f for f in found if f.endswith((".bw", ".bam"))))
