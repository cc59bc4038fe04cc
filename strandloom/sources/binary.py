"""Binary sources in pure Python: 2bit genomes here, bigWig tracks in ``bigwig``, BAM in ``bam``.

Each is a Python data source. Partitions are stretches of the file's sequences; files must be
reachable from the executors by their path, or by a URI that Arrow opens. ``read_store`` takes the
same files from any store that Spark reads: BAM in splits, the others a file a task and below 2 GB each.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.sources.bam import Bam, located, opened, parse_region, read_bam, write_bams
from strandloom.sources.bam import block_of as _block, record_of as bam_record
from strandloom.sources.bigwig import BigWig, Track, files_below, write_bigwig

__all__ = ["Bam", "_block", "bam_record", "BigWig", "Track", "files_below", "write_bigwig", "TwoBit", "read_bam", "read_sam", "read_store", "register", "twobit_index", "twobit_sequence", "write_bams"]
_BASES = "TCAG"
_QUADS = ["".join(_BASES[b >> s & 3] for s in (6, 4, 2, 0)) for b in range(256)]


def _open(source: str | bytes):
    """A file by its path, or its content."""
    return io.BytesIO(source) if isinstance(source, bytes) else opened(source)


class _Part(InputPartition):
    def __init__(self, path: str, name: str = "", place: int = 0, begin: int = 0, end: int | None = None):
        self.path, self.name, self.place, self.begin, self.end = path, name, place, begin, end


# --- 2bit -------------------------------------------------------------------------------------------


def twobit_index(path: str | bytes) -> tuple[str, dict[str, int]]:
    """Byte order and the place of each sequence."""
    with _open(path) as f:
        head = f.read(16)
        order = "<" if struct.unpack("<I", head[:4])[0] == 0x1A412743 else ">"
        if struct.unpack(order + "I", head[:4])[0] != 0x1A412743:
            raise ValueError(f"not a 2bit file: {path}")
        out = {}
        for _ in range(struct.unpack(order + "I", head[8:12])[0]):
            name = f.read(f.read(1)[0]).decode()
            out[name] = struct.unpack(order + "I", f.read(4))[0]
    return order, out


def twobit_part(path: str | bytes, order: str, place: int, begin: int = 0, end: int | None = None) -> tuple[str, int]:
    """Bases [begin, end) of a sequence, and its size; only their bytes are read."""
    with _open(path) as f:
        f.seek(place)
        number = lambda: struct.unpack(order + "I", f.read(4))[0]

        def blocks() -> list[tuple[int, int]]:
            n = number()
            starts, sizes = (struct.unpack(f"{order}{n}I", f.read(4 * n)) for _ in range(2))
            return list(zip(starts, sizes))

        size, unknown, masked = number(), blocks(), blocks()
        number()
        end = size if end is None else min(end, size)
        begin = min(begin, end)
        f.seek(f.tell() + begin // 4)
        seq = bytearray("".join(_QUADS[b] for b in f.read((end + 3) // 4 - begin // 4))[begin % 4 :][: end - begin].encode())
    for runs, change in ((unknown, lambda old: b"N" * len(old)), (masked, bytes.lower)):
        for s, n in runs:
            a, b = max(s, begin) - begin, min(s + n, end) - begin
            if a < b:
                seq[a:b] = change(bytes(seq[a:b]))
    return seq.decode(), size


def twobit_sequence(path: str | bytes, order: str, place: int) -> str:
    return twobit_part(path, order, place)[0]


def _twobit_size(path: str, order: str, place: int) -> int:
    with _open(path) as f:
        f.seek(place)
        return struct.unpack(order + "I", f.read(4))[0]


class _TwoBitReader(DataSourceReader):
    """Partitions are stretches of ``span`` bases, whole tiles each."""

    def __init__(self, path: str, tile: int, regions: list[str], span: int):
        self.path, self.tile, self.regions, self.span = path, tile, [parse_region(r) for r in regions], max(1, span // tile) * tile

    def partitions(self) -> list[InputPartition]:
        order, places = twobit_index(self.path)
        out = []
        for name, begin, end in self.regions or [(n, 0, None) for n in places]:
            if name in places:
                size = _twobit_size(self.path, order, places[name])
                stop = size if end is None else min(end, size)
                first = begin // self.tile * self.tile
                out += [_Part(self.path, name, places[name], a, min(a + self.span, -(-stop // self.tile) * self.tile)) for a in range(first, max(stop, first + 1), self.span)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        seq, size = twobit_part(partition.path, twobit_index(partition.path)[0], partition.place, partition.begin, partition.end)
        for t in range(0, max(len(seq), 1), self.tile):
            yield partition.name, (partition.begin + t) // self.tile, seq[t : t + self.tile], size


class _PushingTwoBitReader(_TwoBitReader):
    def pushFilters(self, filters) -> Iterator:
        """``chrom = x`` and bounds of ``tile`` become a region; every filter is applied again by Spark."""
        chrom, low, high = None, 0, None
        for f in filters:
            kind, of = type(f).__name__, getattr(f, "attribute", None)
            if kind == "EqualTo" and of == ("chrom",):
                chrom = f.value
            elif of == ("tile",):
                if kind == "EqualTo":
                    low, high = max(low, f.value), f.value if high is None else min(high, f.value)
                elif kind in ("GreaterThan", "GreaterThanOrEqual"):
                    low = max(low, f.value + (kind == "GreaterThan"))
                elif kind in ("LessThan", "LessThanOrEqual"):
                    high = f.value - (kind == "LessThan") if high is None else min(high, f.value - (kind == "LessThan"))
            yield f
        if chrom is not None and not self.regions:
            self.regions = [(chrom, low * self.tile, None if high is None else max(high + 1, 0) * self.tile)]


class TwoBit(DataSource):
    """(chrom, tile, seq, chrom_size); option ``tile`` is the bases of a tile, ``span`` those of a task, ``regions`` (comma list of
    chrom or chrom:begin-end) reads the tiles that meet them only. Option ``pushdown`` turns filters on chrom and tile into a
    region; it needs spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "chrom string, tile long, seq string, chrom_size long"

    def reader(self, schema) -> DataSourceReader:
        regions = self.options.get("regions")
        kind = _PushingTwoBitReader if self.options.get("pushdown", "false").lower() == "true" else _TwoBitReader
        return kind(self.options["path"], int(self.options.get("tile", 65536)), regions.split(",") if regions else [], int(self.options.get("span", 1 << 24)))


def _twobit_rows(content: bytes, tile: int) -> Iterator[tuple]:
    order, places = twobit_index(content)
    for chrom, place in places.items():
        seq = twobit_sequence(content, order, place)
        for t in range(0, max(len(seq), 1), tile):
            yield chrom, t // tile, seq[t : t + tile], len(seq)


def _bigwig_rows(content: bytes, least: float) -> Iterator[tuple]:
    track = Track(content)
    for (chrom, first), (ident, _) in zip(located(list(track.chroms)), track.chroms.values()):
        for pos, x in track.positions(ident, least):
            yield from zip([chrom] * len(pos), (pos + first).tolist(), x.tolist())


def read_store(spark: SparkSession, kind: str, paths: str | list[str], tile: int = 65536, min_score: float = 0.01, batch: int = 4096) -> DataFrame:
    """``kind`` twobit, bigwig or bam from any store that Spark reads, with the columns of the data source of that name.

    A BAM file is split; the others are a file a task, below 2 GB each."""
    if kind == "bam":
        return read_bam(spark, paths).drop("file")
    rows_of = {"twobit": lambda c: _twobit_rows(c, tile), "bigwig": lambda c: _bigwig_rows(c, min_score)}[kind]
    schema = {"twobit": TwoBit, "bigwig": BigWig}[kind].schema(None)
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32()}
    fields = pa.schema([(name, arrow[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                held: list[tuple] = []
                for row in rows_of(content.as_py()):
                    held.append(row)
                    if len(held) >= batch:
                        yield table(held)
                        held = []
                if held:
                    yield table(held)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, schema)


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SAM text with the columns of the BAM source; positions become 0-based."""
    from pyspark.sql import functions as F

    f = F.split("value", "\t")
    rows = spark.read.text(paths).where("value not like '@%'")
    return rows.select(f[0].alias("name"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("start"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"))


def register(spark: SparkSession) -> None:
    for source in (TwoBit, BigWig, Bam):
        spark.dataSource.register(source)
