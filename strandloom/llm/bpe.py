"""Byte-level BPE by a global shuffle of distinct words, and decoding.

Encoding. Texts are cut into pre-tokens by the tokenizer's pattern. A task deals its texts into
chunks; a chunk keeps, for each text, the positions of its pre-tokens as a sequence of numbers of
the chunk's distinct words. The distinct words travel to hash buckets, where equal words of all
chunks meet and each is encoded once; token ids travel back to the chunk and are put in place by
position. A frequent word so costs one entry a chunk, not one a use, and no bucket holds more than
its share of the distinct words. Texts are cut twice, once for the words and once for the positions,
which so travel once. The usual pattern is cut by the classes of code points, over many texts at
once; other patterns by their matches, text by text.

Decoding joins ids with the table of token bytes (at most the vocabulary's size, so broadcast).
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _words
from strandloom.llm._pack import narrow, pack, unpack
from strandloom.workspace import as_scan, shuffle_width

#: Bytes of UTF-8 of a chunk, and one a text; the text that reaches it is the chunk's last.
CHUNK_CHARS = 8_000_000
ROW = "bucket int, chunk long, kind string, blob binary"
#: The pattern of GPT-2 and of many vocabularies since.
CLASS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER = range(4)
_encoders: dict[bytes, object] = {}


def read_ranks(path: str) -> bytes:
    """The rank file as bytes; it is read once, on the driver."""
    with open(path, "rb") as f:
        return f.read()


def token_bytes(ranks: bytes) -> list[bytes]:
    """Bytes of each token id."""
    pairs = [line.split() for line in ranks.splitlines() if line.strip()]
    table = [b""] * (max(int(i) for _, i in pairs) + 1)
    for b, i in pairs:
        table[int(i)] = base64.b64decode(b)
    return table


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    mark = hashlib.sha1(ranks + pattern.encode()).digest()
    if mark not in _encoders:
        merges = {base64.b64decode(b): int(i) for b, i in (x.split() for x in ranks.splitlines() if x.strip())}
        _encoders[mark] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _encoders[mark]


def _cut_by_regex(pattern: str):
    """Start and end of each match of any pattern, and the number of matches of each text."""
    import regex

    regexp = regex.compile(pattern)

    def cut(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(len(off) - 1, np.int64)
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            text = buf[a:b].tobytes().decode()
            found = regexp.findall(text) if not regexp.groups else None
            if found is not None and sum(map(len, found)) == len(text):
                end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
                start = np.append(0, end[:-1])[: len(end)]
            else:
                start, end = np.array([m.span() for m in regexp.finditer(text)], np.int64).reshape(-1, 2).T
            # from code points to bytes
            lead = np.append(np.flatnonzero((buf[a:b] & 0xC0) != 0x80), b - a) + a
            starts.append(lead[start])
            ends.append(lead[end])
            counts[i] = len(start)
        return np.concatenate(starts), np.concatenate(ends), counts

    return cut


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other, as the pattern's own library has them."""
    import regex

    table, every = np.full(0x110000, OTHER, np.uint8), "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def _cut_by_classes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for CLASS_PATTERN. Its matches cover a text, so starts say all. A match starts at each text, at each
    change of class but behind a blank, which the next match takes in, at the last of several white spaces before
    something else, and behind a contraction, whose apostrophe must start a match."""
    n = len(buf)
    lead = None
    if n and int(buf.max()) < 128:
        code = buf
    else:
        code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero((buf & 0xC0) != 0x80), n)
        off = np.searchsorted(lead, off)
    n = len(code)
    first, start = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[off] = True
    if n:
        kind = _classes()[code]
        blank = kind == SPACE
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start[1:n] &= (code[:-1] != 32) | blank[1:]
        start[: n - 1] |= blank[:-1] & ~blank[1:] & ~first[1:n]
        start |= first
        at = np.flatnonzero(code == 39)
        at = at[start[at]]
        # the next two code points of the same text, 0 beyond it
        one = np.where(first[at + 1], 0, code[np.minimum(at + 1, n - 1)])
        two = np.where((one == 0) | first[np.minimum(at + 2, n)], 0, code[np.minimum(at + 2, n - 1)])
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long] + 3] = True
    start[n] = True
    edge = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(edge, off))
    edge = edge if lead is None else lead[edge]
    return edge[:-1], edge[1:], counts


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word; running sums span a block of words only, however long a text is."""
    out = [np.empty(0, np.uint64)]
    for i, j in _words.slices(np.append(start[:1], end)):
        a, b = start[i], end[j - 1]
        out.append(_words.span_hash(_words.prefix_hash(buf[a:b], fold=False), start[i:j] - a, end[i:j] - a))
    return np.concatenate(out)


def _numbers(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word and a place of each number. Words are told apart by hashes, and every word is then
    compared with the first of its hash; if any differs, by their bytes."""
    _, number, n = _words.codes(h)
    place = np.empty(len(n), np.int64)
    place[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    size = end - start
    same = np.array_equal(size, size[place][number])
    ends = np.cumsum(size)
    for i, j in _words.slices(np.append(0, ends)) if same else ():
        gap = np.arange(ends[j - 1] - (ends[i] - size[i])) - np.repeat(ends[i:j] - size[i:j] - (ends[i] - size[i]), size[i:j])
        if not np.array_equal(buf[gap + np.repeat(start[i:j], size[i:j])], buf[gap + np.repeat(start[place[number[i:j]]], size[i:j])]):
            same = False
            break
    if not same:
        raw, known = buf.tobytes(), {}
        number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())], np.int32)
        place = np.empty(len(known), np.int64)
        place[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return number, place


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, c, k, v = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(k, pa.string()), pa.array(v, pa.binary())], names=["bucket", "chunk", "kind", "blob"])


def _split(pattern: str, buckets: int, chunk_chars: int, kind: str):
    """Rows of one kind, words or docs, of a task's chunks; both kinds number chunks and words alike."""

    def flush(chunk: int, parts: list[tuple]) -> pa.RecordBatch | None:
        buf, keys, nulls, lengths, start, end, h = (np.concatenate(x) for x in zip(*parts))
        number, place = _numbers(buf, start, end, h)
        order = np.argsort(-np.bincount(number, minlength=len(place)), kind="stable")
        home = (h[place[order]] % np.uint64(buckets)).astype(np.uint32)
        if kind == "docs":
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            return _rows([(-1, chunk, "docs", pack(keys, nulls, lengths, rank[number], home))])
        by_home = np.argsort(home, kind="stable")
        place = place[order[by_home]]
        cuts = np.searchsorted(home[by_home], np.arange(buckets + 1))
        size = end[place] - start[place]
        ends = np.cumsum(size)
        flat = buf[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[place] - (ends - size), size)]
        ends = np.append(0, ends)
        out = []
        for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if i < j:
                out.append((b, chunk, "words", pack(size[i:j].astype(np.uint32), flat[ends[i] : ends[j]])))
        return _rows(out) if out else None

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cut_by_classes if pattern == CLASS_PATTERN else _cut_by_regex(pattern)
        chunk = TaskContext.get().partitionId() << 32
        parts, held, room = [], 0, chunk_chars
        for batch in batches:
            buf, off = _words.utf8(batch.column(1))
            keys, nulls = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            filled, at = off + np.arange(len(off)), 0
            while at < len(keys):
                # the text that fills the chunk is its last one, wherever batches end
                stop = min(int(np.searchsorted(filled, filled[at] + room)), len(keys))
                for i, j in _words.slices(off[at : stop + 1]):
                    i, j = at + i, at + j
                    piece = buf[off[i] : off[j]]
                    start, end, counts = cut(piece, off[i : j + 1] - off[i])
                    parts.append((piece, keys[i:j], nulls[i:j], counts.astype(np.uint32), start + held, end + held, _hashes(piece, start, end)))
                    held += len(piece)
                room -= int(filled[stop] - filled[at])
                at = stop
                if room <= 0:
                    if (out := flush(chunk, parts)) is not None:
                        yield out
                    chunk, parts, held, room = chunk + 1, [], 0, chunk_chars
        if parts and (out := flush(chunk, parts)) is not None:
            yield out

    return run


def _encode_bucket(ranks, pattern: str):
    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        encode = _encoder(ranks.value, pattern)._encode_single_piece
        known: dict[bytes, np.ndarray] = {}
        out = []
        for bucket, chunk, blob in zip(*(table[c] for c in ("bucket", "chunk", "blob"))):
            bucket, chunk = bucket.as_py(), chunk.as_py()
            lengths, raw = unpack(blob.as_buffer())
            ends = np.cumsum(lengths, dtype=np.int64).tolist()
            raw, at, found = raw.tobytes(), 0, []
            for end in ends:
                word = raw[at:end]
                if word not in known:
                    known[word] = np.array(encode(word), np.uint32)
                found.append(known[word])
                at = end
            out.append((bucket, chunk, "ids", pack(np.array([len(x) for x in found], np.uint32), np.concatenate(found))))
        return pa.Table.from_batches([_rows(out)])

    return run


@_words.lean
def _assemble(table: pa.Table) -> pa.Table:
    kinds, buckets = table["kind"].to_pylist(), table["bucket"].to_pylist()
    keys, nulls, lengths, seq, home = unpack(table["blob"][kinds.index("docs")].as_buffer())
    count = np.zeros(len(home), np.int64)
    parts, order = [], []
    by_home = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[by_home], np.arange(int(home.max()) + 2 if len(home) else 1))
    for row, (kind, b) in enumerate(zip(kinds, buckets)):
        if kind == "ids":
            n, ids = unpack(table["blob"][row].as_buffer())
            mine = by_home[cuts[b] : cuts[b + 1]]
            count[mine] = n
            parts.append(ids)
            order.append(mine)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
    place = np.concatenate(order) if order else np.empty(0, np.int64)
    start = np.empty(len(home), np.int64)
    start[place] = np.cumsum(count[place]) - count[place]
    n = count[seq]
    ends = np.cumsum(n)
    take = np.repeat(start[seq] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    tokens = flat[take]
    cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))]
    ids = pa.LargeListArray.from_arrays(pa.array(cut, pa.int64()), pa.array(tokens)).cast(pa.list_(pa.int32()))
    return pa.table({"doc_id": pa.array(keys, mask=nulls.astype(bool)), "ids": ids})


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``(doc_id, ids)``, one row per input row; a null or empty text has no ids.

    Special tokens are ordinary text. Null and repeated keys are kept as they are; other columns
    are ignored. Chunks are made of a task's rows in their order, so shuffled rows are written first; they
    hold about ``chunk_chars`` bytes.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    buckets = max(16, 2 * shuffle_width(spark))
    rows = as_scan(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "texts")
    placed, words = (rows.mapInArrow(_split(pattern, buckets, chunk_chars, kind), ROW) for kind in ("docs", "words"))
    coded = words.groupBy("bucket").applyInArrow(_encode_bucket(ranks, pattern), ROW)
    return placed.unionByName(coded).groupBy("chunk").applyInArrow(_assemble, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """The columns of ``coded`` and ``decoded``: the concatenated bytes of its ids; null ids: empty. An id outside the
    table is an error. A column ``decoded`` is replaced."""
    coded = coded.drop("decoded") if ids != "decoded" else coded
    table = coded.sparkSession.sparkContext.broadcast(token_bytes(read_ranks(ranks_path)))
    at = coded.columns.index(ids)

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.__getitem__
        for batch in batches:
            col = batch.column(at)
            flat, off = col.values.to_numpy(), col.offsets.to_numpy()
            out = [b"".join(map(get, flat[a:b].tolist())) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField("decoded", BinaryType())]))


def digest(coded: DataFrame) -> DataFrame:
    """Digest columns of a decoded table."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_ranks() -> tuple[str, str]:
    """Path and pattern of the installed multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path, pattern = default_ranks()
    return digest(decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pattern), path))
