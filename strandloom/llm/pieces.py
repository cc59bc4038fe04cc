"""SentencePiece encoding and decoding with a merge (BPE) model, by a prefix table.

A sequence of pieces is what the merges make of its text if and only if each two neighbours are
what the merges make of these two alone. So every prefix of a text has one last piece: the match
of the vocabulary's automaton that ends there and is compatible with the last piece of the prefix
before it. The table holds that piece for each prefix, and ids are recovered from its end
backwards; the work grows with the text's length, whatever its merges.

* Compatibility is tested by making the merges of two pieces, highest score first and leftmost
  among equals, once for each pair that is met.
* A text is cut where no piece can stand across (before white space, between letters and marks, around
  digits and line feeds, as far as the vocabulary has no piece across them). Segments that come again are
  looked up; what is kept of segments and pairs is bounded by ``KEPT`` and started anew beyond it, which changes no result.
* Letters outside the vocabulary stand alone and become byte pieces.

Nothing is shuffled: texts stay in the task that reads them, and the model is the only broadcast.
"""

from __future__ import annotations

import hashlib
import re
import string
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandloom.llm import _words

SPACE = "▁"
KEPT = 400_000
LONG = 80
BATCH_IDS = 1_000_000
_models: dict[bytes, "Model"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


def _cutter(inside: set[tuple[str, str]]):
    """The function that cuts a text into segments which no piece crosses; ``inside``: neighbours within pieces.

    Letters and marks are parted where they meet, if no piece holds a letter beside that mark.
    """
    if any(b == SPACE != a for a, b in inside):
        return re.compile("(?s).+").findall
    letter = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
    is_letter = re.compile(f"[{letter}]").match
    single = [c for c in "\n0123456789" if not any(c in pair for pair in inside)]
    beside = {a for a, b in inside if is_letter(b)} | {b for a, b in inside if is_letter(a)}
    mark = re.escape("".join(c for c in string.punctuation if c not in beside))
    one, rest = "".join(map(re.escape, single)), f"[^{SPACE}{''.join(map(re.escape, single))}]"
    ends = f"(?=[{SPACE}{one}{{}}]|\\Z)"
    forms = [f"{SPACE}*+[{letter}]++" + ends.format(mark)] + ([f"{SPACE}*+[{mark}]++" + ends.format(letter)] if mark else [])
    return re.compile("|".join([*forms, f"{SPACE}*+{rest}++", f"{SPACE}++", *([f"[{one}]"] if one else [])])).findall


class _Segments(dict):
    """Ids of each segment, as the bytes of 32-bit numbers; long ones are not kept."""

    def __init__(self, model: "Model"):
        super().__init__()
        self.model = model

    def __missing__(self, segment: str) -> bytes:
        ids = array("i", self.model.segment_ids(segment)).tobytes()
        if len(segment) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[segment] = ids
        return ids


class Model:
    """Pieces of a model file and the prefix tables of texts.

    Models with their own normalisation, pieces defined by users, or letters that are in pieces but
    no pieces themselves are refused: ValueError.
    """

    def __init__(self, raw: bytes):
        import ahocorasick
        import sentencepiece

        parts = list(_fields(raw))
        trainer, normal = (dict(_fields(next((v for k, v in parts if k == n), b""))) for n in (2, 3))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("only merge models with byte pieces and white space before words are read")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models that keep texts as they are, with white space escaped, are read")
        lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.size, self.end = lib.get_piece_size(), lib.eos_id()
        self.prefix = SPACE if normal.get(3, 1) else ""
        self.pieces = [lib.id_to_piece(i) for i in range(self.size)]
        self.scores = [lib.get_score(i) for i in range(self.size)]
        kinds = [dict(_fields(v)).get(3, 1) for k, v in parts if k == 1]
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("pieces defined by users and unused pieces are not read")
        self.normal = {p: i for i, p in enumerate(self.pieces) if kinds[i] == 1}
        letters = {c for p in self.normal for c in p}
        if not letters <= self.normal.keys():
            raise ValueError("a letter of a piece is no piece")
        self.byte_id = [0] * 256
        self.table: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if kinds[i] == 6:
                self.byte_id[int(p[1:-1], 16)] = i
            self.table.append(bytes([int(p[1:-1], 16)]) if kinds[i] == 6 else b"" if kinds[i] == 3 else " ⁇ ".encode() if kinds[i] == 2 else p.replace(SPACE, " ").encode())
        self.is_byte = np.array(kinds) == 6
        self.hidden = np.array(kinds) == 3
        self.leads = np.array([kinds[i] == 1 and p.startswith(SPACE) for i, p in enumerate(self.pieces)])
        self.automaton = ahocorasick.Automaton()
        for p, i in self.normal.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.cut = _cutter({pair for p in self.normal for pair in pairwise(p)})
        self.sizes = [len(p) for p in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.segments = _Segments(self)

    def merges(self, text: str) -> list[str]:
        """What the merges make of a short text: the best pair first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i, pair in enumerate(pairwise(parts)):
                found = self.normal.get(pair[0] + pair[1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are beside each other; left -1: the right one alone."""
        key = (left + 1) * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * KEPT:
                self.pairs.clear()
            two = ([self.pieces[left]] if left >= 0 else []) + [self.pieces[right]]
            known = self.pairs[key] = self.merges("".join(two)) == two
        return known

    def last_pieces(self, text: str) -> list[int]:
        """The last piece of each prefix; -1 for a letter outside the vocabulary."""
        # one more entry in the end, where index -1 finds what stands before the first letter
        last = [-1] * (len(text) + 1)
        known, n = self.pairs.get, self.size
        for end, (piece, size) in self.automaton.iter(text):
            if last[end] < 0:
                left = last[end - size]
                stays = known((left + 1) * n + piece)
                if stays or stays is None and self.compatible(left, piece):
                    last[end] = piece
        return last

    def segment_ids(self, text: str) -> list[int]:
        last, sizes, ids, at = self.last_pieces(text), self.sizes, [], len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece >= 0:
                ids.append(piece)
                at -= sizes[piece]
            else:
                ids.extend(self.byte_id[b] for b in reversed(text[at].encode()))
                at -= 1
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids, with the end id, as the bytes of 32-bit numbers."""
        if text:
            text = self.prefix + text.replace(" ", SPACE)
        return b"".join(map(self.segments.__getitem__, self.cut(text))) + np.int32(self.end).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """White space of the first piece that shows is the prefix; bytes that are no letter become U+FFFD each."""
        shown = ids[~self.hidden[ids]]
        raw = b"".join(map(self.table.__getitem__, shown.tolist()))
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            out = self._repaired(shown)
        return out[1:] if self.prefix and len(shown) and self.leads[shown[0]] else out

    def _repaired(self, ids: np.ndarray) -> str:
        out, held = [], bytearray()

        def settle() -> None:
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[:n].decode())
                    except UnicodeDecodeError:
                        continue
                    break
                else:
                    out.append("�")
                    n = 1
                del held[:n]

        for i in ids.tolist():
            if self.is_byte[i]:
                held += self.table[i]
            else:
                settle()
                out.append(self.table[i].decode())
        settle()
        return "".join(out)


def read_model(path: str) -> bytes:
    """The model file as bytes; it is read once, on the driver."""
    with open(path, "rb") as f:
        return f.read()


def _model(raw: bytes) -> Model:
    mark = hashlib.sha1(raw).digest()
    if mark not in _models:
        _models[mark] = Model(raw)
    return _models[mark]


def encode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)``, one row per input row: the ids of its whole text and the end id.

    A null or empty text has the end id only. Null and repeated keys and repeated rows are kept as
    they are; other columns are ignored; an empty table stays empty. A very long text is one row of one task, at a
    cost that grows with its length.
    """
    raw = read_model(model_path)
    Model(raw)
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = _model(shared.value).encode
        for batch in batches:
            keys, texts = batch.columns
            begun, parts, total = 0, [], 0
            for i, t in enumerate(texts):
                parts.append(encode_one(t.as_py() or ""))
                total += len(parts[-1]) // 4
                if total >= BATCH_IDS or i == len(texts) - 1:
                    off = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(begun, len(parts)), ids], names=["doc_id", "ids"])
                    begun, parts, total = i + 1, [], 0

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """The columns of ``coded`` and ``decoded``: the text of its ids; null or no ids: empty. An id outside
    the table is an error. A column ``decoded`` is replaced; an empty table stays empty."""
    coded = coded.drop("decoded") if ids != "decoded" else coded
    shared = coded.sparkSession.sparkContext.broadcast(read_model(model_path))
    at = coded.columns.index(ids)

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_one = _model(shared.value).decode
        for batch in batches:
            col = batch.column(at)
            flat, off = col.values.to_numpy(), col.offsets.to_numpy()
            out = [decode_one(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField("decoded", StringType())]))


def digest(coded: DataFrame) -> DataFrame:
    """Digest columns of a decoded table."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_model() -> str:
    """Path of the installed merge model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_pieces(spark, sf_dir: str) -> DataFrame:
    path = default_model()
    return digest(decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path))
