"""Sequence packing along a space-filling curve.

Every text is tokenised once. Its hashed token vector is projected to ``DIMS`` dimensions by fixed random signs and
scaled to unit length; the Hilbert number of that point orders documents so that neighbours use similar words. Rows are
range-partitioned and sorted by that number, then by a hash of the id, so that a third of all rows with one point still
spread over many tasks; long documents are several rows. Each partition is then cut, in order, into sequences of ``LENGTH`` tokens. What is left at a
partition's end is cut at powers of two, which need no padding.

The tokenised rows are written once to the shared folder, since range partitioning reads its input twice.

Words are cut here and looked up one by one where the tokenizer's file says that it works word by word as the fixed values
below do; any other tokenizer encodes whole texts.

Defined results: a null or empty text is the end token alone; repeated rows and null ids are packed as rows of their
own, ordered by their tokens, so that a retried task packs alike; ids of any type are kept as they are; a very long text is
cut over as many sequences as it needs; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

LENGTH, END = 4096, 2

#: Most tokens of a document in one row before packing, so that rows are dealt out evenly.
SEGMENT = 8192

#: Dimensions of the projection and bits for each on the curve.
DIMS, CURVE_BITS = 3, 10

#: Bytes of written tokens in a task that packs them, at most about.
TASK_BYTES = 64 << 20

#: Words whose ids a worker remembers, and the longest that it remembers.
CACHE_WORDS, CACHE_BYTES = 400_000, 48


#: ASCII without control characters, and the letters of Latin-1: what these characters become is the same in all versions.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")

# Fixed value: how this vocabulary's file cuts lower-cased words, for the characters above.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

# The normalizer and pre-tokenizer, as tokenizer files state them, that work so.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def id_type(tokenizer_path: str) -> np.dtype:
    """The narrowest little-endian type that holds every id of the tokenizer."""
    from tokenizers import Tokenizer

    return _id_type(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True))


def _id_type(n_ids: int) -> np.dtype:
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


def works_by_word(tokenizer_path: str) -> bool:
    """Whether the file's normalizer and pre-tokenizer are the fixed ones above, with BPE after them."""
    with open(tokenizer_path, encoding="utf-8") as file:
        d = json.load(file)
    return d["normalizer"] == _NORMALIZER and d["pre_tokenizer"] == _PRE_TOKENIZER and d["model"].get("type", "BPE") == "BPE" and all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in d["added_tokens"])


class _Words(dict):
    """Word (UTF-8) to its ids as little-endian numbers; unknown words are encoded, and kept while there is room.

    A plain word is cut here and goes to the BPE model piece by piece; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.code = _id_type(self.whole.get_vocab_size(with_added_tokens=True)).char
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            pieces = _CUT.findall(text.lower())
            ids = [t.id for x in pieces for t in self.model.tokenize(x if x.isascii() else x.translate(self.letters))]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        out = array(self.code, ids).tobytes()
        if len(word) <= CACHE_BYTES and len(self) < CACHE_WORDS:
            self[word] = out
        return out


class WordTokenizer:
    """Token ids of texts, by way of their words between white space where no token crosses it, else of whole texts."""

    def __init__(self, path: str, by_word: bool | None = None):
        self._words = _Words(path)
        self._by_word = works_by_word(path) if by_word is None else by_word
        common.give_back()  # reading the file takes several times what is kept of it

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self._by_word:
            ids = self._words.__getitem__
            return [b"".join(map(ids, t.split())) for t in texts]
        whole = self._words.whole
        return [array(self._words.code, whole.encode(t.decode(), add_special_tokens=False).ids).tobytes() for t in texts]


@cache
def word_tokenizer(path: str, by_word: bool) -> WordTokenizer:
    """One for all tasks of a Python worker, so that its memory of words lasts."""
    return WordTokenizer(path, by_word)


_signs: dict[int, np.ndarray] = {}


def projected(ids: np.ndarray, ends: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Unit vectors of documents, whose token ids lie one after the other; a document has one id at least."""
    table = _signs.get(dims)
    if table is None or len(table) <= int(ids.max(initial=0)):
        bits = common.seeded(1 << max(16, int(ids.max(initial=0)).bit_length()), 11)
        table = _signs[dims] = np.stack([((bits >> np.uint64(k)) & np.uint64(1)).astype(np.float32) * 2 - 1 for k in range(dims)], 1)
    starts = np.concatenate([[0], ends[:-1]])
    point = np.stack([np.add.reduceat(table[ids, k], starts, dtype=np.float64) for k in range(dims)], 1)
    return point / np.maximum(np.sqrt((point**2).sum(1, keepdims=True)), 1e-9)


def hilbert_key(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """The place on the Hilbert curve of points with ``dims`` integer coordinates of ``bits`` bits."""
    axis = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(axis)
    for level in range(bits - 1, 0, -1):  # undo the turns of each cell, coarse to fine
        bit, low = 1 << level, (1 << level) - 1
        for k in range(n):
            high = (axis[k] & bit) != 0
            swap = np.where(high, 0, (axis[0] ^ axis[k]) & low)
            axis[0] = np.where(high, axis[0] ^ low, axis[0] ^ swap)
            if k:
                axis[k] = axis[k] ^ swap
    for k in range(1, n):
        axis[k] = axis[k] ^ axis[k - 1]
    turn = np.zeros_like(axis[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axis[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(axis[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | (((axis[k] ^ turn) >> level) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, curve, total, start, ids): each document's place on the curve and its little-endian token ids, of id_type(), with
    the end token, in rows of at most ``SEGMENT`` ids from ``start`` on."""
    common.small_batches(docs.sparkSession)
    kind, by_word = id_type(tokenizer_path), works_by_word(tokenizer_path)  # here, so that workers read the file once
    wide = kind.itemsize

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path, by_word)
        end = END.to_bytes(wide, "little")
        for batch in common.chunks(batches):
            rows = [x + end for x in words.encode(common.texts_of(batch))]
            ids = np.frombuffer(b"".join(rows), kind)
            point = projected(ids, np.cumsum([len(x) // wide for x in rows]))
            side = 1 << CURVE_BITS
            cells = np.clip(((point + 1) / 2 * side).astype(np.int64), 0, side - 1)
            parts = [(i, len(x) // wide, at) for i, x in enumerate(rows) for at in range(0, len(x) // wide, SEGMENT)]
            of = pa.array([i for i, _, _ in parts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(of),
                    pa.array(hilbert_key(cells)).take(of),
                    pa.array([n for _, n, _ in parts], pa.int64()),
                    pa.array([at for _, _, at in parts], pa.int64()),
                    pa.array([rows[i][wide * at : wide * (at + SEGMENT)] for i, _, at in parts], pa.binary()),
                ],
                names=["id", "curve", "total", "start", "ids"],
            )

    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, curve long, total long, start long, ids binary")


class _Packer:
    """Cuts one partition's stream of documents into sequences."""

    def __init__(self, first_sequence: int, length: int):
        self.sequence, self.length = first_sequence, length
        self.open: list[tuple[object, int, np.ndarray, int]] = []  # id, start, ids, tokens of the document
        self.filled = 0
        self.out: list[tuple] = []

    def _close(self) -> None:
        at = 0
        for doc, start, ids, total in self.open:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at))
            at += len(ids)
        self.open, self.filled = [], 0
        self.sequence += 1

    def add(self, doc: object, ids: np.ndarray, limit: int | None = None, start: int = 0, total: int | None = None) -> None:
        limit, total, at = limit or self.length, len(ids) if total is None else total, 0
        while at < len(ids):
            take = min(limit - self.filled, len(ids) - at)
            self.open.append((doc, start + at, ids[at : at + take], total))
            self.filled += take
            at += take
            if self.filled == limit:
                self._close()
                if limit != self.length:
                    return self.rest.insert(0, (doc, start + at, ids[at:], total)) if at < len(ids) else None
        return None

    def finish(self) -> None:
        """Cut the open sequence at powers of two."""
        self.rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            need = size
            while need:
                doc, start, ids, total = self.rest.pop(0)
                need -= min(need, len(ids))
                self.add(doc, ids, size, start, total)
            left -= size

    def drain(self, id_kind: pa.DataType) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k else id_kind) for k in range(7)], names=PIECE)


PIECE = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document in a sequence; see PIECE, with ``id_col`` for id."""
    spark = docs.sparkSession
    rows, path = common.write_scratch(tokenised(docs, tokenizer_path, id_col), "tokens")
    rows = rows.withColumns({"tie": F.xxhash64("id", "total"), "tie2": F.xxhash64("ids")})
    order = ("curve", "tie", "start", "tie2")
    tasks = common.table_bytes(spark, path) // TASK_BYTES + 1
    spread = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []  # else as many as the session says
    ranged = rows.repartitionByRange(*spread, *map(F.col, order)).sortWithinPartitions(*order).select("id", "total", "start", "ids")
    kind = id_type(tokenizer_path)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, id_kind = _Packer(TaskContext.get().partitionId() << 40, length), None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc, total, start, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                packer.add(doc, np.frombuffer(ids.as_buffer(), kind), None, start, total)
            yield packer.drain(id_kind)
        packer.finish()
        if packer.out:
            yield packer.drain(id_kind)

    types = ", ".join(f"{c} long" for c in PIECE[1:])
    return ranged.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {types}").withColumnRenamed("id", id_col)
