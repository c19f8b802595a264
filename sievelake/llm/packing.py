"""Packing by concatenating and cutting, with offsets from prefix sums over partition totals."""

from __future__ import annotations

import json
import re
import zlib
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, text_of, written

#: Pieces of words that a Python worker remembers the ids of (about 200 bytes each); others are encoded again.
REMEMBERED = 1_000_000
#: Totals of so many partitions at most are broadcast: 16 bytes each, 32 MB in all.
BROADCAST_PARTITIONS = 2_000_000


# Fixed values of the vocabulary file: what it does to texts before it cuts them, and the pattern that it cuts by.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed values of the vocabulary file: its pattern of pieces, for texts of printable ASCII and Latin-1 letters.
_LETTER = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[^\x20\x09-\x0d{_LETTER}0-9]+")
#: In such texts lower case, NFC and blanks are as in the tokenizer; others go through the tokenizer itself.
_PLAIN = re.compile("[\x20\x09-\x0d\x21-\x7e\u00c0-\u00ff]*")
_BLANK = re.compile("[\x20\x09-\x0d]+")
_SPECIAL = "<|"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies have for each byte: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def _is_known(vocabulary: str) -> bool:
    """Whether the file cuts texts into pieces of words as PieceIds does; if not, the tokenizer itself gets whole texts."""
    with open(vocabulary, encoding="utf-8") as file:
        held = json.load(file)
    before = (held.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split, byte_level = before[0], before[-1]
    return (
        len(before) == 2
        and (held.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": _SPLIT}, "Removed", True)
        and (byte_level.get("type"), byte_level.get("add_prefix_space"), byte_level.get("use_regex")) == ("ByteLevel", False, False)
        and held.get("truncation") is None
        and all(_SPECIAL in t["content"] and t["special"] and not t["lstrip"] and not t["rstrip"] for t in held.get("added_tokens", []))
    )


class PieceIds(dict):
    """Ids of lower-case pieces of words as bytes, found as they are asked for.

    A vocabulary never joins across pieces, and there are far fewer of them
    than words. A Python worker keeps them from one task to the next.
    """

    workers: ClassVar[dict[str, PieceIds]] = {}

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.letters = _byte_letters()
        self.known = _is_known(vocabulary)

    @classmethod
    def of(cls, vocabulary: str) -> PieceIds:
        if vocabulary not in cls.workers:
            cls.workers[vocabulary] = cls(vocabulary)
        return cls.workers[vocabulary]

    def __missing__(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = np.array([t.id for t in self.model.tokenize(mapped)], self.dtype).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.known:
            return self.whole(text)
        if _SPECIAL not in text and _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, _PIECE.findall(text.lower())))
        return b"".join(self.encode(w) if _SPECIAL not in w and _PLAIN.fullmatch(w) else self.whole(w) for w in _BLANK.split(text))

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()


def token_runs(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: every document's ids with end_id after them, and where they start within their partition.

    Written to the shared folder, so that the partitions are fixed: doc_id,
    part, part_start, n, ids (little-endian, 16 bits each if the vocabulary
    allows, else 32).
    """

    def encode(batches):
        part, at, pieces = TaskContext.get().partitionId(), 0, PieceIds.of(vocabulary)
        end = np.array([end_id], pieces.dtype).tobytes()
        width = len(end)
        for batch in batches:
            codes = [pieces.encode(t) + end for t in batch.column(1).to_pylist()]
            n = np.array([len(c) // width for c in codes], np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array(ends - n), pa.array(n), pa.array(codes, pa.binary())], ["doc_id", "part", "part_start", "n", "ids"])
            at = int(ends[-1]) if len(ends) else at

    kind = docs.select(F.col(quoted(id_col)).alias("id")).dtypes[0][1]
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("text"))
    return written(rows.mapInArrow(encode, f"doc_id {kind}, part int, part_start long, n long, ids binary"), "token-runs")


def packed(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into windows of `length` ids, cut where a window is full; only the last has padding.

    Pass one (token_runs) counts the ids of each partition; sums over the
    totals of earlier partitions give every document its place in the whole
    stream; pass two cuts at multiples of `length` and returns a row for each
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents follow one another as the input's partitions hold them, so that
    files split in another way are packed in another order; every id is packed
    once either way. Null and empty texts have end_id alone; repeated rows are packed again;
    null ids are kept; an empty table gives no rows.
    """
    runs = token_runs(docs, vocabulary, end_id, id_col, text_col)
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    parts = runs.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    if parts <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    placed = runs.join(offsets, "part").select("doc_id", (F.col("part_start") + F.col("ahead")).alias("at"), "n", "ids")

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            row = []
            for k, (at, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                codes = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    row.append(k)
                    for column, value in zip(out, (start, size, zlib.crc32(codes[4 * start : 4 * (start + size)]), n, sequence, offset), strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = dict(runs.dtypes)["doc_id"]
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
