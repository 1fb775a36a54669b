"""Best-fit packing of token sequences by length-histogram planning."""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import lean, stage
from .textblocks import flat

#: The id that ends each document.
END_ID = 0
#: Distinct words, and ids in all, that a worker remembers before it starts over.
CACHED_WORDS, CACHED_IDS = 500_000, 6_000_000
#: Pieces of one length that are ranked in one task, about.
RANK_ROWS = 500


#: Whole chunks, lower-cased, of printable ASCII and Latin letters (which no normal form changes), and their parts as the
#: tokenizer's own pattern splits them: contractions, letters, single digits, all else.
PLAIN = re.compile("[!-~\u00df-\u00f6\u00f8-\u024f]+").fullmatch
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+").findall


# The normaliser and splits for which chunks between white space, and PART within them, give the same ids
# as whole texts. Other tokenizers encode whole texts.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLITS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_chunk(tokenizer) -> bool:
    """Whether the tokenizer declares the normaliser and splits above, and its added tokens all start with <| and hold no
    white space."""
    said = [x and json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return said == [NORMALIZER, PRE_TOKENIZER] and all(t.startswith("<|") and not re.search(r"\s", t) for t in added)


def byte_symbols() -> list[str]:
    """How byte-level vocabularies write each byte: as the character of that number if it is visible in Latin-1, else
    by its turn as characters from 256 on."""
    turn = iter(range(256, 512))
    return [chr(i) if 33 <= i <= 126 or 161 <= i <= 255 and i != 173 else chr(next(turn)) for i in range(256)]


SHOWN = byte_symbols()


class WordEncoder(dict[bytes, int]):
    """Encodes white-space separated chunks one by one and remembers them. This equals encoding whole texts for a
    tokenizer that drops white space and whose normaliser and splits never look across it (by_chunk tells; for others
    whole texts are encoded). Plain chunks go to the tokenizer's model part by part, which is faster; others through the
    whole tokenizer."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.chunks = by_chunk(self.tokenizer)
        self.parts: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.clear()
        if len(self.parts) > CACHED_WORDS // 2:
            self.parts.clear()
        self.pool, self.starts, self.sizes = array("I"), array("q"), array("i")

    def _ids(self, chunk: str) -> bytes | None:
        """Ids (four bytes each) of a chunk that is plain after lower-casing, from those of its parts; None for others."""
        lower = chunk.lower()
        if not PLAIN(lower) or "<|" in chunk:
            return None
        out = []
        for part in PART(lower):
            found = self.parts.get(part)
            if found is None:
                shown = part if part.isascii() else "".join([SHOWN[x] for x in part.encode()])
                found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            out.append(found)
        return b"".join(out)

    def __missing__(self, chunk: bytes) -> int:
        """The place of a chunk that is not remembered yet: it is encoded now."""
        text = chunk.decode()
        ids = self._ids(text)
        if ids is None:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        slot = self[chunk] = len(self.starts)
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids) >> 2)
        self.pool.frombytes(ids)
        return slot

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, END_ID after each text, and how many each text has."""
        if not self.chunks:
            found = [np.array([*self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, END_ID], np.uint32) for t in texts]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        if len(self) > CACHED_WORDS or len(self.pool) > CACHED_IDS:
            self._clear()
        chunks: list[bytes] = []
        marks = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            chunks += t.split()
            marks[i] = len(chunks)
        at = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        pool, starts, sizes = np.frombuffer(self.pool, np.uint32), np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int32).astype(np.int64)
        n, begin = sizes[at], starts[at]
        ends = np.cumsum(n)
        counts = np.diff(np.concatenate([[0], ends])[marks], prepend=0) + 1
        out = np.full(int(counts.sum()), END_ID, np.uint32)
        if len(at) and ends[-1]:
            total = int(ends[-1])
            ids = pool[np.repeat(begin - (ends - n), n) + np.arange(total)]
            body = np.ones(len(out), bool)
            body[np.cumsum(counts) - 1] = False
            out[body] = ids
        return out, counts


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pieces(path: str, limit: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b, offsets = flat(batch.column("text"))
            raw = b.tobytes()
            ids, counts = encoder(path).encode([raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            first = np.cumsum(counts) - counts
            parts = -(-counts // limit)
            row = np.repeat(np.arange(len(counts)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * limit
            length = np.minimum(limit, counts[row] - start)
            at = first[row] + start
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def best_fit_plan(counts: dict[int, int], limit: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: rows (length, rank, n, sequence, each, offset) and the number of sequences.

    Pieces of a length with ranks from rank to rank + n - 1 go to sequences from sequence on, each of them to one,
    side by side from offset. Sequences of equal room stay together as ranges, so the plan has a few rows for each
    distinct length, however many pieces there are.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]  # ranges (first, n) of sequences by what room they have
    plan, opened = [], 0
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank, tight = counts[length], 0, length
        while left:
            while tight <= limit and not room[tight]:
                tight += 1
            if tight > limit:
                free, each = limit, limit // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                free, each = tight, tight // length
                first, n = room[tight].pop()
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            if full:
                plan.append((length, rank, full * each, first, each, limit - free))
                room[free - each * length].append((first, full))
            if rest:
                plan.append((length, rank + full * each, rest, first + full, rest, limit - free))
                room[free - rest * length].append((first + full, 1))
            if (untouched := n - full - bool(rest)) > 0:
                room[free].append((first + full + bool(rest), untouched))
            left -= full * each + rest
            rank += full * each + rest
    return plan, opened



def pack(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with with_ids).

    Whole texts become ids, then END_ID; only documents of more than limit ids are cut. The histogram of lengths
    (limit rows at most) comes to the driver, is planned there, and each piece takes the slot of its rank among
    the pieces of its length. Ranks are counted in hashed buckets first, so that no length meets in one task.

    Defined results: null text is an empty one, whose only id is END_ID; repeated rows are packed each; equal
    lengths rank by bucket, doc_id and piece; null doc_id is kept; an empty table gives an empty result; other
    columns are ignored. The plan has fewer than 4 * limit rows and is broadcast.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(_pieces(tokenizer_path, limit, with_ids)), schema), "pack-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = best_fit_plan(counts, limit)
    buckets = max(1, math.ceil(sum(counts.values()) / RANK_ROWS))
    pieces = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    base = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(F.col("length").alias("base_length"), F.col("bucket").alias("base_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("inside", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("base_length")) & (F.col("bucket") == F.col("base_bucket"))).withColumn("rank", F.col("before") + F.col("inside"))
    slots = spark.createDataFrame(plan, "plan_length long, plan_rank long, plan_n long, plan_sequence long, each long, plan_offset long")
    nth = F.col("rank") - F.col("plan_rank")
    packed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("plan_length")) & (nth >= 0) & (nth < F.col("plan_n")))
    sequence = (F.col("plan_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id")
    offset = (F.col("plan_offset") + nth % F.col("each") * F.col("length")).cast("long").alias("offset")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, offset, *(["ids"] if with_ids else []))
