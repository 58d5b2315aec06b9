"""Best-fit packing planned on the histogram of lengths.

Every text is tokenized once; only (document, piece, start, length, CRC) rows go on. The plan is made on the histogram
alone, which has at most ``capacity`` rows: best-fit decreasing places counts of equal pieces into counts of equal
sequences at once, so planning costs the same for a thousand documents or a trillion. A piece then takes the planned slot
of its rank among the pieces of its length. A common length is ranked in several buckets whose offsets come from their
counts, so that no task ranks an unbounded group.

Tokens: whole texts, split at single spaces that stand between solid characters (the tokenizer never joins across these)
and looked up in a bounded cache of chunks; unknown chunks go through an engine that runs the vocabulary and merges of the
tokenizer's own file (the ids are the same); texts with other spacing or a special token are tokenized whole.

Defined cases: a null text is empty (its one id is the end id); repeated rows are packed as often as they occur; null
keys stay null; a very long text is tokenized by one task and cut into pieces; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import sys
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 0
#: Rows that one bucket ranks, as expected, and buckets of a length at most (their offsets are summed by one task).
RANKED, BUCKETS = 500, 4096
_CACHE_ENTRIES = 800_000
_tokenizers: dict[str, tuple] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranked_engine(path: str):
    """A tiktoken engine with the vocabulary of the tokenizer's file, if its merges are in the order of their ids (as
    byte-level BPE files have it); else None."""
    import tiktoken
    from public_tokenizers import PATTERN

    model = json.loads(Path(path).read_text())["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    vocab, merges = model["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    if sys.byteorder != "little" or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(decode[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class OddSpacing(Exception):
    """White space beside a space: the tokenizer's own rules are needed."""


class Chunks(dict):
    """Ids of chunks, made when first asked for."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise OddSpacing
        out = self[chunk] = self.encode(self.lead + chunk)
        return out


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = ranked_engine(path)
        # Chunks hold no special token, so the same vocabulary and merges may run in the quicker engine.
        encode = (lambda x: array("I", self.ranked.encode_ordinary(x)).tobytes()) if self.ranked else self.whole
        self.first, self.later = Chunks(encode, ""), Chunks(encode, " ")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:  # may begin a special token, which a split could cut in two
            return self.whole(text)
        if len(self.later) > _CACHE_ENTRIES:
            self.first.clear()
            self.later.clear()
        first, *rest = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.later.__getitem__, rest))
        except OddSpacing:
            return self.whole(text)


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces; only texts beyond the capacity are cut, and then the first piece may be shorter."""
    n = len(ids) // 4
    starts = [0] if n <= capacity else ([0] if n % capacity else []) + list(range(n % capacity, n, capacity))
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches):
        encode = encoder(path)
        for batch in common.slices(batches):
            keys, texts = batch.column(0), batch.column(1)
            out = [(j, k, *p) for j in range(batch.num_rows) for k, p in enumerate(cut(encode(texts[j].as_py() or "") + end, capacity))]
            rows = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[:, 0])), pa.array(rows[:, 1].astype(np.int32)), *(pa.array(rows[:, c]) for c in (2, 3, 4))], names=["key", "piece", "start", "length", "ids_crc32"])

    part = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return part.mapInArrow(tokenize, f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """Best-fit decreasing over counts. For each length, runs (first rank, first sequence, offset): the pieces of a run
    go to sequences one after another, all at the same offset.

    Open sequences are held as groups of equal room: (first sequence, how many, offset).
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    open_groups: dict[int, list[tuple[int, int, int]]] = {}
    rooms: list[int] = []  # sorted; each has groups
    sequences = 0

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room:
            if room not in open_groups:
                bisect.insort(rooms, room)
                open_groups[room] = []
            open_groups[room].append(group)

    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):  # the fullest sequences that still take it
                room = rooms[i]
                first, many, offset = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room], rooms[i]
            else:
                each = capacity // length
                room, offset, first = capacity, 0, sequences
                many = left // each if left >= each else 1
                sequences += many
            used = min(many, left)
            if used < many:
                put(room, (first + used, many - used, offset))
            runs.append((rank, first, offset))
            rank, left = rank + used, left - used
            put(room - length, (first, used, offset + length))
        out[length] = runs
    return out


def ranked(df: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank`` from 0 within each length. A length with many rows is ranked in buckets of about RANKED rows."""
    many = {k: min(BUCKETS, -(-n // RANKED)) for k, n in counts.items() if n > RANKED}
    spread = F.xxhash64("key", "piece", "serial")
    buckets = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in many.items() for x in kv)), F.col("length").cast("int")), F.lit(1)) if many else F.lit(1)
    df = df.withColumn("bucket", F.pmod(spread, buckets.cast("long")))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece", "serial")) - 1
    if not many:
        return df.withColumn("rank", rank.cast("long"))
    sizes = df.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("from"))
    return df.withColumn("own", rank).join(offsets, ["length", "bucket"]).withColumn("rank", (F.col("from") + F.col("own")).cast("long"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    cutted = common.written(pieces(docs, path or vocabulary_path(), capacity, text, key).withColumn("serial", F.monotonically_increasing_id()), "pieces")
    counts = {int(r[0]): r[1] for r in cutted.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in plan(counts, capacity).items()}
    shared = spark.sparkContext.broadcast(runs)  # bounded by the number of lengths and their splits, not by the documents

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    ranks, firsts, offsets = shared.value[int(length[rows[0]])]
                    at = np.searchsorted(ranks, rank[rows], "right") - 1
                    sequence[rows], offset[rows] = firsts[at] + rank[rows] - ranks[at], offsets[at]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    rows = ranked(cutted, counts).select("key", "piece", "start", "length", "ids_crc32", "rank")
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("key", key)
