"""Repeated passages by a sparse suffix array.

Of a text's suffixes (by words) only those at minimisers stay: the word positions whose 8-word hash is the smallest of some
43 in a row. Every run of 50 words belongs to the one position that is its own minimiser, and equal runs belong to the same
one. A run of 50 words spans at least 25 words to the right of its position or at least 26 to the left (and the position's
own 8), so it goes on only if that stretch occurs again anywhere. Within the positions of an equal stretch all their runs
of 50 words are grouped by hash, each by its own reach to the left and right; runs that occur again are merged into spans.

Two passes over the text. Positions travel as hashes; only those whose stretch repeats get the hashes of their runs. A
stretch that occurs very often is dealt into salted groups, each grouped in its own task as a stream with bounded memory; a
second round joins the salts: one row of each different run of each salt, and those that met no copy in theirs.

A span counts wherever its words occur again: in another document or elsewhere in its own. Words are compared as they are
written, whatever white space lies between them.

Defined cases: texts that are null or shorter than ``MIN_WORDS`` have no spans; rows that share a key are one document
(they are no copies of each other); rows without a key are left out; a very long text is hashed in pieces and held as 8
bytes a word; an empty table gives no spans; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS, K = 50, 8
WINDOW = MIN_WORDS - K + 1
RIGHT, LEFT = MIN_WORDS // 2, MIN_WORDS - MIN_WORDS // 2 + 1
#: Members of a group of equal stretches before it is salted.
GROUP = 4096
_BLOCK = 1 << 22
_INDEX = np.uint64((1 << 24) - 1)


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """For each run of ``MIN_WORDS`` words of a text, by its start, the position that is its minimiser."""
    out = []
    for start in range(0, max(1, len(hashes) - MIN_WORDS + 1), _BLOCK):
        g = common.grams(hashes[start : start + _BLOCK + MIN_WORDS - 1], K)
        if len(g) < WINDOW:
            continue
        low = (g & ~_INDEX) | np.arange(len(g), dtype=np.uint64)
        size = 1
        while size * 2 <= WINDOW:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < WINDOW:
            low = np.minimum(low[: len(low) - (WINDOW - size)], low[WINDOW - size :])
        out.append((low & _INDEX).astype(np.int64) + start)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def runs_of(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, side, first start, end) of the runs that share a minimiser and lean on its stretch to one side: right 0, left 1."""
    start = np.arange(len(low))
    side = (low - start >= LEFT).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (side[1:] != side[:-1])])) if len(low) else start
    return low[first], side[first], first, np.append(first[1:], len(low))[: len(first)]


def stretches(hashes: np.ndarray, at: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The hashes of the stretches to the right (side 0) or to the left (side 1) of kept positions."""
    out, right = np.zeros(len(at), np.uint64), side == 0
    out[right] = common.window_hashes(hashes, at[right], RIGHT)
    out[~right] = common.window_hashes(hashes, at[~right] - LEFT, LEFT + K) ^ np.uint64(0x5851F42D4C957F2D)
    return out.view(np.int64)


def positions(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(stretch, side, key, pos) of all kept positions of all texts."""

    def emit(batches):
        for batch in batches:
            keys = batch.column(0)
            rows, pos, side, value = [], [], [], []
            for start, end, data, bounds in common.text_chunks(batch.column(1)):
                hashes, first = common.word_hashes(data, bounds, lower=False)
                for i in np.flatnonzero(np.diff(first) >= MIN_WORDS):
                    own = hashes[first[i] : first[i + 1]]
                    p, s, _, _ = runs_of(minimisers(own))
                    rows.append(np.full(len(p), start + i))
                    pos.append(p)
                    side.append(s)
                    value.append(stretches(own, p, s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(value)), pa.array(np.concatenate(side)), keys.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(pos).astype(np.int32))], names=["stretch", "side", "key", "pos"])

    part = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return part.mapInArrow(emit, f"stretch long, side int, key {docs.schema[key].dataType.simpleString()}, pos int")


def contexts(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """(key, stretch, salt, salted, first, runs): for each wanted position the hashes of its runs, the first from ``first`` on."""
    lists = wanted.groupBy("key").agg(F.collect_set(F.struct("stretch", "salt", "salted", "side", "pos")).alias("at"))  # one document's own positions
    kind = docs.schema[key].dataType.simpleString()
    joined = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(lists, "key").select("key", "text", "at")

    def extract(batches):
        for batch in batches:
            at = batch.column(2)
            flat, offsets = at.flatten(), np.concatenate([[0], np.cumsum(np.array([len(x) for x in at]))])
            stretch, salt, salted, side, pos = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            for start, end, data, bounds in common.text_chunks(batch.column(1)):
                hashes, first = common.word_hashes(data, bounds, lower=False)
                who, rows, starts, runs = [], [], [], []
                for i in range(end - start):
                    own, a, b = hashes[first[i] : first[i + 1]], offsets[start + i], offsets[start + i + 1]
                    if len(own) < MIN_WORDS or a == b:
                        continue
                    p, s, begin, stop = runs_of(minimisers(own))
                    name = p * 2 + s  # in order: equal minimisers are neighbours, and the left runs' starts come first
                    order = np.argsort(name)
                    want = pos[a:b].astype(np.int64) * 2 + side[a:b]
                    found = order[np.minimum(np.searchsorted(name, want, sorter=order), len(name) - 1)]
                    ok = np.flatnonzero((name[found] == want) & (stretches(own, p, s)[found] == stretch[a:b]))  # a key that several rows share may name positions of another text
                    found = found[ok]
                    raw = common.window_hashes(own, np.arange(len(own) - MIN_WORDS + 1), MIN_WORDS).tobytes()
                    who.append(np.full(len(ok), start + i))
                    rows.append(a + ok)
                    starts.append(begin[found])
                    runs += [raw[8 * x : 8 * y] for x, y in zip(begin[found].tolist(), stop[found].tolist(), strict=True)]
                if runs:
                    rows = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(who))), pa.array(stretch[rows]), pa.array(salt[rows]), pa.array(salted[rows]), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(runs, pa.binary())], names=["key", "stretch", "salt", "salted", "first", "runs"])

    return joined.mapInArrow(extract, f"key {kind}, stretch long, salt int, salted boolean, first int, runs binary")


def matches(context: DataFrame) -> DataFrame:
    """(key, start, end, other, run, met): the parts of each position's runs that occur again in its group, and a document where.

    Of salted groups also one row for each different run (``run`` is its hash); ``met`` tells whether it met a copy there.
    """
    kind = context.schema["key"].dataType.simpleString()

    def walk(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 2 * GROUP:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            stretch, salt = table.column("stretch").to_numpy(), table.column("salt").to_numpy()
            change = np.flatnonzero((stretch[1:] != stretch[:-1]) | (salt[1:] != salt[:-1]))
            if len(change):  # whole groups only; the last one goes on
                yield from found(table.slice(0, change[-1] + 1))
                table = table.slice(change[-1] + 1)
            held, size = table.to_batches(), table.num_rows
        if size:
            yield from found(pa.Table.from_batches(held))

    def found(table: pa.Table):
        keys = pa.concat_arrays(table.column("key").chunks)
        code = keys.dictionary_encode().indices.to_numpy().astype(np.int64)
        pieces = table.column("runs").to_pylist()
        first, salted = table.column("first").to_numpy(), table.column("salted").to_numpy()
        run = np.frombuffer(b"".join(pieces), np.uint64)
        many = np.array([len(x) // 8 for x in pieces])
        row = np.repeat(np.arange(len(many)), many)
        start = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + first[row]
        place = (code[row] << 32) | start
        order = np.lexsort((place, run))
        ranked, there = run[order], place[order]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        tail = np.append(head[1:], len(ranked)) - 1
        group = np.repeat(np.arange(len(head)), tail - head + 1)
        again = there[head] != there[tail]
        # The partner: the first of the group, for the first itself the last; a document other than its own, if an end is one.
        lowest, highest = head[group], tail[group]
        partner = np.where(there[lowest] >> 32 == there >> 32, highest, lowest)
        hit, other = np.zeros(len(run), bool), np.zeros(len(run), np.int64)
        hit[order], other[order] = again[group], row[order][partner]
        # Neighbouring runs of a row with the same partner are one stretch of words.
        fresh = np.ones(len(run), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (hit[1:] != hit[:-1]) | (code[other[1:]] != code[other[:-1]])
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(run)) - 1
        begin, last = begin[hit[begin]], last[hit[begin]]
        if len(begin):
            none = len(begin)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[begin])), pa.array(start[begin].astype(np.int64)), pa.array(start[last].astype(np.int64) + MIN_WORDS), keys.take(pa.array(other[begin])), pa.nulls(none, pa.int64()), pa.nulls(none, pa.bool_())], names=names)
        one = order[head]
        kept = salted[row[one]]
        if kept.any():
            one, met = one[kept], again[kept]
            at = start[one].astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[one])), pa.array(at), pa.array(at + MIN_WORDS), pa.nulls(len(one), keys.type), pa.array(run[one].view(np.int64)), pa.array(met)], names=names)

    names = ["key", "start", "end", "other", "run", "met"]
    dealt = context.repartition("stretch", "salt").sortWithinPartitions("stretch", "salt")
    return dealt.mapInArrow(walk, f"key {kind}, start long, end long, other {kind}, run long, met boolean")


def across_salts(single: DataFrame) -> DataFrame:
    """(key, start, end, other) of the runs that met no copy in their own salt, but meet one in another."""
    same = Window.partitionBy("run")
    place = F.struct("key", "start")
    ends = single.withColumn("low", F.min(place).over(same)).withColumn("high", F.max(place).over(same))
    other = F.when(F.col("low.key") == F.col("key"), F.col("high.key")).otherwise(F.col("low.key"))
    return ends.where("not met and low <> high").select("key", "start", "end", other.alias("other"))


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start_word, end_word, n_words, other_<key>): the spans of each document that occur again, merged; ends exclusive."""
    kept = common.written(positions(docs, text, key), "suffixes")
    again = kept.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = again.select("stretch", F.ceil(F.col("n") / GROUP).cast("long").alias("salts"))
    salt = F.pmod(F.xxhash64("key", "pos"), F.col("salts")).cast("int")
    wanted = kept.join(groups, "stretch").select("stretch", salt.alias("salt"), (F.col("salts") > 1).alias("salted"), "side", "key", "pos")  # no sort or sum above this join: a common stretch's rows may be split
    rows = common.written(matches(contexts(docs, wanted, text, key)), "matches")
    found = rows.where("met is null").select("key", "start", "end", "other").unionByName(across_salts(rows.where("met is not null")))
    own = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("key", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.max_by("other", F.struct(F.col("end") - F.col("start"), "other")).alias("other"))
    return spans.select(F.col("key").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("other").alias(f"other_{key}"))


def cut_spans(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with the words of their spans taken out (with the white space that follows); others unchanged."""
    lists = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__spans"))
    joined, columns = docs.join(lists, key, "left"), list(docs.columns)

    def rewrite(batches):
        for batch in batches:
            names = batch.schema.names
            column, spans = batch.column(names.index(text)), batch.column(names.index("__spans")).to_pylist()
            out = column.to_pylist()
            for start, end, data, bounds in common.text_chunks(column):
                _, first, begin, _ = common.word_parts(data, bounds)
                for i in range(end - start):
                    if spans[start + i]:
                        at = np.append(begin[first[i] : first[i + 1]], bounds[i + 1])
                        raw, kept, last = data.tobytes(), [], bounds[i]
                        for span in spans[start + i]:
                            kept.append(raw[last : at[span["start_word"]]])
                            last = at[min(span["end_word"], len(at) - 1)]
                        out[start + i] = b"".join([*kept, raw[last : bounds[i + 1]]]).decode("utf-8", "replace")
            fixed = batch.set_column(names.index(text), batch.schema.field(names.index(text)), pa.array(out, batch.schema.field(names.index(text)).type))
            yield fixed.select(columns)

    return joined.mapInArrow(rewrite, docs.schema)
