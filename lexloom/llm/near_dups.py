"""Near duplicates by HyperMinHash.

A document is the set of its distinct k-word shingles. Its sketch has one 16-bit register for each of 128 buckets: the
smallest hash of the bucket as leading-zero count (6 bits) and mantissa (10 bits); empty buckets borrow from a bucket
that their own permutation names. Documents of equal sets form one class. The compressed registers are banded, four to a
band: at a similarity of 0.8 a pair misses all 32 bands with probability 5e-8.

A bucket of a band never gives its pairs as rows. Each bucket names its hub, the member that shares most buckets with
others (the centre of a group of copies has the most), and buckets of one hub form one cell: a class goes to some two
cells, whatever the number of its buckets. In a cell everything is judged at once, in memory: the collision-corrected
Jaccard estimate of the registers says who has a likely partner (0.6 and more, over five standard deviations under 0.8; a
small set's registers are borrowed from a few values, so its pairs go without the estimate), and these are verified on
full sets, all intersections of the cell by matrix products over its common shingles. A cell gives a tree of links, not
its pairs. Trees are united to components.

A cell that is larger than a block is dealt into parts, the hub in each: so its copies collapse in one round, every member
met once. Only then, and only where a cell still lies in several components, members outside of its largest component
meet all others, in blocks. Rows are in proportion to the members, and to (members x members outside) / block in that
second round.

Defined cases: a text that is null or has no words has an empty set, links with nothing and is kept; rows that repeat a
key are judged one by one, each by its own text; a row without a key has no component and is kept; an empty table gives
no rows; a very long text is hashed in pieces, and its set (8 bytes a shingle) is held by one task at a time; other
columns pass, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
ESTIMATE = 0.6
#: Shingles from which on a set's estimate decides.
SMALL = 128
#: Members, and shingles of all of them, that meet in one block.
BLOCK, HELD = 1024, 1 << 21
#: Columns of a matrix product, and pairs counted at once.
STRIP, CODES = 4096, 1 << 22
#: Rows up to which the table of wanted texts is broadcast (about 100 bytes each); beyond that the texts are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Edges that one task unites at most (about 200 bytes each).
UNITED = 500_000
_TOP = np.uint64(57)
_LOW = np.uint64((1 << 57) - 1)
_PROBES = np.argsort(np.random.default_rng(77).random((REGISTERS, REGISTERS)), axis=1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of hashes."""
    bins, first = np.unique(shingles >> _TOP, return_index=True)
    value = shingles[first] & _LOW
    _, bits = np.frexp(value.astype(np.float64))
    shift = bits.astype(np.int64) - 11
    mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64(1023)
    out = np.zeros(REGISTERS, np.uint16)
    bins = bins.astype(np.int64)
    out[bins] = ((57 - bits.astype(np.int64)) << 10) | mantissa.astype(np.int64)
    filled = np.zeros(REGISTERS, bool)
    filled[bins] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), np.argmax(filled[probes], axis=1)]]
    return out


def shingle_sets(column, k: int):
    """(row, sorted distinct shingle hashes) of each text that has words."""
    for start, end, data, bounds in common.text_chunks(column):
        hashes, first = common.word_hashes(data, bounds)
        for i in range(end - start):
            own = hashes[first[i] : first[i + 1]]
            if len(own):
                yield start + i, np.unique(common.grams(own, min(k, len(own))))


def chance_collision(n: int, m: int) -> float:
    """How often registers of two disjoint sets agree, for sets of n and m shingles.

    A bucket's smallest hashes agree in leading zeros and mantissa by chance: the sum over all register values of the
    product of both sets' probabilities of that value.
    """
    a, b = max(n / REGISTERS, 1e-9), max(m / REGISTERS, 1e-9)
    zeros = np.arange(0, 58)
    low, width = 2.0 ** -(zeros + 1.0), 2.0 ** -(zeros + 1.0) / 1024
    steps = low[:, None] + width[:, None] * np.arange(0, 1024, 16)
    wide = width[:, None] * 16
    p = lambda s: np.exp(-s * steps) - np.exp(-s * (steps + wide))
    return float((p(a) * p(b)).sum() / 16)


def name_of(shingles: np.ndarray) -> bytes:
    """The name of the class of all documents with this set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int, text: str, key: str) -> DataFrame:
    """(key, n, hash of the set, registers); the last two are null for an empty set."""

    def sketch(batches):
        for batch in common.slices(batches):
            n, hashes, regs = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for row, own in shingle_sets(batch.column(1), k):
                n[row], hashes[row], regs[row] = len(own), name_of(own), registers(own).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(hashes, pa.binary()), pa.array(regs, pa.binary())], names=["key", "n", "hash", "regs"])

    part = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return part.mapInArrow(sketch, f"key {docs.schema[key].dataType.simpleString()}, n long, hash binary, regs binary")


def likely_members(sizes: np.ndarray, regs: np.ndarray, comps: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a cell have a partner of another component whose size and estimate allow the similarity."""
    order = np.argsort(sizes, kind="stable")
    n, regs, comps = sizes[order], regs[order], comps[order]
    last = np.searchsorted(n, n * 100 // percent, "right")  # partners of a larger set lie in a run
    out, known = np.zeros(len(n), bool), {}
    for i in range(len(n)):
        j = np.arange(i + 1, last[i])
        j = j[comps[j] != comps[i]]
        if not len(j):
            continue
        if n[i] >= SMALL:
            step = np.round(np.log2(n[j]), 1)
            chance = np.zeros(len(j))
            for s in np.unique(step):
                pair = round(float(np.log2(n[i])), 1), float(s)
                if pair not in known:
                    known[pair] = chance_collision(2 ** pair[0], 2 ** pair[1])
                chance[step == s] = known[pair]
            share = (regs[j] == regs[i]).mean(1)
            j = j[(share - chance) / (1 - chance) >= ESTIMATE]
        out[j] = True
        out[i] |= len(j) > 0
    found = np.zeros(len(n), bool)
    found[order] = out
    return found


def estimated(cells: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows (hub, x, y, node, comp) of the members that have a likely partner in their cell."""
    rows = cells.join(classes.select(F.col("hash").alias("node"), "n", "regs"), "node").select("hub", "x", "y", "node", "comp", "n", "regs")

    def estimate(batches):
        for table in common.whole_groups(batches, 3):
            table, start = table.combine_chunks(), common.group_starts(table, 3)
            sizes = table.column("n").to_numpy()
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            comps = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
            keep = np.concatenate([likely_members(sizes[a:b], regs[a:b], comps[a:b], percent) for a, b in zip(start[:-1], start[1:], strict=True)])
            yield from table.select(["hub", "x", "y", "node"]).filter(pa.array(keep)).to_batches()

    return rows.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y").mapInArrow(estimate, "hub binary, x long, y long, node binary")


def intersections(owns: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of some sorted sets: [i, j] for i < j."""
    m = len(owns)
    flat, who = np.concatenate(owns), np.repeat(np.arange(m), [len(x) for x in owns])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    many = np.diff(np.append(head, len(flat)))
    out = np.zeros((m, m), np.int32)
    wide = np.flatnonzero(many >= max(2, m // 16))
    for s in range(0, len(wide), STRIP):  # shingles of many members: a matrix product
        at, size = head[wide[s : s + STRIP]], many[wide[s : s + STRIP]]
        column = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size) + at[column]
        part = np.zeros((m, len(at)), np.float32)
        part[who[place], column] = 1
        out += (part @ part.T).astype(np.int32)
    for size in np.unique(many[(many > 1) & (many < max(2, m // 16))]):  # of a few: their pairs
        i, j = np.triu_indices(size, 1)
        at = head[many == size]
        step = max(1, CODES // len(i))
        for s in range(0, len(at), step):
            group = who[at[s : s + step, None] + np.arange(size)]
            code, times = np.unique(group[:, i] * m + group[:, j], return_counts=True)
            out.ravel()[code] += times.astype(np.int32)
    return out


def linked(owns: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of some sets the first one of its component, by links of 100 * intersection >= percent * union."""
    m, both = len(owns), intersections(owns).astype(np.int64)
    n = np.array([len(x) for x in owns], np.int64)
    link = np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1)
    link |= link.T
    label = np.arange(m)
    while True:
        near = np.minimum(label, np.where(link, label[None, :], m).min(1))
        new = label.copy()
        np.minimum.at(new, label, near)  # a root hooks to the least neighbour of its tree
        new = np.minimum(new, near)
        while (up := new[new]).tolist() != new.tolist():
            new = up
        if (new == label).all():
            return label
        label = new


def verified(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, text: str, key: str) -> DataFrame:
    """(a, b): links between the members of each cell (hub, x, y, node), as a forest, by full sets of whole texts."""
    wanted = common.written(wanted, "wanted")
    lists = wanted.groupBy("node").agg(F.collect_list(F.struct("hub", "x", "y")).alias("cells"))  # one class's own cells
    named = common.written(lists.join(classes.select(F.col("hash").alias("node"), "key"), "node"), "named")
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(named) if few else named, "key")

    def sets(batches):
        seen = set()  # rows that repeat a key and a text
        for batch in common.slices(batches, 256):
            names, out = batch.column(0).to_pylist(), {}
            for row, own in shingle_sets(batch.column(1), k):
                if names[row] not in seen and name_of(own) == names[row]:  # rows that share a key may have other texts
                    seen.add(names[row])
                    out[row] = own.tobytes()
            if out:
                rows = pa.array(list(out))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(list(out.values()), pa.binary())], names=["node", "cells", "own"])

    def judge(table: pa.Table) -> pa.Table:
        nodes = table.column("node").combine_chunks()
        label = linked([np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()], percent)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.Table.from_arrays([nodes.take(pa.array(tied)), nodes.take(pa.array(label[tied]))], names=["a", "b"])

    rows = texts.select("node", "text", "cells").mapInArrow(sets, "node binary, cells array<struct<hub:binary,x:long,y:long>>, own binary")
    dealt = rows.select("node", "own", F.explode("cells").alias("cell")).select("cell.*", "node", "own")
    return dealt.groupBy("hub", "x", "y").applyInArrow(judge, "a binary, b binary").where("a <> b")


def _united(batches):
    """Union-find over all edges of one task; a root is the smallest of its nodes."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        kind = batch.schema.types[0]
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of (a, b), comp being the smallest node. A bounded number of edges is united in one task;
    more are contracted in rounds, each label hooking to a neighbour of smaller random rank."""
    kind = edges.schema["a"].dataType.simpleString()
    edges = common.written(edges, "edges")
    if edges.count() <= UNITED:
        return edges.coalesce(1).mapInArrow(_united, f"node {kind}, comp {kind}")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c)  # noqa: B023, E731
        down = edges.select(F.when(rank("a") > rank("b"), F.col("a")).otherwise(F.col("b")).alias("label"), F.when(rank("a") > rank("b"), F.col("b")).otherwise(F.col("a")).alias("to"))
        hook = common.written(down.groupBy("label").agg(F.min_by("to", rank("to")).alias("to")), "hooks")
        moved = lambda df, c: df.join(hook.select(F.col("label").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        labels = common.written(moved(labels, "label"), "labels")
        edges = common.written(moved(moved(edges, "a"), "b").where("a <> b").select("a", "b").distinct(), "edges")
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("comp"))
    return labels.join(least, "label").select("node", F.col("comp").cast(kind).alias("comp"))


def blocks(members, shingles):
    """The number of blocks for so many members with so many shingles."""
    return F.ceil(F.greatest(F.coalesce(members, F.lit(0)) / BLOCK, F.coalesce(shingles, F.lit(0)) / HELD)).cast("long")


def cells_of(classes: DataFrame) -> DataFrame:
    """(hub, node, n): the classes that share a bucket with each hub, the hub itself among them."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * 2 * ROWS + 1, F.lit(2 * ROWS))))
    banded = classes.select(F.col("hash").alias("node"), "n", F.explode(bands).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = common.written(banded.join(shared, "bucket"), "members")
    degree = members.groupBy("node").agg(F.sum("m").alias("degree"))
    ranked = members.select("bucket", "node").join(degree, "node")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", F.xxhash64("node").alias("lot"), "node")).alias("hub")).select("bucket", F.col("hub.node").alias("hub"))
    return members.join(hubs, "bucket").select("hub", "node", "n").distinct()


def first_round(cells: DataFrame, large: DataFrame) -> DataFrame:
    """(hub, x, y, node, comp): each cell as one block, or as parts that all have the hub; each node is a component."""
    parts = cells.join(large, "hub", "left")
    own = F.array(F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1).cast("long"))))
    every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0).cast("long")))
    return parts.select("hub", F.explode(F.when(F.col("hub") == F.col("node"), every).otherwise(own)).alias("x"), F.lit(0).cast("long").alias("y"), "node", F.col("node").alias("comp"))


def second_round(cells: DataFrame, large: DataFrame, comps: DataFrame) -> DataFrame:
    """(hub, x, y, node, comp): of the large cells that lie in several components, the blocks outside of the largest one
    (x, and y where it is one of them) against each other and against its blocks (y from the number of the others on)."""
    placed = cells.join(large.select("hub"), "hub").join(comps, "node", "left").select("hub", "node", "n", F.coalesce("comp", "node").alias("comp"))
    placed = common.written(placed, "placed")
    sums = placed.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    most = sums.groupBy("hub").agg(F.max(F.struct("m", "comp", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s")).where("m > top.m")
    most = most.select("hub", F.col("top.comp").alias("major"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("others"), blocks(F.col("top.m"), F.col("top.s")).alias("majors"))
    dealt = placed.join(common.written(most, "most"), "hub").withColumn("inside", F.col("comp") == F.col("major"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("majors")).otherwise(F.col("others")))
    to = lambda a, b: F.sequence(a.cast("long"), b.cast("long"))
    zero, last = F.lit(0), F.col("others") + F.col("majors") - 1
    inside = F.transform(to(zero, F.col("others") - 1), lambda x: F.struct(x.alias("x"), (F.col("block") + F.col("others")).alias("y")))
    before = F.transform(to(zero, F.col("block")), lambda x: F.struct(x.alias("x"), F.col("block").alias("y")))
    after = F.transform(to(F.col("block") + 1, last), lambda y: F.struct(F.col("block").alias("x"), y.alias("y")))
    cell = F.explode(F.when(F.col("inside"), inside).otherwise(F.concat(before, after)))
    return dealt.withColumn("block", block).select("hub", cell.alias("c"), "node", "comp").select("hub", "c.x", "c.y", "node", "comp")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: key, n_shingles, component_id (the smallest key reachable over links), kept."""
    sketched = common.written(sketches(docs, k, text, key), "sketches")
    full = sketched.where("n > 0 and key is not null")
    classes = common.written(full.groupBy("hash").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("regs").alias("regs")), "classes")
    cells = common.written(cells_of(classes), "cells")
    sizes = cells.groupBy("hub").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("parts")).where("parts > 1")
    large = common.written(sizes, "large")
    judged = lambda part: common.written(verified(estimated(part, classes, percent), classes, docs, k, percent, text, key), "links")
    links = judged(first_round(cells, large))
    comps = common.written(components(links), "comps")
    if not large.isEmpty():
        more = judged(second_round(cells, large, comps))
        if not more.isEmpty():
            comps = common.written(components(links.unionByName(more)), "comps")
    named = classes.select(F.col("hash").alias("node"), "key").join(comps, "node").select("node", "key", "comp")
    least = named.groupBy("comp").agg(F.min("key").alias("least"))
    reached = classes.select("hash", F.col("key").alias("first")).join(named.join(least, "comp").select(F.col("node").alias("hash"), "least"), "hash", "left")
    # Many rows of one hash stream past a single row of its class.
    out = sketched.join(reached.select("hash", F.coalesce("least", "first").alias("comp")).hint("shuffle_hash"), "hash", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("comp", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without near duplicates: of each group the one of the smallest key stays, once."""
    judged = common.written(near_duplicates(docs, k, percent, text, key), "judged")
    gone = judged.where(~F.col("kept")).select(key).distinct()
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    repeats = judged.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    if repeats.isEmpty():
        return out
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(f"`{c}`") for c in docs.columns if c != key)))
    return out.withColumn("__rank", rank).where((F.col("__rank") == 1) | F.col(key).isNull()).drop("__rank")
