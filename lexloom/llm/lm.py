"""Language-model scores: a gated recurrent network in numpy with a class-factored softmax, beside a smoothed unigram base.

Vocabulary: Spark counts every token of the training documents (those whose crc32 of the key, as text, is not 0 modulo 10).
The 1,024 most frequent words form 32 classes by rank; every other word belongs to one of 48 classes that its last two
bytes name. The network reads the previous token (a frequent word, or a class), and predicts the next token's class and,
in the frequent classes, the word within it, both by softmax from its state; within the other classes a word has its
smoothed share of the class, with room for words never seen, so the probabilities of all tokens sum to one.

Training: every training document is read once, in rounds and streams that a hash of its key and text deals out and orders,
so the weights do not depend on how the table is partitioned; in a round each stream starts from the same weights, runs
truncated backpropagation over windows of 16 tokens in up to 128 lanes (the state goes on from window to window), and the
streams' weights are averaged by their tokens. The output layer starts at the logarithms of the counted shares, so an
untrained network equals the class-wise unigram.

Scoring: documents lie in lanes; the state is carried over the windows of a document to its end. The counts of the most
frequent words (a bounded table) are broadcast; the rarer tokens of all documents join the vocabulary by shuffle.

Defined cases: a null or empty text is the end token alone; a null key counts as empty text for the split; repeated rows
are scored each, and learned from in one stream; an empty table gives no rows; a very long text is one lane; with no training tokens the base is uniform over the one unknown word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SMOOTH = 0.1
WIDE, DEEP = 32, 32  # frequent classes, words in each
SHORT = WIDE * DEEP
TAIL = 48
CLASSES = WIDE + TAIL
HIDDEN = 16
STEPS, LANES, SCORE_LANES, SCORE_ROWS = 16, 128, 1024, 4096
#: Output weights stay within this, so that no logit overflows.
BOUND = 4.0
ROUNDS, RATE = 3, 0.08
#: Tokens of a stream in a round, about; rows that a stream trains on at once.
STREAM, SLICE = 1 << 20, 2000
#: Words whose counts are broadcast at most (16 bytes each).
HEAD = 400_000
END = np.uint64(0xE7D1E7D1E7D1E7D1)
TAIL_SALT = np.uint64(0x2545F4914F6CDD1D)


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens one after another, each text closed by END: hashes, tail classes, and the texts' bounds."""
    hashes, kinds, sizes = [], [], []
    for start, end, data, bounds in common.text_chunks(column):
        h, first, begin, stop = common.word_parts(data, bounds)
        last = common._LOWER[data[stop - 1]].astype(np.uint64) if len(stop) else np.zeros(0, np.uint64)
        before = np.where(stop - begin > 1, common._LOWER[data[np.maximum(stop - 2, 0)]], 0).astype(np.uint64) if len(stop) else np.zeros(0, np.uint64)
        kind = (common.mix(last * TAIL_SALT + before) % np.uint64(TAIL)).astype(np.int16)
        hashes.append(np.insert(h, first[1:], END))
        kinds.append(np.insert(kind, first[1:], np.int16(0)))
        sizes.append(np.diff(first) + 1)
    if not sizes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(kinds), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def in_training(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 != 0


def vocabulary(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(h, kind, n): every token of the training documents, summed in each task first."""

    def count(batches):
        h, k, n = np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.int64)
        ahead = []  # summed pieces, merged some at a time

        def merged(parts):
            hh, kk, nn = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hh)
            hh = hh[order]
            first = np.flatnonzero(np.r_[True, hh[1:] != hh[:-1]][: len(hh)])
            return (hh[first], np.minimum.reduceat(kk[order], first), np.add.reduceat(nn[order], first)) if len(hh) else (hh, kk, nn)

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                hh, kk, _ = tokens(batch.column(0).slice(at, 2000))
                ahead.append(merged([(hh, kk, np.ones(len(hh), np.int64))]))
                if sum(len(x[0]) for x in ahead) > 300_000:
                    (h, k, n), ahead = merged([(h, k, n), *ahead]), []
                if len(h) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(n)], names=["h", "kind", "n"])
                    h, k, n = h[:0], k[:0], n[:0]
        h, k, n = merged([(h, k, n), *ahead])
        for at in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in (h.view(np.int64), k, n)], names=["h", "kind", "n"])

    part = docs.where(in_training(key)).select(F.col(text).cast("string").alias("text"))
    return part.mapInArrow(count, "h long, kind short, n long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What all tasks know: totals, the frequent words' counts (sorted by hash), the short list, the tail classes' shares."""

    total: int
    distinct: int
    hashes: np.ndarray  # of the head, sorted
    counts: np.ndarray
    slots: np.ndarray  # place in the short list, or -1
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    short_counts: np.ndarray = field(default_factory=lambda: np.zeros(SHORT))
    _starts: tuple[np.uint64, np.ndarray, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_starts": None}

    def starts(self) -> tuple[np.uint64, np.ndarray, int]:
        """(shift, first place of each bucket of leading bits, most words in a bucket); two buckets a word or so."""
        if self._starts is None:
            bits = min(20, len(self.hashes).bit_length())
            shift = np.uint64(64 - bits)
            starts = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32)
            self._starts = shift, starts, int(np.diff(starts, append=len(self.hashes)).max())
        return self._starts

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, slot) of tokens; count -1 where the token is not in the head."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        shift, starts, most = self.starts()
        last = len(self.hashes) - 1
        at = np.minimum(starts[(h >> shift).view(np.int64)], last)
        hit = self.hashes[at] == h
        left = np.flatnonzero(~hit) if most > 1 else np.zeros(0, np.int64)
        for _ in range(1, most):  # the further words of a bucket
            left = left[self.hashes[at[left]] < h[left]]
            at[left] = np.minimum(at[left] + 1, last)
            found = self.hashes[at[left]] == h[left]
            hit[left[found]] = True
            left = left[~found]
        return np.where(hit, self.counts[at], -1), np.where(hit, self.slots[at], -1)


def lexicon(vocab: DataFrame) -> Lexicon:
    """Bounded parts of the vocabulary: the head by the lowest count bin that keeps it within HEAD words."""
    total, distinct = vocab.agg(F.sum("n"), F.count(F.lit(1))).first()
    bins = vocab.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("bin")).collect()  # a few hundred
    taken, lowest = 0, None
    for b, words in bins:
        if taken + words > HEAD:
            break
        taken, lowest = taken + words, b
    head = vocab.where(F.floor(F.log2("n") * 8) >= (lowest if lowest is not None else 1 << 20)).toPandas()
    head["h"] = head["h"].to_numpy().view(np.uint64)
    head = head.sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    slots = np.full(len(head), -1, np.int64)
    slots[: min(SHORT, len(head))] = np.arange(min(SHORT, len(head)))
    short = np.zeros(SHORT)
    short[: min(SHORT, len(head))] = head["n"][:SHORT]
    sums = vocab.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    tail_tokens, tail_types = np.zeros(TAIL), np.zeros(TAIL)
    for r in sums:
        tail_tokens[r["kind"]], tail_types[r["kind"]] = r["n"], r["types"]
    first = head[:SHORT]
    tail_tokens -= np.bincount(first["kind"], first["n"], TAIL)
    tail_types -= np.bincount(first["kind"], minlength=TAIL)
    order = np.argsort(head["h"].to_numpy())
    return Lexicon(int(total or 0), int(distinct), head["h"].to_numpy()[order], head["n"].to_numpy()[order], slots[order], tail_tokens, tail_types, short)


class Network:
    """Weights: ``g`` input rows for the three gates (short words, tail classes, start), ``u`` recurrent, ``wc, bc`` classes, ``ww, bw`` words in frequent classes."""

    NAMES = ("g", "u", "wc", "bc", "ww", "bw")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def fresh(cls, lex: Lexicon) -> Network:
        rng = np.random.default_rng(5)
        short = lex.short_counts.reshape(WIDE, DEEP) + SMOOTH
        mass = np.concatenate([short.sum(1), lex.tail_tokens + SMOOTH * (lex.tail_types + 1)])
        return cls({"g": rng.normal(0, 0.3, (SHORT + TAIL + 1, 3 * HIDDEN)), "u": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), "wc": rng.normal(0, 0.02, (HIDDEN, CLASSES)), "bc": np.log(mass / mass.sum()), "ww": rng.normal(0, 0.02, (WIDE, HIDDEN, DEEP)), "bw": np.log(short / short.sum(1, keepdims=True))})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.NAMES]).astype(np.float64)

    def like(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k in self.NAMES:
            out[k] = flat[at : at + self.w[k].size].reshape(self.w[k].shape)
            at += self.w[k].size
        return Network(out)

    def run(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        """States after each of some steps: x and reset are (steps, lanes); and what backpropagation needs, if kept: the
        states before, both gates, the candidates and their recurrent part."""
        half = np.r_[np.full(2 * HIDDEN, 0.5, np.float32), np.ones(HIDDEN, np.float32)]  # a gate is tanh of half its sum
        u, begins = self.w["u"] * half, reset.any(1)
        kept = tuple(np.empty((*x.shape, k * HIDDEN), np.float32) for k in (1, 2, 1, 1)) if keep else ()
        states = np.empty((*x.shape, HIDDEN), np.float32)
        g = self.w["g"] * half
        b, zr, n = (np.empty((x.shape[1], k * HIDDEN), np.float32) for k in (3, 2, 1))
        for t in range(len(x)):
            if begins[t]:
                h = np.where(reset[t][:, None], np.float32(0), h)
            a = g.take(x[t], 0)
            np.matmul(h, u, out=b)
            if keep:
                kept[0][t], kept[3][t] = h, b[:, 2 * HIDDEN :]
                zr, n = kept[1][t], kept[2][t]
            np.add(a[:, : 2 * HIDDEN], b[:, : 2 * HIDDEN], out=zr)
            np.tanh(zr, out=zr)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            np.multiply(zr[:, HIDDEN:], b[:, 2 * HIDDEN :], out=n)
            n += a[:, 2 * HIDDEN :]
            np.tanh(n, out=n)
            own = states[t]
            np.subtract(h, n, out=own)
            own *= zr[:, :HIDDEN]
            own += n
            h = own
        return states, kept

    def output(self, s: np.ndarray, kind: np.ndarray, word: np.ndarray, grad: bool = False):
        """Natural log probabilities of classes (and, in frequent classes, words) at states; with gradients of their negative sum."""
        w, m = self.w, len(s)
        s = np.concatenate([s, np.ones((m, 1), np.float32)], axis=1)  # the last input's weights are the biases
        logits = np.concatenate([w["wc"], w["bc"][None]]).T @ s.T  # a class a line, so that what is done to all tokens runs along them
        at = kind * np.int64(m) + np.arange(m)
        flat = logits.reshape(-1)
        chosen = flat[at]
        np.exp(logits, out=logits)
        total = np.ones(CLASSES, np.float32) @ logits
        p = chosen - np.log(total)
        # Rows of one frequent class lie together, so each class is one product and all else is done at once.
        order = np.argsort(kind.astype(np.int8), kind="stable")  # by radix, as all sorts of so short integers
        edges = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=CLASSES)[:WIDE])])
        rows = order[: edges[-1]]
        own, i = s.take(rows, 0), np.arange(0, len(rows) * DEEP, DEEP) + word[rows]
        runs = [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if a < b]
        inner, ww = np.empty((len(rows), DEEP), np.float32), np.concatenate([w["ww"], w["bw"][:, None]], axis=1)
        for c, a, b in runs:
            np.matmul(own[a:b], ww[c], out=inner[a:b])
        words = inner.reshape(-1)
        chosen = words[i]
        np.exp(inner, out=inner)
        inner_total = inner @ np.ones((DEEP, 1), np.float32)
        p[rows] += chosen - np.log(inner_total[:, 0])
        if not grad:
            return p
        logits /= total
        flat[at] -= 1
        inner /= inner_total
        words[i] -= 1
        ds, back = logits.T @ w["wc"].T, np.empty((len(rows), HIDDEN), np.float32)
        of_classes, of_words = s.T @ logits.T, np.zeros_like(ww)
        for c, a, b in runs:
            np.matmul(own[a:b].T, inner[a:b], out=of_words[c])
            np.matmul(inner[a:b], w["ww"][c].T, out=back[a:b])
        ds[rows] += back
        return p, {"wc": of_classes[:-1], "bc": of_classes[-1], "ww": of_words[:, :-1], "bw": of_words[:, -1]}, ds

    def back(self, x: np.ndarray, reset: np.ndarray, kept: tuple, ds: np.ndarray) -> dict[str, np.ndarray]:
        h, zr, n, inner = kept
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        to_n, to_z, to_r = 1 - n * n, h - n, inner * r
        to_n *= 1 - z
        to_z *= z * (1 - z)
        to_r *= 1 - r
        back, begins = np.ascontiguousarray(self.w["u"].T), reset.any(1)
        db, dn = np.empty((*x.shape, 3 * HIDDEN), np.float32), np.empty((*x.shape, HIDDEN), np.float32)
        dh = np.zeros_like(ds[0])
        for t in range(len(x) - 1, -1, -1):
            dh += ds[t]
            np.multiply(dh, to_n[t], out=dn[t])
            np.multiply(dh, to_z[t], out=db[t, :, :HIDDEN])
            np.multiply(dn[t], to_r[t], out=db[t, :, HIDDEN : 2 * HIDDEN])
            np.multiply(dn[t], r[t], out=db[t, :, 2 * HIDDEN :])
            dh *= z[t]
            dh += db[t] @ back
            if begins[t]:
                dh[reset[t]] = 0
        du = h.reshape(-1, HIDDEN).T @ db.reshape(-1, 3 * HIDDEN)
        db[..., 2 * HIDDEN :] = dn
        ids = x.ravel().astype(np.int16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return {"u": du, "rows": ids[first], "g": np.add.reduceat(db.reshape(-1, 3 * HIDDEN).take(order, 0), first, axis=0)}


def coded(lex: Lexicon, h: np.ndarray, kind: np.ndarray, bounds: np.ndarray):
    """For the tokens of some texts: count, input id of the token before, class, word in class, whether a text begins."""
    count, slot = lex.lookup(h)
    own = np.where(slot >= 0, slot, SHORT + kind).astype(np.int32)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    begins = np.zeros(len(h), bool)
    begins[bounds[:-1]] = True
    before[begins] = SHORT + TAIL
    return count, before, np.where(slot >= 0, slot // DEEP, WIDE + kind).astype(np.int32), np.where(slot >= 0, slot % DEEP, 0).astype(np.int32), begins


def train_task(start: Network, lex: Lexicon, columns):
    """One task's share of a round; returns its network and tokens."""
    net = Network({k: v.copy() for k, v in start.w.items()})
    # All weights but the input rows lie in one vector, bounded ones first, and take a step at once.
    names = ("wc", "ww", "bc", "bw", "u")
    dense = np.concatenate([net.w[k].ravel() for k in names])
    bounded = net.w["wc"].size + net.w["ww"].size
    ends = np.cumsum([net.w[k].size for k in names])
    net.w |= {k: dense[end - net.w[k].size : end].reshape(net.w[k].shape) for k, end in zip(names, ends, strict=True)}
    sums, row_sums = np.full_like(dense, 1e-2), np.full_like(net.w["g"], 1e-2)
    seen = 0
    for column in columns:
        _, before, kind, word, begins = coded(lex, *(x := tokens(column))[:2], x[2])
        if not len(before):
            continue
        seen += len(before)
        lanes = max(1, min(LANES, len(before) // (4 * STEPS)))
        length = -(-len(before) // lanes)
        pad = lanes * length - len(before)  # the last lane's end: reset rows that no gradient counts
        shape = lambda v, fill: np.ascontiguousarray(np.concatenate([v, np.full(pad, fill, v.dtype)]).reshape(lanes, length).T)  # noqa: B023, E731
        xs, ks, ws, rs, live = shape(before, SHORT + TAIL), shape(kind, 0), shape(word, 0), shape(begins, True), shape(np.ones(len(before), bool), False)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, length, STEPS):
            x, r, ok = xs[t : t + STEPS], rs[t : t + STEPS], live[t : t + STEPS].ravel()
            s, kept = net.run(x, r, h)
            h = s[-1]
            s, k, w = s.reshape(-1, HIDDEN), ks[t : t + STEPS].ravel(), ws[t : t + STEPS].ravel()
            if ok.all():
                _, grads, full = net.output(s, k, w, True)
            else:
                _, grads, ds = net.output(s[ok], k[ok], w[ok], True)
                full = np.zeros((len(ok), HIDDEN), np.float32)
                full[ok] = ds
            grads |= net.back(x, r, kept, full.reshape(*x.shape, HIDDEN))
            rows, scale = grads.pop("rows"), np.float32(64 / max(1, int(ok.sum())))
            v = grads.pop("g") * scale
            np.clip(v, -1, 1, out=v)
            total = row_sums[rows] + v * v
            row_sums[rows] = total
            net.w["g"][rows] -= RATE * v / np.sqrt(total)
            v = np.concatenate([grads[name].ravel() for name in names])
            v *= scale
            np.clip(v, -1, 1, out=v)
            sums += v * v
            dense -= RATE * v / np.sqrt(sums)
            np.clip(dense[:bounded], -BOUND, BOUND, out=dense[:bounded])
    return net, seen


def streams_of(lex: Lexicon, rounds: int) -> int:
    """How many streams share a round: of about ``STREAM`` tokens each."""
    return max(1, round(lex.total / (rounds * STREAM)))


def train(docs: DataFrame, lex: Lexicon, text: str, key: str, rounds: int = ROUNDS) -> Network:
    """Every training document once; weights are averaged over streams after each round. Rows are dealt to rounds and
    streams, and ordered in them, by hash: the weights are a function of the rows, however the table is partitioned."""
    sc = docs.sparkSession.sparkContext
    net, streams = Network.fresh(lex), streams_of(lex, rounds)
    lot = F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string"))
    part = docs.where(in_training(key)).select(F.col(text).cast("string").alias("text"), lot.alias("lot"))
    for turn in range(rounds):
        shared = sc.broadcast((net, lex))

        def learn(batches, shared=shared):
            start, lex = shared.value
            for _, columns in common.streams(batches, SLICE):
                net, seen = train_task(start, lex, columns)
                if seen:
                    flat = net.flat()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], names=["i", "v", "n"])

        own = part.where(F.pmod("lot", F.lit(rounds)) == turn).select(F.pmod(F.floor(F.col("lot") / rounds), F.lit(streams)).alias("stream"), "lot", "text")
        dealt = own.repartition(streams, "stream").sortWithinPartitions("stream", "lot").select("stream", "text")
        rows = dealt.mapInArrow(learn, "i int, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas().sort_values("i")
        if len(rows):
            net = net.like(rows["v"].to_numpy())
        shared.unpersist()
    return net


def lane_scores(net: Network, before: np.ndarray, kind: np.ndarray, word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of class (and word) of every token; each text runs in one lane from its start to its end."""
    sizes = np.diff(bounds)
    lanes = max(1, min(SCORE_LANES, len(sizes), int(bounds[-1]) // 1000 + 1))
    loads, lists = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable"):
        lane = int(loads.argmin())
        lists[lane].append(i)
        loads[lane] += sizes[i]
    ranked = np.argsort(-loads, kind="stable")
    index = [np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in lists[lane]]) if lists[lane] else np.zeros(0, np.int64) for lane in ranked]
    begins = np.zeros(bounds[-1], bool)
    begins[bounds[:-1]] = True
    out, h, at = np.zeros(bounds[-1]), np.zeros((lanes, HIDDEN), np.float32), 0
    lengths = np.array([len(x) for x in index])
    while at < lengths[0]:
        live = int((lengths > at).sum())
        steps = min(4 * STEPS, int(lengths[live - 1]) - at)  # all live lanes have so many left
        rows = np.stack([x[at : at + steps] for x in index[:live]], 1)
        s, _ = net.run(before[rows], begins[rows], h[:live], keep=False)
        h = s[-1]
        flat = rows.ravel()
        s = s.reshape(-1, HIDDEN)
        for a in range(0, len(flat), SCORE_ROWS):  # what is made of a piece stays in a core's own cache
            part = flat[a : a + SCORE_ROWS]
            out[part] = net.output(s[a : a + SCORE_ROWS], kind[part], word[part])
        at += steps
    return out


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    vocab = common.written(vocabulary(docs, text, key), "vocabulary")
    lex = lexicon(vocab)
    shared = docs.sparkSession.sparkContext.broadcast((train(docs, lex, text, key), lex))
    base_norm = math.log10(lex.total + SMOOTH * (lex.distinct + 1))
    kind_of = docs.schema[key].dataType.simpleString()
    names = ["uid", "key", "held_out", "n_tokens", "n_known", "n_tail", "base", "score", "h", "tf"]

    def run(batches):
        from pyspark import TaskContext

        net, lex = shared.value
        norm = np.log10(lex.tail_tokens + SMOOTH * (lex.tail_types + 1))
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 7000):
                part = batch.slice(start, 7000)
                h, kind, bounds = tokens(part.column(2))
                count, before, cls, word, _ = coded(lex, h, kind, bounds)
                p = lane_scores(net, before, cls, word, bounds) / math.log(10)
                known = count >= 0
                logc = np.where(known, np.log10(np.maximum(count, 0) + SMOOTH), 0.0)
                p += np.where(cls >= WIDE, logc - norm[np.maximum(cls - WIDE, 0)], 0.0)
                sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds])  # noqa: B023, E731
                n, doc = part.num_rows, np.repeat(np.arange(part.num_rows), np.diff(bounds))
                ids = uid + np.arange(n)
                uid += n
                none = lambda t, m: pa.nulls(m, t)
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(sums(known.astype(np.int64))), pa.array(sums((~known).astype(np.int64))), pa.array(sums(logc)), pa.array(sums(p)), none(pa.int64(), n), none(pa.int32(), n)], names=names)
                rare = np.flatnonzero(~known)
                order = np.lexsort((h[rare], doc[rare]))
                d, w = doc[rare][order], h[rare][order]
                first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(d) else np.zeros(0, np.int64)
                tf, m = np.diff(np.append(first, len(d))).astype(np.int32), len(first)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[d[first]]), none(part.column(0).type, m), none(pa.bool_(), m), *(none(pa.int64(), m) for _ in range(3)), none(pa.float64(), m), none(pa.float64(), m), pa.array(w[first].view(np.int64)), pa.array(tf)], names=names)

    source = docs.select(F.col(key).alias("key"), (~in_training(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    rows = common.written(source.mapInArrow(run, f"uid long, key {kind_of}, held_out boolean, n_tokens long, n_known long, n_tail long, base double, score double, h long, tf int"), "scored")
    tail = rows.where("h is not null").select("uid", "h", "tf")
    counted = tail.join(vocab.select("h", "n"), "h", "left")
    sums = counted.groupBy("uid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("known"))
    whole = rows.where("h is null").join(sums, "uid", "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return whole.select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + known).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * F.lit(base_norm)).alias("base_score"), (F.col("score") + more).alias("score"))
