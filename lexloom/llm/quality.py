"""Quality rules with n-gram perplexity.

A character n-gram model (order 4, modified Kneser-Ney) is counted by Spark over all distinct texts, one model for each
language: however many copies a text has, it counts once, so that copies cannot set a language's bands. It is a class model:
a character's probability is that of its class after the three classes before it, by n-grams, times its share of its class.
Characters are dealt to 32 classes, each language's own: its letters are counted, the 27 most frequent get a class each, every
further one joins the class that is least used so far (a script of thousands of letters fills all classes evenly). No character
is left out or stands for another one: those that share a class have shares of their own, in all planes. Only white space,
digits, case and the marks of Latin letters are read alike. So a language has at most 32**4 n-grams of the highest order and
a share for each character. A model is stored in arrays that are sorted by the n-grams' hashes and searched by bisection.
Documents whose perplexity lies outside their language's lower and upper bands go; the bands come from a histogram over all
distinct texts.

The models of the 64 languages with most texts, and that of texts without a language, are broadcast. All other languages, any
number of them, have models and bands of the same kind in a table with a row for each: their texts are dealt by language and
read behind their model.

Four passes over the text: letters, count (over distinct texts, whose shuffle is the only one of text), histogram, decide. The
others are plain maps from the input; the histogram shuffles hashes. Texts in languages beyond the 64 are shuffled in all but
the first.

Defined cases: a null or empty text has no words and fails the base rules; every language has a model of its own, null is one
of them; repeated rows and equal ids are judged row by row; very long texts are scored whole; an empty table gives no rows;
other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER, CLASSES, BITS = 4, 32, 5
SPACE, DIGIT, POINT, SYMBOL, LETTER, OTHER = 0, 27, 28, 29, 30, 31
#: The classes of letters, and how many languages have models that are broadcast; those of all others lie in a table.
LETTERS, LANGUAGES = (*range(1, 27), LETTER), 64
POINTS = 0x110000  # code points; beside letters' counts, the number of texts
UNIT = 1 << 24  # logarithms are whole multiples of 1 / UNIT, so their sums are the same in any order
SYMBOLS = b"#*$%&|<>"
BIN = 1000  # histogram bins for each unit of log10 perplexity
_classes: tuple[np.ndarray, np.ndarray] | None = None


@dataclass(frozen=True)
class Rules:
    """The base rules' limits, and the fence of the perplexity bands: that many interquartile ranges beyond the quartiles."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    fence: float = 4.0


def base_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its class (LETTER for all letters), and the character that it is read as."""
    global _classes
    if _classes is None:
        table, read = np.full(POINTS, OTHER, np.uint8), np.arange(POINTS, dtype=np.int32)
        for cp in (*range(0x32400), *range(0xE0000, 0xE0200)):  # nothing else is assigned, but for private use
            ch = chr(cp)
            base = unicodedata.normalize("NFKD", ch)[:1].lower() if cp > 127 else ch.lower()
            kind = unicodedata.category(ch)
            if "a" <= base <= "z" and len(base) == 1:
                table[cp], read[cp] = LETTER, ord(base)
            elif ch.isspace():
                table[cp], read[cp] = SPACE, 32
            elif kind[0] == "N":
                table[cp], read[cp] = DIGIT, 48
            elif kind[0] in "LM":  # marks are the vowels of many scripts
                small = ch.lower()
                table[cp], read[cp] = LETTER, ord(small) if len(small) == 1 else cp
            elif ch in ".,;:!?'\"()-":
                table[cp] = POINT
            elif cp < 128 or kind[0] in "PS":
                table[cp] = SYMBOL
        table[read[table == LETTER]] = LETTER
        _classes = table, read
    return _classes


class Alphabet:
    """A language's characters in order, their classes, and the log10 of each one's share of its class (0 until set)."""

    def __init__(self, letters: np.ndarray, classes: np.ndarray):
        self.letters, self.classes, self.shares, self.dense = letters, classes, np.zeros(len(letters), np.float32), None

    def __getstate__(self):
        return self.__dict__ | {"dense": None}

    def tables(self, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes and shares by code point, up to ``top`` at least."""
        if self.dense is None or top >= len(self.dense[0]):
            base, read = base_classes()
            read = read[: min(POINTS, 1 << max(16, int(top).bit_length()))]
            kinds, shares = base.astype(np.int32), np.zeros(POINTS, np.float32)
            kinds[self.letters], shares[self.letters] = self.classes, self.shares
            self.dense = kinds[read], shares[read]
        return self.dense

    def __getitem__(self, point: int) -> int:
        """The class of a code point."""
        return self.tables(point)[0][point]

    def share(self, letters: np.ndarray, n: np.ndarray) -> None:
        """Set the shares, from counts of characters."""
        at = np.searchsorted(self.letters, letters)
        own = np.zeros(len(self.letters), np.int64)
        own[at] = n
        total = np.bincount(self.classes, own, CLASSES)[self.classes]
        shares = np.log10(np.where(own > 0, own, 1) / np.maximum(total, 1))
        self.shares, self.dense = (np.rint(shares * UNIT) / UNIT).astype(np.float32), None


def class_table(letters: np.ndarray, n: np.ndarray) -> Alphabet:
    """The classes of a language with these counts of characters."""
    classes = base_classes()[0][letters]
    loads = [(0, i) for i in range(len(LETTERS))]
    for i in np.lexsort((letters, -n)):
        if classes[i] == LETTER:
            load, least = heapq.heappop(loads)
            classes[i] = LETTERS[least]
            heapq.heappush(loads, (load + int(n[i]), least))
    order = np.argsort(letters)
    return Alphabet(letters[order].astype(np.int32), classes[order])


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.intp)


def added(sums: np.ndarray | None, points: np.ndarray) -> np.ndarray:
    """Counts of code points, with those of some more."""
    n = np.bincount(points, minlength=0 if sums is None else len(sums))
    if sums is not None:
        n[: len(sums)] += sums
    return n


def as_read(sums: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Characters and their counts, from counts of code points."""
    if sums is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.flatnonzero(sums)
    letters, which = np.unique(base_classes()[1][points], return_inverse=True)
    n = np.zeros(len(letters), np.int64)
    np.add.at(n, which, sums[points])
    return letters, n


def alphabets(docs: DataFrame, text: str, lang: str) -> tuple[tuple[str, ...], list[Alphabet]]:
    """The languages whose models are broadcast, and the characters of each and, last, of texts without a language."""
    return known_alphabets(count_letters(docs, text, lang))[:2]


def count_letters(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, letter, n) of the characters of each language; as letter POINTS, its texts."""

    def count(batches):
        sums: dict[str | None, np.ndarray] = {}
        texts: dict[str | None, int] = {}

        def out():
            for one, n in texts.items():
                letters, counts = as_read(sums.get(one))
                yield pa.RecordBatch.from_arrays([pa.array([one] * (len(letters) + 1), pa.string()), pa.array(np.append(letters, POINTS).astype(np.int32)), pa.array(np.append(counts, n))], names=["lang", "letter", "n"])

        for batch in batches:
            names = batch.column(1).to_pylist()
            ids = tuple({x for x in names if x is not None})
            for one, rows, data, _ in by_language(batch, "text", "lang", ids):
                name = ids[one] if one < len(ids) else None
                texts[name] = texts.get(name, 0) + len(rows)
                if len(data):
                    sums[name] = added(sums.get(name), code_points(data))
                if sum(map(len, sums.values())) > 1 << 23 or len(texts) > 1 << 16:
                    yield from out()
                    sums.clear()
                    texts.clear()
        yield from out()

    part = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return common.written(part.mapInArrow(count, "lang string, letter int, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n")), "letters")


def known_alphabets(counted: DataFrame) -> tuple[tuple[str, ...], list[Alphabet], bool]:
    """The languages whose models are broadcast, their characters and those of texts without a language, and whether there
    are more languages."""
    most = counted.where((F.col("letter") == POINTS) & F.col("lang").isNotNull()).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    languages = tuple(sorted(r["lang"] for r in most[:LANGUAGES]))
    letters = counted.where((F.col("letter") < POINTS) & among("lang", languages)).toPandas()
    name = letters["lang"].where(letters["lang"].notna(), None)
    tables = []
    for one in (*languages, None):
        own = letters[name.isna() if one is None else name == one]
        tables.append(class_table(own["letter"].to_numpy(), own["n"].to_numpy()))
    return languages, tables, len(most) > LANGUAGES


def among(lang: str, languages: tuple[str, ...]) -> Column:
    """Whether a row's model is broadcast."""
    name = F.col(lang).cast("string")
    return name.isNull() | name.isin(*languages)


def gram_codes(data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of some texts, the code of the n-gram that ends there and its code point, and the texts' bounds in
    characters."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[bounds]
    points = code_points(data)
    if len(points) != at[-1]:  # bytes that are not UTF-8
        each = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        points = np.frombuffer("".join(each).encode("utf-32-le", "replace"), np.uint32).astype(np.intp)
        at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    kinds = alphabet.tables(points.max(initial=0))[0][points]
    code = kinds.copy()
    starts, ends = at[:-1], at[1:]
    for back in range(1, ORDER):
        before = np.zeros_like(kinds)
        before[back:] = kinds[:-back]
        for j in range(back):  # before a text there is only space
            inside = starts + j
            before[inside[inside < ends]] = SPACE
        code |= before << (BITS * back)
    return code, points, at


def language_ids(column, languages: tuple[str, ...]) -> np.ndarray:
    known = {x: i for i, x in enumerate(languages)}
    return np.array([known.get(x, len(languages)) for x in column.to_pylist()], np.int64)


def by_language(batch: pa.RecordBatch, text: str, lang: str, languages: tuple[str, ...], limit: int = common._PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, rows, bytes, bounds) of runs of texts in one language."""
    names = batch.schema.names
    ids, column = language_ids(batch.column(names.index(lang)), languages), batch.column(names.index(text))
    for one in np.unique(ids):
        rows = np.flatnonzero(ids == one)
        for a, b, data, bounds in common.text_chunks(column.take(pa.array(rows)), limit):
            yield int(one), rows[a:b], data, bounds


class Counts:
    """Counts of the n-grams of a language's texts and, behind them, of its characters."""

    def __init__(self):
        self.grams, self.letters = np.zeros(CLASSES**ORDER, np.int64), None

    def add(self, data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet) -> None:
        if len(data):
            code, points, _ = gram_codes(data, bounds, alphabet)
            self.grams += np.bincount(code, minlength=CLASSES**ORDER)
            self.letters = added(self.letters, points)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        code = np.flatnonzero(self.grams)
        letters, n = as_read(self.letters)
        return np.concatenate([code, CLASSES**ORDER + letters]), np.concatenate([self.grams[code], n])


def count_grams(docs: DataFrame, text: str, lang: str, languages: tuple[str, ...], tables: list[Alphabet]) -> DataFrame:
    """(lang, code, n) over the distinct texts of each language, summed in each task first; from 32**4 on, characters."""

    def count(batches):
        sums: dict[int, Counts] = {}
        for batch in common.slices(batches, 4096):
            for one, _, data, bounds in by_language(batch, "text", "lang", languages, common._CHUNK):  # each is summed into all n-grams
                sums.setdefault(one, Counts()).add(data, bounds, tables[one])
        for one, counts in sums.items():
            code, n = counts.rows()
            yield pa.RecordBatch.from_pydict({"lang": np.full(len(code), one, np.int32), "code": code.astype(np.int32), "n": n})

    part = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).distinct()
    return part.mapInArrow(count, "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney, by count; where counts of counts are missing, the usual fractions."""
    n = [max(0, int((counts == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in zip((1, 2, 3), d, strict=True))])


def kneser_ney(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the dense counts of one language, for each order: n-grams seen, their log10 probability, contexts, their log10 back-off."""
    levels = [counts]
    for _ in range(ORDER - 1):  # lower orders count how many different characters stand before
        levels.append((levels[-1] > 0).reshape(CLASSES, -1).sum(0).astype(np.int64))
    lower = np.full((1, CLASSES), 1 / CLASSES)
    out = []
    for c in reversed(levels):
        c = c.reshape(-1, CLASSES)
        d = _discounts(c)
        total, off = c.sum(1, keepdims=True), d[np.minimum(c, 3)]
        left = np.where(total > 0, off.sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
        below = np.tile(lower, (len(c) // len(lower), 1)) if len(c) >= len(lower) else lower
        p = (c - off) / np.maximum(total, 1) + left * below
        seen, known = np.flatnonzero(c.ravel()), np.flatnonzero(total.ravel())
        out.append((seen, np.log10(p.ravel()[seen]), known, np.log10(left.ravel()[known])))
        lower = p
    return out


def _keys(lang, order: int, code: np.ndarray) -> np.ndarray:
    return common.mix((np.uint64(lang) << np.uint64(40)) | (np.uint64(order) << np.uint64(32)) | code.astype(np.uint64))


class GramModel:
    """Sorted hash arrays: for each order n-gram hashes with log10 probabilities and context hashes with log10 back-offs."""

    def __init__(self, lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        grams: list[list] = [[] for _ in range(ORDER)]
        for one in np.unique(lang):
            dense = np.zeros(CLASSES**ORDER, np.int64)
            dense[code[lang == one]] = n[lang == one]
            for k, (seen, p, known, off) in enumerate(kneser_ney(dense)):
                grams[k].append((_keys(one, k + 1, seen), p, _keys(one, k, known) if k else np.zeros(0, np.uint64), off if k else np.zeros(0)))
        self.orders = []
        for parts in grams:
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)]
            a, b = np.argsort(cols[0]), np.argsort(cols[2])
            self.orders.append((cols[0][a], cols[1][a].astype(np.float32), cols[2][b], cols[3][b].astype(np.float32)))
        self.cache: dict[int, np.ndarray] = {}

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
        """NaN where a key is not there."""
        if not len(keys):
            return np.full(len(want), np.nan, np.float32)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, values[at], np.float32(np.nan))

    def lookup(self, lang: int, code: np.ndarray) -> np.ndarray:
        """log10 probabilities by bisection, backing off to shorter n-grams."""
        out = np.full(len(code), -np.log10(CLASSES), np.float32)
        for k, (keys, values, contexts, offs) in enumerate(self.orders):
            gram = code & (CLASSES ** (k + 1) - 1)
            if k:
                off = self._find(contexts, offs, _keys(lang, k, gram >> BITS))
                out = out + np.nan_to_num(off)
            found = self._find(keys, values, _keys(lang, k + 1, gram))
            out = np.where(np.isnan(found), out, found)
        return out

    def score(self, lang: int, code: np.ndarray) -> np.ndarray:
        table = self.cache.setdefault(lang, np.full(CLASSES**ORDER, np.nan, np.float32))
        got = table[code]
        if len(missing := np.unique(code[np.isnan(got)])):
            table[missing] = np.rint(self.lookup(lang, missing).astype(np.float64) * UNIT) / UNIT
            got = table[code]
        return got


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def base_features(data: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    hashes, first = common.word_hashes(data, bounds, lower=False)
    solid = common._SOLID[data] & ((data & 0xC0) != 0x80)
    marks = np.zeros(256, np.int64)
    marks[list(SYMBOLS)] = 1
    out = np.zeros((len(bounds) - 1, 5), np.int64)
    out[:, 0], out[:, 1], out[:, 2] = np.diff(first), _sums(solid.astype(np.int64), bounds), _sums(marks[data], bounds)
    for i in range(len(out)):
        raw = data[bounds[i] : bounds[i + 1]].tobytes()
        if b"\n" in raw:
            lines = [x for x in raw.split(b"\n") if x.strip()]
            out[i, 3] = len(lines) - len(set(lines))
        runs = common.grams(hashes[first[i] : first[i + 1]], window)
        if len(runs) > 1:
            ranked = np.sort(runs)
            twice = ranked[1:][ranked[1:] == ranked[:-1]]
            if len(twice):
                at = np.flatnonzero(np.isin(runs, twice))
                step = np.zeros(out[i, 0] + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                out[i, 4] = int((np.cumsum(step) > 0).sum())
    return out


class Judge:
    """Features, perplexity and verdict of the rows of a batch."""

    def __init__(self, model: GramModel, bands: dict[int, tuple[float, float]], languages: tuple[str, ...], tables: list[Alphabet], rules: Rules):
        self.model, self.bands, self.languages, self.tables, self.rules = model, bands, languages, tables, rules

    def perplexity(self, lang: int, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of the perplexity of a character; 0 for an empty text."""
        if not len(data):
            return np.zeros(len(bounds) - 1)
        code, points, at = gram_codes(data, bounds, self.tables[lang])
        share = self.tables[lang].tables(0)[1][points]  # gram_codes has made them large enough
        return -_sums(np.add(self.model.score(lang, code), share, dtype=np.float64), at) / np.maximum(np.diff(at), 1)

    def __call__(self, batch: pa.RecordBatch, text: str, lang: str) -> dict[str, np.ndarray]:
        n = batch.num_rows
        features, ppl, low, high = np.zeros((n, 5), np.int64), np.zeros(n), np.zeros(n), np.full(n, np.inf)
        for one, rows, data, bounds in by_language(batch, text, lang, self.languages):
            features[rows] = base_features(data, bounds, self.rules.window)
            ppl[rows] = self.perplexity(one, data, bounds)
            low[rows], high[rows] = self.bands.get(one, (0.0, np.inf))
        failed = (features[:, 0] < self.rules.min_words) | (100 * features[:, 4] > self.rules.max_repeat_percent * features[:, 0])
        return dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), features.T, strict=True)) | {"base_failed": failed, "kept": ~failed & (ppl >= low) & (ppl <= high), "log_perplexity": ppl, "lower_band": low, "upper_band": high}


def trained(lang: np.ndarray, code: np.ndarray, n: np.ndarray, languages: tuple[str, ...], tables: list[Alphabet], rules: Rules) -> Judge:
    """A judge without bands, from the counts of n-grams and characters."""
    grams = code < CLASSES**ORDER
    for one, alphabet in enumerate(tables):
        own = ~grams & (lang == one)
        alphabet.share(code[own] - CLASSES**ORDER, n[own])
    return Judge(GramModel(lang[grams], code[grams], n[grams]), {}, languages, tables, rules)


def bins_of(judge: Judge, batch: pa.RecordBatch, text: str, lang: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(language, rows, bins) of the texts that have words enough."""
    for one, rows, data, bounds in by_language(batch, text, lang, judge.languages):
        enough = np.diff(common.word_hashes(data, bounds)[1]) >= judge.rules.min_words
        yield one, rows[enough], np.rint(judge.perplexity(one, data, bounds)[enough] * BIN).astype(np.int32)


def fit(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> tuple[Judge, DataFrame | None]:
    """Count the models over the distinct texts, then the bands from the histograms of their perplexities (min_words at least):
    a judge of the languages with most texts, and a table with a judge for each of the others, if any."""
    spark = docs.sparkSession
    letters = count_letters(docs, text, lang)
    languages, tables, more = known_alphabets(letters)
    most = docs.where(among(lang, languages)) if more else docs
    counts = count_grams(most, text, lang, languages, tables).toPandas()  # bounded: (languages + 1) * (32**4 + characters) rows at most
    counts = counts.sort_values(["lang", "code"])
    judge = trained(counts["lang"].to_numpy(), counts["code"].to_numpy(), counts["n"].to_numpy(), languages, tables, rules)
    shared = spark.sparkContext.broadcast(judge)

    def binned(batches):
        for batch in common.slices(batches):
            for one, rows, bins in bins_of(shared.value, batch, "text", "lang"):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), one, np.int32)), pa.array(bins), *(batch.column(i).take(pa.array(rows)) for i in (2, 3))], names=["lang", "bin", "h", "size"])

    def hashed(df):
        return df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.length(F.col(text).cast("string")).alias("size"))

    once = hashed(most).mapInArrow(binned, "lang int, bin int, h long, size int").distinct()  # a text's copies count once
    bins = once.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).toPandas()
    for one, own in bins.sort_values("bin").groupby("lang"):
        share = own["n"].cumsum().to_numpy() / own["n"].sum()
        q1, q3 = (own["bin"].to_numpy()[min(np.searchsorted(share, q), len(share) - 1)] / BIN for q in (0.25, 0.75))
        reach = rules.fence * max(q3 - q1, 10 / BIN)
        judge.bands[int(one)] = (q1 - reach, q3 + reach)
    judge.model.cache = {}
    if not more:
        return judge, None
    judges = other_judges(docs.where(~among(lang, languages)), letters.where(~among("lang", languages)), rules, text, lang)

    def other(judge, batch):
        for _, rows, bins in bins_of(judge, batch, "text", "lang"):
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), pa.array(bins), *(batch.column(i).take(pa.array(rows)) for i in (2, 3))], names=["lang", "bin", "h", "size"])

    once = along(hashed(docs.where(~among(lang, languages))), judges, "lang", other, "lang string, bin int, h long, size int").distinct()
    return judge, common.written(judges.drop("low", "high").join(other_bands(once.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")), rules), "lang", "left"), "judges")


def other_bands(bins: DataFrame, rules: Rules) -> DataFrame:
    """(lang, low, high) from (lang, bin, n), as for the languages with most texts."""
    own = Window.partitionBy("lang")
    upto = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(own)
    q1, q3 = (F.min(F.when(F.col("upto") >= q, F.col("bin"))) / BIN for q in (0.25, 0.75))
    reach = rules.fence * F.greatest(F.col("q3") - F.col("q1"), F.lit(10 / BIN))
    quartiles = bins.withColumn("upto", upto).groupBy("lang").agg(q1.alias("q1"), q3.alias("q3"))
    return quartiles.select("lang", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def language_runs(batches) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(language, rows) in turn, of batches that are sorted by their first column, the language."""
    for batch in batches:
        if batch.num_rows:
            start = common.group_starts(pa.Table.from_batches([batch]), 1)
            for a, b in zip(start[:-1], start[1:], strict=True):
                yield batch.column(0)[int(a)].as_py(), batch.slice(a, b - a)


def other_judges(docs: DataFrame, letters: DataFrame, rules: Rules, text: str, lang: str) -> DataFrame:
    """(lang, judge, low, high), a row for each language, without bands: its characters, then its distinct texts pass by."""

    def build(batches):
        now, held, counts, alphabet = None, [], Counts(), None

        def done():
            own = alphabet or class_table(*(np.concatenate(x) for x in zip(*held, strict=True)))
            code, n = counts.rows()
            judge = trained(np.zeros(len(code), np.int64), code, n, (now,), [own], rules)
            return pa.RecordBatch.from_pydict({"lang": pa.array([now]), "judge": pa.array([pickle.dumps(judge)], pa.binary()), "low": pa.array([None], pa.float64()), "high": pa.array([None], pa.float64())})

        for one, rows in language_runs(batches):
            if one != now:
                if now is not None:
                    yield done()
                now, held, counts, alphabet = one, [(np.zeros(0, np.int32), np.zeros(0, np.int64))], Counts(), None
            first = rows.filter(pc.equal(rows.column(1), 0))
            held.append((first.column(2).to_numpy(), first.column(3).to_numpy()))
            texts = rows.filter(pc.equal(rows.column(1), 1)).column(4)
            if len(texts):
                alphabet = alphabet or class_table(*(np.concatenate(x) for x in zip(*held, strict=True)))
                for _, _, data, bounds in common.text_chunks(texts, common._CHUNK):
                    counts.add(data, bounds, alphabet)
        if now is not None:
            yield done()

    characters = letters.where(F.col("letter") < POINTS).select("lang", F.lit(0).alias("kind"), "letter", "n", F.lit(None).cast("string").alias("text"))
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.lit(1).alias("kind"), F.lit(0).alias("letter"), F.lit(0).cast("long").alias("n"), F.col(text).cast("string").alias("text")).distinct()
    dealt = characters.unionByName(texts).repartition("lang").sortWithinPartitions("lang", "kind")
    return common.written(dealt.mapInArrow(build, "lang string, judge binary, low double, high double"), "judges")


def along(docs: DataFrame, judges: DataFrame, lang: str, work: Callable[[Judge, pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """What ``work`` makes of the documents, which pass by behind their language's judge."""

    def run(batches):
        judge, now = None, None
        for one, rows in language_runs(batches):
            head = rows.filter(pc.equal(rows.column(1), 0))
            if head.num_rows:
                got = head.column(2)[0].as_py()
                judge, now = pickle.loads(got["judge"]), one
                judge.bands = {0: (got["low"], got["high"])} if got["low"] is not None else {}
            own = rows.filter(pc.equal(rows.column(1), 1))
            assert now == one, "a language without a judge"
            for part in common.slices([pa.RecordBatch.from_struct_array(own.column(3))]):
                yield from work(judge, part)

    first = judges.select("lang", F.lit(0).alias("kind"), F.struct("judge", "low", "high").alias("judge"))
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.lit(1).alias("kind"), F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"))
    dealt = first.unionByName(rows, allowMissingColumns=True).repartition("lang").sortWithinPartitions("lang", "kind")
    return dealt.mapInArrow(run, schema)


def ruled(docs: DataFrame, rules: Rules, text: str, lang: str, work: Callable[[Judge, pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """What ``work`` makes of the documents with the judge of their language."""
    judge, others = fit(docs, rules, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        for batch in common.slices(batches):
            yield from work(shared.value, batch)

    if others is None:
        return docs.mapInArrow(run, schema)
    return docs.where(among(lang, judge.languages)).mapInArrow(run, schema).unionByName(along(docs.where(~among(lang, judge.languages)), others, lang, work, schema))


def assess(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row for each document: the key, the features, base_failed, kept, and perplexity and bands (log10)."""

    def judged(judge, batch):
        got = judge(batch, "text", "lang")
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in got.values())], names=["key", *got])

    part = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    kind = docs.schema[key].dataType.simpleString()
    out = ruled(part, rules, "text", "lang", judged, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_perplexity double, lower_band double, upper_band double")
    return out.withColumnRenamed("key", key)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns only."""

    def passed(judge, batch):
        yield batch.filter(pa.array(judge(batch, text, lang)["kept"]))

    return ruled(docs, rules, text, lang, passed, docs.schema)
