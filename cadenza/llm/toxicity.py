"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two hashed rows, one for the word and one for its first
letters. Filters of several widths slide over the words; the greatest response of each
goes into a logistic layer. Thresholds are calibrated by language, which is guessed from
the text's function words (the ``lang`` column is never read): the score is shifted so that
``THRESHOLD`` falls on each language's calibrated cut.

The model is learnt from every labelled text. Labelled texts are dealt to shards by hash of their id, as many as
rows and bytes ask for. In each round every shard trains a copy of the net on all its
texts, and the copies' steps are averaged, a word's row over the shards that moved it; sums are of
whole numbers, so that neither the order nor the partitions matter. A quarter of the
labelled texts, by crc32 of the text, isn't trained on but sets the cuts, all of it, counted in
bins of ``1 / BINS``. All texts are scored whole.

Edge cases: null and empty texts have no word and get the score of an empty text; null ids
count as held out and keep their null; of rows that repeat a labelled id, each is learnt from; rows may repeat and get equal scores; a very long text is
pooled in stretches of ``STRETCH`` words, whole; an empty table gives an empty result; with
labels of one class or none, every score is 0. A score equal to the threshold is toxic. Other
columns are kept by ``score_texts`` as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cadenza.llm.common import Scratch, bounded_batches, crc_fold, lean, lean_group, with_ids

SHARD_ROWS, SHARD_BYTES = 4000, 64 << 20  #: labelled texts of a shard; bytes of all texts that a shard stands for
CHUNK_BYTES = 200_000  #: of a shard's row, but for longer texts
PIECES, UNIT = 32, 1 << 24  #: parts in which steps are summed; their unit is 1 / UNIT
BINS = 64  #: bins of a logit's unit where cuts may lie
HEAVY = 8.0  #: greatest weight of a class in training
SLOTS = 1 << 15  #: rows of the hashed embedding; row 0 is silence
WIDTH, FILTERS, SPANS = 12, 6, (1, 2, 3)
STEM = 4  #: letters of a word's second hash
EPOCHS, STEPS, BATCH, RATE, SEED = 4, 400, 32, 0.1, 7  #: rounds over the sample, or more until so many steps
STRETCH = 40_000  #: words scored at once
THRESHOLD = 0.7
#: A clean text that is rejected weighs so many times a toxic one that is kept.
CLEAN_WEIGHT = 3.0

#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with was on are be this by from at".split(),
    "de": "der die das und ist zu für mit auf den nicht ein eine sich des von im dem".split(),
    "fr": "le les et est des une dans pour du qui sur au par pas plus ce il en".split(),
    "es": "el los las y una por con del se es para su al lo como más o un".split(),
}
LANGS = ("", *FUNCTION_WORDS)
_LANG = {w: i for i, ws in enumerate(FUNCTION_WORDS.values(), 1) for w in ws if sum(w in x for x in FUNCTION_WORDS.values()) == 1}
_LETTERS = re.compile(r"[\W_]+")


def features(chunk: str) -> tuple[int, int, int]:
    """(word's slot, stem's slot, language) of a run of non-blanks; slot 0 if it has no letter or digit."""
    w = _LETTERS.sub("", chunk.lower())
    if not w:
        return 0, 0, 0
    slot = lambda s: 1 + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (SLOTS - 1)
    return slot(w), slot("^" + w[:STEM]), _LANG.get(w, 0)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both slots and the language mark of every word of the texts in turn, and each text's first word (one more than texts)."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = pc.list_flatten(parts).dictionary_encode()
    table = np.array([features(x) for x in flat.dictionary.to_pylist()] or [(0, 0, 0)], np.int64)
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seen = table[code] if len(code) else np.zeros((0, 3), np.int64)
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))).astype(np.int64)
    keep = seen[:, 0] > 0
    kept = np.concatenate(([0], np.cumsum(keep)))
    seen = seen[keep]
    return seen[:, 0], seen[:, 1], seen[:, 2], kept[starts]


@dataclass
class Net:
    """Embedding rows, one matrix (span * WIDTH, FILTERS) for each span, and the logistic layer; cuts by language."""

    rows: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: float
    cuts: np.ndarray
    slope: float = 1.0

    @staticmethod
    def fresh() -> Net:
        r = np.random.default_rng(SEED)
        rows = (r.standard_normal((SLOTS, WIDTH)) * 0.1).astype(np.float32)
        rows[0] = 0
        filters = [(r.standard_normal((s * WIDTH, FILTERS)) / np.sqrt(s * WIDTH)).astype(np.float32) for s in SPANS]
        return Net(rows, filters, (r.standard_normal(len(SPANS) * FILTERS) * 0.3).astype(np.float32), 0.0, np.zeros(len(LANGS)))

    def pooled(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """One text: greatest response of each filter (0 at least), where it is, and the padded embeddings."""
        pad = max(SPANS) - 1
        e = np.vstack([self.rows[a] + self.rows[b], np.zeros((pad + (not len(a)), WIDTH), np.float32)])
        n, best, at = max(1, len(a)), [], []
        for s, m in zip(SPANS, self.filters, strict=True):
            z = sum(e[j : j + n] @ m[j * WIDTH : (j + 1) * WIDTH] for j in range(s))
            p = z.argmax(0)
            at.append(p)
            best.append(z[p, np.arange(FILTERS)])
        return np.maximum(np.concatenate(best), 0), at, e

    def squares(self) -> list[np.ndarray]:
        """Sums of squared gradients before any step: of the embedding rows, the filters, the logistic layer and the bias."""
        return [np.full_like(x, 1e-6) for x in (self.rows, *self.filters, self.out, np.zeros(1, np.float32))]

    def train(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, weight: np.ndarray, square: list[np.ndarray], seed: int = SEED) -> None:
        """Steps over all texts, so many times; weight is of the classes. ``square`` goes along."""
        r = np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                g_rows: dict[int, np.ndarray] = {}
                g_f, g_out, g_bias = [np.zeros_like(m) for m in self.filters], np.zeros_like(self.out), 0.0
                some = order[lo : lo + BATCH]
                for i in some:
                    a, b = texts[i]
                    h, at, e = self.pooled(a, b)
                    err = (1 / (1 + np.exp(-np.clip(h @ self.out + self.bias, -30, 30))) - y[i]) * weight[int(y[i])] / len(some)
                    g_out += err * h
                    g_bias += err
                    back = err * self.out * (h > 0)
                    for k, (s, m) in enumerate(zip(SPANS, self.filters, strict=True)):
                        for f in range(FILTERS):
                            if not (d := back[k * FILTERS + f]):
                                continue
                            p = at[k][f]
                            g_f[k][:, f] += d * e[p : p + s].ravel()
                            for j in range(s):
                                if p + j < len(a):
                                    v = d * m[j * WIDTH : (j + 1) * WIDTH, f]
                                    for x in (a[p + j], b[p + j]):
                                        g_rows[x] = g_rows[x] + v if x in g_rows else v
                for k, g in enumerate(g_f):
                    square[k + 1] += g * g
                    self.filters[k] -= RATE * g / np.sqrt(square[k + 1])
                square[-2] += g_out * g_out
                self.out -= RATE * g_out / np.sqrt(square[-2])
                square[-1] += g_bias * g_bias
                self.bias -= float(RATE * g_bias / np.sqrt(square[-1][0]))
                if g_rows:
                    x, g = np.array(list(g_rows)), np.array(list(g_rows.values()), np.float32)
                    square[0][x] += g * g
                    self.rows[x] -= RATE * g / np.sqrt(square[0][x])
        self.rows[0] = 0

    def responses(self) -> np.ndarray:
        """Of every slot, what it adds to every filter at every place: a table that scoring only looks up."""
        parts = [self.rows @ m[j * WIDTH : (j + 1) * WIDTH] for s, m in zip(SPANS, self.filters, strict=True) for j in range(s)]
        return np.hstack(parts).astype(np.float32)

    def best(self, x: np.ndarray, first: np.ndarray, dead: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Greatest response of each filter in each run of places that starts at first, the dead places left out."""
        pad, h, col = max(SPANS) - 1, [], 0
        r = table[x[0]] + table[x[1]]
        for s in SPANS:
            z = r[: len(r) - pad, col : col + FILTERS].copy()
            for j in range(1, s):
                z += r[j : len(r) - pad + j, col + j * FILTERS : col + (j + 1) * FILTERS]
            col += s * FILTERS
            z[dead] = -np.inf
            h.append(np.maximum.reduceat(z, first, axis=0))
        return np.hstack(h)

    def logits(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Of each of many texts, from all their words; texts go in turn, in runs of bounded length, long ones in stretches."""
        table = self.responses() if table is None else table
        out = np.empty(len(starts) - 1)
        pad, t, none = max(SPANS) - 1, 0, np.empty(0, np.int64)
        while t < len(out):
            u = max(t + 1, int(np.searchsorted(starts, starts[t] + STRETCH, "right")) - 1)
            length = np.diff(starts[t : u + 1])
            if length[0] > STRETCH:
                h, end = np.full((1, len(SPANS) * FILTERS), -np.inf), starts[u]
                for at in range(starts[t], end, STRETCH):
                    to = min(at + STRETCH + pad, end)  # the next stretch's first words end this one's last spans
                    x = np.zeros((2, min(STRETCH, end - at) + pad), np.int64)
                    x[0, : to - at], x[1, : to - at] = a[at:to], b[at:to]
                    h = np.maximum(h, self.best(x, np.zeros(1, np.int64), none, table))
            else:
                room = np.maximum(length, 1) + pad  # silence follows each text
                first = np.concatenate(([0], np.cumsum(room)))
                x = np.zeros((2, first[-1]), np.int64)
                put = np.repeat(first[:-1] - starts[t:u], length) + np.arange(starts[t], starts[u])
                x[0, put], x[1, put] = a[starts[t] : starts[u]], b[starts[t] : starts[u]]
                # places in the silence between texts are not a text's own
                dead = (first[1:-1, None] - 1 - np.arange(pad)).ravel()
                h = self.best(x, first[:-1], dead, table)
            out[t:u] = np.maximum(h, 0) @ self.out + self.bias
            t = u
        return out


def language(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index into LANGS of each text's most frequent language mark, 0 without any."""
    n, k = len(starts) - 1, len(LANGS)
    doc = np.repeat(np.arange(n), np.diff(starts))
    seen = np.bincount(doc * k + marks, minlength=n * k).reshape(n, k)
    seen[:, 0] = 0
    return np.where(seen.any(1), seen.argmax(1), 0)


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of least weighted error, in the middle of its gap."""
    o = np.argsort(z, kind="stable")
    z, y, weight = z[o], y[o], weight[o]
    edge = np.concatenate(([z[0] - 2], z, [z[-1] + 2]))
    wrong = np.concatenate(([0], np.cumsum(weight * y))) + np.concatenate((np.cumsum((weight * (1 - y))[::-1])[::-1], [0]))
    wrong[edge[1:] == edge[:-1]] = np.inf
    i = int(np.flatnonzero(wrong == wrong.min()).mean()) if np.ptp(np.flatnonzero(wrong == wrong.min())) + 1 == (wrong == wrong.min()).sum() else int(wrong.argmin())
    return float((edge[i] + edge[i + 1]) / 2)


def epochs_for(rows: float) -> int:
    """Rounds over so many texts."""
    return max(EPOCHS, math.ceil(STEPS * BATCH / max(1, rows)))


def class_weights(n: list[int]) -> np.ndarray:
    """Weights that make classes of such sizes count alike, up to a bound."""
    return np.minimum(HEAVY, max(n) / np.maximum(1, n))


def set_cuts(net: Net, z: np.ndarray, y: np.ndarray, lang: np.ndarray, times: np.ndarray) -> None:
    """Cuts of each language from logits, labels and languages that occur so many times."""
    weight = times * np.where(y == 1, 1 / max(1, times[y == 1].sum()), CLEAN_WEIGHT / max(1, times[y == 0].sum()))
    common = best_cut(z, y, weight)
    for k in range(len(LANGS)):
        own = lang == k
        enough = min(times[own & (y == 1)].sum(), times[own & (y == 0)].sum()) >= 5
        net.cuts[k] = best_cut(z[own], y[own], weight[own]) if enough else common


def fit(rows: list[tuple[str, int]]) -> Net | None:
    """Net and cuts from all of some labelled texts, as one shard; a quarter of them, by crc32 of the text, sets the cuts."""
    if len({y for _, y in rows}) < 2:
        return None
    held = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 4 == 0 for t, _ in rows])
    y = np.array([v for _, v in rows], float)
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    a, b, marks, starts = words_of(pa.array([t for t, _ in rows], pa.string()))
    net = Net.fresh()
    learn = np.flatnonzero(~held)
    sizes = [int((y[learn] == c).sum()) for c in (0, 1)]
    net.train([(a[starts[i] : starts[i + 1]], b[starts[i] : starts[i + 1]]) for i in learn], y[learn], epochs_for(len(learn)), class_weights(sizes), net.squares())
    sets = held if held.any() else ~held
    z, lang = net.logits(a, b, starts), language(marks, starts)
    set_cuts(net, z[sets], y[sets], lang[sets], np.ones(sets.sum()))
    return net


TEXTS = "k string, words binary, held boolean, lang int"
SHARD = "shard int, sizes array<long>, y binary, held binary, lang binary, starts binary, a binary, b binary"
_TEXTS = pa.schema([("k", pa.string()), ("words", pa.binary()), ("held", pa.bool_()), ("lang", pa.int32())])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (k, text): both slots of each text's words, whether it sets the cuts, and its language."""
    for batch in batches:
        texts = batch.column(1).fill_null("")
        a, b, marks, starts = words_of(texts)
        cut = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        words = [a[i:j].astype("<u2").tobytes() + b[i:j].astype("<u2").tobytes() for i, j in cut]  # SLOTS is 1 << 15
        held = [zlib.crc32(x) % 4 == 0 for x in texts.cast(pa.binary()).to_pylist()]
        lang = language(marks, starts) if len(cut) else []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(held, pa.bool_()), pa.array(lang, pa.int32())], schema=_TEXTS)


def _shard(texts: pa.Table, labels: pa.Table) -> pa.Table:
    """A shard's labelled texts, in an order of their own, as rows of bounded size; sizes are of both classes among those to train on and of both among the others."""
    y = dict(zip(labels.column("k").to_pylist(), labels.column("y").to_pylist(), strict=True))
    texts = texts.filter(pc.is_in(texts.column("k"), labels.column("k").combine_chunks())) if y else texts.slice(0, 0)
    rows = sorted(zip(*(texts.column(c).to_pylist() for c in ("k", "words", "held", "lang", "shard")), strict=True))
    out, at = [], 0
    while at < len(rows):
        to, size = at + 1, len(rows[at][1])
        while to < len(rows) and size + len(rows[to][1]) <= CHUNK_BYTES:
            size, to = size + len(rows[to][1]), to + 1
        part, at = rows[at:to], to
        label = [y[k] for k, *_ in part]
        sizes = [sum(r[2] == held and v == c for r, v in zip(part, label, strict=True)) for held in (False, True) for c in (0, 1)]
        starts = np.concatenate(([0], np.cumsum([len(r[1]) // 4 for r in part]))).astype(np.int64)
        halves = [b"".join(r[1][: len(r[1]) // 2] for r in part), b"".join(r[1][len(r[1]) // 2 :] for r in part)]
        out.append([part[0][4], sizes, bytes(label), bytes(int(r[2]) for r in part), bytes(r[3] for r in part), starts.tobytes(), *halves])
    types = [pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 6]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["shard", "sizes", "y", "held", "lang", "starts", "a", "b"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(y, held, lang, starts, a, b) of each shard, whose rows follow one another."""
    rows = ([batch.column(c)[r].as_py() for c in (0, *range(2, 8))] for batch in batches for r in range(batch.num_rows))
    for _, part in groupby(rows, key=lambda r: r[0]):
        part = list(part)
        y, held, lang, a, b = (np.frombuffer(b"".join(r[c] for r in part), t) for c, t in ((1, np.uint8), (2, np.uint8), (3, np.uint8), (5, "<u2"), (6, "<u2")))
        length = np.concatenate([np.diff(np.frombuffer(r[4], np.int64)) for r in part])
        yield y.astype(float), held > 0, lang.astype(np.int64), np.concatenate(([0], np.cumsum(length))), a.astype(np.int32), b.astype(np.int32)


def _flat(net: Net, square: list[np.ndarray]) -> np.ndarray:
    """Embedding rows with their squares, a slot in a row, then all else."""
    rest = [*net.filters, net.out, np.array([net.bias]), *square[1:]]
    return np.concatenate([np.hstack([net.rows, square[0]]).ravel(), *[x.ravel() for x in rest]]).astype(np.float64)


def _from_flat(v: np.ndarray) -> tuple[Net, list[np.ndarray]]:
    net, at = Net.fresh(), SLOTS * 2 * WIDTH
    square = net.squares()
    both = v[:at].reshape(SLOTS, 2 * WIDTH).astype(np.float32)
    net.rows, square[0] = both[:, :WIDTH].copy(), both[:, WIDTH:].copy()
    for x in (*net.filters, net.out, bias := np.zeros(1), *square[1:]):
        x.ravel()[:] = v[at : at + x.size]
        at += x.size
    net.bias = float(bias[0])
    return net, square


def _stepped(shared, epochs: int, weight: np.ndarray, every: bool, seed: int):
    """(piece, data): the steps of a partition's shards from the shared net, weighed by their texts and summed, and the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total = shared.value, None
        for y, held, _, starts, a, b in _unpacked(batches):
            learn = np.arange(len(y)) if every else np.flatnonzero(~held)
            net, square = _from_flat(base)
            old = _flat(net, square)
            net.train([(a[starts[i] : starts[i + 1]], b[starts[i] : starts[i + 1]]) for i in learn], y[learn], epochs, weight, square, seed)
            step = _flat(net, square) - old
            moved = (step[: SLOTS * 2 * WIDTH].reshape(SLOTS, -1) != 0).any(1)
            x = np.concatenate((np.rint(step * (len(learn) * UNIT)).astype(np.int64), moved * len(learn), [len(learn)]))
            total = x if total is None else total + x
        if total is not None:
            parts = [x.tobytes() for x in np.array_split(total, PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], ["piece", "data"])

    return run


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("data"))
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def _binned(shared, every: bool):
    """(lang, bin, y, n): how often a partition's texts that set the cuts have a logit in each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, _ = _from_flat(shared.value)
        table = net.responses()
        for y, held, lang, starts, a, b in _unpacked(batches):
            place = np.rint(np.clip(net.logits(a, b, starts, table), -30, 30) * BINS).astype(np.int64)
            sets = np.ones(len(y), bool) if every else held
            seen, n = np.unique(np.stack([lang, place, y.astype(np.int64)], 1)[sets], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*seen.T, n)], ["lang", "bin", "y", "n"])

    return run


def score_texts(docs: DataFrame, net: Net | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in a new last column."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if net is None:
        return docs.withColumn(score_col, F.lit(0.0))
    shared = spark.sparkContext.broadcast((net.responses(), net.out, net.bias, net.cuts))  # SLOTS rows
    at, names = docs.columns.index(text_col), [*docs.columns, score_col]
    lift = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, bias, cuts = shared.value
        own = Net(np.zeros((1, 1)), [], out, bias, cuts)
        for batch in batches:
            a, b, marks, starts = words_of(batch.column(at))
            z = own.logits(a, b, starts, table) if batch.num_rows else np.zeros(0)
            z = z - cuts[language(marks, starts)] + lift
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names)

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return docs.mapInArrow(lean(run), schema)


def trained(docs: DataFrame, labels: DataFrame) -> Net | None:
    """Net and cuts from every labelled text of folds other than 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    y = labels.select(F.col("doc_id").cast("string").alias("k"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1))
    y = y.where(crc_fold("k") != 1).groupBy("k").agg(F.max("y").alias("y"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    labelled = y.count()
    shards = max(1, -(-labelled // SHARD_ROWS), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("shard")
    d = docs.select(F.col("doc_id").cast("string").alias("k"), "text").where(crc_fold("k") != 1)
    words = with_ids(d, "k", y, labelled, _words, TEXTS).select(shard, "*")
    left, right = words.groupBy("shard"), y.select(shard, "k", "y").groupBy("shard")
    dealt = scratch.stored(left.cogroup(right).applyInArrow(lean_group(_shard), SHARD), "toxicity-shards")
    n = dealt.agg(*[F.sum(F.col("sizes")[i]) for i in range(4)], F.countDistinct("shard")).first()
    learn, held, shards = [n[0] or 0, n[1] or 0], [n[2] or 0, n[3] or 0], n[4]
    every = min(learn) == 0 or min(held) == 0
    if every:
        learn = [p + q for p, q in zip(learn, held, strict=True)]
    if min(learn) == 0:
        scratch.drop(dealt)
        return None
    net = Net.fresh()
    v = _flat(net, net.squares())
    epochs = epochs_for(sum(learn) / shards)
    for r in range(epochs if shards > 1 else 1):
        shared = spark.sparkContext.broadcast(v.astype(np.float32))
        steps = dealt.mapInArrow(lean(_stepped(shared, 1 if shards > 1 else epochs, class_weights(learn), every, SEED + r)), "piece int, data binary")
        found = {x.piece: np.frombuffer(x.data, np.int64) for x in steps.groupBy("piece").applyInArrow(lean_group(_summed), "piece int, data binary").collect()}
        total = np.concatenate([found[i] for i in range(PIECES)])
        step, moved, texts = total[: len(v)] / UNIT, total[len(v) : -1], total[-1]
        wide = SLOTS * 2 * WIDTH
        step[:wide] /= np.repeat(np.maximum(1, moved), 2 * WIDTH)
        step[wide:] /= texts
        v = shared.value + step
        shared.unpersist()
    shared = spark.sparkContext.broadcast(v.astype(np.float32))
    counts = dealt.mapInArrow(lean(_binned(shared, every)), "lang long, bin long, y long, n long").groupBy("lang", "bin", "y").agg(F.sum("n").alias("n"))
    lang, place, label, times = np.array([tuple(x) for x in counts.collect()], np.int64).T  # bins of five languages and two classes at most
    shared.unpersist()
    scratch.drop(dealt)
    net, _ = _from_flat(v)
    set_cuts(net, place / BINS, label.astype(float), lang, times)
    return net


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_texts(docs.select("doc_id", "text"), trained(docs, labels))
    return scored.select("doc_id", (crc_fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
