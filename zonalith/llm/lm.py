"""A hidden Markov language model, trained by Baum-Welch, beside a smoothed unigram base.

Symbols are the `head` most frequent training words and, for all others, classes by shape; a state emits symbols, and a
rare word has its smoothed share of its class.  So the model's size is bounded while every word keeps its own count.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalith.llm.common import small_batches, text_batches, utf8, written

#: Classes of rare words; symbol 0 is the end of a text, then come the classes, then the head.
N_CLASSES = 256


@dataclass(frozen=True)
class Shape:
    states: int = 6
    head: int = 130_000
    iterations: int = 2
    held_out: int = 10


def word_class(word: bytes) -> int:
    """1 to N_CLASSES: from the last three bytes of a word without marks."""
    return 1 + zlib.crc32(word.rstrip(b".,;:!?\"'()")[-3:]) % N_CLASSES


def is_held_out(doc: int | None, parts: int) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % parts == 0


class _Counts:
    """Words of training texts with their counts, summed within each batch; the end of a text is the null word."""

    def __init__(self, parts: int):
        self.parts = parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        ends = 0
        for b in text_batches(batches):
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                if not is_held_out(doc, self.parts):
                    held.update(text.lower().split())
                    ends += 1
            if len(held) > 300_000:
                yield self.rows(held, ends)
                held, ends = Counter(), 0
        yield self.rows(held, ends)

    @staticmethod
    def rows(held: Counter, ends: int) -> pa.RecordBatch:
        words = pa.array([*held, None] if ends else [*held], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([*held.values(), ends] if ends else [*held.values()], pa.int64())], names=["word", "n"])


@dataclass
class Model:
    """start (K), move (K x K), emit (symbols x K): probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


#: Bytes of batches that are worked on at once: the more texts a step has, the fewer calls.
AT_ONCE = 3 << 20


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of AT_ONCE bytes or more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= AT_ONCE:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _padded(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, lengths, symbols by step) of texts of similar length, longest first, about 400,000 symbols at a time."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    i = 0
    while i < len(order):
        longest = len(texts[order[i]])
        own = order[i : i + max(1, 400_000 // longest)]
        sizes = np.array([len(texts[j]) for j in own])
        steps = np.zeros((longest, len(own)), np.int64)
        for c, j in enumerate(own):
            steps[: sizes[c], c] = texts[j]
        yield own, sizes, steps
        i += len(own)


def forward(model: Model, sizes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward recursion: (states after each step, scales, natural log likelihood); texts are sorted by falling length."""
    n, width = steps.shape
    alpha, scale = np.zeros((n, width, len(model.start))), np.ones((n, width))
    live = np.searchsorted(-sizes, -np.arange(1, n + 1), side="right")
    for t in range(n):
        m = live[t]
        ahead = alpha[t - 1, :m] @ model.move if t else np.broadcast_to(model.start, (m, len(model.start)))
        now = ahead * model.emit[steps[t, :m]]
        scale[t, :m] = now.sum(axis=1)
        alpha[t, :m] = now / scale[t, :m, None]
    return alpha, scale, np.log(scale).sum(axis=0)


def expected(model: Model, sizes: np.ndarray, steps: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled backward recursion: expected counts (first states, moves, states by symbol in the order of steps[live])."""
    n, width = steps.shape
    k = len(model.start)
    moves, beta = np.zeros((k, k)), np.ones((width, k))
    states = alpha
    live = np.searchsorted(-sizes, -np.arange(1, n + 1), side="right")
    for t in range(n - 1, 0, -1):
        m = live[t]
        behind = beta[:m] * model.emit[steps[t, :m]] / scale[t, :m, None]
        states[t, :m] *= beta[:m]
        moves += states[t - 1, :m].T @ behind
        beta[:m] = behind @ model.move.T
    states[0] *= beta
    return states[0].sum(axis=0), moves * model.move, states


class _Symbols(dict):
    """Symbols of words: the head's own, the rest by class; what was looked up is kept while there is room."""

    def __init__(self, head: dict[bytes, int], room: int = 300_000):
        super().__init__(head)
        self.head, self.most = head, len(head) + room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.head)
        self[word] = out = word_class(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(chain(map(self.__getitem__, words), (0,)), np.int32, len(words) + 1)


def _anchor(text: bytes, states: int) -> int:
    """A first guess of a text's state: from its most frequent letter beyond ASCII."""
    if text.isascii():
        return 0
    letter = Counter(text.decode("utf-8", "replace").translate(_no_ascii)).most_common(1)
    return 1 + zlib.crc32(letter[0][0].encode()) % (states - 1) if letter and states > 1 else 0


_no_ascii = dict.fromkeys(range(128))


class _Lay:
    """Each text as symbols, with what the head knows of its score and the counts of its words outside the head."""

    def __init__(self, head, base, states: int, parts: int):
        self.head, self.base, self.states, self.parts = head, base, states, parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, logs = _Symbols(self.head.value), self.base.value
        row = TaskContext.get().partitionId() << 40  # the rows are written, so a number stays with its row
        for b in text_batches(batches):
            docs, texts = b.column(0).to_pylist(), [t.lower() for t in utf8(b.column(1))]
            words = [t.split() for t in texts]
            laid = [symbols.of(w) for w in words]
            rare = [Counter([own[k] for k in np.flatnonzero((s[:-1] <= N_CLASSES)).tolist()]) for own, s in zip(words, laid, strict=True)]
            known = [int((s > N_CLASSES).sum()) + (logs[0] != 0) for s in laid]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(row, row + len(docs)), pa.int64()), b.column(0), pa.array([is_held_out(d, self.parts) for d in docs]), pa.array([_anchor(t, self.states) for t in texts], pa.int32()),
                pa.array(map(len, laid), pa.int64()), pa.array(map(int, known), pa.int64()), pa.array([float(logs[s].sum()) for s in laid]), pa.array([s.astype("<i4").tobytes() for s in laid], pa.binary()),
                pa.array([list(r) for r in rare], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int64())), pa.array([[symbols[w] for w in r] for r in rare], pa.list_(pa.int32())),
            ], names=["row", "doc_id", "held_out", "anchor", "n_tokens", "n_known", "base", "symbols", "rare", "times", "classes"])
            row += len(docs)


_LAID = "row long, doc_id long, held_out boolean, anchor int, n_tokens long, n_known long, base double, symbols binary, rare array<string>, times array<long>, classes array<int>"


class _Expect:
    """One pass of Baum-Welch over (anchor, symbols) of training texts: expected counts, summed in the task.

    kind 0: first states; 1: moves from state `at`; 2: states by symbol `at`.  Without a model, the first guess: each
    text stays in the state of its anchor.
    """

    def __init__(self, size: int, model, states: int):
        self.size, self.model, self.states = size, model, states

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = self.model.value if self.model else None
        k, size = self.states, self.size
        first, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
        for b in _several(batches):
            laid = [np.frombuffer(x, "<i4") for x in b.column(1).to_pylist()]
            if not laid:
                continue
            if model is None:
                anchors = b.column(0).to_numpy()
                for at in range(k):
                    own = [laid[i] for i in np.flatnonzero(anchors == at).tolist()]
                    if own:
                        first[at] += len(own)
                        moves[at, at] += sum(map(len, own)) - len(own)
                        emit[:, at] += np.bincount(np.concatenate(own), minlength=size)
                continue
            for _, sizes, steps in _padded(laid):
                alpha, scale, _ = forward(model, sizes, steps)
                f, m, states = expected(model, sizes, steps, alpha, scale)
                first += f
                moves += m
                on = np.arange(len(steps))[:, None] < sizes
                flat, own = steps[on], states[on]
                for i in range(k):
                    emit[:, i] += np.bincount(flat, own[:, i], minlength=size)
        met = np.flatnonzero(emit.sum(axis=1))
        kinds = np.concatenate([[0], np.ones(k), np.full(len(met), 2)]).astype(np.int32)
        at = np.concatenate([[0], np.arange(k), met]).astype(np.int64)
        rows = np.concatenate([first[None], moves, emit[met]])
        e = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(at), e], names=["kind", "at", "e"])


def baum_welch(laid: DataFrame, n_symbols: int, shape: Shape) -> Model:
    """Train on all texts that aren't held out: counts are summed in the tasks, then by symbol; the driver gets K numbers for each."""
    sc, k = laid.sparkSession.sparkContext, shape.states
    model = None
    texts = laid.filter(~F.col("held_out")).select("anchor", "symbols")
    for _ in range(shape.iterations + 1):
        shared = sc.broadcast(model) if model else None
        counts = texts.mapInArrow(_Expect(n_symbols, shared, k), "kind int, at long, e array<double>")
        sums = counts.groupBy("kind", "at").agg(*[F.sum(F.col("e")[i]).alias(f"e{i}") for i in range(k)]).toArrow()
        kind, at = sums.column(0).to_numpy(), sums.column(1).to_numpy()
        e = np.stack([sums.column(2 + i).to_numpy() for i in range(k)], axis=1) if len(kind) else np.zeros((0, k))
        first, moves, emit = np.ones(k), np.full((k, k), 1.0), np.zeros((n_symbols, k))
        first += e[kind == 0].sum(axis=0)
        moves[at[kind == 1]] += e[kind == 1]
        emit[at[kind == 2]] += e[kind == 2]
        emit += 0.01 + 1e-3 * emit.sum(axis=1, keepdims=True)  # no state excludes what another one emits
        model = Model(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


class _Score:
    """The log10 likelihood of each row's symbols."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for b in _several(batches):
            score = np.zeros(b.num_rows)
            for at, sizes, steps in _padded([np.frombuffer(x, "<i4") for x in b.column(b.num_columns - 1).to_pylist()]):
                score[at] = forward(model, sizes, steps)[2] / math.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*b.schema.names[:-1], "score"])


class _Classes:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_class(w) for w in utf8(b.column(0))], pa.int32()), b.column(1)], names=["class", "c"])


def score(docs: DataFrame, shape: Shape | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text).

    Training texts are those whose crc32 of the doc_id as text isn't divisible by 10 (a null doc_id trains).  A null text is
    the empty one and has its end token alone.  Rows that repeat a doc_id are texts of their own.  Without any training
    text N and V are 0 and all words unknown.  An empty table gives no rows.  Other columns are not looked at.

    Word counts are summed over all training texts.  The `head` most frequent words and their counts are broadcast, a
    bounded table; all other words meet their counts in a join by word, after each text's own were counted.
    """
    spark = docs.sparkSession
    shape = shape or Shape()
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    counted = docs.mapInArrow(_Counts(shape.held_out), "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = written(counted, "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"], total["ends"] or 0
    words = counts.filter(F.col("word").isNotNull())
    top = words.orderBy(F.desc("c"), "word").limit(shape.head).toArrow()
    first = 1 + N_CLASSES
    table = {w.encode(): first + i for i, w in enumerate(top.column(0).to_pylist())}
    head = spark.sparkContext.broadcast(table)
    divisor = n + 0.1 * (v + 1)
    own = np.zeros(first + len(table))
    own[0] = math.log10((ends + 0.1) / divisor)
    own[first:] = np.log10((top.column(1).to_numpy() + 0.1) / divisor) if len(table) else 0
    base = spark.sparkContext.broadcast(own)
    laid = written(docs.mapInArrow(_Lay(head, base, shape.states, shape.held_out), _LAID), "laid")
    model = spark.sparkContext.broadcast(baum_welch(laid, first + len(table), shape))
    in_head = F.lit(False)
    if len(table):
        least, last = top.column(1)[-1].as_py(), top.column(0)[-1].as_py()
        in_head = (F.col("c") > least) | ((F.col("c") == least) & (F.col("word") <= last))
    tail = words.filter(~in_head)
    sums = {r["class"]: (r["n"], r["v"]) for r in tail.mapInArrow(_Classes(), "class int, c long").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    divisors = [math.log10(a + 0.1 * (b + 1)) for a, b in (sums.get(c, (0, 0)) for c in range(1, first))]
    asked = laid.select("row", F.explode(F.arrays_zip("rare", "times", "classes")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"), F.col("x.classes").alias("class"))
    c = F.coalesce("c", F.lit(0)) + 0.1
    in_class = F.log10(c) - F.element_at(F.array(*map(F.lit, divisors)), F.col("class"))
    met = asked.join(tail, "word", "left").groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("times") * F.log10(c / divisor)).alias("_base"), F.sum(F.col("times") * in_class).alias("_score"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("_known")
    )
    numbers = laid.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "symbols")
    scored = numbers.mapInArrow(_Score(model), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    slim = scored.join(met, F.col("row") == F.col("_row"), "left")
    more = lambda c, extra: F.col(c) + F.coalesce(extra, F.lit(0))
    return slim.select("doc_id", "held_out", "n_tokens", more("n_known", "_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), more("base", "_base").alias("base_score"), more("score", "_score").alias("score"))
