"""Scoring by a hidden Markov language model.

Words and one end per text are the tokens. Corpus counts cover all training texts: texts are coded in
blocks with block-local word numbers, and only (block, distinct word) pairs are dealt out by word to be
counted and to come back. Counts are 64-bit numbers. Words that make at least ``own_share`` of the training tokens are symbols of
their own (at most 1 / own_share of them, since shares add up to one); a rarer word is its letter class
times its share of the class; a word never seen in training is one unknown symbol. Baum-Welch counts of
every training text are added up across partitions and train the latent states, until the likelihood of a
token hardly grows; the first guess comes from all training texts too, by the signs of their principal components.
The scaled forward recursion gives the exact probability of each text.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hmm
from .common import held_out, materialize, text_of

#: The end of a text; no word contains a space.
END = b" "
#: Letter classes of rare words.
CLASSES = 4096
#: Symbols per row when counts are added up.
CHUNK = 8192
#: Tokens and texts per call of the recursion.
RUN_TOKENS = 250_000
RUN_TEXTS = 4096
#: Places of hashed words, a byte each, whose principal components give the first guess of a text's state.
WIDTH = 256


def letter_class(word: bytes) -> int:
    """Class of a rare word by how it begins and ends."""
    return zlib.crc32(word[:3] + b" " + word[-2:]) % CLASSES


def word_place(word: bytes) -> int:
    """Where the first guess counts a word: by its letters alone, since a symbol's number depends on how rows are dealt out."""
    return zlib.crc32(b"place " + word) % WIDTH


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses better."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _code_blocks(texts: DataFrame, id_type: T.DataType, block_chars: int, buckets: int) -> DataFrame:
    """Rows of two kinds: a block (bucket -1: its documents as local word numbers) and, per bucket of words, the block's distinct words with their training counts."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
        *(T.StructField(c, T.BinaryType()) for c in ("lengths", "held", "tokens", "words", "counts")),
    ])

    names = schema.names

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), itertools.count()

        def block(ids: list[pa.Array], held: list[np.ndarray], runs: list[np.ndarray], words: list[bytes]) -> pa.RecordBatch:
            number = (task << 24) + next(nth)
            lengths = np.array([len(r) for r in runs], "<u4")
            tokens, out = np.concatenate(runs), np.concatenate(held)
            bucket = np.array([zlib.crc32(w) for w in words], np.uint32) % np.uint32(buckets)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens = place[tokens]
            seen = np.bincount(tokens[np.repeat(~out, lengths)], minlength=len(words))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            ordered = [words[i] for i in order.tolist()]
            none = [None] * len(full)
            flat = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(flat)] + [len(flat)] * len(full), pa.int32()), flat, mask=pa.array([False] + [True] * len(full)))
            return pa.RecordBatch.from_arrays([
                pa.array([number] * (len(full) + 1), pa.int64()), pa.array([-1, *full], pa.int32()), lists,
                pa.array([lengths.tobytes(), *none], pa.binary()), pa.array([np.packbits(out).tobytes(), *none], pa.binary()), pa.array([_planes(tokens), *none], pa.binary()),
                pa.array([None, *(b"\n".join(ordered[cuts[b] : cuts[b + 1]]) for b in full)], pa.binary()),
                pa.array([None, *(seen[cuts[b] : cuts[b + 1]].astype("<u4").tobytes() for b in full)], pa.binary()),
            ], names=names)

        def fresh() -> tuple:
            numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
            numbers[END]  # noqa: B018
            return [], [], [], numbers

        ids, held, runs, numbers = fresh()
        size = 0
        for batch in batches:
            texts, out, at = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), 0
            for i, t in enumerate(texts):
                words = t.encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                runs.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(t) + 1
                if size >= block_chars:
                    ids.append(batch.column(0).slice(at, i + 1 - at))
                    held.append(out[at : i + 1])
                    yield block(ids, held, runs, list(numbers))
                    ids, held, runs, numbers = fresh()
                    size, at = 0, i + 1
            if at < len(texts):
                ids.append(batch.column(0).slice(at))
                held.append(out[at:])
        if runs:
            yield block(ids, held, runs, list(numbers))

    return texts.mapInArrow(code, schema)


def _count_words(batches: Iterator[pa.RecordBatch], own_least: float) -> Iterator[pa.RecordBatch]:
    """Per bucket (rows sorted by it): one row per block with code and count of each of its words, and one row (block -1) of totals.

    A code is the word's number among the bucket's own symbols, or -1 - letter class, or -2 ** 30 if training has not seen it.
    """
    names = ["block", "bucket", "codes", "counts", "own", "classes", "distinct", "once", "places"]

    def merged(bucket: int, cells: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        places = []
        for _, words, _ in cells:
            own = words.split(b"\n")
            places.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
        total = np.zeros(len(numbers), np.int64)
        for at, (_, _, seen) in zip(places, cells, strict=True):
            np.add.at(total, at, np.frombuffer(seen, "<u4"))
        codes = np.array([-1 - letter_class(w) for w in numbers], np.int64)
        codes[total == 0] = -(2**30)
        big = total >= own_least
        if END in numbers:
            big[numbers[END]] = True  # texts end, whatever the share
        codes[big] = np.arange(int(big.sum()))
        rare = (total > 0) & ~big
        classes = np.bincount(-1 - codes[rare], total[rare], CLASSES).astype("<i8")
        none = [None] * len(cells)
        return pa.RecordBatch.from_arrays([
            pa.array([-1, *(b for b, _, _ in cells)], pa.int64()), pa.array([bucket] * (len(cells) + 1), pa.int32()),
            pa.array([None, *(codes[at].astype("<i4").tobytes() for at in places)], pa.binary()),
            pa.array([None, *(total[at].astype("<i8").tobytes() for at in places)], pa.binary()),
            pa.array([total[big].astype("<i8").tobytes(), *none], pa.binary()),
            pa.array([[[int(c), int(classes[c])] for c in np.flatnonzero(classes)], *none], pa.list_(pa.list_(pa.int64()))),
            pa.array([int((total > 0).sum()), *none], pa.int64()), pa.array([int((total == 1).sum()), *none], pa.int64()),
            pa.array([bytes(word_place(w) for w in itertools.compress(numbers, big.tolist())), *none], pa.binary()),
        ], names=names)

    now, cells = None, []
    for batch in batches:
        for bucket, block, words, seen in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "words", "counts")), strict=True):
            if bucket != now and cells:
                yield merged(now, cells)
                cells = []
            now = bucket
            cells.append((block, words, seen))
    if cells:
        yield merged(now, cells)


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about RUN_TOKENS tokens each, and at most RUN_TEXTS documents."""
    group = np.cumsum(lengths.astype(np.int64)) // RUN_TOKENS + np.arange(len(lengths)) // RUN_TEXTS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    return ((i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j)


def _block_parts(lengths: bytes, held: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(lengths, "<u4").astype(np.int64)
    return n, np.unpackbits(np.frombuffer(held, np.uint8), count=len(n)).astype(bool), _unplanes(symbols).astype(np.int64)


def _hashed(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text the square roots of its symbols' shares of the WIDTH places."""
    at = np.repeat(np.arange(len(lengths)) * WIDTH, lengths) + places
    return np.sqrt(np.bincount(at, minlength=len(lengths) * WIDTH).reshape(-1, WIDTH) / lengths[:, None])


def _chunks(emit: np.ndarray) -> dict[int, np.ndarray]:
    """Pieces of CHUNK symbols, but those of nothing."""
    return {i: emit[i * CHUNK : (i + 1) * CHUNK].ravel() for i in range(-(-len(emit) // CHUNK)) if emit[i * CHUNK : (i + 1) * CHUNK].any()}


class Corpus:
    """Coded texts and the corpus counts that scores need; all of them written tables or numbers of bounded size."""

    def __init__(self, docs: DataFrame, modulus: int, id_col: str, text_col: str, block_chars: int, own_share: float):
        spark = self.spark = docs.sparkSession
        self.id_type = docs.schema[id_col].dataType
        texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"), held_out(id_col, modulus).alias("held"))
        buckets = max(16, texts.rdd.getNumPartitions())
        coded = materialize(_code_blocks(texts, self.id_type, block_chars, buckets), "coded-blocks")
        cells = coded.where("bucket >= 0").select("bucket", "block", "words", "counts")
        # training tokens, from the counts of the blocks' words
        sums = lambda it: (pa.RecordBatch.from_pydict({"n": pa.array([int(sum(np.frombuffer(c, "<u4").sum(dtype=np.int64) for c in b.column(0).to_pylist()))], pa.int64())}) for b in it)
        self.tokens = int(cells.select("counts").mapInArrow(sums, "n long").agg(F.sum("n")).first()[0] or 0)
        least = max(1.0, own_share * self.tokens)
        counted_form = "block long, bucket int, codes binary, counts binary, own binary, classes array<array<long>>, distinct long, once long, places binary"
        counted = materialize(cells.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _count_words(it, least), counted_form), "counted-words")
        totals = counted.where("block = -1")
        self.distinct, once = (int(x or 0) for x in totals.agg(F.sum("distinct"), F.sum("once")).first())
        own = sorted((r["bucket"], np.frombuffer(r["own"], "<i8"), bytes(r["places"])) for r in totals.where("length(own) > 0").select("bucket", "own", "places").toLocalIterator())
        offsets = np.zeros(buckets + 1, np.int64)
        for b, c, _ in own:
            offsets[b + 1] = len(c)
        offsets = np.cumsum(offsets)[:-1]
        self.n_own = int(sum(len(c) for _, c, _ in own))
        by_class = totals.select(F.explode("classes").alias("c")).groupBy(F.col("c")[0].alias("k")).agg(F.sum(F.col("c")[1]).alias("n"))
        self.class_counts = np.zeros(CLASSES, np.int64)
        for r in by_class.collect():
            self.class_counts[r["k"]] = r["n"]
        #: Symbols: own words, letter classes, the unknown word.
        self.n_symbols = self.n_own + CLASSES + 1
        self.symbol_counts = np.concatenate([*(c for _, c, _ in own), self.class_counts, [0]]).astype(float)
        #: Each symbol's place in the first guess.
        self.places = np.frombuffer(b"".join([*(p for _, _, p in own), bytes(word_place(b"class %d" % c) for c in range(CLASSES + 1))]), np.uint8)
        # Good and Turing: the share of tokens that are new words is that of words seen once
        self.unknown = min(0.5, max(once, 1) / max(self.tokens, 1) if self.tokens else 0.5)
        self.blocks = materialize(self._symbols(coded, counted, offsets, buckets), "symbols")

    def _symbols(self, coded: DataFrame, counted: DataFrame, offsets: np.ndarray, buckets: int) -> DataFrame:
        """One row per block: ids, lengths, held, symbols, and per document n_known, base and the rare words' shares of their classes (log10)."""
        n_own, total, distinct = self.n_own, self.tokens, self.distinct
        class_log = np.log10(np.maximum(self.class_counts, 1))
        names = ["block", "ids", "lengths", "held", "symbols", "known", "base", "rare"]
        schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(self.id_type)), *(T.StructField(c, T.BinaryType()) for c in names[2:])])
        shared = self.spark.sparkContext.broadcast((offsets, class_log))

        def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, logs = shared.value

            def done(block: int, ids: pa.Array, n: bytes, held: bytes, tokens: bytes, cells: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
                code, count = [], []
                for b, c, k in cells:
                    x = np.frombuffer(c, "<i4").astype(np.int64)
                    code.append(np.where(x >= 0, x + first[b], np.where(x == -(2**30), n_own + CLASSES, n_own - 1 - x)))
                    count.append(np.frombuffer(k, "<i8"))
                code, count = np.concatenate(code), np.concatenate(count)
                base = np.log10(count + 1.0) - np.log10(total + distinct + 1.0)
                in_class = (code >= n_own) & (code < n_own + CLASSES)
                rare = np.zeros(len(code))
                rare[in_class] = np.log10(count[in_class]) - logs[code[in_class] - n_own]
                lengths = np.frombuffer(n, "<u4").astype(np.int64)
                at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                local = _unplanes(tokens).astype(np.int64)
                add = lambda x: np.add.reduceat(x[local], at)
                return pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), ids, pa.array([n], pa.binary()), pa.array([held], pa.binary()), pa.array([_planes(code[local])], pa.binary()),
                    pa.array([add((count > 0).astype(np.int64)).astype("<i8").tobytes()], pa.binary()), pa.array([add(base).astype("<f8").tobytes()], pa.binary()), pa.array([add(rare).astype("<f8").tobytes()], pa.binary()),
                ], names=names)

            now, head, cells = None, None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    block, bucket = batch.column("block")[i].as_py(), batch.column("bucket")[i].as_py()
                    if bucket < 0:
                        if now is not None:
                            yield done(now, *head, cells)
                        now, cells = block, []
                        head = (batch.column("ids").slice(i, 1), *(batch.column(c)[i].as_py() for c in ("lengths", "held", "tokens")))
                    else:
                        cells.append((bucket, batch.column("codes")[i].as_py(), batch.column("counts")[i].as_py()))
            if now is not None:
                yield done(now, *head, cells)

        heads = coded.where("bucket < 0").select("block", "bucket", "ids", "lengths", "held", "tokens", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("counts"))
        cells = counted.where("block >= 0").select("block", "bucket", F.lit(None).cast(heads.schema["ids"].dataType).alias("ids"), *(F.lit(None).cast("binary").alias(c) for c in ("lengths", "held", "tokens")), "codes", "counts")
        both = heads.unionByName(cells).repartition(buckets, "block").sortWithinPartitions("block", "bucket")
        return both.mapInArrow(translate, schema)

    def emissions(self, counts: np.ndarray, mix: float) -> np.ndarray:
        """Emission probabilities (symbols, states) from expected counts: each state's own share, mixed with the corpus', and the unknown word's."""
        if not self.tokens:
            out = np.full(counts.shape, 1e-300)
            out[-1] = 1.0
            return out
        background = (self.symbol_counts + 1e-9) / (self.symbol_counts + 1e-9)[:-1].sum()
        own = counts / np.maximum(counts.sum(0), 1e-9)
        out = (1 - self.unknown) * ((1 - mix) * own + mix * background[:, None])
        out[-1] = self.unknown
        return np.maximum(out, 1e-300)

    def _added(self, count: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
        """Sums over all tasks of what ``count`` makes of a task's training texts (symbols, lengths), piece by piece.

        Tasks hand over pieces, which are added up apart from each other; the driver gets the sums.
        """

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    n, held, sym = _block_parts(*row)
                    at = np.concatenate([[0], np.cumsum(n)])
                    for i, j in _runs(n):
                        train = ~held[i:j]
                        if train.any():
                            yield sym[at[i] : at[j]][np.repeat(train, n[i:j])], n[i:j][train]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = count(texts(batches))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(parts), pa.int32()), "c": pa.array([p.astype("<f8").tobytes() for p in parts.values()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(c, "<f8")
                    sums[i] = sums[i] + x if i in sums else x
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "c": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

        partial = self.blocks.select("lengths", "held", "symbols").mapInArrow(part, "chunk int, c binary")
        return {r["chunk"]: np.frombuffer(r["c"], "<f8") for r in partial.repartition("chunk").mapInArrow(add, "chunk int, c binary").collect()}

    def _emit(self, sums: dict[int, np.ndarray], k: int) -> np.ndarray:
        out = np.zeros((self.n_symbols, k))
        for i, x in sums.items():
            if i >= 0:
                out[i * CHUNK : (i + 1) * CHUNK] = x.reshape(-1, k)
        return out

    def seeds(self, states: int) -> np.ndarray:
        """Expected counts to begin with: each training text as a whole in one state, by the signs of its principal components.

        Components are those of all training texts' hashed words (square roots of shares), whose sums of squares
        are a fixed number of values per task.
        """
        some = max(1, (states - 1).bit_length())
        rows = 16  # of the square matrix, in a piece
        shared = self.spark.sparkContext.broadcast(self.places)

        def moments(texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
            n, total, squares = 0, np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))
            for sym, lengths in texts:
                x = _hashed(shared.value[sym], lengths)
                n += len(x)
                total += x.sum(0)
                squares += x.T @ x
            return {-1: np.append(total, n)} | {i: squares[i * rows : (i + 1) * rows].ravel() for i in range(WIDTH // rows)}

        sums = self._added(moments) if self.tokens else {}
        if not sums or not sums[-1][-1]:
            return np.tile(self.symbol_counts[:, None] / states, (1, states))
        n, mean = sums[-1][-1], sums[-1][:-1] / sums[-1][-1]
        squares = np.concatenate([sums[i].reshape(rows, WIDTH) for i in range(WIDTH // rows)])
        axes = np.linalg.eigh(squares / n - np.outer(mean, mean))[1][:, ::-1][:, :some]
        axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(some)])
        border, n_symbols = mean @ axes, self.n_symbols

        def assign(texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
            emit = np.zeros((n_symbols, states))
            for sym, lengths in texts:
                state = ((_hashed(shared.value[sym], lengths) @ axes > border) @ (1 << np.arange(some))) % states
                emit += np.bincount(sym * states + np.repeat(state, lengths), minlength=n_symbols * states).reshape(n_symbols, states)
            return _chunks(emit)

        emit = self._emit(self._added(assign), states)
        shared.unpersist()
        return emit

    def baum_welch(self, model: hmm.Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of all training texts: (symbols, states), moves, starts; and the texts' log-likelihood."""
        shared = self.spark.sparkContext.broadcast(model)
        k, n_symbols = len(model.start), self.n_symbols

        def expect(texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
            m = shared.value
            emit, moves, starts, likelihood = np.zeros((n_symbols, k)), np.zeros((k, k)), np.zeros(k), 0.0
            for sym, lengths in texts:
                used, c, mv, st, ll = hmm.counts(sym, lengths, m)
                emit[used] += c
                moves += mv
                starts += st
                likelihood += ll
            return {-1: np.concatenate([moves.ravel(), starts, [likelihood]])} | _chunks(emit)

        sums = self._added(expect)
        shared.unpersist()
        last = sums[-1]
        return self._emit(sums, k), last[: k * k].reshape(k, k), last[k * k : -1], float(last[-1])

    def score(self, model: hmm.Model) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        shared = self.spark.sparkContext.broadcast(model)
        total = self.tokens
        schema = T.StructType([
            T.StructField("doc_id", self.id_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
            *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score")),
        ])

        def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("lengths", "held", "symbols", "known", "base", "rare")}
                    n, held, sym = _block_parts(row["lengths"], row["held"], row["symbols"])
                    at = np.concatenate([[0], np.cumsum(n)])
                    log = np.concatenate([hmm.log_likelihood(sym[at[a] : at[b]], n[a:b], m) for a, b in _runs(n)]) / np.log(10) + np.frombuffer(row["rare"], "<f8")
                    yield pa.RecordBatch.from_arrays([
                        batch.column("ids").slice(i, 1).flatten(), pa.array(held), pa.array(n, pa.int64()), pa.array(np.frombuffer(row["known"], "<i8")),
                        pa.array(np.full(len(n), total), pa.int64()), pa.array(np.frombuffer(row["base"], "<f8")), pa.array(log),
                    ], names=schema.names)

        return self.blocks.select("ids", "lengths", "held", "symbols", "known", "base", "rare").mapInArrow(forward, schema)


def train(corpus: Corpus, states: int = 4, tolerance: float = 0.01, mix: float = 0.1) -> tuple[hmm.Model, list[float]]:
    """The model, and the log-likelihood of a training token (natural logarithm) in each round.

    Baum-Welch over every training text, from :meth:`Corpus.seeds`, until a round gains less than ``tolerance`` a
    token; likelihoods are bounded, so that comes.
    """
    emit = corpus.seeds(states)
    move = np.full((states, states), 0.02 / states) + np.eye(states) * 0.98
    start, rounds = np.full(states, 1 / states), []
    while corpus.tokens:
        emit, moves, starts, likelihood = corpus.baum_welch(hmm.Model(start, move, corpus.emissions(emit, mix)))
        move = (moves + 1e-3) / (moves + 1e-3).sum(1, keepdims=True)
        start = (starts + 1e-3) / (starts + 1e-3).sum()
        rounds.append(likelihood / corpus.tokens)
        if len(rounds) > 1 and rounds[-1] - rounds[-2] < tolerance:
            break
    return hmm.Model(start, move, corpus.emissions(emit, mix)), rounds


def score_texts(docs: DataFrame, modulus: int = 7, states: int = 4, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4_000_000, own_share: float = 2e-6) -> DataFrame:
    """Score every text by a model of those whose crc32(id as text) mod ``modulus`` is not 2.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-one unigram) and score (log10 probability by the hidden Markov model).

    Null texts are empty and have the end alone; a null id counts as the id ''. Repeated rows count each.
    Texts are whole, however long. Without training texts every word is unknown. Columns besides the two are
    not read. An empty table gives no rows.
    """
    corpus = Corpus(docs, modulus, id_col, text_col, block_chars, own_share)
    return corpus.score(train(corpus, states, tolerance)[0])
