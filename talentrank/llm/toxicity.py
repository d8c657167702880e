"""Toxicity by weak supervision.

Many voters look at each text: a fixed lexicon, words and word beginnings found in a bounded sample of
labelled texts (in tiers of reliability) and writing patterns. A generative label model over all texts'
votes, with a latent class, estimates how each voter behaves per class and which voters go together (a
tree of dependences), by expectation maximization. Its posterior labels train a linear classifier.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialize, text_of, with_row_ids, without
from .ngram_join import Shingler

#: Common insults of four languages, whole words.
LEXICON = frozenset("""
    bastard bitch bloody clown creep crap cretin damn degenerate disgusting dumb dumbass filth filthy fool
    freak garbage hate idiot idiotic imbecile jerk kill loser lowlife moron moronic nasty pathetic pig pervert
    retard scum scumbag shit shut slut stupid sucker trash ugly vermin vile whore worthless
    abruti abrutie conne connard connasse crétin crétine débile dégueulasse enculé imbécile merde pourriture putain salaud salope taré vermine
    abschaum arsch arschloch blöd bastarde drecksau dumm dummkopf fotze hässlich hurensohn idioten missgeburt scheiße schlampe schwachkopf trottel widerlich wichser
    asqueroso bastardo cabrón estúpida estúpido gilipollas hijoputa idiota imbécil mierda maldito maldita pendejo puta puto subnormal tarado zorra
""".split())  # fmt: skip
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"!!|\?!|!\?")
#: Lengths of word beginnings.
STEMS = range(3, 8)
VOTERS = ("lexicon", "words_high", "words_mid", "stems_high", "stems_good", "stems_fair", "terms_weak", "shouting", "marks")
#: Terms that a task counts before it hands them on.
HELD_TERMS = 150_000
#: Votes are counts 0, 1, 2 or 3 and more, so there are at most 4 ** 9 vote patterns.
LEVELS = 4


def terms_of(text: str) -> set[str]:
    """Words (=word) and beginnings of longer words (^stem) of a text."""
    words = set(_WORD.findall(text.lower()))
    return {f"={w}" for w in words} | {f"^{w[:k]}" for w in words for k in STEMS if len(w) > k}


def tier(term: str, precision: float) -> int:
    """The voter that a found term belongs to."""
    if precision < 0.65:
        return 6
    if term[0] == "=":
        return 1 if precision >= 0.9 else 2
    return 3 if precision >= 0.9 else 4 if precision >= 0.8 else 5


class Votes:
    """Votes of one text. ``terms``: found terms with their precision."""

    def __init__(self, terms: dict[str, float], remember: int = 300_000):
        self.terms, self.known, self.remember = terms, {}, remember

    def _voter(self, word: str) -> int:
        if word in LEXICON:
            return 0
        best = max([(self.terms.get(f"={word}", 0.0), f"={word}"), *((self.terms.get(f"^{word[:k]}", 0.0), f"^{word[:k]}") for k in STEMS if len(word) > k)])
        return tier(best[1], best[0]) if best[0] else -1

    def __call__(self, text: str) -> list[int]:
        out = [0] * len(VOTERS)
        words = _WORD.findall(text.lower())
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for w, n in Counter(words).items():
            v = known.get(w)
            if v is None:
                v = known[w] = self._voter(w)
            if v >= 0:
                out[v] += n
        big = sum(len(w) > 1 and w.isupper() for w in _WORD.findall(text)) if sum(map(text.count, "AEIOU")) * 20 > len(text) else 0
        out[7] = 0 if len(words) < 5 else int(3 * big / len(words))
        out[8] = len(_MARKS.findall(text))
        return [min(LEVELS - 1, v) for v in out]


def find_terms(docs: DataFrame, labels: DataFrame, sample_toxic: int, sample_clean: int, max_terms: int, discovery: float, least_precision: float) -> dict[str, float]:
    """Terms that mark toxic texts: term -> precision (shrunk to the prior), from a bounded sample of labelled rows.

    Near copies in the sample would make any of their words look telling, so of texts that share one of three
    min-hashes one stays. Terms are tested against independence by their log-likelihood ratio (one degree of freedom), all at
    once: of those that are taken, ``discovery`` are expected to be chance (Benjamini and Hochberg's rule).
    """
    known = labels.where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    wanted = pick(1, sample_toxic).unionByName(pick(0, sample_clean))
    sample = materialize(docs.select("doc_id", "t").join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "t"), "toxic-sample")  # at most sample_toxic + sample_clean ids

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(3)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                s = shingle(t)
                with np.errstate(over="ignore"):
                    rows.append([int((s * np.uint64(k) >> np.uint64(1)).min()) if len(s) else 0 for k in (1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=["doc_id", "m0", "m1", "m2"])

    form = T.StructType([sample.schema["doc_id"], *(T.StructField(f"m{k}", T.LongType()) for k in range(3))])
    alone = sample.select("doc_id", "t").mapInArrow(hashes, form)
    for k in range(3):
        alone = alone.groupBy(f"m{k}").agg(*(F.min_by(c, F.struct(F.xxhash64("doc_id"), "doc_id")).alias(c) for c in ("doc_id", *(f"m{j}" for j in range(3) if j != k))))
    kept = sample.join(alone.select("doc_id"), "doc_id", "left_semi").select("y", "t")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(clean.keys() | toxic.keys())
            out = pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "clean": pa.array([clean[w] for w in names], pa.int64()), "toxic": pa.array([toxic[w] for w in names], pa.int64())})
            clean.clear()
            toxic.clear()
            return out

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = toxic if y else clean
                seen.update(terms_of(t))
                seen[""] += 1  # the number of texts
                if len(clean) + len(toxic) > HELD_TERMS:  # parts of a sum add up as well
                    yield counted()
        yield counted()

    terms = materialize(kept.mapInArrow(frequencies, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("n"), F.sum("toxic").alias("p")).where("p >= 4 or term = ''"), "toxic-terms")
    whole = terms.where("term = ''").first()
    if whole is None or not whole["p"] or not whole["n"]:
        return {}
    all_p, all_n = whole["p"], whole["n"]
    share = all_p / (all_p + all_n)
    k = F.col("p") + F.col("n")
    xlog = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    gain = 2 * (xlog(F.col("p"), k * share) + xlog(F.col("n"), k * (1 - share)) + xlog(all_p - F.col("p"), all_p - k * share) + xlog(all_n - F.col("n"), all_n - k * (1 - share)))
    precision = (F.col("p") + 8 * share) / (k + 8)
    tested = terms.where("term <> ''").where(F.col("p") > k * share).withColumn("gain", gain).withColumn("precision", precision)
    number = tested.count()
    best = tested.orderBy(F.desc("gain"), "term").limit(max_terms).select("term", "gain", "precision").collect()
    chance = [2 * (1 - NormalDist().cdf(math.sqrt(max(r["gain"], 0.0)))) for r in best]
    last = max((i + 1 for i, x in enumerate(chance) if x <= (i + 1) * discovery / max(number, 1)), default=0)
    return {r["term"]: float(r["precision"]) for r in best[:last] if r["precision"] > least_precision}


class LabelModel:
    """p(class) and p(vote | parent's vote, class) on a tree of voters, by expectation maximization over vote patterns."""

    def __init__(self, patterns: np.ndarray, weight: np.ndarray, known: np.ndarray, tolerance: float = 1e-6):
        """patterns (n, voters) of levels, weights, and known: 0, 1 or -1 (latent). Rounds end when one gains less than ``tolerance`` of log-likelihood per text."""
        m = patterns.shape[1]
        # first guess: texts with reliable votes
        q = np.where(known >= 0, known, np.where((patterns[:, [0, 1, 3]].sum(1) >= 2), 0.9, 0.02)).astype(float)
        self.likelihoods: list[float] = []
        while len(self.likelihoods) < 2 or self.likelihoods[-1] - self.likelihoods[-2] > tolerance:
            w = np.stack([weight * (1 - q), weight * q], 1)
            self.prior = (w.sum(0) + 1) / (w.sum() + 2)
            joint = lambda a, b: np.stack([np.bincount(patterns[:, a] * LEVELS + patterns[:, b], w[:, y], LEVELS * LEVELS).reshape(LEVELS, LEVELS) for y in (0, 1)])
            gain = np.zeros((m, m))
            for a in range(m):
                for b in range(a):
                    p = joint(a, b) + 0.01
                    rows, cols, total = p.sum(2, keepdims=True), p.sum(1, keepdims=True), p.sum((1, 2), keepdims=True)
                    gain[a, b] = gain[b, a] = (p * np.log(p * total / (rows * cols))).sum() / p.sum()
            self.parent, inside = [-1] * m, {0}
            while len(inside) < m:  # the tree of the largest dependences within classes
                b, a = max(((b, a) for a in inside for b in range(m) if b not in inside), key=lambda x: (gain[x], -x[0], -x[1]))
                self.parent[b] = a
                inside.add(b)
            self.dependence = gain
            self.tables = []
            for j in range(m):
                p = joint(self.parent[j], j) + 0.05 if self.parent[j] >= 0 else np.repeat(np.stack([np.bincount(patterns[:, j], w[:, y], LEVELS) for y in (0, 1)])[:, None, :] + 0.05, LEVELS, 1)
                self.tables.append(p / p.sum(2, keepdims=True))
            log = self.log_joint(patterns)
            top = log.max(1)
            seen = np.where(known >= 0, log[np.arange(len(log)), np.maximum(known, 0)], top + np.log(np.exp(log - top[:, None]).sum(1)))
            self.likelihoods.append(float((weight * seen).sum() / weight.sum()))
            q = np.where(known >= 0, known, self.posterior(patterns))

    def log_joint(self, patterns: np.ndarray) -> np.ndarray:
        """log p(class, votes) per pattern and class."""
        log = np.tile(np.log(self.prior), (len(patterns), 1))
        for j, table in enumerate(self.tables):
            above = patterns[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(patterns), int)
            log += np.log(table[:, above, patterns[:, j]]).T
        return log

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = self.log_joint(patterns)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Per voter: share of its votes (level above 0) that fall on toxic texts."""
        out = []
        for j, table in enumerate(self.tables):
            if self.parent[j] < 0:
                on = 1 - table[:, 0, 0]
            else:
                a = self.parent[j]
                up = self.tables[a].mean(1)
                on = 1 - (up * table[:, :, 0]).sum(1)
            out.append(self.prior[1] * on[1] / max(self.prior @ on, 1e-12))
        return np.array(out)


def one_hot(patterns: np.ndarray) -> np.ndarray:
    """Bias, then per voter whether it has at least 1, 2, 3 votes."""
    return np.concatenate([np.ones((len(patterns), 1)), *(patterns >= k for k in range(1, LEVELS))], 1).astype(float)


def fit_linear(patterns: np.ndarray, weight: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic classifier on soft labels, by Newton steps."""
    x = one_hot(patterns)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - penalty * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def linear_score(w: np.ndarray, columns: list[str]) -> Column:
    total = F.lit(float(w[0]))
    for j, c in enumerate(columns):
        table = np.cumsum([0.0, *(float(w[1 + (k - 1) * len(columns) + j]) for k in range(1, LEVELS))])
        total = total + F.element_at(F.array(*[F.lit(float(x)) for x in table]), F.col(c).cast("int") + 1)
    return 1 / (1 + F.exp(-total))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = 4000, sample_clean: int = 8000, max_terms: int = 5000, discovery: float = 0.01, least_precision: float = 0.3, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= ``threshold``) and the votes, for every document.

    Labels count only where crc32(id as text) mod ``modulus`` is not 2. Terms come from at most
    ``sample_toxic`` + ``sample_clean`` labelled texts; votes, label model and classifier cover all texts.
    Null and empty texts have no votes and the score of that. Documents without a label, repeated rows and
    null ids are scored alike; of repeated labels the larger counts. With no labels the lexicon and patterns
    vote alone. Columns besides those named are not read, but for ``carry``, a column that is passed on. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"), *([F.col(carry)] if carry else []))
    known = labels.select(F.col(id_col).alias("doc_id"), F.when(F.col(label_col) > 0, 1).when(F.col(label_col) <= 0, 0).alias("y")).where(~held_out("doc_id", modulus))
    found = find_terms(rows, known, sample_toxic, sample_clean, max_terms, discovery, least_precision)
    shared = spark.sparkContext.broadcast(found)  # at most max_terms short strings
    names = [f"v{j}" for j in range(len(VOTERS))]
    kept = ["doc_id", *([carry] if carry else [])]
    form = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, T.ByteType()) for c in names)])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(shared.value)
        for b in batches:
            v = np.array([votes(t) for t in b.column("t").to_pylist()], np.int8).reshape(-1, len(VOTERS))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(v[:, j]) for j in range(len(VOTERS)))], names=form.names)

    voted = materialize(rows.mapInArrow(vote, form), "votes")
    each = known.where("y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    patterns = voted.join(each, "doc_id", "left").groupBy(*names, "y").agg(F.count("*").alias("n")).toPandas()
    if not len(patterns):
        return voted.select(*kept, F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *names)
    x, n = patterns[names].to_numpy(np.int64), patterns["n"].to_numpy(float)
    y = patterns["y"].fillna(-1).to_numpy(np.int64)
    weight = np.where(y >= 0, 4.0, 1.0) * n
    model = LabelModel(x, weight, y)
    # the classifier learns from posterior labels; a seen label moves its pattern's posterior, it doesn't replace it
    q = model.posterior(x)
    target = np.where(y >= 0, 0.5 * q + 0.5 * y, q)
    w = fit_linear(x, weight, target)
    score = linear_score(w, names)
    scored = voted.select(*kept, held_out("doc_id", modulus).alias("held_out"), score.alias("score"), *names)
    return scored.select(*kept, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *names)


def toxicity_filter(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, each judged by its own text, all columns unchanged."""
    held, row = with_row_ids(docs, "toxicity-input")
    toxic = score_toxicity(held, labels, carry=row, **settings).where("predicted = 1").select(row)
    return without(held, toxic, row).select(*docs.columns)
