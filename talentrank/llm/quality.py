"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame functions only.

Statistics of each text are transformed into a short vector. Per language and source the share of rows
whose covariance has the least determinant is searched for: from several deterministic starts,
concentration steps (rows are ranked by distance, the nearest share gives the next mean and covariance) go on
until no determinant falls any more, and the start with the least one stays. A consistency factor makes
its covariance that of normal rows, one reweighting step takes in all rows that are not outliers, and rows whose
squared Mahalanobis distance is beyond a chi-square quantile are rejected, besides those that fail fixed base rules.

A step is one pass: moments are added up per group and narrow band of distances, so the share's border and
the next centre come from the same small table, whatever the size of a group and however rows are dealt out.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of, with_row_ids, without

#: Components of the vector, and the least standard deviation that a group counts with: spread below it is never an outlier.
FLOORS = {"log_words": 0.7, "word_length": 0.45, "symbols": 0.06, "dup_lines": 0.09, "repeats": 0.13}
DIMS = list(FLOORS)
K = len(DIMS)
WHITE = " \t\n\x0b\x0c\r"
PAIRS = [(i, j) for i in range(K) for j in range(i + 1)]
#: Rows that every group is imagined to have besides its own, with the floors' spread: they count in small groups only.
PRIOR_ROWS = 5
#: Bands of squared distances per doubling; a share of rows is rounded up to whole bands.
BANDS = 16
#: Bins per floor for medians and quartiles, and the number of bins on either side of 0 (what lies beyond counts in the last).
BINS, MOST_BINS = 16, 1 << 16


def chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    """Chi-square quantile, by bisection."""
    low, high = 0.0, 1.0
    while chi2_cdf(high, d) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal rows that of all of them."""
    d = K
    return share / chi2_cdf(chi2_quantile(share, d), d + 2)


def statistics(text: Column) -> dict[str, Column]:
    """Words, lines with a word, and symbols of one text, all of it, as native columns; see :func:`with_statistics`."""
    inside = F.btrim(text, F.lit(WHITE))
    return {
        "words": F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, r"[\x20\x09-\x0D]+")),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    }


def _windows_by_text(words: Column) -> Column:
    """Places of the 3-word windows found twice or more, by sorting the windows' texts."""
    n = F.size(words)
    windows = F.transform(F.slice(words, 1, n - 2), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    ordered = F.sort_array(windows)
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    return F.filter(F.transform(ordered, lambda x, k: F.when(same(x, F.get(ordered, k + 1)) | same(x, F.get(ordered, k - 1)), x["i"])), lambda i: i.isNotNull())


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words to rows with ``words``: how many lie in a 3-word window found twice or more.

    A window is one number, its hash with its place in the low bits, so sorting numbers brings equal windows
    together, and neighbours of equal hash are compared by their words. Should any of them differ, the text's
    windows are sorted as texts instead.
    """
    n = F.size("words")
    word = lambda at: F.get(F.col("words"), at)
    place_mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + 2)).cast("int")) - 1
    rows = rows.withColumn("_place", place_mask).withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    hashed = lambda i: F.get(F.col("_hashes"), i)
    keys = F.transform(F.slice("_hashes", 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, hashed(i + 1), hashed(i + 2)).bitwiseAND(F.bitwise_not("_place")).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("_keys", F.sort_array(keys))
    at = lambda key: key.bitwiseAND(F.col("_place")).cast("int")
    # per window and its successor: 0 other hash, 1 equal, 2 equal hash of other words
    after = lambda k: F.get(F.col("_keys"), k + 1)
    equal = lambda p, q: (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))
    step = lambda x, k: F.when(F.coalesce(x.bitwiseXOR(after(k)) > F.col("_place"), F.lit(True)) | (x.bitwiseXOR(after(k)) < 0), 0).when(equal(at(x), at(after(k))), 1).otherwise(2)
    rows = rows.withColumn("_same", F.transform("_keys", step))
    known = F.transform(F.filter(F.transform("_keys", lambda x, k: F.when((F.get("_same", k) == 1) | (F.coalesce(F.get("_same", k - 1), F.lit(0)) == 1), x)), lambda x: x.isNotNull()), at)
    found = F.when(~F.array_contains("_same", 1) & ~F.array_contains("_same", 2), F.array().cast("array<int>")).when(F.array_contains("_same", 2), _windows_by_text(F.col("words"))).otherwise(known)
    rows = rows.withColumn("_found", found)
    covered = F.size(F.array_distinct(F.concat("_found", F.transform("_found", lambda i: i + 1), F.transform("_found", lambda i: i + 2))))
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("_place", "_hashes", "_keys", "_same", "_found")


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the group columns as text, the counts, base_failed and the transformed vector. One narrow pass over whole texts."""
    have = set(docs.columns)
    groups = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(f"g{i}") for i, c in enumerate(group_cols)]
    a = docs.select(F.col(id_col).alias("doc_id"), *groups, text_of(text_col).alias("_text"))
    a = a.select("doc_id", *[f"g{i}" for i in range(len(groups))], *[c.alias(k) for k, c in statistics(F.col("_text")).items()])
    counts = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    }
    a = with_repeated_words(a.withColumns(counts).drop("lines")).drop("words")
    n = F.greatest(F.col("n_words"), F.lit(1))
    vector = {
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / n,
        "symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / n),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return a.select("*", failed.alias("base_failed"), *[v.alias(k) for k, v in vector.items()])


def _sums() -> list[Column]:
    """Moments that add up: n, and sums of components and of their products."""
    return [F.count("*").alias("n"), *[F.sum(d).alias(f"x{i}") for i, d in enumerate(DIMS)], *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"y{i}{j}") for i, j in PAIRS]]


SUMS = ["n", *(f"x{i}" for i in range(K)), *(f"y{i}{j}" for i, j in PAIRS)]


def _full(entry) -> Column:
    """A symmetric matrix as an array of its rows, from what gives entry (i, j), i >= j."""
    return F.array(*[entry(max(i, j), min(i, j)) for i in range(K) for j in range(K)])


def _moments(sums: DataFrame, by: list[str]) -> DataFrame:
    """n, mean ``m`` and covariance ``s`` (arrays) from moments that add up."""
    mean = [F.col(f"x{i}") / F.col("n") for i in range(K)]
    return sums.select(*by, "n", F.array(*mean).alias("m"), _full(lambda i, j: F.col(f"y{i}{j}") / F.col("n") - mean[i] * mean[j]).alias("s"))


def _precision(moments: DataFrame, by: list[str], factor: float) -> DataFrame:
    """n, ``m``, ``p`` (inverse of the regularized covariance) and its ``logdet``, by sweeping the matrix once per component.

    The covariance is ``factor`` times the rows' own, with PRIOR_ROWS imagined ones, and with the floors added to the variances.
    """
    own = F.col("n") / (F.col("n") + PRIOR_ROWS)
    floors = F.array(*[F.lit(FLOORS[DIMS[i]] ** 2 if i == j else 0.0) for i in range(K) for j in range(K)])
    matrix = F.zip_with("s", floors, lambda s, f: own * factor * s + (2 - own) * f)

    def sweep(state: Column, t: Column) -> Column:
        p = state["p"]
        pivot = F.greatest(F.get(p, t * (K + 1)), F.lit(1e-12))

        def swept(x: Column, e: Column) -> Column:
            i, j = F.floor(e / K).cast("int"), e % K
            other = x - F.get(p, i * K + t) * F.get(p, t * K + j) / pivot
            return F.when((i == t) & (j == t), 1 / pivot).when(i == t, x / pivot).when(j == t, -x / pivot).otherwise(other)

        return F.struct(F.transform(p, swept).alias("p"), (state["logdet"] + F.log(pivot)).alias("logdet"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(K - 1)), F.struct(matrix.alias("p"), F.lit(0.0).alias("logdet")), sweep)
    return moments.select(*by, "n", "m", done.alias("done")).select(*by, "n", "m", "done.p", "done.logdet")


def _distance() -> Column:
    x = [F.col(d) - F.get("m", F.lit(i)) for i, d in enumerate(DIMS)]
    return reduce(add, [(1 if i == j else 2) * F.get("p", F.lit(i * K + j)) * x[i] * x[j] for i, j in PAIRS])


def _quartiles(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group the quartiles a0, b0 (median), c0, a1 ..: middles of fine bins, from a histogram, so the dealing of rows doesn't matter."""
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.greatest(F.least(F.floor(F.col(d) / (FLOORS[d] / BINS)), F.lit(MOST_BINS)), F.lit(-MOST_BINS)).alias("bin")) for i, d in enumerate(DIMS)]))
    counted = rows.select(*by, bins.alias("b")).groupBy(*by, F.col("b.dim").alias("dim"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("k"))
    every = Window.partitionBy(*by, "dim")
    counted = counted.withColumn("upto", F.sum("k").over(every.orderBy("bin"))).withColumn("n", F.sum("k").over(every))
    place = lambda i, q: ((F.min(F.when((F.col("dim") == i) & (F.col("upto") >= q * F.col("n")), F.col("bin"))) + 0.5) * (FLOORS[DIMS[i]] / BINS))
    return counted.groupBy(*by).agg(*[place(i, q).alias(f"{name}{i}") for i in range(K) for name, q in (("a", 0.25), ("b", 0.5), ("c", 0.75))])


def _starts(rows: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Deterministic starts per group: quartile spreads alone, covariances of squashed components, of rows drawn in to the unit sphere, and of all rows."""
    spread = {f"w{i}": F.sqrt(F.pow((F.col(f"c{i}") - F.col(f"a{i}")) / 1.349, F.lit(2)) + FLOORS[DIMS[i]] ** 2) for i in range(K)}
    quart = materialize(_quartiles(rows, by).withColumns(spread), "quartiles")
    scaled = rows.join(quart, by).withColumns({f"z{i}": (F.col(DIMS[i]) - F.col(f"b{i}")) / F.col(f"w{i}") for i in range(K)})
    norm = F.sqrt(reduce(add, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(K)]) / K)
    scaled = scaled.withColumn("norm", F.greatest(norm, F.lit(1.0)))
    squashed = [F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in PAIRS]
    drawn = [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") / F.col("norm")).alias(f"r{i}{j}") for i, j in PAIRS]
    found = materialize(scaled.groupBy(*by).agg(*_sums(), *squashed, *drawn).join(quart, by), "starts")
    medians = F.array(*[F.col(f"b{i}") for i in range(K)]).alias("m")
    scale = lambda i, j: F.col(f"w{i}") * F.col(f"w{j}")
    own = [lambda i, j: scale(i, j) if i == j else F.lit(0.0), lambda i, j: F.col(f"t{i}{j}") * scale(i, j), lambda i, j: F.col(f"r{i}{j}") * scale(i, j)]
    kinds = [*(found.select(*by, "n", medians, _full(entry).alias("s")) for entry in own), _moments(found, by)]
    kinds = [f.withColumn("start", F.lit(i)) for i, f in enumerate(kinds)]
    return _precision(reduce(DataFrame.unionByName, kinds), [*by, "start"], factor).withColumn("logdet", F.lit(math.inf))


def mcd_centres(rows: DataFrame, by: list[str], support: float = 0.75) -> DataFrame:
    """Minimum-covariance-determinant centre per group: ``by``, n (rows in the share), ``m`` (mean), ``p`` (precision, row by row), ``logdet``.

    Concentration steps go on until no start of any group lowers its determinant, which ends as shares are
    finite; of the starts the least determinant stays (ties: the first start). A group of any size is added up in
    parts; a small one is defined too, by its own rows and the imagined ones of :func:`_precision`.
    """
    factor, key = consistency(support), [*by, "start"]
    moving = materialize(_starts(rows, by, factor), "centres")
    steps = [moving]
    while True:
        near = rows.join(moving.select(*key, "m", "p"), by).withColumn("band", F.floor(BANDS * F.log2(_distance() + 1e-6)))
        banded = near.groupBy(*key, "band").agg(*_sums())
        whole = Window.partitionBy(*key)
        banded = banded.withColumn("upto", F.sum("n").over(whole.orderBy("band"))).withColumn("all", F.sum("n").over(whole))
        banded = banded.where(F.col("upto") - F.col("n") < F.ceil(support * F.col("all")))
        fresh = _precision(_moments(banded.groupBy(*key).agg(*[F.sum(c).alias(c) for c in SUMS]), key), key, factor)
        fresh = materialize(fresh.join(moving.select(*key, F.col("logdet").alias("before")), key), "centres")
        moving = fresh.where(F.col("logdet") < F.col("before") - 1e-9).drop("before")
        if moving.isEmpty():
            break
        steps.append(moving)
    columns = ["n", "m", "p", "logdet"]
    best = reduce(DataFrame.unionByName, steps)
    return best.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct("logdet", "start")).alias("c")).select(*by, *[F.col(f"c.{c}").alias(c) for c in columns])


def reweighted(rows: DataFrame, centres: DataFrame, by: list[str], share: float = 0.975) -> DataFrame:
    """Means and precisions of the rows within the chi-square quantile ``share`` of the robust centres."""
    near = rows.join(centres.select(*by, "m", "p"), by).where(_distance() <= chi2_quantile(share, K))
    return _precision(_moments(near.groupBy(*by).agg(*_sums()), by), by, consistency(share))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), support: float = 0.75, tail: float = 0.0005) -> DataFrame:
    """One row per document: doc_id, counts, ``base_failed``, ``distance2`` and ``kept``.

    ``kept`` is false if a base rule fails, else whether the squared Mahalanobis distance from the robust
    centre of its language and source is at most the chi-square quantile that ``tail`` of normal rows exceed.
    Centres are learnt from rows that pass the base rules, per group, whatever its size: a group of few rows
    has the covariance of its own rows shrunk towards a fixed one, and a single row is its own centre.

    Null and empty texts have no words: base_failed. Null group values form a group, as empty ones. Repeated rows count each.
    An empty table gives no rows. Columns besides those named are not read. Long texts are taken whole.
    """
    rows = materialize(with_statistics(docs, id_col, text_col, group_cols), "statistics")
    keys = [f"g{i}" for i in range(len(group_cols))]
    good = rows.where(~F.col("base_failed")).select(*keys, *DIMS)
    centres = materialize(reweighted(good, mcd_centres(good, keys, support), keys), "centres")
    scored = rows.join(centres.select(*keys, "m", "p"), keys, "left").withColumn("distance2", _distance())
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= chi2_quantile(1 - tail, K))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "distance2")


def quality_filter(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, each judged by its own text, all columns unchanged."""
    held, row = with_row_ids(docs, "quality-input")
    rejected = judge_quality(held, id_col=row, **settings).where("not kept").select(F.col("doc_id").alias(row))
    return without(held, rejected, row).select(*docs.columns)
