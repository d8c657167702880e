"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k = error_rate * m edits. Cut into k + 1 pieces,
at least one piece of it occurs unchanged in such a passage. One automaton finds all pieces of all items
in one pass over a text; each hit places the item, and Myers' bit-parallel recursion gives the exact least
edit distance of the item to any passage there.

Texts and items are compared as lower-cased runs of word characters with one space around each, so case,
punctuation and line breaks cost no edits and short items match whole words only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of, with_row_ids, without

_WORDS = re.compile(r"\w+")
#: Characters of items that are matched in one pass; more items are matched block by block.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Words lower-cased, a space around each; '' without words."""
    words = " ".join(_WORDS.findall(text)).lower()
    return f" {words} " if words else ""


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """``errors`` + 1 pieces (start, end) of nearly equal length, at most one per character."""
    n = min(errors + 1, length)
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring, end of the first such substring).

    The columns of the distance table are two bit vectors of vertical differences, one bit per pattern
    character, held in one integer however long the pattern is.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | ~(diagonal | up) & every
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        right_up = right_up << 1 & every  # a match may begin anywhere: row 0 stays 0
        right_down = right_down << 1 & every
        up = right_down | ~(diagonal | right_up) & every
        down = right_up & diagonal
    return best, end


class Matcher:
    """Finds items in texts. ``items``: (key, normalized item) pairs."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(key, item, int(error_rate * len(item))) for key, item in items if item]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item, errors) in enumerate(self.items):
            for i, j in pieces(len(item), errors):
                at.setdefault(item[i:j], []).append((n, j))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, places)
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item key, distance, start, end) of the best passage per item found in a normalized text."""
        if self.empty or not text:
            return []
        starts: dict[int, set[int]] = {}
        for last, places in self.automaton.iter(text):
            for n, j in places:
                starts.setdefault(n, set()).add(last + 1 - j)
        found = []
        for n, begins in starts.items():
            key, item, errors = self.items[n]
            best = None
            done = -1
            windows: list[list[int]] = []
            for b in sorted(begins):
                low, high = max(0, b - errors), min(len(text), b + len(item) + errors)
                if windows and low <= windows[-1][1] - len(item):  # nearly the same place
                    windows[-1][1] = max(windows[-1][1], high)
                else:
                    windows.append([low, high])
            for low, high in windows:
                if high - low + errors < len(item) or high <= done:
                    continue
                distance, end = myers(item, text[low:high])
                if distance <= errors and (best is None or distance < best[0]):
                    best = (distance, low + end)
                    if not distance:
                        break
            if best:
                distance, end = best
                back = myers(item[::-1], text[max(0, end - len(item) - errors) : end][::-1])[1]
                found.append((key, distance, end - back, end))
        return found


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The places in the text of the words that a span of its normalized form touches."""
    at, first, last = 1, None, 0
    for m in _WORDS.finditer(text):
        length = len(m[0].lower())
        if at + length > start and at < end:
            first = m.start() if first is None else first
            last = m.end()
        at += length + 1
    return (first or 0), last


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, ``distance`` (edits of the best passage, at
    most ``error_rate`` of the item's normalized length, rounded down), ``match_start``, ``match_end``
    (characters of the text).

    Every text is searched whole for every item. Items without a word match nothing, as do null or empty
    texts. Repeated rows give repeated matches; items with null keys keep the null. Columns besides those
    named are not read. An empty table on either side gives no rows.

    Items are broadcast in blocks of at most ``BLOCK_CHARS`` characters; each block is one narrow pass over
    the documents, so nothing is shuffled and no block grows with the benchmark.
    """
    spark = docs.sparkSession
    keyed = benchmark.select(F.col(item_col).alias("item_id"), text_of(item_text_col).alias("item"))
    chars = keyed.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("nth", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("distance", "match_start", "match_end"))])
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    out = None
    for block in range(blocks):
        own = keyed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else keyed
        rows = own.collect()
        found = _search(spark, texts, [normal(r["item"]) for r in rows], error_rate, schema)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], T.StructType([T.StructField("nth", T.LongType()), T.StructField("item_id", item_type)]))
        found = found.join(F.broadcast(names), "nth").select("doc_id", "item_id", "distance", "match_start", "match_end")
        out = found if out is None else out.unionByName(found)
    return out


def _search(spark: SparkSession, texts: DataFrame, items: list[str], error_rate: float, schema: T.StructType) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(list(enumerate(shared.value)), error_rate)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for key, distance, start, end in matcher.find(normal(text)):
                    rows.append(row)
                    found.append((key, distance, *original_span(text, start, end)))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=schema.names)

    return texts.mapInArrow(search, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns unchanged."""
    held, row = with_row_ids(docs, "decontamination-input")
    hit = benchmark_matches(held, benchmark, error_rate, row, text_col).select(F.col("doc_id").alias(row)).distinct()
    return without(held, hit, row).select(*docs.columns)
