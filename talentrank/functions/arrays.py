"""Ordered and keyed array functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def constant_map(values: dict, kind: str = "string") -> Column:
    """A fixed map as one expression, which the optimizer folds to a value; large tables stay small in plans."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"map<string,{kind}>")


def contains_any(text: Column, words) -> Column:
    """Whether the text has any of the words as a substring; false for null."""
    return F.coalesce(text.rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)), F.lit(False))


def contained(text: Column, words) -> Column:
    """The words that the text has as substrings, in the words' order."""
    return F.filter(literal(words), lambda w: text.contains(w))


def _runs_first(pairs: Column) -> Column:
    """Of sorted structs those whose ``k`` no earlier one has; null keys go."""
    return F.filter(pairs, lambda e, j: e["k"].isNotNull() & ((j == 0) | ~F.get(pairs, j - 1)["k"].eqNullSafe(e["k"])))


def first_by_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items whose key no earlier item has, in order; null keys go. Keys are sorted, so time is n log n."""

    def firsts(a: Column) -> Column:
        pairs = F.array_sort(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        places = F.array_sort(F.transform(bind(pairs, _runs_first), lambda e: e["i"]))
        return F.transform(places, lambda i: F.get(a, i))

    return bind(items, firsts)


def ordered_distinct(items: Column) -> Column:
    """Case-insensitive distinct, first spelling kept."""
    return first_by_key(items, F.lower)


def trimmed(items: Column) -> Column:
    """Trimmed items without nulls and blanks."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def difference_ci(items: Column, minus: Column) -> Column:
    """Items whose trimmed lower form is not among ``minus``'."""
    return bind(F.transform(minus, lambda m: F.lower(F.trim(m))), lambda low: F.filter(items, lambda x: ~F.array_contains(low, F.lower(F.trim(x)))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; both empty: 1, one empty: 0."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def overlap_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def max_wins(items: Column, key: Callable[[Column], Column], weight: Callable[[Column], Column]) -> Column:
    """Per key the item of the largest weight, the first on ties, at the place where the key came first; null keys go."""

    def winners(a: Column) -> Column:
        each = lambda order: bind(F.array_sort(F.transform(a, order)), _runs_first)
        best = each(lambda x, i: F.struct(key(x).alias("k"), (-weight(x)).alias("w"), i.alias("i")))
        first = each(lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
        placed = F.array_sort(F.zip_with(first, best, lambda f, b: F.struct(f["i"].alias("at"), b["i"].alias("i"))))  # both in the keys' order
        return F.transform(placed, lambda p: F.get(a, p["i"]))

    return bind(items, winners)


def interval_union_days(spans: Column) -> Column:
    """Days covered by array<struct<s date, e date>>, overlaps once. Null starts or ends and reversed spans are left out; null if none is left."""
    good = F.filter(spans, lambda x: x["s"].isNotNull() & x["e"].isNotNull() & (x["e"] >= x["s"]))
    start = F.struct(F.lit(0).alias("days"), F.lit(None).cast("date").alias("end"))
    step = lambda acc, x: F.struct(
        (acc["days"] + F.when(acc["end"].isNull() | (x["s"] > acc["end"]), F.datediff(x["e"], x["s"])).when(x["e"] > acc["end"], F.datediff(x["e"], acc["end"])).otherwise(0)).alias("days"),
        F.greatest(acc["end"], x["e"]).alias("end"),
    )
    return bind(F.array_sort(good), lambda g: F.when(F.size(g) > 0, F.aggregate(g, start, step, lambda acc: acc["days"])))


def finite_non_negative(m: Column) -> Column:
    """Map entries with finite values of at least 0."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))


def fill_categories(m: Column, categories) -> Column:
    """The map with 0.0 for missing categories."""
    return F.map_from_arrays(literal(categories), F.array(*[F.coalesce(F.try_element_at(m, F.lit(c)), F.lit(0.0)) for c in categories]))


def sorted_entries(m: Column) -> Column:
    """Positive map entries, largest value first, ties by key."""
    entries = F.filter(F.map_entries(m), lambda e: e["value"] > 0)
    return F.transform(F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))), lambda e: F.struct(e["key"], e["value"]))


def entries_to_bullets(m: Column) -> Column:
    """{some_key: value} to lines 'Some Key: value'."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(F.initcap(F.translate(e["key"], "_", " ")), F.lit(": "), e["value"].cast("string"))), "\n")
