"""N-gram Jaccard join by signature trees.

A document's set is its distinct word shingles. Two documents link when their sets' Jaccard similarity
reaches the threshold. The join is exact:

1. Equal sets are one class, found by a digest of the set; only one member of each goes on.
2. Routing. At similarity t two sets of sizes a, b differ in at most (a + b) (1 - t) / (1 + t) shingles.
   Shingle space is cut by hash into more parts than that, so at least one part of linked sets is
   equal. Empty parts are equal in unrelated sets, so a set speaks for the parts it fills; if these are too
   few to leave an equal one it speaks under the next cut too, and so on. Equal parts tie documents into
   groups (a pair that links is always in one group); the ties are spanning trees, never all pairs. The number of
   parts follows a size class, and a document also speaks for the neighbouring classes that its partners can be in.
   Common passages can tie unrelated documents into large groups; groups of more than a slice are routed again by
   keys that cover more shingles each (FINER), which takes them apart and keeps every link.
3. Signature trees. Within a group, nodes hold the OR of their members' shingle bitmaps and their size
   range, and a dual traversal drops node pairs whose maximum possible overlap cannot reach the threshold.
   What is left is checked on the exact sets, so each link between classes is met once and counted
   for both sides with the other's copies. Where only components are asked for, node pairs whose members
   are all linked already are dropped too.
4. Links (reduced to a spanning forest per task after they are counted) become components.

Shingles are held as 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, with_row_ids, without
from .components import connected_components, local_forest

#: Children of a tree node.
FANOUT = 8
#: Members of a group, and shingles of them all, that a slice holds; larger groups are compared slice by slice.
#: A group of g slices costs g (g + 1) / 2 comparisons of slices and g copies of its sets, spread over as many tasks.
SLICE = 4_000
SLICE_SHINGLES = 8_000_000
#: Copies of a group's sets that are dealt out at a time; a group of more slices is compared in as many waves as that takes.
COPIES = 4
#: Tasks at most that tie documents by equal keys. Each gives one forest, so this bounds the ties a document is in, whatever the number of buckets.
TYING_TASKS = 64
#: Errors per block and parts of a block, for the groups that are still larger than a slice.
FINER = ((1, 4), (2, 6))
#: Cuts of shingle space that are tried before a set speaks for empty parts.
CUTS = 8
#: Ids of grouped documents that are broadcast at most (16 bytes each); beyond it the join is dealt out by id.
BROADCAST_ROWS = 500_000
#: Ratio between neighbouring size classes.
CLASS_STEP = 1.25


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; word hashes are remembered, a bounded number of them."""

    def __init__(self, n: int, remember: int = 500_000):
        self.n, self.remember = n, remember
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=False)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.remember:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self._hash(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def size_class(n: int) -> int:
    return int(math.log(n) / math.log(CLASS_STEP) + 1e-9)


def class_top(c: int) -> int:
    """The largest set size of a class."""
    n = int(CLASS_STEP ** (c + 1)) + 2
    while size_class(n) > c:
        n -= 1
    return n


def differences(both: int, threshold: float) -> int:
    """Shingles in which linked sets of ``both`` shingles together can differ."""
    return int(both * (1 - threshold) / (1 + threshold) + 1e-9)


def parts_of(c: int, threshold: float) -> int:
    """Parts for pairs whose larger set is in class ``c``: more than shingles in which they can differ, some to spare for empty ones."""
    most = differences(2 * class_top(c), threshold)
    return most + 3 + most // 16 if most else 1


def part_digests(s: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """64-bit keys of the set's parts for every class its larger partner (or itself) can be in.

    A pair is found in the class of its larger set: the smaller one emits the keys of that class too,
    which is its own or one whose least member is within 1 / threshold of it. A set that fills more parts of a
    cut than the two can differ in shares a filled one with each partner; else it emits the keys of the next cut as
    well. So both sets of a pair speak under the first cut that is enough for either. A set for which no cut
    is enough (thresholds far below 0.8) speaks for its empty parts at last.
    """
    n, c = len(s), size_class(len(s))
    while True:
        m, most = parts_of(c, threshold), differences(n + class_top(c), threshold)
        for cut in range(CUTS):
            with np.errstate(over="ignore"):
                dealt = s if not cut else (s ^ (s >> np.uint64(29 + cut))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * cut)
                part = ((dealt >> np.uint64(11)) % np.uint64(m)).astype(np.int64)
                mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                sums = np.zeros(m, np.uint64)
                np.add.at(sums, part, mixed)
                key = (sums + np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c * CUTS + cut) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(33)
            filled = np.bincount(part, minlength=m) > 0
            enough = filled.sum() > most
            yield key if cut == CUTS - 1 and not enough else key[filled]
            if enough:
                break
        c += 1
        if threshold * (class_top(c - 1) + 1) > n + 1e-9:
            return


def block_digests(s: np.ndarray, threshold: float, errors: int, parts: int) -> Iterator[np.ndarray]:
    """64-bit keys for large groups: of blocks of shingle space, cut into ``parts``, with any ``errors`` parts left out.

    Two linked sets differ in at most ``errors`` shingles in more than a bounded number of blocks, and there some key is
    equal. A key covers several times the shingles of one of :func:`part_digests`, so sets that share only a passage have
    hardly any in common. Classes, further cuts and the last resort are as there: a block speaks surely if whichever parts
    are left out something remains, and a set is enough for itself if it has more such blocks than can be spoilt.
    """
    n, c = len(s), size_class(len(s))
    kept = list(itertools.combinations(range(parts), parts - errors))
    while True:
        most, worst = differences(2 * class_top(c), threshold), differences(n + class_top(c), threshold) // (errors + 1)
        blocks = most // (errors + 1) + 4 + most // 32
        for cut in range(CUTS):
            with np.errstate(over="ignore"):
                dealt = (s ^ (s >> np.uint64(27 + cut))) * np.uint64(0xD1342543DE82EF95 + 2 * cut)
                place = ((dealt >> np.uint64(13)) % np.uint64(blocks * parts)).astype(np.int64)
                mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                sums = np.zeros(blocks * parts, np.uint64)
                np.add.at(sums, place, mixed)
                sums = sums.reshape(blocks, parts)
                filled = np.bincount(place, minlength=blocks * parts).reshape(blocks, parts) > 0
                name = np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c * CUTS + cut) * np.uint64(0xD6E8FEB86659FD93)
                keys, some = [], []
                for k, subset in enumerate(kept):
                    key = (sums[:, subset].sum(1, dtype=np.uint64) + name + np.uint64(k + 1) * np.uint64(0xA24BAED4963EE407)) * np.uint64(0xFF51AFD7ED558CCD)
                    keys.append(key ^ (key >> np.uint64(33)))
                    some.append(filled[:, subset].any(1))
            enough = int((filled.sum(1) > errors).sum()) > worst
            key, full = np.concatenate(keys), np.concatenate(some)
            yield key if cut == CUTS - 1 and not enough else key[full]
            if enough:
                break
        c += 1
        if threshold * (class_top(c - 1) + 1) > n + 1e-9:
            return


class Node:
    """A tree node: OR of bitmaps, size range, and the most shingles that share a bit with another one of their set."""

    __slots__ = ("bits", "children", "excess", "high", "item", "low")

    def __init__(self, bits: int, low: int, high: int, excess: int, children: list | None, item: int):
        self.bits, self.low, self.high, self.excess, self.children, self.item = bits, low, high, excess, children, item


def signature_tree(order: list[int], bitmaps: list[int], sizes: list[int]) -> Node | None:
    """A tree over items in the given order (neighbours should be alike)."""
    level = [Node(bitmaps[i], sizes[i], sizes[i], sizes[i] - bitmaps[i].bit_count(), None, i) for i in order]
    while len(level) > 1:
        up = []
        for k in range(0, len(level), FANOUT):
            kids = level[k : k + FANOUT]
            bits = 0
            for x in kids:
                bits |= x.bits
            up.append(Node(bits, min(x.low for x in kids), max(x.high for x in kids), max(x.excess for x in kids), kids, -1))
        level = up
    return level[0] if level else None


def bitmap(s: np.ndarray, width: int) -> int:
    """Bitmap of a set as an integer; ``width`` is a power of two."""
    at = np.zeros(width, np.uint8)
    at[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(at, bitorder="little").tobytes(), "little")


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, roots: list[int] | None, offset: int) -> Iterator[tuple[int, int]]:
    """Links that join what was not joined before, among ``left`` or between ``left`` and ``right``.

    ``roots``: union-find over left, then (from ``offset``) right; it is updated. Items of one root are
    never compared. Without it, all pairs that may link, unchecked. Yields (index, index) into that common numbering.
    """
    everything = left + (right or [])
    if not everything:
        return
    width = 1 << max(6, int(4 * max(map(len, everything)) - 1).bit_length())
    width = min(width, 1 << 15)

    def find(i: int) -> int:
        while roots[i] != i:
            roots[i] = roots[roots[i]]
            i = roots[i]
        return i

    def built(sets: list[np.ndarray]) -> tuple[Node | None, list[int], list[int]]:
        bits, sizes = [bitmap(s, width) for s in sets], [len(s) for s in sets]
        # alike sets lie together: by size band, then by their least hashes
        order = sorted(range(len(sets)), key=lambda i: (size_class(sizes[i]), int(sets[i][0]), sizes[i], int(sets[i][-1])))
        return signature_tree(order, bits, sizes), bits, sizes

    tree_a, bits_a, sizes_a = built(left)
    tree_b = tree_a if right is None else built(right)[0]
    if tree_a is None or tree_b is None:
        return
    same = right is None

    def exact(i: int, j: int) -> bool:
        x, y = everything[i], everything[j]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    def one_root(node: Node, shift: int) -> int:
        """The common root of all below, or -1."""
        if node.children is None:
            return find(node.item + shift)
        r = one_root(node.children[0], shift)
        if r < 0:
            return -1
        for x in node.children[1:]:
            if one_root(x, shift) != r:
                return -1
        return r

    def possible(a: Node, b: Node) -> bool:
        if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
            return False
        most = min((a.bits & b.bits).bit_count() + min(a.excess, b.excess), a.high, b.high)
        # overlap that the least sizes need: 100 o >= percent (low + low - o)
        return (100 + percent) * most >= percent * (a.low + b.low)

    # nearest first: pairs inside small subtrees come before pairs across large ones
    def inside(node: Node) -> Iterator[tuple[Node, Node]]:
        for x in node.children or ():
            if x.children is not None:
                yield from inside(x)
        kids = node.children or ()
        for p in range(len(kids)):
            for q in range(p + 1, len(kids)):
                yield kids[p], kids[q]

    shift = 0 if same else offset
    starts = inside(tree_a) if same else iter([(tree_a, tree_b)])
    for start in starts:
        stack = [start]
        while stack:
            a, b = stack.pop()
            if not possible(a, b):
                continue
            if a.children is None and b.children is None:
                i, j = a.item, b.item + shift
                if roots is None:
                    yield i, j
                    continue
                ri, rj = find(i), find(j)
                if ri != rj and exact(i, j):
                    roots[max(ri, rj)] = min(ri, rj)
                    yield i, j
                continue
            if roots is not None:
                ra = one_root(a, 0)
                if ra >= 0 and ra == one_root(b, shift):
                    continue
            if b.children is None or a.children is not None and a.high >= b.high:
                stack.extend((x, b) for x in a.children)
            else:
                stack.extend((a, x) for x in b.children)


def all_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, pairs: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every link among ``left`` or between ``left`` and ``right``, once, numbered as in :func:`tree_links`; so many pairs are checked at a time."""
    sets = left + (right or [])
    found = tree_links(left, right, percent, None, len(left))
    while some := list(itertools.islice(found, pairs)):
        some.sort()
        for i, run in itertools.groupby(some, key=lambda p: p[0]):
            x, js = sets[i], np.array([j for _, j in run], np.int64)
            sizes = np.array([len(sets[j]) for j in js.tolist()], np.int64)
            flat = np.concatenate([sets[j] for j in js.tolist()])
            at = np.searchsorted(x, flat)
            at[at == len(x)] = 0
            both = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            linked = js[100 * both >= percent * (len(x) + sizes - both)]
            if len(linked):
                yield np.full(len(linked), i, np.int64), linked


def group_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of all links among some sets (indices)."""
    roots = list(range(len(sets)))
    return list(tree_links(sets, None, percent, roots, 0))


def _bucketed(keys: list[np.ndarray], owners: list[tuple[int, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys and their documents as one row per bucket of keys: bucket, keys, docs."""
    key = np.concatenate(keys)
    doc = np.repeat(np.array([i for i, _ in owners], np.int64), [k for _, k in owners])
    to = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    key, doc, to = key[order], doc[order], to[order]
    cuts = np.searchsorted(to, np.arange(buckets + 1))
    full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    part = lambda x: pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), part(key), part(doc)], names=["bucket", "keys", "docs"])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties between documents with an equal key, as one forest of stars for all of a task's buckets; rows come bucket by bucket."""

    def ties(keys: list[bytes], docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        key, doc = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(docs), np.int64)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        same = key[1:] == key[:-1]
        return doc[1:][same], doc[:-1][same]

    bucket, keys, docs = None, [], []
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for b, k, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != bucket and keys:
                x, y = local_forest(*ties(keys, docs))
                u, v = local_forest(np.concatenate([u, x]), np.concatenate([v, y]))
                keys, docs = [], []
            bucket = b
            keys.append(k)
            docs.append(d)
    if keys:
        x, y = local_forest(*ties(keys, docs))
        u, v = local_forest(np.concatenate([u, x]), np.concatenate([v, y]))
    for k in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000], pa.int64()), pa.array(v[k : k + 100_000], pa.int64())], names=["a", "b"])


def _joined(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str, give: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their sets' keys, classes of equal sets, what the comparison of class representatives gives).

    The last has rows (a, b, null, null) for links and (a, null, n, key) for n links of the documents that have
    the set ``key`` of a with those of other classes, found by one task. ``give``: "links" gives every link, "counts" a
    spanning forest of the links and the counts of every link, "forest" a spanning forest alone.
    """
    threshold = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    buckets = max(16, rows.rdd.getNumPartitions())
    cell = "bucket int, keys binary, docs binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())], names=["doc_id", "n_shingles", "set_key"])

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            keys, owners = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle(t)
                if i is not None and len(s):
                    for k in part_digests(s, threshold):
                        keys.append(k)
                        owners.append((i, len(k)))
            if keys:
                yield from _bucketed(keys, owners, buckets)

    # texts are shingled again for their parts' keys, which are as large as the texts and so are only ever shuffled, once, and not written
    members = materialize(rows.mapInArrow(describe, "doc_id long, n_shingles long, set_key binary"), "members")
    # classes of equal sets, each named by its smallest id
    classes = members.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
    classes = materialize(classes, "classes")

    # groups of representatives in which all links lie
    def grouped(cells: DataFrame) -> DataFrame:
        """doc_id, grp, copies, set_key, slices, mine: components of documents with an equal key; those without one are left out."""
        ties = connected_components(cells.repartition(min(buckets, TYING_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(_tied, "a long, b long"))
        found = ties.join(classes.select(F.col("rep").alias("node"), "copies", "set_key", "n_shingles"), "node").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"), "copies", "set_key", "n_shingles")
        sizes = found.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).where("size > 1")
        slices = F.ceil(F.greatest(F.col("size") / SLICE, F.col("shingles") / SLICE_SHINGLES)).cast("int")
        found = found.join(sizes, "grp").withColumn("slices", slices).withColumn("mine", F.pmod(F.xxhash64("doc_id", "set_key"), "slices").cast("int"))
        return materialize(found.select("doc_id", "grp", "copies", "set_key", "slices", "mine"), "groups")

    def texts_of(group: DataFrame) -> DataFrame:
        """The texts of documents in groups; the ids are broadcast only while they are few."""
        return rows.join(F.broadcast(group) if group.count() <= BROADCAST_ROWS else group, "doc_id").select("t", "doc_id", "set_key", "grp", "copies", "slices", "mine")

    def again(errors: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle = Shingler(words)
            for batch in batches:
                keys, owners = [], []
                for t, i, k, g in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    s = shingle(t)
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k:
                        salt = np.uint64(g * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                        for key in block_digests(s, threshold, errors, parts):
                            keys.append(key ^ salt)
                            owners.append((i, len(key)))
                if keys:
                    yield from _bucketed(keys, owners, buckets)

        return keys_of

    group = grouped(rows.mapInArrow(speak, cell))
    for errors, parts in FINER:
        large = group.where("slices > 1")
        if large.isEmpty():
            break
        group = materialize(group.where("slices = 1").unionByName(grouped(texts_of(large).mapInArrow(again(errors, parts), cell))), "groups")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [shingle(t).tobytes() for t in batch.column("t").to_pylist()]
            # an id may have several sets; each row of the group goes with the text it is about
            right = [hashlib.blake2b(x, digest_size=16).digest() == k for x, k in zip(sets, batch.column("set_key").to_pylist(), strict=True)]
            whole = [pa.array(sets, pa.large_binary()).cast(pa.binary()) if c == "s" else batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays(whole, names=carried).filter(pa.array(right, pa.bool_()))

    carried = ["grp", "slices", "mine", "doc_id", "s", "copies", "set_key"]

    def dealt(wave: int) -> DataFrame:
        """Sets by pair of slices: a text is cut into shingles once a wave; its set goes to the slice pairs (x, y) with x <= y of the wave in which it takes part."""
        held = texts_of(group.where(F.ceil(F.col("slices") / COPIES) > wave))
        sets = held.mapInArrow(shingled, "grp long, slices int, mine int, doc_id long, s binary, copies long, set_key binary")
        others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda o: (F.col("mine") + o) % F.ceil(F.col("slices") / COPIES) == wave)
        sets = sets.select("*", F.explode(others).alias("other")).select("grp", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "doc_id", "s", "copies", "set_key")
        return sets.repartition(F.col("grp"), F.col("x"), F.col("y")).sortWithinPartitions("grp", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None, key: list[bytes] | None = None) -> pa.RecordBatch:
            column = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([column(a), column(b), column(n), pa.nulls(len(a), pa.binary()) if key is None else pa.array(key, pa.binary())], names=["a", "b", "n", "set_key"])

        def linked(key: tuple, left: dict, right: dict) -> Iterator[pa.RecordBatch]:
            if key[1] != key[2] and not (left and right):
                return
            names = sorted(left) + sorted(right)
            ids, one, two = np.array([i for i, _ in names], np.int64), [left[i][0] for i in sorted(left)], [right[i][0] for i in sorted(right)] or None
            if give == "forest":
                links = list(tree_links(one, two, percent, list(range(len(ids))), len(one)))
                if links:
                    yield out(ids[[i for i, _ in links]], ids[[j for _, j in links]], None)
                return
            copies = np.array([(left if k < len(one) else right)[i][1] for k, i in enumerate(names)], np.int64)
            n, u, v, new, size = np.zeros(len(ids), np.int64), ids[:0], ids[:0], [], 0
            for i, j in all_links(one, two, percent):
                if give == "links":
                    yield out(ids[i], ids[j], None)
                    continue
                np.add.at(n, i, copies[j])
                np.add.at(n, j, copies[i])
                new.append((i, j))
                size += len(i)
                if size > 1_000_000:
                    u, v = local_forest(np.concatenate([u, *(x for x, _ in new)]), np.concatenate([v, *(y for _, y in new)]))
                    new, size = [], 0
            if give == "counts" and n.any():
                u, v = local_forest(np.concatenate([u, *(x for x, _ in new)]), np.concatenate([v, *(y for _, y in new)]))
                yield out(ids[u], ids[v], None)
                yield out(ids[n > 0], None, n[n > 0], [k for (_, k), some in zip(names, (n > 0).tolist(), strict=True) if some])

        now, left, right = None, {}, {}
        for batch in batches:
            for g, x, y, mine, i, s, copies, k in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if (g, x, y) != now:
                    if now:
                        yield from linked(now, left, right)
                    now, left, right = (g, x, y), {}, {}
                (left if mine == x else right)[(i, k)] = np.frombuffer(s, np.uint64), copies
        if now:
            yield from linked(now, left, right)

    waves = -(-(group.agg(F.max("slices")).first()[0] or 1) // COPIES)
    found = [materialize(dealt(w).mapInArrow(compare, "a long, b long, n long, set_key binary"), "joined") for w in range(waves)]
    return members, classes, reduce(DataFrame.unionByName, found)


def jaccard_links(docs: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b (a < b): every link between different sets, once; a set is named by the smallest id that has it (sets of one id: no link).

    Links as in :func:`jaccard_components`. A group of k texts that are all alike has k (k - 1) / 2 rows.
    """
    links = _joined(docs, percent, words, id_col, text_col, "links")[2].where("a <> b")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _components(members: DataFrame, classes: DataFrame, joined: DataFrame, ids_repeat: bool) -> DataFrame:
    links = joined.where("b is not null").select("a", "b")
    if ids_repeat:  # an id with several sets ties their classes together
        several = members.where("doc_id is not null and set_key is not null").groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select("doc_id")
        own = members.join(several, "doc_id", "left_semi").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        links = links.unionByName(own)
    component = connected_components(links).withColumnsRenamed({"node": "rep"})
    named = classes.join(component, "rep", "left").select("set_key", "rep", "copies", F.coalesce("component", "rep").alias("component_id"))
    return members.join(named, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def jaccard_components(docs: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest id reachable by links, itself included), n_links (other rows that the row's set links with).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of distinct shingles of
    ``words`` words (A-Z lower-cased; fewer words: the whole sequence as one shingle). Null and empty texts
    have the empty set and link with nothing. Ids are integers. Rows that repeat an id are one document, whose
    links are those of all its texts; each row has the size of its own set. A row with a null id links through rows with
    an equal set only (its component is null if there are none). Columns besides the two are not read. An empty table
    gives no rows.
    """
    members, classes, joined = _joined(docs, percent, words, id_col, text_col, "counts")
    others = joined.where("n is not null").groupBy("set_key").agg(F.sum("n").alias("others"))
    found = _components(members, classes, joined, True).join(others, "set_key", "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))
    return found.select("doc_id", "n_shingles", "component_id", n_links.alias("n_links"))


def near_duplicate_filter(docs: DataFrame, percent: int = 80, words: int = 5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that link to an earlier one: one row of each component stays, all columns unchanged. Rows without a shingle all stay."""
    held, row = with_row_ids(docs, "join-input")
    found = _components(*_joined(held, percent, words, row, text_col, "forest"), False)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return without(held, gone, row).select(*docs.columns)
