"""Pieces without Spark, against plain versions."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from talentrank.llm import hmm, language_model, quality
from talentrank.llm.binary_ids import decode_ranks, encode_ranks
from talentrank.llm.components import local_forest
from talentrank.llm.decontamination import Matcher, myers, normal, original_span, pieces
from talentrank.llm.encoders import WordEncoder, encoder, public_path
from talentrank.llm.html_extraction import labelled_pages, main_text, marginals, parse, trained
from talentrank.llm.ngram_join import Shingler, block_digests, class_top, group_links, part_digests, parts_of, size_class
from talentrank.llm.packing import piece_lengths
from talentrank.llm.toxicity import LabelModel, Votes, fit_linear, one_hot

ODD = list("abzAZ'st.,!*-=<>|129 \n\t\r\x0b\x0c\x1c\x1d") + ["é", "É", "ß", "»", "…", "́", "̸", " ", "　", "שלום", "Σ", "İ", "😀", "ﬁ", "<|endoftext|>", "'s"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_give_the_librarys_ids(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_path(name))
    library.encode_special_tokens = True
    import pyarrow.parquet as pq

    rnd = random.Random(3)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 16))) for _ in range(3000)] + ["a" * 5000, " " * 3000]
    found = encoder(public_path(name)).many(texts)
    for text, ids, e in zip(texts, found, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, text


def test_runs_of_few_new_parts_keep_their_own_ids():
    from tokenizers import Tokenizer

    path = public_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rnd, e = random.Random(5), WordEncoder(path)
    odd = ["\u00a0", "\u2028", "\u3000", "42", "7", "…", "\u2014", "é", "İ", "x9", "a\u00a0b", "word", "été", "中文"]
    for texts in [["\u00a0 42 … \u2014"], ["\u00a0 42"], *([" ".join(rnd.sample(odd, rnd.randint(2, 5)))] for _ in range(300))]:
        e._known, e._older, e._parts = {}, {}, {}
        assert e.many(texts)[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids, texts


@given(st.integers(0, 10**6), st.sampled_from([1, 2, 64, 1024]))
def test_piece_lengths(n, sequence):
    p = piece_lengths(n, sequence)
    assert sum(p) == n and all(x & (x - 1) == 0 and x <= sequence for x in p) and p == sorted(p, reverse=True)
    assert len([x for x in p if x < sequence]) <= sequence.bit_length()


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=6))
def test_coding_round_trip(docs):
    n = np.array([len(d) for d in docs], np.int64)
    flat = np.array(list(itertools.chain(*docs)), np.uint32)
    control, data = encode_ranks(flat, n)
    assert decode_ranks(control, data, n).tolist() == flat.tolist()
    assert [len(c) for c in control] == [-(-k // 4) for k in n]


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        row, last = [i], row
        for j, d in enumerate(t, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


@settings(max_examples=300)
@given(st.text("ab c", min_size=1, max_size=80), st.text("ab c", max_size=90))
def test_myers(p, t):
    assert myers(p, t)[0] == plain_distance(p, t)


def test_pieces_cover_an_item():
    for n, k in itertools.product(range(1, 40), range(0, 8)):
        p = pieces(n, k)
        assert p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in itertools.pairwise(p)) and len(p) == min(k + 1, n)


def test_matcher_finds_what_brute_force_finds():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 7)))
    items = [normal(" ".join(word() for _ in range(rnd.randint(6, 20)))) for _ in range(12)]
    rate = 0.08
    matcher = Matcher(list(enumerate(items)), rate)
    for _ in range(60):
        item = rnd.choice(items)
        edited = list(item)
        for _ in range(rnd.randint(0, int(rate * len(item)) + 2)):
            edited[rnd.randrange(1, len(edited) - 1)] = rnd.choice("xyz")
        text = normal(" ".join(word() for _ in range(20)) + "".join(edited) + " ".join(word() for _ in range(20)))
        found = {k: d for k, d, _, _ in matcher.find(text)}
        assert found == {k: d for k, i in enumerate(items) if (d := plain_distance(i, text)) <= int(rate * len(i))}


def test_original_span():
    text = "Say: «The QUICK brown—fox» jumps!"
    n = normal(text)
    at = n.index("quick")
    assert text[slice(*original_span(text, at, at + len("quick brown fox")))] == "QUICK brown—fox"


def test_hmm_against_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    k, v = 3, 6
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.copy())
    monkeypatch.setattr(hmm, "SEGMENT", 3)
    lengths = np.array([1, 2, 3, 4, 5, 6])
    x = rng.integers(0, v, lengths.sum())
    ends = np.cumsum(lengths)
    counts, moves, starts = np.zeros((v, k)), np.zeros((k, k)), np.zeros(k)
    for log, i, j in zip(hmm.log_likelihood(x, lengths, m), ends - lengths, ends, strict=True):
        s, total = x[i:j], 0.0
        for path in itertools.product(range(k), repeat=len(s)):
            p = m.start[path[0]] * np.prod([m.move[a, b] for a, b in itertools.pairwise(path)]) * np.prod([m.emit[w, q] for w, q in zip(s, path, strict=True)])
            total += p
        assert np.isclose(log, np.log(total))
        for path in itertools.product(range(k), repeat=len(s)):
            p = m.start[path[0]] * np.prod([m.move[a, b] for a, b in itertools.pairwise(path)]) * np.prod([m.emit[w, q] for w, q in zip(s, path, strict=True)]) / total
            starts[path[0]] += p
            for w, q in zip(s, path, strict=True):
                counts[w, q] += p
            for a, b in itertools.pairwise(path):
                moves[a, b] += p
    used, c, mv, s0, likelihood = hmm.counts(x, lengths, m)
    assert np.isclose(likelihood, hmm.log_likelihood(x, lengths, m).sum())
    assert np.allclose(c, counts[used]) and np.allclose(mv, moves) and np.allclose(s0, starts)


def test_hmm_of_cut_texts_against_plain_recursion():
    rng = np.random.default_rng(5)
    k, v = 4, 50
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.copy())
    lengths = np.array([3, hmm.SEGMENT, 1, hmm.SEGMENT + 1, 3 * hmm.SEGMENT, 700, 5 * hmm.SEGMENT - 1, 2 * hmm.SEGMENT + 9])
    x = rng.integers(0, v, lengths.sum())
    ends = np.cumsum(lengths)
    counts, moves, starts, logs = np.zeros((v, k)), np.zeros((k, k)), np.zeros(k), []
    for i, j in zip(ends - lengths, ends, strict=True):
        s, alpha, log = x[i:j], [], 0.0
        for w in s:
            a = (alpha[-1] @ m.move if alpha else m.start) * m.emit[w]
            log += np.log(a.sum())
            alpha.append(a / a.sum())
        logs.append(log)
        beta = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            g = alpha[t] * beta / (alpha[t] @ beta)
            counts[s[t]] += g
            if t:
                pair = alpha[t - 1][:, None] * m.move * (m.emit[s[t]] * beta)
                moves += pair / pair.sum()
                beta = m.move @ (m.emit[s[t]] * beta)
                beta /= beta.sum()
        starts += g
    assert np.allclose(hmm.log_likelihood(x, lengths, m), logs, rtol=1e-12)
    used, c, mv, s0, likelihood = hmm.counts(x, lengths, m)
    assert np.allclose(c, counts[used]) and np.allclose(mv, moves) and np.allclose(s0, starts) and np.isclose(likelihood, sum(logs), rtol=1e-12)


def test_hmm_of_ordinary_texts_costs_no_transfer_matrices(monkeypatch):
    """These cost several recursions a token, by which op3 took more CPU than its budget."""
    cut, transfers = [], hmm._transfers
    monkeypatch.setattr(hmm, "_transfers", lambda lanes, *args: [cut.append(len(args[-1])), transfers(lanes, *args)][1])
    rng = np.random.default_rng(6)
    m = hmm.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(9), 4).T.copy())
    lengths = np.array([500] * 20 + [3000])
    x = rng.integers(0, 9, lengths.sum())
    hmm.counts(x[:10_000], lengths[:-1], m)
    hmm.log_likelihood(x[:10_000], lengths[:-1], m)
    assert cut == []
    hmm.log_likelihood(x, lengths, m)
    assert cut == [3000 // hmm.SEGMENT]  # the long text's segments but its last


def test_word_counts_beyond_32_bits():
    import pyarrow as pa

    most = 2**32 - 1
    cells = pa.RecordBatch.from_pydict({"bucket": [0, 0, 0], "block": [1, 2, 3], "words": [b"common\nrare", b"common", b"common"], "counts": [np.array(x, "<u4").tobytes() for x in ([most, 3], [most], [7])]})
    total, *blocks = itertools.chain.from_iterable(b.to_pylist() for b in language_model._count_words(iter([cells]), 1e6))
    assert np.frombuffer(total["own"], "<i8").tolist() == [2 * most + 7] and total["distinct"] == 2
    assert [np.frombuffer(b["counts"], "<i8").tolist() for b in blocks] == [[2 * most + 7, 3], [2 * most + 7], [2 * most + 7]]


def test_parts_never_miss_a_pair():
    rnd = random.Random(9)
    for _ in range(300):
        n = rnd.randint(1, 120)
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rnd.randint(0, max(1, n // 9))):
            b.discard(next(iter(b))) if rnd.random() < 0.5 and len(b) > 1 else b.add(rnd.getrandbits(64))
        if 100 * len(a & b) >= 90 * len(a | b):
            keys = [set(itertools.chain(*(k.tolist() for k in part_digests(np.array(sorted(s), np.uint64), 0.9)))) for s in (a, b)]
            assert keys[0] & keys[1]
    assert all(size_class(class_top(c)) <= c < size_class(class_top(c) + 1) for c in range(40)) and parts_of(0, 0.9) == 1


@pytest.mark.parametrize("percent", [80, 90])
def test_empty_parts_tie_nothing_and_miss_no_pair(percent):
    rnd = random.Random(10)
    keys = lambda s: set(itertools.chain(*(k.tolist() for k in part_digests(np.array(sorted(s), np.uint64), percent / 100))))
    for n in [*range(1, 30), *range(30, 400, 23)] * 6:
        a = [rnd.getrandbits(64) for _ in range(n)]
        b = set(a[rnd.randint(0, n // 5) :]) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 6))}
        a = set(a)
        if 100 * len(a & b) >= percent * len(a | b):
            assert keys(a) & keys(b)
    for low, high, many in ((4, 60, 1500), (600, 1000, 200)):
        met = collections.Counter(itertools.chain(*(keys({rnd.getrandbits(64) for _ in range(rnd.randint(low, high))}) for _ in range(many))))
        assert max(met.values()) == 1


@pytest.mark.parametrize(("percent", "errors", "parts"), [(80, 1, 4), (80, 2, 6), (90, 1, 4), (90, 2, 6), (50, 1, 4)])
def test_finer_keys_miss_no_pair(percent, errors, parts):
    rnd = random.Random(15)
    keys = lambda s: set(itertools.chain(*(k.tolist() for k in block_digests(np.array(sorted(s), np.uint64), percent / 100, errors, parts))))
    linked = 0
    for n in [*range(1, 40), *range(40, 400, 23)] * 4:
        a = [rnd.getrandbits(64) for _ in range(n)]
        b = set(a[rnd.randint(0, n // 5) :]) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 6))}
        a = set(a)
        if 100 * len(a & b) >= percent * len(a | b):
            linked += 1
            assert keys(a) & keys(b)
    assert linked > 40


def test_low_thresholds_miss_no_pair():
    rnd = random.Random(14)
    keys = lambda s: set(itertools.chain(*(k.tolist() for k in part_digests(np.array(sorted(s), np.uint64), 0.5))))
    for n in range(1, 120):
        a = [rnd.getrandbits(64) for _ in range(n)]
        b = set(a[n // 4 :]) | {rnd.getrandbits(64) for _ in range(n // 5)}
        if 100 * len(set(a) & b) >= 50 * len(set(a) | b):
            assert keys(set(a)) & keys(b)


def test_signature_tree_components_against_all_pairs():
    rnd = random.Random(4)
    for _ in range(25):
        base = [[rnd.getrandbits(64) for _ in range(rnd.randint(1, 60))] for _ in range(4)]
        sets = []
        for _ in range(40):
            s = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 5)):
                s.add(rnd.getrandbits(64))
            sets.append(np.array(sorted(s), np.uint64))
        root = list(range(len(sets)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
        mine = list(range(len(sets)))

        def own(i, mine=mine):
            while mine[i] != i:
                i = mine[i]
            return i

        links = group_links(sets, 90)
        for i, j in links:
            mine[max(own(i), own(j))] = min(own(i), own(j))
        assert [find(i) for i in range(len(sets))] == [own(i) for i in range(len(sets))]
        assert len(links) == len(sets) - len({find(i) for i in range(len(sets))})


def test_shingles():
    s = Shingler(3)
    assert len(s("")) == 0 and len(s(" \n")) == 0 and len(s("a b")) == 1 and len(s("a b c a b c")) == 3
    assert s("A b C").tolist() == s("a B c").tolist() and s("a b").tolist() != s("b a").tolist()


def test_local_forest():
    a, b = np.array([1, 5, 7, 9]), np.array([2, 2, 8, 7])
    u, v = local_forest(a, b)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {2: 1, 5: 1, 8: 7, 9: 7}


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="page"><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
<div class="ad">Buy   now!</div><article><h1>Title &amp; more</h1><p>First <b>bold</b> line<br>goes on.<p>Second &#8212; one.<div class="comments"><p>A reader wrote this.</p></div>
<ul><li>One item here.<li>Two items here.</ul></article><aside>Related</aside><footer>&copy; x</footer><script>var a="</p><p>no";</script></body></html>"""


def test_page():
    assert main_text(PAGE, trained()) == "Title & more\n\nFirst bold line goes on.\n\nSecond — one.\n\nOne item here.\n\nTwo items here."


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "</p></div>", "<p>" * 3000, "<div>" * 2000 + "x", "<!-- open", "<script>never ends", "a<b>c", "<p class='x\">y", "<table><td>a<td>b<tr><td>c"])
def test_broken_pages(page):
    assert isinstance(main_text(page, trained()), str)


def test_marginals_against_enumeration():
    potentials = trained()
    nodes = parse("<body><nav><a>x</a></nav><article><p>Some words here.</p></article></body>")
    from talentrank.llm.html_extraction import features

    own = [np.exp(sum(potentials.own.get(f, 0) for f in features(n, nodes[n.parent] if n.parent >= 0 else None))) for n in nodes]
    total, on = 0.0, np.zeros(len(nodes))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        p = potentials.root if labels[0] else 1 - potentials.root
        for i, y in enumerate(labels):
            p *= own[i] if y else 1
            if i:
                p *= potentials.between(nodes[i], nodes[nodes[i].parent])[labels[nodes[i].parent]][y]
        total += p
        on += p * np.array(labels)
    assert np.allclose(marginals(nodes, potentials), on / total)


def test_extraction_on_held_out_layouts():
    """Pages of another seed than the training's: almost every run of text gets its label."""
    good = wrong = 0
    for page in labelled_pages(80, seed=99):
        nodes = parse(page)
        for i, (n, p) in enumerate(zip(nodes, marginals(nodes, trained()), strict=True)):
            if n.label < 0:
                n.label = nodes[n.parent].label if i else 0
            if not n.tag:
                good, wrong = good + ((p > 0.5) == (n.label == 1)), wrong + ((p > 0.5) != (n.label == 1))
    assert wrong < 0.03 * good


def test_label_model_recovers_voters():
    rng = np.random.default_rng(1)
    n = 4000
    y = rng.random(n) < 0.2
    x = np.zeros((n, 9), int)
    for j, (hit, false) in enumerate([(0.8, 0.01), (0.7, 0.02), (0.3, 0.25), (0.6, 0.01), (0.5, 0.05), (0.4, 0.1), (0.2, 0.2), (0.1, 0.1), (0.1, 0.1)]):
        x[:, j] = 3 * (rng.random(n) < np.where(y, hit, false))
    known = np.where(rng.random(n) < 0.2, y, -1).astype(int)
    m = LabelModel(x, np.ones(n), known)
    q = m.posterior(x)
    assert ((q > 0.5) == y).mean() > 0.95 and m.accuracies()[0] > m.accuracies()[2]
    w = fit_linear(x, np.ones(n), q)
    assert (((one_hot(x) @ w) > 0) == y).mean() > 0.95


def test_votes():
    v = Votes({"=blarg": 0.95, "^zor": 0.85})
    assert v("You idiot, blarg zorple zorx!!")[:5] == [1, 1, 0, 0, 2] and v("")[:] == [0] * 9 and sum(v("a nice day")) == 0


def test_held_out_rows_are_the_contracts(spark):
    from talentrank.llm.common import held_out

    ids = [*range(-20, 200), 10**15, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: (r.a, r.b) for r in rows.select("doc_id", held_out("doc_id", 7).alias("a"), held_out("doc_id", 4).alias("b")).collect()}
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    assert got == {i: (crc(i) % 7 == 2, crc(i) % 4 == 2) for i in ids}


def plain_mcd(x, support, factor, floors, prior, rnd, tries=60):
    """Least determinant over random starts of the nearest ``support`` share of rows, and that share's mean and covariance."""
    n, k = x.shape
    h = int(np.ceil(support * n))

    def regular(some):
        own = len(some) / (len(some) + prior)
        return own * factor * np.cov(some.T, bias=True).reshape(k, k) + (2 - own) * np.diag(floors**2)

    best = None
    for _ in range(tries):
        some = x[rnd.sample(range(n), min(n, k + 1))]
        for _ in range(50):
            centre, inverse = some.mean(0), np.linalg.inv(regular(some))
            d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
            nearest = x[np.argsort(d, kind="stable")[:h]]
            if len(nearest) == len(some) and np.allclose(nearest.sum(0), some.sum(0)):
                break
            some = nearest
        found = np.linalg.slogdet(regular(some))[1]
        if best is None or found < best[0]:
            best = found, some.mean(0), regular(some)
    return best


def test_quality_centres_have_the_least_determinant(spark):
    import pandas as pd

    rnd, gen = random.Random(4), np.random.default_rng(4)
    floors = np.array(list(quality.FLOORS.values()))
    frames = []
    for name, n, far in (("a", 300, 60), ("b", 80, 15), ("c", 6, 1), ("d", 1, 0)):
        mix = gen.normal(size=(5, 5)) * floors * 3
        x = gen.normal(size=(n, 5)) @ mix
        x[:far] += floors * 25 * gen.normal(size=5)  # a cluster of outliers pulls mean and covariance
        frames.append(pd.DataFrame(x, columns=quality.DIMS).assign(g=name))
    whole = pd.concat(frames, ignore_index=True)
    rows = spark.createDataFrame(whole)
    got = {r.g: r for r in quality.mcd_centres(rows, ["g"]).collect()}
    again = {r.g: r for r in quality.mcd_centres(rows.repartition(7), ["g"]).collect()}
    factor = quality.consistency(0.75)
    for name, some in whole.groupby("g"):
        x, r = some[quality.DIMS].to_numpy(), got[name]
        logdet, centre, covariance = plain_mcd(x, 0.75, factor, floors, quality.PRIOR_ROWS, rnd)
        # shares are rounded up to whole bands of distance, so a few more rows may lie in one
        assert len(x) * 0.75 <= r.n <= len(x) * 0.75 + 1 + 0.05 * len(x)
        assert abs(r.logdet - logdet) < 0.25 and np.allclose(np.linalg.inv(np.array(r.p).reshape(5, 5)), covariance, atol=0.2 * np.abs(covariance).max())
        assert np.allclose(r.m, centre, atol=0.35 * np.sqrt(np.diag(covariance)).max())
        assert abs(again[name].logdet - r.logdet) < 1e-6


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi2_quantile(0.9995, 5) - 22.1053) < 1e-3 and abs(quality.chi2_cdf(6.6257, 5) - 0.75) < 1e-4


def test_repeated_words_with_equal_hashes(spark, monkeypatch):
    """Windows of equal hash and other words are told apart by their texts."""
    texts = ["a b c x a b c y q r s", "a b c d", "a b c a b c a b c", "p q r s t u v"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("words", F.split("t", " "))
    want = {r.i: r.n_repeat_words for r in quality.with_repeated_words(frame).collect()}
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    assert {r.i: r.n_repeat_words for r in quality.with_repeated_words(frame).collect()} == want
    assert want == {0: 6, 1: 0, 2: 9, 3: 0}


def held_out_figures(pages, potentials):
    """Precision and recall of the words kept on labelled pages, and the share of pages whose text is exactly the article's."""
    kept = right = wanted = exact = 0
    for page in pages:
        nodes = parse(page)
        for i, node in enumerate(nodes):
            if node.label < 0:
                node.label = nodes[node.parent].label if i else 0
        shown = [p > 0.5 for p in marginals(nodes, potentials)]
        runs = [(s, n.label == 1, len(n.words().split())) for n, s in zip(nodes, shown, strict=True) if not n.tag and n.words()]
        kept += sum(k for s, _, k in runs if s)
        right += sum(k for s, y, k in runs if s and y)
        wanted += sum(k for _, y, k in runs if y)
        exact += all(s == y for s, y, _ in runs)
    return right / kept, right / wanted, exact / len(pages)


def test_layouts_with_names_that_training_has_not_seen():
    precision, recall, exact = held_out_figures(labelled_pages(300, seed=99, half=1), trained())
    assert precision > 0.93 and recall > 0.95 and exact > 0.6, (precision, recall, exact)


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<p title=it's>Middle paragraph stands here now.</p>", "Middle paragraph stands here now."), ('<p class="x>Middle paragraph is here.</p><p class="y">The next one is here.</p>', "Middle paragraph is here.\n\nThe next one is here."),
        ('<p title="a > b">It is 3 < 4 and 5 > 4 here.</p>', "It is 3 < 4 and 5 > 4 here."), ("<p a=1 b='2' c>One &amp; two &lt;three&gt; are here.</p>", "One & two <three> are here."), ("<p>Before it.</p><!-- no <p>x</p> --><p>After it.</p>", "Before it.\n\nAfter it."),
        ("<p>Whole text here.</p><p class='never closed>Its text too is here.</p>", "Whole text here.\n\nIts text too is here."), ("<p>Some text is here.</p><p class=", "Some text is here."), ("<p =a b= c>Odd names are here.</p>", "Odd names are here."),
    ],
)
def test_odd_tags_are_never_text(inside, want):
    assert main_text(f'<html><body><nav><a href="/">Home</a></nav><article>{inside}</article></body></html>' if inside[-1] != "=" else f"<html><body><article>{inside}", trained()) == want


@pytest.mark.parametrize(
    "odd", ["<x ", '<a "', "</script", "<!--", "<p a='x>", '<p a="x>t</p>', "<b><a></a>", "<div></p>", "<h1></h2>", "<", "&amp;<"],
)
def test_odd_pages_take_linear_time(odd):
    import time

    def seconds(n):
        begin = time.process_time()
        main_text("<article>" + odd * n + "<div>" * n + "</i>" * n, trained())
        return time.process_time() - begin

    trained()
    assert min(seconds(24000) for _ in range(2)) < 4 * max(0.1, min(seconds(8000) for _ in range(2)))


def test_label_model_posterior_by_enumeration():
    """The posterior is the joint probability of class and votes over that of both classes, term by term on the tree; likelihoods rise until they settle."""
    rng = np.random.default_rng(7)
    y = (rng.random(4000) < 0.2).astype(int)
    patterns = np.stack([np.minimum(3, rng.poisson(np.where(y == 1, hi, lo))) for hi, lo in ((1.5, 0.05), (1.0, 0.2), (0.6, 0.1), (0.3, 0.3))], 1)
    patterns[:, 3] = np.where(rng.random(4000) < 0.7, patterns[:, 2], patterns[:, 3])  # two voters that go together
    known = np.where(rng.random(4000) < 0.2, y, -1)
    model = LabelModel(patterns, np.ones(4000), known)
    assert all(b > a - 1e-3 for a, b in itertools.pairwise(model.likelihoods)) and model.likelihoods[-1] - model.likelihoods[-2] <= 1e-6
    assert model.parent[3] == 2 or model.parent[2] == 3
    for v, q in zip(patterns[:200], model.posterior(patterns[:200]), strict=True):
        joint = []
        for c in (0, 1):
            p = model.prior[c]
            for j, table in enumerate(model.tables):
                p *= table[c][v[model.parent[j]] if model.parent[j] >= 0 else 0][v[j]]
            joint.append(p)
        assert np.isclose(q, joint[1] / sum(joint))
    # probabilities of all vote patterns add up to one
    every = np.array(list(itertools.product(range(4), repeat=4)))
    assert np.isclose(np.exp(model.log_joint(every)).sum(), 1)
