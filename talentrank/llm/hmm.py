"""A hidden Markov model over symbols: scaled forward recursion and Baum-Welch counts, in numpy.

Texts are laid side by side in segments, and arrays hold states by tokens, step by step, so that a step works on
a slice of long rows. Longer texts are cut, their segments' transfer matrices computed together, and chained: the
likelihood is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens of a segment at most; the texts cut by it cost transfer matrices besides, each as much as a recursion per state.
SEGMENT = 512


@dataclass
class Model:
    """start: (K,), move: (K, K), emit: (symbols, K), rows and columns of probabilities per state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Lanes:
    """Segments of some texts, longest first: segments active at step t are a prefix, and their tokens lie at cuts[t] to cuts[t + 1]."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        per = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(np.cumsum(lengths) - lengths, per) + nth * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(lengths, per) - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        self.text, self.nth, self.size = text[order], nth[order], size[order]
        self.first, self.long = self.nth == 0, per[self.text] > 1
        self.last = self.nth == per[self.text] - 1
        self.n_texts = len(lengths)
        steps = np.arange(int(size.max(initial=0)))
        active = len(size) - np.searchsorted(np.sort(size), steps, side="right")
        self.cuts = np.concatenate([[0], np.cumsum(active)])
        lane = np.arange(self.cuts[-1]) - np.repeat(self.cuts[:-1], active)
        #: Where each token stands in the texts.
        self.at = begin[order][lane] + np.repeat(steps, active)
        self.symbols = symbols[self.at]
        # segments of cut texts by their place in the text
        parts = np.flatnonzero(self.long)
        parts = parts[np.argsort(self.nth[parts], kind="stable")]
        self.by_nth = np.split(parts, np.searchsorted(self.nth[parts], np.arange(1, per.max(initial=0))))

    def steps(self) -> list[tuple[int, int]]:
        cuts = self.cuts.tolist()
        return list(zip(cuts[:-1], cuts[1:], strict=True))


def _transfers(lanes: Lanes, model: Model, emitted: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Transfer matrices of some segments (in lane order), each divided by some number: (from, to, segments)."""
    k, turned = len(model.start), np.ascontiguousarray(model.move.T)
    m = np.repeat(np.eye(k)[:, :, None], len(which), 2)
    size, first = lanes.size[which], lanes.first[which]
    for t in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -t, side="left"))  # sizes fall; those above t
        step = turned @ m[:, :, :n]
        if t == 0:
            step[:, :, first[:n]] = m[:, :, :n][:, :, first[:n]]
        step *= emitted.take(lanes.cuts[t] + which[:n], 1)
        np.divide(step, step.sum((0, 1)), out=m[:, :, :n])
    return m


def _chain(lanes: Lanes, model: Model, emitted: np.ndarray, need_beta: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors before the segments, which add up to one, and backward vectors after them, up to a factor each: (states, segments)."""
    n, k = len(lanes.text), len(model.start)
    before, after = np.repeat(model.start[:, None], n, 1), np.ones((k, n))
    which = np.flatnonzero(lanes.long if need_beta else ~lanes.last)  # what is before a segment asks for no last one
    if not len(which):
        return before, after
    m = _transfers(lanes, model, emitted, which)
    place = np.full(n, -1)
    place[which] = np.arange(len(which))
    state = np.repeat(model.start[:, None], lanes.n_texts, 1)
    for segs in lanes.by_nth:
        before[:, segs] = state[:, lanes.text[segs]]
        segs = segs[~lanes.last[segs]]
        out = np.einsum("in,ijn->jn", before[:, segs], m[:, :, place[segs]])
        state[:, lanes.text[segs]] = out / out.sum(0)
    if need_beta:
        back = np.ones((k, lanes.n_texts))
        for segs in reversed(lanes.by_nth):
            after[:, segs] = back[:, lanes.text[segs]]
            out = np.einsum("ijn,jn->in", m[:, :, place[segs]], after[:, segs])
            back[:, lanes.text[segs]] = out / out.sum(0)
    return before, after


def _forward(lanes: Lanes, model: Model, emitted: np.ndarray, before: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Each token's probability after those before it; ``out`` (may be ``emitted``) gets the forward vectors, which add up to one."""
    turned, scale, now = np.ascontiguousarray(model.move.T), np.empty(len(lanes.at)), before
    for i, j in lanes.steps():
        moved = turned @ now[:, : j - i]
        if i == 0:
            moved[:, lanes.first] = before[:, lanes.first]
        now = np.multiply(moved, emitted[:, i:j], out=out[:, i:j])
        now /= np.add.reduce(now, 0, out=scale[i:j])
    return scale


def log_likelihood(symbols: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Natural log of the probability of each text (lengths above 0)."""
    lanes = Lanes(symbols, lengths)
    emitted = np.ascontiguousarray(model.emit.take(lanes.symbols, 0).T)
    before, _ = _chain(lanes, model, emitted, need_beta=False)
    log = np.empty(len(lanes.at))
    log[lanes.at] = np.log(_forward(lanes, model, emitted, before, out=emitted))
    return np.add.reduceat(log, np.cumsum(lengths) - lengths)


def counts(symbols: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of some texts: (symbols seen, their expected counts per state, moves, starts), and their natural log-likelihood."""
    lanes = Lanes(symbols, lengths)
    emitted = np.ascontiguousarray(model.emit.take(lanes.symbols, 0).T)
    before, after = _chain(lanes, model, emitted, need_beta=True)
    alpha = np.empty_like(emitted)
    scale = _forward(lanes, model, emitted, before, out=alpha)
    # with the forward pass's scales, and a segment's last vectors at a product of one, every token's product of both vectors is one
    after /= (alpha[:, lanes.cuts[lanes.size - 1] + np.arange(len(lanes.size))] * after).sum(0)
    weight = np.divide(emitted, scale, out=emitted)
    beta, moves, late = np.empty_like(alpha), np.zeros_like(model.move), None
    steps = lanes.steps()
    for t in range(len(steps) - 1, -1, -1):
        i, j = steps[t]
        more = 0 if late is None else late.shape[1]
        if more:
            beta[:, i : i + more] = model.move @ late
        beta[:, i + more : j] = after[:, more : j - i]
        late = np.multiply(weight[:, i:j], beta[:, i:j], out=weight[:, i:j])
        if t:
            begin = steps[t - 1][0]
            moves += alpha[:, begin : begin + j - i] @ late.T
    n = len(lanes.text)
    cut = ~lanes.first
    moves += before[:, cut] @ weight[:, :n][:, cut].T
    beta *= alpha
    used = np.flatnonzero(np.bincount(lanes.symbols))
    seen = np.stack([np.bincount(lanes.symbols, b)[used] for b in beta], 1)
    return used, seen, moves * model.move, beta[:, :n][:, lanes.first].sum(1), float(np.log(scale).sum())
