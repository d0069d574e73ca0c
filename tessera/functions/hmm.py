"""Gaussian mixtures and hidden Markov models for one series at a time, in numpy, by log probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Numbers that series worked on together hold at most, about.
HELD = 1 << 21


@dataclass
class Hmm:
    """Diagonal Gaussians, one a state; log start, transition and leave probabilities."""

    mean: np.ndarray
    var: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    leave: np.ndarray

    def emit(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.mean
        return -0.5 * (np.log(2 * np.pi * self.var) + d * d / self.var).sum(2)

    @classmethod
    def stack(cls, models: list, trans: np.ndarray, start: np.ndarray, leave: np.ndarray) -> Hmm:
        return cls(np.concatenate([m.mean for m in models]), np.concatenate([m.var for m in models]), trans, start, leave)


@dataclass
class Discrete:
    """Chances of symbols, a row a state, by logarithms; log start, transition and leave probabilities."""

    symbols: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    leave: np.ndarray

    def emit(self, x: np.ndarray) -> np.ndarray:
        """x: symbols by number, in the first column."""
        return self.symbols[:, x[:, 0].astype(int)].T

    @classmethod
    def stack(cls, models: list, trans: np.ndarray, start: np.ndarray, leave: np.ndarray) -> Discrete:
        return cls(np.concatenate([m.symbols for m in models]), trans, start, leave)


def odd(n: int) -> int:
    return n + 1 if n % 2 == 0 else n


def overlapping(x: np.ndarray, parts: int, share: float = 0.25) -> list[np.ndarray]:
    """x cut into `parts` even pieces, each longer by `share` of a piece on both sides; no piece is empty."""
    width = len(x) / parts
    ends = [(max(0, int(np.floor((i - share) * width))), min(len(x), int(np.ceil((i + 1 + share) * width)))) for i in range(parts)]
    return [x[min(a, len(x) - 1) : max(b, min(a, len(x) - 1) + 1)] for a, b in ends]


def left_right(examples: list[np.ndarray], states: int, floor: np.ndarray, stay: float, leave: float = 0.2, skip: float = 0.1) -> Hmm:
    """A left-right model: each example is cut into overlapping segments, one a state; states may be skipped."""
    parts = list(zip(*[overlapping(x, states) for x in examples]))
    mean = np.stack([np.concatenate(p).mean(0) for p in parts])
    return moving(mean, np.maximum(np.stack([np.concatenate(p).var(0) for p in parts]), floor), stay, leave, skip)


def moving(mean: np.ndarray, var: np.ndarray, stay: float, leave: float = 0.2, skip: float = 0.1) -> Hmm:
    """A left-right model of the states given, which may be skipped."""
    states = len(mean)
    trans = np.zeros((states, states))
    for s in range(states):
        trans[s, s] = stay
        if s + 1 < states:
            trans[s, s + 1] = (1 - stay) * (1 - skip if s + 2 < states else 1)
        if s + 2 < states:
            trans[s, s + 2] = (1 - stay) * skip
    start, out = np.full(states, -np.inf), np.full(states, -np.inf)
    start[0], out[-1] = 0.0, np.log(leave)
    with np.errstate(divide="ignore"):
        return Hmm(mean, var, np.log(trans), start, out)


def counted(model: Hmm, examples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected frames of each state, their sums and squares, and moves between states, over all paths through the examples."""
    n, s, q, moves = 0.0, 0.0, 0.0, 0.0
    for x, (p, m, _) in zip(examples, forward_backward_many(model, examples)):
        n, s, q, moves = n + p.sum(0), s + p.T @ x, q + p.T @ (x * x), moves + m
    return n, s, q, moves


def estimated(model: Hmm, counts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], floor: np.ndarray, keep_var: bool = False) -> Hmm:
    """Means, variances and transitions by what `counted` gives."""
    n, s, q, moves = counts
    n = np.maximum(n, 1e-9)[:, None]
    mean = s / n
    var = model.var if keep_var else np.maximum(q / n - mean**2, floor)
    total = moves.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        trans = np.where(total > 1e-9, np.log(moves / total), model.trans)
    return Hmm(mean, var, trans, model.start, model.leave)


#: How often a model of occurrences is re-estimated.
ROUNDS = 3


def trained(model: Hmm, examples: list[np.ndarray], floor: np.ndarray, rounds: int = ROUNDS, keep_var: bool = False) -> Hmm:
    """Re-estimated means, variances and transitions over all paths through the examples."""
    for _ in range(rounds):
        model = estimated(model, counted(model, examples), floor, keep_var)
    return model


def blended(model: Hmm, trans: np.ndarray, share: float = 0.5) -> Hmm:
    """Transitions mixed with others, as chances."""
    with np.errstate(divide="ignore"):
        return Hmm(model.mean, model.var, np.log(share * np.exp(trans) + (1 - share) * np.exp(model.trans)), model.start, model.leave)


def _stay(length: float, states: int) -> float:
    return max(1 - (states - 1) / length, 0.1) if states > 1 else max(1 - 1 / length, 0.1)


def occurrence_states(least: int, mean: float) -> int:
    """States of a model of several occurrences: as many as their mean length, but no more than twice the shortest less one, and odd."""
    return odd(max(1, min(2 * least - 1, int(mean))))


def from_occurrences(examples: list[np.ndarray], floor: np.ndarray) -> Hmm:
    """A model of several occurrences."""
    lengths = [len(x) for x in examples]
    states = occurrence_states(min(lengths), np.mean(lengths))
    first = left_right(examples, states, floor, _stay(np.mean(lengths), states))
    return blended(trained(first, examples, floor), first.trans)


def group_states(mean: float) -> int:
    """States of a model of a group: as many as three quarters of the mean length, and odd."""
    return odd(max(1, int(mean * 0.75)))


def from_group(examples: list[np.ndarray], floor: np.ndarray, share: float = 0.98) -> Hmm:
    """A model of a group without re-estimation: each state's deviation is mixed with the mean over states."""
    mean = np.mean([len(x) for x in examples])
    states = group_states(mean)
    return levelled(left_right(examples, states, floor, _stay(mean, states)), floor, share)


def levelled(m: Hmm, floor: np.ndarray, share: float = 0.98) -> Hmm:
    """Each state's deviation, mixed with the mean over states."""
    sd = share * np.sqrt(m.var) + (1 - share) * np.sqrt(m.var).mean(0)
    return Hmm(m.mean, np.maximum(sd**2, floor), m.trans, m.start, m.leave)


class Apart:
    """A model of occurrences or of a group whose examples lie in many places: sums over some of them are added up, round by round, each round's model coming from the sums of all."""

    def __init__(self, how: str, least: int, mean: float, floor: np.ndarray):
        self.how, self.floor, self.model = how, floor, None
        self.states = occurrence_states(least, mean) if how == "occurrences" else group_states(mean)
        self.stay = _stay(mean, self.states)
        self.rounds = 1 + (ROUNDS if how == "occurrences" else 0)

    def sums(self, examples: list[np.ndarray], middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """In the first round frames of each state, their sums and squares about `middle`; later what `counted` gives."""
        if self.model is not None:
            return counted(self.model, examples)
        parts = [np.concatenate(p) - middle for p in zip(*[overlapping(x, self.states) for x in examples])]
        n = np.array([len(p) for p in parts], float)
        return n, np.stack([p.sum(0) for p in parts]), np.stack([(p * p).sum(0) for p in parts]), np.zeros((self.states, self.states))

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray, moves: np.ndarray, middle: np.ndarray) -> None:
        """The next round's model by the sums of all examples."""
        if self.model is None:
            mean = s / n[:, None]
            self.first = moving(mean + middle, np.maximum(q / n[:, None] - mean**2, self.floor), self.stay)
            self.model = self.first
        else:
            self.model = estimated(self.model, (n, s, q, moves), self.floor)

    def done(self) -> Hmm:
        return blended(self.model, self.first.trans) if self.how == "occurrences" else levelled(self.model, self.floor)


def from_window(x: np.ndarray, var: np.ndarray) -> Hmm:
    """A model of one window: states for three quarters of its length, all with the variance given."""
    return from_windows([x], var)[0]


def from_windows(xs: list[np.ndarray], var: np.ndarray) -> list[Hmm]:
    """A model of each window alone; those of one length are trained at the same time, each by its own model."""
    out: list[Hmm] = [None] * len(xs)  # type: ignore[list-item]
    for size in {len(x) for x in xs}:
        own = [i for i, x in enumerate(xs) if len(x) == size]
        for at in range(0, len(own), WINDOWS):
            some = own[at : at + WINDOWS]
            for i, m in zip(some, _of_windows(np.stack([xs[i] for i in some]), var)):
                out[i] = m
    return out


#: Windows whose models are trained at the same time.
WINDOWS = 1024


def _of_windows(x: np.ndarray, var: np.ndarray, rounds: int = ROUNDS) -> list[Hmm]:
    """x: (windows, frames, dims)."""
    size = x.shape[1]
    states = odd(max(3, round(size * 0.75)))
    parts = overlapping(np.arange(size), states)
    mean = np.stack([x[:, p].mean(1) for p in parts], axis=1)
    one = moving(mean[0], np.tile(var, (states, 1)).astype(float), _stay(size, states))
    trans = np.tile(one.trans, (len(x), 1, 1))
    for _ in range(rounds):
        d = x[:, :, None, :] - mean[:, None]
        e = -0.5 * (np.log(2 * np.pi * one.var) + d * d / one.var).sum(3)
        a, b = np.zeros(e.shape), np.zeros(e.shape)
        a[:, 0] = one.start + e[:, 0]
        for t in range(1, size):
            a[:, t] = _log_sum(a[:, t - 1, :, None] + trans, 1) + e[:, t]
        for t in range(size - 2, -1, -1):
            b[:, t] = _log_sum(trans + (e[:, t + 1] + b[:, t + 1])[:, None], 2)
        total = _log_sum(a[:, -1], 1)
        moves = np.zeros(trans.shape)
        for t in range(size - 1):
            moves += np.exp(a[:, t, :, None] + trans + (e[:, t + 1] + b[:, t + 1])[:, None] - total[:, None, None])
        p = np.exp(a + b - total[:, None, None])
        mean = np.einsum("wtk,wtd->wkd", p, x) / np.maximum(p.sum(1), 1e-9)[:, :, None]
        out = moves.sum(2, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            trans = np.where(out > 1e-9, np.log(moves / out), trans)
    return [blended(Hmm(m, one.var, t, one.start, one.leave), one.trans) for m, t in zip(mean, trans)]


def mixture(paths: list[Hmm]) -> Hmm:
    """Models side by side as one: any of them is entered with the same chance and left from its own end."""
    n, at = sum(len(m.mean) for m in paths), 0
    trans, start, leave = np.full((n, n), -np.inf), np.full(n, -np.inf), np.full(n, -np.inf)
    for m in paths:
        k = len(m.mean)
        trans[at : at + k, at : at + k] = m.trans
        start[at : at + k], leave[at : at + k] = m.start - np.log(len(paths)), m.leave
        at += k
    return Hmm(np.concatenate([m.mean for m in paths]), np.concatenate([m.var for m in paths]), trans, start, leave)


def background(mean: np.ndarray, var: np.ndarray, leave: float = 0.2) -> Hmm:
    return Hmm(mean[None], var[None], np.log([[1 - leave]]), np.zeros(1), np.log([leave]))


def join(models: list[Hmm]) -> tuple[Hmm, np.ndarray]:
    """One model in which any model may follow any other, and the model of each of its states."""
    owner = np.concatenate([np.full(len(m.start), i) for i, m in enumerate(models)])
    n = len(owner)
    trans = np.full((n, n), -np.inf)
    at = np.concatenate([[0], np.cumsum([len(m.start) for m in models])])
    start = np.concatenate([m.start for m in models]) - np.log(len(models))
    leave = np.concatenate([m.leave for m in models])
    for i, m in enumerate(models):
        trans[at[i] : at[i + 1], at[i] : at[i + 1]] = m.trans
    trans = np.logaddexp(trans, leave[:, None] + start[None])
    return models[0].stack(models, trans, start, leave), owner


def parse_mixture(paths: list[Hmm], wide: Hmm) -> Hmm:
    """One model that parses a stretch into any of the paths, with a background before, between and after them."""
    return join([wide, *paths])[0]


def viterbi(model: Hmm, x: np.ndarray) -> tuple[np.ndarray, float]:
    """The best path of states and its log likelihood."""
    e = model.emit(x)
    back = np.zeros(e.shape, int)
    score = model.start + e[0]
    for t in range(1, len(x)):
        step = score[:, None] + model.trans
        back[t] = step.argmax(0)
        score = step.max(0) + e[t]
    path = np.empty(len(x), int)
    path[-1] = score.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(score.max())


def viterbi_many(model: Hmm | Discrete, xs: list[np.ndarray], block: int = 1024) -> tuple[list[np.ndarray], list[float]]:
    """The best path and its log likelihood for each of several series, those of similar length at the same time, `block` series at most."""
    paths, scores = [np.zeros(0, int)] * len(xs), [0.0] * len(xs)
    order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    for at in range(0, len(order), block):
        own = order[at : at + block]
        last = block_products(model, [xs[i] for i in own], [True] * len(own))
        ends = [int(s.argmax()) if len(s) else 0 for s in last]
        for i, path, s in zip(own, viterbi_within_many(model, [xs[i] for i in own], [np.zeros(0)] * len(own), ends), last):
            paths[i], scores[i] = path, float(s.max()) if len(s) else 0.0
    return paths, scores


def together(model: Hmm | Discrete, xs: list[np.ndarray], per_series: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Series of similar length, the longest first: their numbers, lengths and the log chances of their frames (series, frames, states), as many at a time as hold HELD numbers, `per_series` more each. Empty ones are left out."""
    order, k = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: -len(xs[i])), len(model.start)
    at = 0
    while at < len(order):
        some = order[at : at + max(1, HELD // (len(xs[order[at]]) * k + per_series))]
        at += len(some)
        sizes = np.array([len(xs[i]) for i in some])
        e = np.zeros((len(some), sizes[0], k))
        e[np.arange(sizes[0]) < sizes[:, None]] = model.emit(np.concatenate([xs[i] for i in some]))
        yield some, sizes, e


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def block_products(model: Hmm, blocks: list[np.ndarray], first: list[bool]) -> list[np.ndarray]:
    """For each block of frames the best scores from every state before it to every state at its end (states, states); of a series' first block, the best scores of its last states (states,).

    These multiply: sums in place of products and maxima in place of sums. Blocks of similar length are worked on together.
    """
    out: list[np.ndarray] = [np.zeros(0)] * len(blocks)
    k = len(model.start)
    for start in (True, False):
        own = [i for i, f in enumerate(first) if bool(f) == start]
        for some, sizes, e in together(model, [blocks[i] for i in own], k**2 if start else k**3):
            score = model.start + e[:, 0] if start else model.trans + e[:, 0, None]
            for t in range(1, sizes[0]):
                on = int(np.searchsorted(-sizes, -t))  # the longer blocks come first
                if start:
                    score[:on] = (score[:on, :, None] + model.trans).max(1) + e[:on, t]
                else:
                    score[:on] = (score[:on, :, :, None] + model.trans).max(2) + e[:on, t, None]
            for i, s in zip(some, score):
                out[own[i]] = s
    return out


#: Series times models whose scores are worked on at a time.
LANES = 4096


def best_totals(base: list[Hmm], tried: list[Hmm], xs: list[np.ndarray]) -> np.ndarray:
    """For each model tried, the summed log likelihood of the best paths of all series through `base` and it, joined. Models of as many states are worked on together, along the moves that are possible."""
    out = np.zeros(len(tried))
    for some, sizes, e in together(join(base)[0], xs, 0):
        e = np.ascontiguousarray(e.transpose(1, 2, 0))  # frames, states, series
        x = np.zeros((sizes[0], xs[some[0]].shape[1], len(some)))
        for i, n in enumerate(some):
            x[: sizes[i], :, i] = xs[n]
        ons = [int(np.searchsorted(-sizes, -t)) for t in range(sizes[0])]  # the longer series come first
        for states in {len(m.start) for m in tried}:
            own = [i for i, m in enumerate(tried) if len(m.start) == states]
            step = max(1, LANES // len(some))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                out[part] += _totals(base, [tried[i] for i in part], e, x, ons)
    return out


def _totals(base: list[Hmm], tried: list[Hmm], e: np.ndarray, x: np.ndarray, ons: list[int]) -> np.ndarray:
    joint = [join([*base, m])[0] for m in tried]
    start, trans = np.stack([m.start for m in joint], axis=1)[:, :, None], np.stack([m.trans for m in joint], axis=2)[..., None]
    mean, var = (np.stack([getattr(m, name) for m in tried], axis=2)[..., None] for name in ("mean", "var"))  # states, dims, models
    level, weight = -0.5 * np.log(2 * np.pi * var).sum(1), -0.5 / var
    old, moves = e.shape[1], [np.flatnonzero((trans[:, j] > -np.inf).any((1, 2))) for j in range(len(trans))]

    def emitted(j: int, t: int, on: int) -> np.ndarray:
        if j < old:
            return e[t, j, :on]
        total = level[j - old]
        for d in range(x.shape[1]):
            step = x[t, d, :on] - mean[j - old, d]
            step *= step
            step *= weight[j - old, d]
            step += total
            total = step
        return total

    n = e.shape[2]
    score = np.stack([np.broadcast_to(start[j] + emitted(j, 0, n), (len(tried), n)) for j in range(len(trans))])
    for t in range(1, len(e)):
        on, new = ons[t], []
        for j, froms in enumerate(moves):
            best = None
            for i in froms:
                step = score[i, :, :on] + trans[i, j]
                best = step if best is None else np.maximum(best, step, out=best)
            new.append(np.full((len(tried), on), -np.inf) if best is None else np.add(best, emitted(j, t, on), out=best))
        score[:, :, :on] = new
    return score.max(0).sum(1)


def composed(products: list[np.ndarray]) -> tuple[list[np.ndarray], list[int], list[int], float]:
    """From the products of a series' blocks in order: the scores of all states before each block (none before the first), the best path's state before each block (-1) and at its end, and its log likelihood."""
    before, score = [np.zeros(0)], products[0]
    for m in products[1:]:
        before.append(score)
        score = (score[:, None] + m).max(0)
    state, enters, ends = int(score.argmax()), [-1] * len(products), [0] * len(products)
    for b in range(len(products) - 1, -1, -1):
        ends[b] = state
        if b:
            state = enters[b] = int((before[b] + products[b][:, state]).argmax())
    return before, enters, ends, float(score.max())


def viterbi_within(model: Hmm, x: np.ndarray, before: np.ndarray, end: int) -> np.ndarray:
    """The best path through a block that ends in a given state, from the scores of all states before it; without any the block is a series' first."""
    return viterbi_within_many(model, [x], [before], [end])[0]


def viterbi_within_many(model: Hmm, xs: list[np.ndarray], before: list[np.ndarray], ends: list[int]) -> list[np.ndarray]:
    """As `viterbi_within`, for many blocks, those of similar length at the same time."""
    paths, k = [np.zeros(0, int)] * len(xs), len(model.start)
    for some, sizes, e in together(model, xs, k**2):
        back, rows = np.zeros(e.shape, np.int32), np.arange(len(some))
        score = np.stack([(before[i][:, None] + model.trans).max(0) if len(before[i]) else model.start for i in some]) + e[:, 0]
        for t in range(1, sizes[0]):
            on = int(np.searchsorted(-sizes, -t))  # the longer blocks come first
            step = score[:on, :, None] + model.trans
            back[:on, t] = step.argmax(1)
            score[:on] = step.max(1) + e[:on, t]
        path, state = np.zeros(e.shape[:2], int), np.array([ends[i] for i in some])
        for t in range(sizes[0] - 1, -1, -1):
            on = int(np.searchsorted(-sizes, -t))
            path[:on, t] = state[:on]
            state[:on] = back[rows[:on], t, state[:on]]
        for i, n, own in zip(some, sizes, path):
            paths[i] = own[:n]
    return paths


def forward_backward(model: Hmm | Discrete, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State probabilities of each frame, summed transition probabilities, and the log likelihood."""
    return forward_backward_many(model, [x])[0]


def forward_backward_many(model: Hmm | Discrete, xs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """As `forward_backward`, for many series, those of similar length at the same time."""
    k = len(model.start)
    out = [(np.zeros((0, k)), np.zeros_like(model.trans), 0.0)] * len(xs)
    for some, sizes, e in together(model, xs, 2 * k**2):
        a, b = np.zeros(e.shape), np.zeros(e.shape)
        a[:, 0] = model.start + e[:, 0]
        ons = [int(np.searchsorted(-sizes, -t)) for t in range(sizes[0] + 1)]  # the longer series come first
        for t in range(1, sizes[0]):
            on = ons[t]
            a[:on, t] = _log_sum(a[:on, t - 1, :, None] + model.trans, 1) + e[:on, t]
        for t in range(sizes[0] - 2, -1, -1):
            on = ons[t + 1]
            b[:on, t] = _log_sum(model.trans + (e[:on, t + 1] + b[:on, t + 1])[:, None], 2)
        total = _log_sum(a[np.arange(len(some)), sizes - 1], 1)
        moves = np.zeros((len(some), k, k))
        for t in range(sizes[0] - 1):
            on = ons[t + 1]
            moves[:on] += np.exp(a[:on, t, :, None] + model.trans + (e[:on, t + 1] + b[:on, t + 1])[:, None] - total[:on, None, None])
        for row, (i, n) in enumerate(zip(some, sizes)):
            out[i] = np.exp(a[row, :n] + b[row, :n] - total[row]), moves[row], float(total[row])
    return out


def forward(model: Hmm | Discrete, x: np.ndarray) -> float:
    """The log likelihood of x over all paths."""
    return forward_many(model, [x])[0]


def forward_many(model: Hmm | Discrete, xs: list[np.ndarray]) -> list[float]:
    """The log likelihood of each of several series over all paths, those of similar length at the same time."""
    out = [0.0] * len(xs)
    for some, sizes, e in together(model, xs, len(model.start) ** 2):
        a = model.start + e[:, 0]
        for t in range(1, sizes[0]):
            on = int(np.searchsorted(-sizes, -t))  # the longer series come first
            a[:on] = _log_sum(a[:on, :, None] + model.trans, 1) + e[:on, t]
        for i, x in zip(some, _log_sum(a, 1)):
            out[i] = float(x)
    return out


def segments(path: np.ndarray, owner: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one model as (model, start, stop); entering a model's first state from its own last begins a new run."""
    out, begin = [], 0
    for t in range(1, len(path) + 1):
        if t == len(path) or owner[path[t]] != owner[path[t - 1]] or (first[path[t]] and path[t] < path[t - 1]):
            out.append((int(owner[path[begin]]), begin, t))
            begin = t
    return out


def assignment(gain: np.ndarray) -> list[int]:
    """For each row its own column, so that the sum of gains is largest; columns are at least as many as rows.

    Shortest augmenting paths over reduced costs.
    """
    cost = gain.max() - gain
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        least, before, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[col]:
            seen[col] = True
            row = match[col]
            free = np.flatnonzero(~seen[1:]) + 1
            now = cost[row - 1, free - 1] - u[row] - v[free]
            better = now < least[free]
            least[free[better]], before[free[better]] = now[better], col
            nearest = free[least[free].argmin()]
            delta = least[nearest]
            u[match[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            col = nearest
        while col:
            match[col] = match[before[col]]
            col = before[col]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def linkage(dist: np.ndarray, how: str) -> list[tuple[int, int, float]]:
    """Merges of an agglomerative clustering as (i, j, distance), clusters named by their least member; complete or average link."""
    dist = dist.astype(float).copy()
    np.fill_diagonal(dist, np.inf)
    size, out, alive = np.ones(len(dist)), [], np.ones(len(dist), bool)
    for _ in range(len(dist) - 1):
        i, j = np.unravel_index(np.argmin(dist), dist.shape)
        i, j = min(i, j), max(i, j)
        out.append((int(i), int(j), float(dist[i, j])))
        merged = np.maximum(dist[i], dist[j]) if how == "complete" else (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
        dist[i] = dist[:, i] = merged
        dist[i, i] = np.inf
        dist[j] = dist[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
    return out


def t_tail(t: float, df: float) -> float:
    """The chance of a Student t above |t|, by the regularised incomplete beta function's continued fraction."""
    from math import exp, lgamma, log

    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x / 2
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + k * d), 1 + k / c
                h *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        return h

    inside = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return inside / 2
