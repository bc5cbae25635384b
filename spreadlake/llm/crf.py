"""A linear-chain conditional random field over word shapes, in numpy.

A token's label depends on the shapes of the tokens around it (`AROUND`), on the last cue
word before it, and on the label before. Labels are `outside`, and `first` and `next` of each
kind; a `next` may only follow its own kind. Training climbs the penalised log-likelihood of
a labelled table, forward and backward over all its rows at once; decoding is Viterbi over
many runs of tokens at once. Nothing here is random: equal tables give equal weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

AROUND = (-2, -1, 0, 1, 2)
NEVER = -1e4
ROUNDS, RATE, PENALTY = 250, 0.15, 0.02


@dataclass
class Model:
    kinds: tuple[str, ...]
    shape: np.ndarray  # (place around the token, shape, label)
    cue: np.ndarray  # (cue, label)
    follow: np.ndarray  # (label, next label)

    @property
    def labels(self) -> int:
        return 1 + 2 * len(self.kinds)


def allowed(kinds: int) -> np.ndarray:
    """0 where a label may follow another, NEVER elsewhere."""
    n = 1 + 2 * kinds
    out = np.zeros((n, n))
    for k in range(kinds):
        begin, inside = 1 + 2 * k, 2 + 2 * k
        out[:, inside] = NEVER
        out[[begin, inside], inside] = 0
    return out


def scores(model: Model, around: np.ndarray, cue: np.ndarray) -> np.ndarray:
    """(token, label) from the shapes around each token (token, place) and its cue."""
    out = model.cue[cue]
    for p in range(len(AROUND)):
        out = out + model.shape[p][around[:, p]]
    return out


def train(kinds: tuple[str, ...], shapes: int, cues: int, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """Weights from rows of (shapes around each token, cues, labels)."""
    n, fixed = 1 + 2 * len(kinds), allowed(len(kinds))
    model = Model(kinds, np.zeros((len(AROUND), shapes, n)), np.zeros((cues, n)), fixed.copy())
    size = np.array([len(y) for _, _, y in rows])
    longest, count = int(size.max()), len(rows)
    around = np.zeros((count, longest, len(AROUND)), np.int64)
    cue, want = np.zeros((count, longest), np.int64), np.zeros((count, longest), np.int64)
    for i, (a, c, y) in enumerate(rows):
        around[i, :len(y)], cue[i, :len(y)], want[i, :len(y)] = a, c, y
    real = np.arange(longest) < size[:, None]
    gold = np.eye(n)[want] * real[..., None]
    pairs = real[:, 1:]
    gold_follow = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    first_label = np.where((np.arange(n) % 2 == 0) & (np.arange(n) > 0), 0.0, 1.0)
    # which shape stands where, as columns, so that the slopes of all shapes are one product
    flat = np.flatnonzero(real.ravel())
    columns = [np.eye(shapes, dtype=np.float32)[around[..., p].ravel()[flat]].T for p in range(len(AROUND))]
    columns.append(np.eye(cues, dtype=np.float32)[cue.ravel()[flat]].T)
    squares = [np.full(w.shape, 1e-8) for w in (model.shape, model.cue, model.follow)]
    for _ in range(ROUNDS):
        emit = scores(model, around.reshape(-1, len(AROUND)), cue.ravel()).reshape(count, longest, n)
        # chances, scaled at every token so that they neither vanish nor grow
        weight = np.exp(emit - emit.max(axis=2, keepdims=True))
        move = np.exp(model.follow)
        ahead, scale = np.empty_like(emit), np.ones((count, longest, 1))
        step = weight[:, 0] * first_label
        for t in range(longest):
            if t:
                step = (ahead[:, t - 1] @ move) * weight[:, t]
            total = step.sum(axis=1, keepdims=True)
            scale[:, t] = np.where(real[:, t, None], total, 1)
            ahead[:, t] = np.where(real[:, t, None], step / total, ahead[:, t - 1])
        back = np.ones_like(emit)
        for t in range(longest - 2, -1, -1):
            step = (weight[:, t + 1] * back[:, t + 1] / scale[:, t + 1]) @ move.T
            back[:, t] = np.where(pairs[:, t, None], step, 1)
        chance = ahead * back * real[..., None]
        onward = weight[:, 1:] * back[:, 1:] / scale[:, 1:] * pairs[..., None]
        moves = move * (ahead[:, :-1].reshape(-1, n).T @ onward.reshape(-1, n))
        off = (gold - chance).reshape(-1, n)[flat].astype(np.float32)
        each = [c @ off for c in columns]
        slopes = [np.stack(each[:-1]), each[-1], gold_follow - moves]
        for w, slope, square in zip((model.shape, model.cue, model.follow), slopes, squares):
            free = w > NEVER / 2
            slope = np.where(free, slope - PENALTY * w, 0)
            square += slope * slope
            w += RATE * slope / np.sqrt(square)
    return model


def viterbi(model: Model, emit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best labels of runs of tokens, laid end to end: `emit` (token, label), `size` of
    each run. Runs of any length are decoded side by side, the longest first, so that a step
    holds the runs that still go on."""
    n = model.labels
    out = np.zeros(len(emit), np.int64)
    if not len(size):
        return out
    order = np.argsort(-size, kind="stable")
    first, size = (np.cumsum(size) - size)[order], size[order]
    going = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # runs with a token t
    start = np.where((np.arange(n) % 2 == 0) & (np.arange(n) > 0), NEVER, 0.0)
    score = emit[first] + start
    came = np.zeros((len(emit), n), np.int8)
    final = score.copy()
    for t in range(1, int(size[0])):
        k = going[t]
        options = score[:k, :, None] + model.follow
        came[first[:k] + t] = options.argmax(axis=1)
        score = options.max(axis=1) + emit[first[:k] + t]
        final[:k] = score
    label = final.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = going[t]
        # runs that end here come in with the label of their end
        out[first[:k] + t] = label[:k]
        if t:
            label[:k] = came[first[:k] + t, label[:k]]
    return out
