"""A linear-chain conditional random field with two states over hashed features.

State 1's score minus state 0's is a sum of feature weights; ``pair`` scores
neighbouring states and ``first`` a chain's start in state 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np


@dataclass
class Chain:
    weight: np.ndarray   # per feature bucket
    pair: np.ndarray     # [from, to]
    first: float


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray, heavy: np.ndarray, buckets: int, mean: dict[int, float] | None = None,
          rounds: int = 50, decay: float = 1e-6, step: float = 0.3) -> Chain:
    """Maximise the conditional likelihood of chains (Adagrad, whole batches).

    ``x`` [chains, places, features] holds buckets (0: none), ``y`` the states, ``n``
    the lengths and ``heavy`` the weights of the chains; ``mean`` are the weights that
    features keep to as far as the chains say nothing else.
    """
    chains, places, parts = x.shape
    used, place = np.unique(x, return_inverse=True)
    place = place.reshape(x.shape)
    center = np.array([(mean or {}).get(int(b), 0.0) for b in used])
    active = used > 0
    mask = np.arange(places) < n[:, None]
    w = center.copy()
    theta = np.zeros(5)  # start, then transitions oo, ot, to, tt
    gw, gt = np.full(len(used), 1e-12), np.full(5, 1e-12)
    yi = y.astype(int)
    both = mask[:, 1:] * heavy[:, None]
    seen = np.array([(both * (yi[:, :-1] == a) * (yi[:, 1:] == b)).sum() for a in (0, 1) for b in (0, 1)], float)
    total = max((mask * heavy[:, None]).sum(), 1)
    for _ in range(rounds if chains else 0):
        e = np.stack([np.zeros(y.shape), w[place].sum(-1)], axis=-1)
        t = theta[1:].reshape(2, 2)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + [0, theta[0]]
        for i in range(1, places):
            now = np.logaddexp.reduce(fwd[:, i - 1, :, None] + t, axis=1) + e[:, i]
            fwd[:, i] = np.where(mask[:, i, None], now, fwd[:, i - 1])
        z = np.logaddexp.reduce(fwd[:, -1], axis=-1)
        for i in range(places - 2, -1, -1):
            now = np.logaddexp.reduce(t + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
            bwd[:, i] = np.where(mask[:, i + 1, None], now, 0.0)
        post = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None]) * mask
        joint = np.exp(fwd[:, :-1, :, None] + t + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        diff = (post - y * mask) * heavy[:, None]
        grad = (np.bincount(place.ravel(), np.repeat(diff.ravel(), parts), len(used)) / total + decay * (w - center)) * active
        gth = np.concatenate([[diff[:, 0].sum()], joint.sum((0, 1)).ravel() - seen]) / total + decay * theta
        gw += grad ** 2
        gt += gth ** 2
        w -= step * grad / np.sqrt(gw)
        theta -= 0.2 * gth / np.sqrt(gt)
    weight = np.zeros(buckets, np.float32)
    for b, v in (mean or {}).items():
        weight[b] = v
    weight[used[active]] = w[active]
    return Chain(weight, theta[1:].reshape(2, 2), float(theta[0]))


def odds(chain: Chain, emission: np.ndarray) -> np.ndarray:
    """Odds of state 1 at each place of one chain (forward-backward on state ratios)."""
    oo, ot, to, tt = np.exp(chain.pair).ravel().tolist()
    e = np.exp(np.clip(emission, -30, 30))
    if len(e) == 0:
        return e
    listed = e.tolist()
    fwd = np.fromiter(accumulate(listed[1:], lambda r, x: x * (r * tt + ot) / (r * to + oo), initial=listed[0] * float(np.exp(chain.first))), float, len(listed))
    bwd = np.fromiter(accumulate(listed[:0:-1], lambda b, x: (tt * x * b + to) / (ot * x * b + oo), initial=1.0), float, len(listed))
    return fwd * bwd[::-1]


def viterbi(chain: Chain, emission: list[float]) -> list[int]:
    """The likeliest states of one chain; ties go to state 0."""
    if not emission:
        return []
    (oo, ot), (to, tt) = chain.pair.tolist()
    a, b, back = 0.0, emission[0] + chain.first, []
    for e in emission[1:]:
        from_a, from_b = to + b > oo + a, tt + b > ot + a
        a, b = (to + b if from_a else oo + a), (tt + b if from_b else ot + a) + e
        back.append((from_a, from_b))
    state = int(b > a)
    out = [state]
    for step in reversed(back):
        state = int(step[state])
        out.append(state)
    return out[::-1]
