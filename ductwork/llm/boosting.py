"""Gradient-boosted trees of depth two for the logistic loss, fitted in numpy on a bounded sample and written as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Split = tuple[int, float]


@dataclass
class Boosted:
    """A start value and trees: (split, left split, right split, four leaf values); a row goes left where feature <= cut."""

    names: list[str]
    start: float = 0.0
    trees: list[tuple[Split, Split, Split, tuple[float, float, float, float]]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for (f, c), (lf, lc), (rf, rc), leaf in self.trees:
            left = x[:, f] <= c
            out += np.where(left, np.where(x[:, lf] <= lc, leaf[0], leaf[1]), np.where(x[:, rf] <= rc, leaf[2], leaf[3]))
        return out

    def sql(self) -> str:
        """The probability as an expression over the feature columns."""
        at = lambda s: f"{self.names[s[0]]} <= {s[1]!r}D"
        parts = [f"{self.start!r}D"]
        for top, left, right, leaf in self.trees:
            parts.append(f"CASE WHEN {at(top)} THEN CASE WHEN {at(left)} THEN {leaf[0]!r}D ELSE {leaf[1]!r}D END ELSE CASE WHEN {at(right)} THEN {leaf[2]!r}D ELSE {leaf[3]!r}D END END")
        return f"1.0D / (1.0D + exp(-({' + '.join(parts)})))"


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], reg: float) -> Split:
    """The cut with the highest gain; (0, inf), which splits nothing, if none gains."""
    whole, best, found = g.sum() ** 2 / (h.sum() + reg), 1e-9, (0, 1e300)
    for f, at in enumerate(cuts):
        if not len(at) or not len(x):
            continue
        place = np.searchsorted(at, x[:, f], side="left")
        gl, hl = np.cumsum(np.bincount(place, weights=g, minlength=len(at) + 1))[:-1], np.cumsum(np.bincount(place, weights=h, minlength=len(at) + 1))[:-1]
        gain = gl**2 / (hl + reg) + (g.sum() - gl) ** 2 / (h.sum() - hl + reg) - whole
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = float(gain[k]), (f, float(at[k]))
    return found


def boost(names: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 25, rate: float = 0.3, reg: float = 1.0, bins: int = 16) -> Boosted:
    """Newton boosting; cuts are quantiles of the sample."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Boosted(names, float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    margin = model.margin(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        top = best_split(x, g, h, cuts, reg)
        left = x[:, top[0]] <= top[1]
        low, high = (best_split(x[m], g[m], h[m], cuts, reg) for m in (left, ~left))
        a, b = x[:, low[0]] <= low[1], x[:, high[0]] <= high[1]
        leaf = tuple(float(-rate * g[m].sum() / (h[m].sum() + reg)) for m in (left & a, left & ~a, ~left & b, ~left & ~b))
        model.trees.append((top, low, high, leaf))
        margin = margin + Boosted(names, 0.0, model.trees[-1:]).margin(x)
    return model


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which the share of ones among scores at or above it is at least precision; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    good = np.flatnonzero((hits / np.arange(1, len(s) + 1) >= precision) & (np.append(s[1:], -1.0) < s))
    return float(s[good[-1]]) if len(good) else 1.1
