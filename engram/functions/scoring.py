"""Scores: decay, rank fusion, budgets, category weights."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.schema import CLAMP, HALF_LIFE, sane_clamp, sane_half_life

#: Candidates of either kind, the rank of a missing one, and the constant of reciprocal rank fusion.
CANDIDATES = 50
MISSING_RANK = CANDIDATES + 1
RRF_K = 60
#: Half-life of importance, a week.
IMPORTANCE_HALF_LIFE = 7 * 86_400.0


def age(timestamp: Column, now: Column | int) -> Column:
    """Seconds up to ``now``, none for what lies ahead."""
    return F.greatest(F.lit(now) - timestamp, F.lit(0))


def recency_decay(timestamp: Column, now: Column | int, half_life: float = HALF_LIFE, default: float = HALF_LIFE) -> Column:
    """1 for now, 0.5 after ``half_life`` seconds; an unusable half-life is ``default``."""
    return F.pow(F.lit(0.5), age(timestamp, now) / F.lit(sane_half_life(half_life, default)))


def rrf(*ranks: Column, k: int = RRF_K, missing: int = MISSING_RANK) -> Column:
    """Sum of 1 / (k + rank); a null rank counts as ``missing``."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.lit(1.0) / (F.coalesce(r, F.lit(missing)) + k)
    return total


def fused_score(rank_sum: Column, decay: Column, boost: Column, clamp: float = CLAMP) -> Column:
    """Rank fusion, weighted by recency and by a boost that moves it by ``clamp`` at most."""
    c = sane_clamp(clamp)
    return rank_sum * decay * (1 + F.least(F.greatest(boost, F.lit(-c)), F.lit(c)))


def scale_budget(base: Column, compactions: Column, escalation: float = 0.25, cap: int | None = None) -> Column:
    """Tokens to give: ``escalation`` of ``base`` more for each compaction beyond the first, ``cap`` at most. Up to one
    compaction, or an unknown number, ``base`` as it is."""
    scaled = F.ceil(base * (1 + (compactions - 1) * F.lit(float(escalation)))).cast("bigint")
    if cap is not None:
        scaled = F.least(scaled, F.lit(cap))
    return F.when(compactions > 1, scaled).otherwise(base).cast("bigint")


CATEGORIES = ("corrective", "stateful", "decisive", "reinforcing")


@dataclass(frozen=True)
class Weights:
    """What each category of passage counts for; ``none``: a passage without one."""

    corrective: float = 1.5
    stateful: float = 1.2
    decisive: float = 1.3
    reinforcing: float = 1.0
    none: float = 0.5

    def of(self, categories: Column) -> Column:
        """The greatest weight among an array of categories."""
        best = F.array_max(F.transform(categories, lambda c: F.coalesce(*[F.when(c == n, F.lit(getattr(self, n))) for n in CATEGORIES], F.lit(self.none))))
        return F.coalesce(best, F.lit(self.none))


def adjust_weights(weights: Weights, compactions: int | None) -> Weights:
    """The same four weights in another order once a conversation was compacted: what was repeated
    counts most, then corrections after two compactions, state after more."""
    n = compactions or 0
    if n <= 1:
        return weights
    order = ("reinforcing", "corrective", "stateful", "decisive") if n == 2 else ("reinforcing", "stateful", "corrective", "decisive")
    values = sorted((getattr(weights, c) for c in CATEGORIES), reverse=True)
    return replace(weights, **dict(zip(order, values)))


def importance(recurrence: Column, weight: Column, decay: Column) -> Column:
    return recurrence * weight * decay


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays, in double precision; null if either has length 0 or sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot(a, b) / norms)


def similarity(distance: Column) -> Column:
    """1 - distance, not below 0; an unknown distance counts as 1."""
    return F.greatest(1 - F.coalesce(distance, F.lit(1.0)), F.lit(0.0))


def ideal_dcg(hits: int) -> float:
    return sum(1 / math.log2(i + 2) for i in range(hits))
