"""Scores of rows and edges: time, salience, confidence, fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring formulas.
TEMPORAL_HALF_LIFE_H = 168.0
SALIENCE_DECAY_PER_DAY, SALIENCE_ACCESS = 0.03, 0.05
RRF_K = 60
CHANNEL_WEIGHTS = {"semantic": 1.0, "bm25": 0.9, "entity": 1.0, "temporal": 0.35, "recency": 1.2, "ppr": 0.55, "salience": 0.25}


def seconds_between(now: Column, then: Column) -> Column:
    """now - then in seconds, of timestamps with or without zone."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1e6


def temporal_score(now: Column, created: Column, half_life_h: float = TEMPORAL_HALF_LIFE_H) -> Column:
    """2 ** -(age / half-life); rows of the future score 1, rows without a time count as new."""
    age = F.greatest(F.lit(0.0), F.coalesce(seconds_between(now, created), F.lit(0.0)) / 3600)
    return F.exp(age * (-math.log(2) / half_life_h))


def effective_salience(salience: Column, access: Column, created: Column, now: Column) -> Column:
    """Decayed salience plus a little for accesses, between 0.1 and 2."""
    days = F.greatest(F.lit(0.0), F.coalesce(seconds_between(now, created), F.lit(0.0)) / 86400)
    base = F.when(salience.isNull() | (salience == 0), 1.0).otherwise(salience)
    raw = base * F.exp(days * -SALIENCE_DECAY_PER_DAY) + F.log1p(F.coalesce(access, F.lit(0)).cast("double")) * SALIENCE_ACCESS
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), raw))


def touched_salience(salience: Column, access: Column, idle_days: Column, degree: Column) -> Column:
    """Salience after an access, between 0.1 and 3."""
    raw = F.coalesce(salience, F.lit(1.0)) * F.exp(idle_days * -0.03) + 0.04 * F.log1p(access.cast("double") + 1) + 0.02 * F.log1p(degree.cast("double"))
    return F.greatest(F.lit(0.1), F.least(F.lit(3.0), raw))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def confidence(n: Column, similarity: Column, contradictions: Column) -> Column:
    """Belief in a statement with n pieces of evidence of a mean similarity and some contradictions."""
    return sigmoid(0.5 * F.log1p(n.cast("double")) + 1.2 * similarity - 0.7 * contradictions)


def rrf(rank: Column, weight: float | Column = 1.0, k: int = RRF_K, first: int = 1) -> Column:
    """Contribution of a 1-based rank to reciprocal-rank fusion; ``first`` = 0 counts ranks from 0."""
    return weight / (k + rank - 1 + first)
