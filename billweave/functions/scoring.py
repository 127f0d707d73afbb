"""Score arithmetic over columns; every score is rounded to six places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def retrieval_policy(score: Column, margin: Column, conflict: Column) -> Column:
    """Retrieval score plus a bonus for the lead over the runner-up, halved on conflict."""
    raised = score + F.least(F.lit(0.15), F.greatest(F.lit(0.0), margin) * 0.5)
    return F.round(_clamp(F.when(conflict, raised * 0.5).otherwise(raised), 0.0, 0.999), 6)


def generated_policy(score: Column, margin: Column, agrees: Column, risky: Column) -> Column:
    """Score of a proposal from what was observed, not from its own claim."""
    base = 0.45 + 0.30 * score + 0.10 * F.least(F.lit(1.0), margin / 0.25)
    total = base + F.when(agrees, 0.10).otherwise(0.0) - F.when(risky, 0.35).otherwise(0.0)
    return F.round(_clamp(total, 0.0, 0.95), 6)


def review_priority(count: Column, value: Column, score: Column, currency: Column) -> Column:
    """Frequency times impact times uncertainty; mixed currencies have no impact."""
    comparable = F.when(currency == "MIXED", F.lit(0.0)).otherwise(F.abs(F.coalesce(value.cast("double"), F.lit(0.0))))
    frequency = 1.0 + F.log1p(F.greatest(F.lit(0), count).cast("double"))
    return F.round(frequency * (1.0 + F.log1p(comparable)) * F.greatest(F.lit(0.05), 1.0 - _clamp(score, 0.0, 1.0)), 6)


# What hybrid scores add without a conflict and for the same category, and their factor on conflict.
NO_CONFLICT, CATEGORY, CONFLICT_FACTOR = 0.10, 0.1, 0.35


def weighted(lexical, token, trigram):
    """Weighted text evidence, of columns or of arrays."""
    return 0.40 * lexical + 0.30 * token + 0.20 * trigram


def hybrid_score(
    lexical: Column, token: Column, trigram: Column, conflict: Column, same_category: Column,
    semantic: Column | None = None, weight: float = 0.2,
) -> Column:
    """Weighted evidence, an optional semantic blend, damped on conflict."""
    base = weighted(lexical, token, trigram)
    base = base + F.when(conflict, 0.0).otherwise(NO_CONFLICT) + F.when(same_category, CATEGORY).otherwise(0.0)
    score = F.least(F.lit(1.0), base)
    if semantic is not None:
        w = min(0.5, max(0.0, weight))
        score = F.when(semantic.isNull(), score).otherwise((1 - w) * score + w * _clamp(semantic, 0.0, 1.0))
    return F.round(F.when(conflict, score * CONFLICT_FACTOR).otherwise(score), 6)


def token_cost(text: Column, output_cap: int, input_price: float, output_price: float) -> Column:
    """Estimated cost of a call: a token per four characters in, the cap out, prices per million."""
    tokens_in = F.ceil(F.char_length(text) / 4)
    return F.round((tokens_in * input_price + F.lit(output_cap * output_price)) / 1_000_000, 6)
