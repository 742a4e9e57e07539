"""Scores as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def days_between(later: Column, earlier: Column) -> Column:
    """Days from ``earlier`` to ``later``, not below 0; null if either is null."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.greatest(seconds / F.lit(86_400_000_000.0), F.lit(0.0))


def time_weight(days: Column) -> Column:
    return 1 + F.exp(-days * 24 / 36)


def activity_score(importance, activation, arousal, days, resolved, digested, pinned, protected, kind, p: Params = DEFAULTS) -> Column:
    """Activity of a record; unparseable age counts 30 days, flags come first."""
    d = F.coalesce(days, F.lit(30.0))
    a = clamp(F.coalesce(arousal, F.lit(0.3)), 0.0, 1.0)
    emotion = p.emotion_base + a * p.arousal_boost
    weight = time_weight(d)
    mixed = F.when(d <= 3.0, weight * 0.7 + emotion * 0.3).otherwise(emotion * 0.7 + weight * 0.3)
    base = clamp(F.coalesce(importance, F.lit(5)).cast("double"), 1.0, 10.0) * F.pow(F.greatest(F.coalesce(activation, F.lit(1)).cast("int"), F.lit(1)).cast("double"), F.lit(0.3)) * F.exp(-p.decay_lambda * d) * mixed
    faded = F.when(resolved & digested, 0.02).when(resolved, 0.05).otherwise(1.0)
    urgent = F.when((a > 0.7) & ~resolved, 1.5).otherwise(1.0)
    return F.when(pinned | protected | (kind == "permanent"), 999.0).when(kind == "feel", 50.0).otherwise(F.round(base * faded * urgent, 4))


def retrieval_decay(age_days, activation, resolved, exempt, p: Params = DEFAULTS) -> Column:
    """Forgetting factor; 1 without a time or for exempt records."""
    half = p.half_life_days * (1 + p.rehearsal * F.log2(1 + F.greatest(F.coalesce(activation, F.lit(0)).cast("double"), F.lit(0.0))))
    raw = F.exp(-0.693 * age_days / F.greatest(half, F.lit(0.001)))
    kept = F.when(resolved, raw).otherwise(F.greatest(raw, F.lit(p.min_decay)))
    return F.when(exempt | age_days.isNull(), 1.0).otherwise(clamp(kept, 0.0, 1.0))


def blend_decay(score: Column, decay: Column, p: Params = DEFAULTS) -> Column:
    return score * ((1 - p.decay_weight) + p.decay_weight * decay)


def emotion_score(valence, arousal, q_valence: float | None, q_arousal: float | None) -> Column:
    if q_valence is None or q_arousal is None:
        return F.lit(0.5)
    v, a = F.coalesce(valence, F.lit(0.5)), F.coalesce(arousal, F.lit(0.3))
    return F.greatest(1 - F.sqrt(F.pow(v - q_valence, 2) + F.pow(a - q_arousal, 2)) / 1.414, F.lit(0.0))


def time_score(days: Column) -> Column:
    return F.exp(-0.1 * F.coalesce(days, F.lit(30.0)))


def resonance(valence, arousal, tension, confidence, q_valence: float, q_arousal: float, q_tension: float) -> Column:
    dist = F.sqrt(F.pow((F.lit(q_valence) - valence) / 2, 2) + F.pow(F.lit(q_arousal) - arousal, 2)) / F.sqrt(F.lit(2.0))
    near = F.greatest(1 - dist, F.lit(0.0))
    calm = F.greatest(1 - F.abs(F.lit(q_tension) - tension), F.lit(0.0))
    return F.round((0.8 * near + 0.2 * calm) * confidence, 6)


def tie_break(score: Column, signal: Column, weight: float) -> Column:
    return score * (1 + min(max(weight, 0.0), 0.25) * clamp(signal, 0.0, 1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for a zero norm or unequal lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot / size)


def token_estimate(text: Column) -> Column:
    """Truncated 1.5 per CJK character + 1.3 per Latin word + 0.05 per character."""
    cjk = F.regexp_count(text, F.lit("[\\x{4e00}-\\x{9fff}]"))
    words = F.regexp_count(text, F.lit("[a-zA-Z]+"))
    return (cjk * 1.5 + words * 1.3 + F.length(text) * 0.05).cast("int")


def noisy_or(values: Column) -> Column:
    """1 - product of (1 - x) over an array, rounded at 3."""
    return F.round(1 - F.aggregate(values, F.lit(1.0), lambda s, x: s * (1 - clamp(x, 0.0, 1.0))), 3)


def backoff_s(attempts: Column, p: Params = DEFAULTS) -> Column:
    return F.least(p.retry_s * F.pow(F.lit(2.0), F.least(attempts, F.lit(8)).cast("double")), F.lit(float(p.retry_cap_s)))


def anchor_relevance(literal: Column, vector: Column, entity: Column) -> Column:
    """0.45 of the best of a literal score (of 100), a vector score and an entity match; null without any."""
    return F.round(0.45 * F.greatest(clamp(literal / 100, 0.0, 1.0) + F.when(literal.isNull(), None).otherwise(0.0), clamp(vector, 0.0, 1.0) + F.when(vector.isNull(), None).otherwise(0.0), F.when(entity, 1.0)), 6)


def segment_similarity(left: Column, right: Column) -> Column:
    """The greatest cosine of any two segments of two lists of vectors, 0 at least."""
    each = F.transform(left, lambda a: F.array_max(F.transform(right, lambda b: cosine(a, b))))
    return F.greatest(F.array_max(each), F.lit(0.0))


# Multipliers by intent, of (keyword pool, vector pool, keyword weight, vector weight),
# and the number of related records; intents that aren't listed change nothing.
POLICIES = {"fact": (1.35, 1.15, 1.35, 1.10, 1), "recall": (1.0, 1.25, 1.0, 1.15, 4), "relation": (1.0, 1.35, 0.90, 1.20, 8), "temporal": (1.30, 0.90, 1.25, 0.85, 2)}
DEFAULT_POLICY = (1.0, 1.0, 1.0, 1.0, 5)
# Boosts of related, emotional and recent records, terms of emotional ones, days that are recent.
RELATED, EMOTIONAL, RECENT, RECENT_DAYS = 1.05, 1.05, 1.15, 14
EMOTION_TERMS = ("恋爱", "关系", "感情", "亲密", "家庭", "约定", "自省", "信任", "社交", "心理", "feel", "沉淀物")


def policy(intent: Column, at: int) -> Column:
    """A policy's number: 0 keyword pool, 1 vector pool, 2 keyword weight, 3 vector weight, 4 related records."""
    return F.coalesce(*[F.when(intent == k, F.lit(v[at])) for k, v in POLICIES.items()], F.lit(DEFAULT_POLICY[at]))


def scaled_pool(intent: Column, base: int, at: int = 0) -> Column:
    return F.ceil(F.round(base * policy(intent, at), 6)).cast("int")


def intent_boost(intent: Column, n_relations: Column, terms: Column, age_days: Column) -> Column:
    """Multiplier of a record's score: related and emotional ones for questions of relations,
    recent ones for questions of time."""
    emotional = F.arrays_overlap(terms, F.array(*[F.lit(t) for t in EMOTION_TERMS]))
    related = F.when(n_relations > 0, RELATED).otherwise(1.0) * F.when(emotional, EMOTIONAL).otherwise(1.0)
    return F.when(intent == "relation", related).when((intent == "temporal") & (age_days <= RECENT_DAYS), RECENT).otherwise(1.0)


def lexicon_valence(text: Column, lexicon: dict[str, float]) -> Column:
    """Sum of a lexicon's values over its words in a text, turned round where negated, in -1..1."""
    from .intents import negated

    low, total = F.lower(text), F.lit(0.0)
    for word, value in lexicon.items():
        total = total + F.when(~F.contains(low, F.lit(word)), 0.0).when(negated(text, word), -value).otherwise(value)
    return clamp(total, -1.0, 1.0)
