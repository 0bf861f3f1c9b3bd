"""Scoring formulas as column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.config import SalienceWeights


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86400e6


def base_level(n, age_days, d=0.5) -> Column:
    """ln(n + 1) - d ln(max(age, .001) / (n + 1))."""
    n = F.greatest(_c(n), F.lit(0)) + 1
    return F.log(n) - _c(d) * F.log(F.greatest(_c(age_days), F.lit(0.001)) / n)


def softplus(x) -> Column:
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def composite_score(match, base, hebbian, confidence, scale=1.0) -> Column:
    return _c(match) * softplus(_c(base) + _c(scale) * _c(hebbian)) * _c(confidence)


def strengthen(w, signal=1.0, rate=0.25) -> Column:
    return F.least(F.exp(F.log(F.greatest(_c(w), F.lit(0.001))) + _c(signal) * F.log(F.lit(1 + rate))), F.lit(5.0))


def decay_edge(w, days, scale=7.0) -> Column:
    return F.greatest(_c(w) * F.pow(1 + _c(days) / _c(scale), F.lit(-0.8)), F.lit(0.001))


def touched_confidence(confidence, access_count, times=1) -> Column:
    """Confidence after that many accesses; a value above .85 comes down to it."""
    n0 = _c(access_count)
    steps = F.sequence(F.lit(0), _c(times) - 1)
    fold = F.aggregate(steps, _c(confidence).cast("double"), lambda c, k: F.least(F.lit(0.85), c + 0.02 / (1 + F.sqrt(n0 + k))))
    return F.when(_c(times) > 0, fold).otherwise(_c(confidence))


def with_feedback(confidence, useful: Column, plus=0.05, minus=0.1) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(confidence) + F.when(useful, plus).otherwise(-minus)))


def above_half(c) -> Column:
    return F.greatest(F.lit(0.0), (_c(c) - 0.5) / 0.5)


def archive_after_days(access_count, confidence) -> Column:
    return F.least(30 * (1 + 0.6 * F.log1p(_c(access_count))) * (1 + 3 * above_half(confidence)), F.lit(360.0))


def edge_half_life(max_confidence, max_access, base=7.0) -> Column:
    return F.least(base * (1 + 2 * above_half(max_confidence)) * F.least(F.lit(2.0), 1 + 0.5 * F.log1p(_c(max_access))), F.lit(42.0))


def access_factor(na, nb) -> Column:
    return F.least(F.lit(1.0), 0.3 + 0.7 * F.log1p(_c(na) + _c(nb)) / F.log(F.lit(21.0)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def saturate(r) -> Column:
    """r / (1 + r)."""
    return _c(r) / (1 + _c(r))


def novelty(similarity, same_concept_recently: Column) -> Column:
    """1 without a match; else 1 - s*s, less .3 for a recent memory of the same concept, in [.05, .95]."""
    s = _c(similarity)
    return F.when(s.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 - s * s - F.when(same_concept_recently, 0.3).otherwise(0.0))))


def eviction_score(salience, confidence, access_count, idle_days) -> Column:
    n = _c(access_count)
    return 0.3 * _c(salience) + 0.3 * _c(confidence) + 0.2 * n / (n + 5) + 0.2 / (1 + _c(idle_days))


def decay_exponent(base, confidence, access_count) -> Column:
    return F.greatest(F.lit(0.2), _c(base) - 0.2 * above_half(confidence) - F.least(F.lit(0.1), 0.05 * F.log1p(_c(access_count))))


def vector_match(similarity, floor) -> Column:
    s = F.coalesce(_c(similarity), F.lit(0.0))
    return F.when(s > floor, F.least(F.lit(1.0), (s - floor) / (0.95 - floor))).otherwise(0.0)


def text_match(keyword, vector) -> Column:
    k, v = _c(keyword), _c(vector)
    return F.when((k > 0) & (v > 0), 0.5 * F.greatest(k, v) + 0.3 * F.least(k, v) + 0.2 * k * v).otherwise(F.greatest(k, v))


def feedback_bonus(confidence) -> Column:
    c = _c(confidence)
    return F.when(c > 0.55, F.least(F.lit(0.15), 0.3 * F.greatest(F.lit(0.0), c - 0.5))).otherwise(0.0)


def centrality(edge_count, weight_sum) -> Column:
    return F.when(_c(edge_count) > 0, F.least(F.lit(0.1), 0.03 * F.log1p(_c(weight_sum)))).otherwise(0.0)


def gated_composite(text, temporal, centr, bonus, confidence, text_weight, temporal_weight) -> Column:
    t = _c(text)
    gate = F.when(t > 0.1, t).otherwise(0.0)
    return (_c(text_weight) * t + gate * (_c(temporal_weight) * _c(temporal) + _c(centr) + _c(bonus))) * _c(confidence)


def salience(surprise, decision: Column, causal_depth, effort, novelty_, event_type: Column, memory_class: Column, verified: Column, trivial: Column, feedback: Column, active=0.4, staging=0.2) -> Column:
    """struct(score, disposition, reasons) of a write; absent signals count as 0, absent novelty as .8."""
    w = SalienceWeights()
    kind = F.when(feedback, "user_feedback").when(verified & (F.coalesce(event_type, F.lit("observation")) == "observation"), "decision").otherwise(F.coalesce(event_type, F.lit("observation")))
    cls = F.when(feedback, "canonical").otherwise(F.coalesce(memory_class, F.lit("working")))
    verified, trivial = ~feedback & verified, ~feedback & ~verified & trivial
    s, d, k, e = F.coalesce(_c(surprise), F.lit(0.0)), F.coalesce(decision, F.lit(False)), F.coalesce(_c(causal_depth), F.lit(0.0)), F.coalesce(_c(effort), F.lit(0.0))
    n = F.coalesce(_c(novelty_), F.lit(0.8))
    bonus = F.lit(0.0)
    for name, b in w.bonus.items():
        bonus = F.when(kind == name, b).otherwise(bonus)
    exempt = kind.isin("user_feedback", "surprise") | ((kind == "decision") & d)
    weak = ~exempt & (s + k + e + F.when(d, 0.5).otherwise(0.0) < 0.5)
    attenuated = weak & (bonus > 0)
    cap = F.when(attenuated, F.least(w.novelty * n, F.lit(0.30))).otherwise(w.novelty * n)
    raw = F.least(w.surprise * s + F.when(d, w.decision).otherwise(0.0) + w.causal_depth * k + w.effort * e + cap + F.when(attenuated, bonus * 0.25).otherwise(bonus), F.lit(1.0))
    raw = F.when(trivial, F.least(raw, F.lit(0.1))).otherwise(raw)
    kept = cls.isin("canonical", "structural")
    score = F.when(kept, F.greatest(raw, F.lit(0.7))).when((cls != "ephemeral") & verified, F.greatest(raw, F.lit(0.45))).otherwise(raw)
    disposition = F.when(kept | (score >= active), "active").when(score >= staging, "staging").otherwise("discard")
    reasons = F.array_compact(
        F.array(
            F.when(feedback, "auto:user_feedback"),
            F.when(verified, "auto:verified_finding"),
            F.when(trivial, "auto:trivial_operation"),
            F.when(s > 0.5, "high_surprise"),
            F.when(d, "decision_point"),
            F.when(k > 0.5, "causal_insight"),
            F.when(e > 0.5, "high_effort_resolution"),
            F.when(n > 0.7, "novel_information"),
            F.when(n < 0.3, "redundant_information"),
            F.when(bonus > 0, F.concat(F.lit("event:"), kind, F.when(attenuated, ":attenuated").otherwise(""))),
            F.when(attenuated & (w.novelty * n > 0.30), "novelty:capped"),
            F.when(cls.isin("canonical", "structural", "ephemeral"), F.concat(F.lit("class:"), cls)),
            F.concat(F.lit("disposition:"), disposition),
        )
    )
    return F.struct(score.alias("score"), disposition.alias("disposition"), reasons.alias("reasons"))


def prior_confidence(disposition: Column, event_type: Column) -> Column:
    """Confidence of a new memory by what was written."""
    return (
        F.when(disposition == "discard", 0.25).when(disposition == "staging", 0.40).when(event_type == "decision", 0.65).when(event_type == "friction", 0.60)
        .when(event_type == "causal", 0.60).when(event_type == "surprise", 0.55).when(event_type == "user_feedback", 0.70).otherwise(0.45)
    )
