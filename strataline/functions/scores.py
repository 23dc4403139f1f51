"""Scores, ranks and labels as expressions. Rounding is half-even where the score is a decimal fraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- similarity ------------------------------------------------------------


def dot(a, b) -> Column:
    """In doubles, whatever the arrays hold."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 if either has no length."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def similarity_plain(distance) -> Column:
    return F.lit(1.0) - _c(distance)


def similarity_half(distance) -> Column:
    return F.lit(1.0) - _c(distance) / 2


def similarity_capped(distance) -> Column:
    return F.lit(1.0) - F.least(_c(distance), F.lit(2.0)) / 2


def rerank_score(distance, content, question_words, kind) -> Column:
    """0.6 of nearness, 0.3 of the share of the question's words inside, 0.1 of the kind."""
    words = F.array_distinct(question_words)
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(_c(content)), w)))
    share = F.least(hits / F.greatest(F.size(words), F.lit(1)), F.lit(1.0))
    worth = F.when(_c(kind).isin("function", "method"), 1.0).when(_c(kind) == "class", 0.8).when(_c(kind) == "block", 0.6).otherwise(0.5)
    return similarity_capped(distance) * 0.6 + share * 0.3 + worth * 0.1


# -- impact ----------------------------------------------------------------


def churn_factor(commits, known: bool = True) -> Column:
    return F.least(F.coalesce(_c(commits), F.lit(0)) / 20.0, F.lit(1.0)) if known else F.lit(1.0)


def risk(distance, centrality, most, churn) -> Column:
    share = F.when(_c(most) > 0, _c(centrality) / _c(most)).otherwise(F.lit(0.0))
    return F.bround((F.lit(1.0) / _c(distance)) * share * _c(churn), 4)


def risk_level(score) -> Column:
    return F.when(_c(score) >= 0.7, "high").when(_c(score) >= 0.3, "medium").otherwise("low")


def risk_reason(distance, share, churn, known: bool = True) -> Column:
    near = F.when(_c(distance) == 1, F.lit("direct importer")).otherwise(F.concat(_c(distance).cast("string"), F.lit(" hops away")))
    central = F.when(_c(share) >= 0.7, "high centrality").when(_c(share) >= 0.3, "moderate centrality")
    recent = F.when(_c(churn) >= 0.7, "high recent churn").when(_c(churn) >= 0.3, "moderate recent churn") if known else F.lit(None).cast("string")
    return F.concat_ws("; ", near, central, recent)


# -- health ----------------------------------------------------------------


def line_health(lines) -> Column:
    n = _c(lines)
    return F.when(n == 0, 0.80).when(n < 50, 0.95).when(n <= 200, 1.00).when(n <= 500, 0.85).when(n <= 1000, 0.65).otherwise(0.40)


def route_health(complexity, commits) -> Column:
    """0 to 1, from average complexity and commits."""
    cc, n = _c(complexity), _c(commits)
    off = F.when(cc > 15, 4.0).when(cc > 10, 2.5).when(cc > 5, 1.0).otherwise(0.0) + F.when(n > 100, 2.0).when(n > 50, 1.0).otherwise(0.0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.lit(10.0) - off)) / 10, 1)


def is_route_hotspot(complexity, commits) -> Column:
    return (_c(complexity) > 10) & (_c(commits) > 30)


def legacy_health(complexity, churn) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.least(_c(complexity), F.lit(50)) - F.least(_c(churn) * 2, F.lit(50)))


def is_legacy_hotspot(health, churn) -> Column:
    return (_c(health) < 50) & (_c(churn) > 5)


def recommendation(health, churn) -> Column:
    """Priority, message and action as one struct."""
    row = lambda p, m, a: F.struct(F.lit(p).alias("priority"), F.lit(m).alias("message"), F.lit(a).cast("string").alias("action"))
    h = _c(health)
    # The messages.
    return (
        F.when(h >= 80, row("none", "✅ This file is healthy. No immediate action needed.", None))
        .when(h >= 60, row("low", "ℹ️ Minor improvements possible. Monitor for increasing complexity.", "Consider cleanup during next related change"))
        .when((h >= 40) & (_c(churn) > 10), row("medium", "⚠️ High-churn file with growing complexity. Risk of bugs.", "Schedule refactoring in next sprint"))
        .when(h >= 40, row("medium", "⚠️ Complex file. Consider splitting into smaller modules.", "Review for extraction opportunities"))
        .otherwise(row("high", "🔴 HOTSPOT: High complexity + high churn. This is a bug magnet.", "Prioritize refactoring immediately. Consider pair programming."))
    )


def complexity_rank(average) -> Column:
    a = _c(average)
    return F.when(a <= 5, "A").when(a <= 10, "B").when(a <= 20, "C").when(a <= 30, "D").otherwise("F")


def churn_rank(commits) -> Column:
    return F.when(_c(commits) <= 3, "low").when(_c(commits) <= 10, "medium").otherwise("high")


def churn_risk(commits, months) -> Column:
    rate = _c(commits) / F.greatest(_c(months), F.lit(1))
    return F.when(rate > 10, "high").when(rate > 5, "medium").otherwise("low")


def history_risk(commits) -> Column:
    return F.when(_c(commits) > 30, "high").when(_c(commits) > 10, "medium").otherwise("low")


def structure_v1(has_git, total, root) -> Column:
    inside = F.when(_c(total) > 0, (_c(total) - _c(root)) / _c(total)).otherwise(0.0)
    return F.least(F.lit(10.0), F.when(_c(has_git), 2.0).otherwise(0.0) + inside * 8)


def structure_v2(has_git, folders, total, root) -> Column:
    ratio = _c(root) / _c(total)
    score = (
        F.lit(5.0)
        + F.when(_c(has_git), 1.5).otherwise(0.0)
        + F.when(_c(folders) >= 3, 1.5).when(_c(folders) >= 1, 0.5).otherwise(0.0)
        + F.when(_c(total) == 0, 0.0).when(ratio < 0.3, 2.0).when(ratio < 0.6, 1.0).otherwise(-1.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))


def expertise(lines, recent_commits) -> Column:
    return F.bround(_c(lines) * 1.0 + _c(recent_commits) * 5.0, 1)


# -- code ------------------------------------------------------------------


def element_complexity(code) -> Column:
    """0 to 100 from lines, control words and indentation."""
    lines = F.split(F.regexp_replace(_c(code), r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    loc = F.size(F.filter(lines, lambda x: x.rlike(r"\S") & ~F.ltrim(x).startswith("#") & ~F.ltrim(x).startswith("//")))
    flow = F.regexp_count(_c(code), F.lit(r"\b(" + "|".join(fixed.CONTROL_WORDS) + r")\b")) + 1
    indent = F.coalesce(F.array_max(F.transform(F.filter(lines, lambda x: x.rlike(r"\S")), lambda x: F.length(F.regexp_extract(x, r"^\s*", 0)))), F.lit(0))
    score = F.least(F.lit(40.0), loc / 100 * 40) + F.least(F.lit(40.0), flow / 20 * 40) + F.least(F.lit(20.0), F.floor(indent / 4) / 5 * 20)
    return F.bround(score, 2)


def test_complexity(code) -> Column:
    """1, a tenth for each line, and 1 for each line with control flow."""
    lines = F.split(F.regexp_replace(_c(code), r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    flow = F.size(F.filter(lines, lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in fixed.TEST_CONTROL_WORDS])))
    n = F.when(_c(code) == "", 0).otherwise(F.size(lines))
    return F.bround(F.lit(1.0) + n * 0.1 + flow, 2)


def complexity_label(score) -> Column:
    return F.when(_c(score) > 10, "high").when(_c(score) > 5, "moderate").when(_c(score) > 0, "low")


def doc_quality(has_doc, description_length, documented, total, kind, has_returns, returns_nothing, has_examples) -> Column:
    """0 to 100: presence 40, description 20, parameters 20, returns 10, examples 10."""
    score = (
        F.lit(40.0)
        + F.when(_c(description_length) >= 20, 20.0).when(_c(description_length) >= 10, 10.0).otherwise(0.0)
        + F.when(_c(total) > 0, _c(documented) / _c(total) * 20.0).otherwise(20.0)
        + F.when(~_c(kind).isin("function", "method"), 10.0).when(_c(has_returns) | _c(returns_nothing), 10.0).otherwise(0.0)
        + F.when(_c(has_examples), 10.0).otherwise(0.0)
    )
    return F.when(_c(has_doc), F.least(score, F.lit(100.0))).otherwise(0.0)


def simple_doc_quality(doc) -> Column:
    n = F.length(F.trim(F.coalesce(_c(doc), F.lit(""))))
    return F.when(n > 20, 100.0).when(n > 0, 50.0).otherwise(0.0)


# -- runtime ----------------------------------------------------------------


def alert_level(error_rate, p99) -> Column:
    return F.when((_c(error_rate) > 5) | (_c(p99) > 5000), "critical").when((_c(error_rate) > 1) | (_c(p99) > 2000), "warning").otherwise("none")


def runtime_summary(level, error_rate, average, last_error) -> Column:
    # The labels.
    head = F.when(_c(level) == "critical", "🔴 CRITICAL:").when(_c(level) == "warning", "⚠️ WARNING:").otherwise("✅ Healthy:")
    errors = F.when(_c(error_rate) > 0, F.concat(F.lit("Error rate: "), F.format_string("%.2f", _c(error_rate)), F.lit("%"))).otherwise("No errors")
    last = F.when(F.coalesce(_c(last_error), F.lit("")) != "", F.concat(F.lit("Last error: "), F.substring(_c(last_error), 1, 50), F.lit("...")))
    return F.concat_ws(" | ", head, errors, F.concat(F.lit("Avg latency: "), F.format_string("%.0f", _c(average)), F.lit("ms")), last)


# -- findings ----------------------------------------------------------------


def severity_rank(severity) -> Column:
    out = None
    for i, s in enumerate(fixed.SEVERITIES):
        out = F.when(_c(severity) == s, i) if out is None else out.when(_c(severity) == s, i)
    return out.otherwise(len(fixed.SEVERITIES))


def severity_weight(severity) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in fixed.SEVERITY_WEIGHTS.items() for x in p]), _c(severity)), F.lit(0))


def compliance_score(total_weight) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - F.coalesce(_c(total_weight), F.lit(0))))


def compliance_summary(total, critical) -> Column:
    n = _c(total).cast("string")
    return (
        F.when(_c(total) == 0, "No compliance violations found.")
        .when(_c(critical) > 0, F.concat(F.lit("Found "), n, F.lit(" violation(s), "), _c(critical).cast("string"), F.lit(" critical.")))
        .otherwise(F.concat(F.lit("Found "), n, F.lit(" violation(s).")))
    )


def commit_concerns(conflicts, sensitive, files, changed) -> Column:
    """What should be seen to before a commit; empty if nothing."""
    shown = F.array_join(F.slice(sensitive, 1, 3), ", ")
    return F.array_compact(
        F.array(
            F.when(_c(conflicts), F.lit("Resolve merge conflicts before committing.")),
            F.when(F.size(sensitive) > 0, F.concat(F.lit("Potentially sensitive file path(s): "), shown, F.lit("."))),
            F.when(_c(files) > 25, F.lit("This touches more than 25 files; consider splitting it into smaller commits.")),
            F.when(_c(changed) > 1200, F.lit("This is a large diff; consider reviewing and splitting it before committing.")),
        )
    )


def health_bar(score) -> Column:
    return F.bround(_c(score) * 10, 0).cast("int")


def health_band(score) -> Column:
    return F.when(_c(score) >= 0.8, "good").when(_c(score) >= 0.5, "fair").otherwise("poor")


# -- progress and time ---------------------------------------------------------


def percent(done, total) -> Column:
    return F.when(_c(total) > 0, _c(done) / _c(total) * 100).otherwise(0.0)


def eta_minutes(files) -> Column:
    return _c(files) * 15 / 60


def duration(seconds) -> Column:
    s = F.floor(_c(seconds)).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def age_phrase(days) -> Column:
    d = _c(days)
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    whole = lambda k: F.floor(d / k).cast("int")
    return (
        F.when(d == 0, "today")
        .when(d == 1, "yesterday")
        .when(d < 7, F.concat(d.cast("string"), F.lit(" days ago")))
        .when(d < 30, some(whole(7), "week"))
        .when(d < 365, some(whole(30), "month"))
        .otherwise(some(whole(365), "year"))
    )


def clamp01(x) -> Column:
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x))))


def backoff_seconds(attempt, base: float = 1.0, jitter=None) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), _c(attempt)) + (F.lit(0.0) if jitter is None else _c(jitter))
