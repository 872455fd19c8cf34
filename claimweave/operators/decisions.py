"""Decision ladders, routing and dependency rules over evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first condition that holds; an undefined one doesn't."""
    out = F.lit(otherwise)
    for condition, name in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def reasons(*checks: tuple[Column, str]) -> Column:
    """Names of all conditions that hold, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks))), ",")


def next_model(order: list[str], attempted: Column) -> Column:
    """The first model of the escalation order that wasn't tried; null when all were."""
    return F.get(F.array_except(F.array(*map(F.lit, order)), attempted), F.lit(0))


def with_precedence(rows: DataFrame, policies: DataFrame, family: str, field: str, value: str, default: Column) -> DataFrame:
    """``rows`` with ``value`` from the policy of (family, field), else (*, field), else (family, *), else ``default``.

    ``policies`` (family, field, value) is a configuration table with one row a key.
    """
    policies = policies.select(F.col(family).alias("__f"), F.col(field).alias("__n"), F.col(value).alias("__v"))
    out, found = rows, []
    for k, (f, n) in enumerate((("own", "own"), ("*", "own"), ("own", "*"))):
        left = [F.col(family) if f == "own" else F.lit("*"), F.col(field) if n == "own" else F.lit("*")]
        p = policies.withColumnsRenamed({c: f"{c}{k}" for c in ("__f", "__n", "__v")})
        out = out.join(F.broadcast(p), (left[0] == F.col(f"__f{k}")) & (left[1] == F.col(f"__n{k}")), "left")
        found.append(F.col(f"__v{k}"))
    return out.select(*rows.columns, F.coalesce(*found, default).alias(value))


def dependency(left: dict[str, Column], right: dict[str, Column], strong: list[str]) -> Column:
    """How two pieces of evidence depend on each other, by the lineage attributes they share.

    CORRELATED if a strong attribute is equal, UNKNOWN if none is known on both
    sides, INDEPENDENT if all known ones differ, PARTIAL else.
    """
    same, known, deep = F.lit(0), F.lit(0), F.lit(False)
    for name, a in left.items():
        b = right[name]
        both = a.isNotNull() & b.isNotNull()
        known = known + both.cast("int")
        same = same + F.coalesce(a == b, F.lit(False)).cast("int")
        if name in strong:
            deep = deep | F.coalesce(a == b, F.lit(False))
    return F.when(deep, "CORRELATED").when(known == 0, "UNKNOWN").when(same == 0, "INDEPENDENT").otherwise("PARTIAL")


def cheapest_route(options: list[tuple[str, list[str], float]], available: Column) -> Column:
    """Struct (route, missing, cost) of the cheapest way to complete the evidence; cost is per missing class."""
    routes = F.array(
        *(
            F.struct((F.size(F.array_except(F.array(*map(F.lit, classes)), available)) * F.lit(cost)).alias("cost"), F.lit(name).alias("route"), F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, classes)), available)), "+").alias("missing"))
            for name, classes, cost in options
        )
    )
    return F.array_min(routes)


def field_decision(missing: Column, contradicted: Column, by_reference: Column, confidence: Column, accept_from: float = 0.98, corroborate_from: float = 0.94) -> Column:
    """A field's place on the decision ladder."""
    return ladder(
        (missing, "HITL_MISSING"), (contradicted, "HITL_CONTRADICTION"), (by_reference, "REFERENCE_CONFIRMED"), (confidence >= accept_from, "AUTO_ACCEPT"), (confidence >= corroborate_from, "ACCEPT_WITH_CORROBORATION"), otherwise="HITL_LOW_CONFIDENCE"
    )


def label_refusals(reviewer: Column, approver: Column, contradictory: Column, held_out: Column) -> Column:
    """Why a label may not be used for training; '' if it may."""
    return reasons((reviewer == approver, "SELF_APPROVAL"), (contradictory, "CONTRADICTORY"), (held_out, "HOLDOUT_MEMBER"))


def independent_readings(crops: tuple[Column, Column], regions: tuple[Column, Column], shared: tuple[Column, Column]) -> Column:
    """Whether two readings are of different crops and regions, all known, and share no dependency (arrays of names; null: none)."""
    known = lambda a: F.coalesce(a, F.lit("")) != ""
    apart = lambda p: known(p[0]) & known(p[1]) & (p[0] != p[1])
    none = F.array().cast("array<string>")
    return F.coalesce(apart(crops) & apart(regions) & ~F.arrays_overlap(F.coalesce(shared[0], none), F.coalesce(shared[1], none)), F.lit(False))


def challenger_verdict(primary: Column, challenger: Column, primary_valid: Column, challenger_valid: Column, independent: Column, crop_safe: Column, agreement_form: Callable[[Column], Column] = lambda v: v) -> Column:
    """Struct (action, agreement, reason): whether a challenger's value replaces the primary one.

    Only a valid, independent challenger does, and only an invalid primary.
    Values agree if their ``agreement_form`` is equal; two valid ones that
    don't agree go to a person, as does all that isn't read from a safe crop.
    """
    yes = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    missing = F.coalesce(challenger.cast("string"), F.lit("")) == ""
    agree = yes(agreement_form(primary) == agreement_form(challenger))
    p, c, own = yes(primary_valid), yes(challenger_valid), yes(independent)
    steps = (
        (~yes(crop_safe), "HITL", F.when(challenger.isNull(), "NO_CANDIDATE").otherwise("DISAGREE"), "LOCALIZATION_NOT_CROP_SAFE"),
        (missing, "KEEP_PRIMARY", F.lit("NO_CANDIDATE"), "CHALLENGER_EMPTY"),
        (agree & own, "KEEP_PRIMARY", F.lit("AGREE"), "INDEPENDENT_ENGINE_AGREEMENT"),
        (agree, "KEEP_PRIMARY", F.lit("AGREE"), "AGREEMENT_NOT_INDEPENDENT"),
        (p & c, "HITL", F.lit("DISAGREE"), "INDEPENDENT_VALID_CANDIDATES_DISAGREE"),
        (c & own, "USE_CHALLENGER", F.lit("DISAGREE"), "VALID_INDEPENDENT_CHALLENGER_REPLACES_INVALID_PRIMARY"),
    )
    agreement = F.lit("DISAGREE")
    for condition, _, says, _ in reversed(steps):
        agreement = F.when(condition, says).otherwise(agreement)
    return F.struct(
        ladder(*((s[0], s[1]) for s in steps), otherwise="HITL").alias("action"), agreement.alias("agreement"), ladder(*((s[0], s[3]) for s in steps), otherwise="CHALLENGER_ACCEPTANCE_GATES_FAILED").alias("reason")
    )


def largest_risk(signals: dict[str, Column], flagged_from: float = 0.5) -> Column:
    """Struct (risk, reasons): the largest of several signals (at least two), and those at or over the threshold."""
    return F.struct(F.greatest(*signals.values()).alias("risk"), reasons(*((x >= flagged_from, name) for name, x in signals.items())).alias("reasons"))


def form_status(traits: list[Column], essential: Column, verified_from: int, ambiguous_from: int) -> Column:
    """Struct (score, status): the part of a form's traits that are there; without the essential one a form isn't verified."""
    n = F.size(F.filter(F.array(*traits), lambda x: x))
    status = ladder(((n >= verified_from) & essential, "VERIFIED"), (n >= ambiguous_from, "AMBIGUOUS"), otherwise="REJECTED")
    return F.struct((n / float(len(traits))).alias("score"), status.alias("status"))


def with_consensus(rows: DataFrame, population: list[str], value: str, document: str, anchored: Column, least: int = 3) -> DataFrame:
    """The rows whose value enough documents of their population share, one of them anchored."""
    agreed = rows.groupBy(*population, value).agg(F.countDistinct(document).alias("__n"), F.bool_or(anchored).alias("__anchored")).filter((F.col("__n") >= least) & F.col("__anchored"))
    return rows.join(agreed, [*population, value], "left_semi")


def routing_summary(rows: DataFrame, truth: str, route: str, wrong_risk: Column, abstain_risk: float = 5.0) -> DataFrame:
    """truth, n, accuracy, abstained, mean_risk: a right route has no risk, an abstention little."""
    n = F.count(F.lit(1))
    risk = F.when(F.col(route).isNull(), abstain_risk).when(F.col(route) == F.col(truth), 0.0).otherwise(wrong_risk.cast("double"))
    part = lambda c: F.count_if(c).cast("double") / n
    return rows.groupBy(truth).agg(n.alias("n"), part(F.col(route) == F.col(truth)).alias("accuracy"), part(F.col(route).isNull()).alias("abstained"), (F.sum(risk) / n).alias("mean_risk"))


def segment_gates(rows: DataFrame, segment: str, reviewed: Column, false_accept: Column, latency: str, least: int = 100, most_reviewed: float = 0.3, most_false: int = 0) -> DataFrame:
    """segment, claims, review_rate, false_accepts, p95 and the gates that a shadow run fails."""
    s = rows.groupBy(segment).agg(F.count(F.lit(1)).alias("claims"), F.count_if(reviewed).alias("__r"), F.count_if(false_accept).alias("false_accepts"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{latency}`)").alias("p95"))
    rate = F.col("__r").cast("double") / F.col("claims")
    failed = reasons((F.col("claims") < least, "ENOUGH"), (rate > most_reviewed, "REVIEW"), (F.col("false_accepts") > most_false, "FALSE_ACCEPTS"))
    return s.select(segment, "claims", rate.alias("review_rate"), "false_accepts", "p95", failed.alias("failed"))


def best_schema(fields: Column, known: dict[str, list[str]], least: float = 0.45, otherwise: str = "UNKNOWN") -> Column:
    """Struct (schema, overlap): the schema whose fields (an array) are best covered; of equal ones the last by name."""
    scores = F.array(*(F.struct((F.size(F.array_intersect(fields, F.array(*map(F.lit, needs)))) / F.lit(float(len(needs)))).alias("overlap"), F.lit(name).alias("schema")) for name, needs in known.items()))
    best = F.array_max(scores)
    return F.struct(F.when(best["overlap"] >= least, best["schema"]).otherwise(otherwise).alias("schema"), best["overlap"].alias("overlap"))
