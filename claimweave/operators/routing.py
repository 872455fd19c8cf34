"""How well pages are routed, and which registered route a field may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate
from .decisions import ladder

#: The extractor made for each standard form.
FIXED = {"CMS1500": "CMS_STANDARD_EXTRACTOR", "UB04": "UB_STANDARD_EXTRACTOR"}
#: The route that each class of documents should take.
ROUTE_OF = {
    **FIXED, "CUSTOM_PROFESSIONAL": "LAYOUT_STRUCTURED_EXTRACTOR", "CUSTOM_INSTITUTIONAL": "LAYOUT_STRUCTURED_EXTRACTOR", "OTHER_STRUCTURED_CLAIM": "LAYOUT_STRUCTURED_EXTRACTOR", "EOB": "LAYOUT_STRUCTURED_EXTRACTOR", "ITEMIZED_BILL": "LAYOUT_STRUCTURED_EXTRACTOR", "MEDICAL_INVOICE": "LAYOUT_STRUCTURED_EXTRACTOR",
    "LAB_REPORT": "LAYOUT_STRUCTURED_EXTRACTOR", "CLINICAL_NOTE": "UNSTRUCTURED_EXTRACTOR", "CORRESPONDENCE": "UNSTRUCTURED_EXTRACTOR", "OTHER_ATTACHMENT": "UNSTRUCTURED_EXTRACTOR", "COVER_PAGE": "STOP_NON_CLAIM", "DOCUMENT_SEPARATOR": "STOP_NON_CLAIM", "ADMINISTRATIVE": "STOP_NON_CLAIM",
    "BLANK_OR_NEAR_BLANK": "STOP_NON_CLAIM", "OTHER_NON_CLAIM": "STOP_NON_CLAIM", "UNKNOWN": "SAFE_UNKNOWN",
}
#: Routes on which a document of a kind isn't lost.
SAFE_ROUTES = {"support": ("LAYOUT_STRUCTURED_EXTRACTOR", "UNSTRUCTURED_EXTRACTOR"), "unknown": ("LAYOUT_STRUCTURED_EXTRACTOR", "UNSTRUCTURED_EXTRACTOR", "SAFE_UNKNOWN")}
#: What a wrong route costs, the worst first.
RISKS = {"false_standard": 100, "other_standard": 80, "wrong_route": 40, "wrong_class": 5}
#: Stages of a route's life in which a mode may use it.
MODES = {"runtime": ("PRODUCTION_APPROVED",), "evaluation": ("EXPERIMENTAL", "EVALUATION_ONLY", "SHADOW", "PRODUCTION_APPROVED"), "shadow": ("SHADOW",)}


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _share(of: Column, among: Column | None = None) -> Column:
    """Part of the rows of a kind that a condition holds for; 0 without any."""
    if among is None:
        return rate(F.count_if(_yes(of)), F.count(F.lit(1)))
    return rate(F.count_if(_yes(of) & _yes(among)), F.count_if(_yes(among)))


def top_level(family: Column) -> Column:
    """CLAIM, CLAIM_SUPPORT, NON_CLAIM or UNKNOWN, by a document's family."""
    return ladder((family.isin(*FIXED) | F.startswith(family, F.lit("CUSTOM_")), "CLAIM"), (family == "CLAIM_SUPPORT", "CLAIM_SUPPORT"), (family == "NON_CLAIM", "NON_CLAIM"), otherwise="UNKNOWN")


def benchmark_rates(rows: DataFrame, truth: str, prediction: str, predicted_top: str, expected_route: str, route: str, calls: str, cloud_calls: str, latency: str, groups: list[list[str]]) -> DataFrame:
    """A routing benchmark's rates over all rows and by each of the ``groups`` (lists of columns, null where they don't divide), in one pass.

    ``grouping`` tells the sets apart: Spark's grouping id over all columns of
    ``groups``. A rate of nothing is 0. Percentiles are by nearest rank; their
    state has a count for each different latency, so give whole milliseconds.
    """
    c = F.col
    t, p, r = c(truth), c(prediction), c(route)
    standard, fixed = t.isin(*FIXED), r.isin(*FIXED.values())
    exact, odd = t == p, ~t.isin(*FIXED)
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{latency}`)").cast("double")
    rates = [
        F.count(F.lit(1)).alias("documents"), _share(exact).alias("family_accuracy"), _share(top_level(t) == c(predicted_top)).alias("top_level_accuracy"), _share(r == c(expected_route)).alias("route_accuracy"),
        _share(standard, p.isin(*FIXED)).alias("nomination_precision"), _share(exact, standard).alias("nomination_recall"),
        *(x for family in FIXED for x in (_share(t == family, p == family).alias(f"{family}_precision"), _share(p == family, t == family).alias(f"{family}_recall"))),
        _share(p.isin("UNKNOWN_STRUCTURED", *FIXED), F.startswith(t, F.lit("CUSTOM_"))).alias("custom_recognition"), _share(r.isin(*SAFE_ROUTES["support"]), t == "CLAIM_SUPPORT").alias("support_compatibility"), _share(p == "NON_CLAIM", t == "NON_CLAIM").alias("non_claim_recall"),
        _share(r.isin(*SAFE_ROUTES["unknown"]), F.startswith(t, F.lit("UNKNOWN_"))).alias("unknown_compatibility"), F.count_if(_yes(odd & fixed)).alias("false_standard"), _share(fixed, odd).alias("false_standard_rate"),
        *(_share(r == FIXED[b], t == a).alias(f"{a}_to_{b}") for a in FIXED for b in FIXED if a != b),
        F.count_if(_yes(standard & exact & (r == "LAYOUT_STRUCTURED_EXTRACTOR"))).alias("safe_fallbacks"), _share(exact & (r == "LAYOUT_STRUCTURED_EXTRACTOR"), standard).alias("safe_fallback_rate"),
        rate(F.coalesce(F.sum(calls), F.lit(0)), F.count(F.lit(1))).alias("calls_per_page"), F.coalesce(F.sum(cloud_calls), F.lit(0)).alias("cloud_calls"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.avg(latency).alias("mean_latency"),
    ]
    columns = list(dict.fromkeys(x for g in groups for x in g))
    if not columns:
        return rows.agg(F.lit(0).cast("long").alias("grouping"), *rates)
    sets = [[c(x) for x in g] for g in ([], *groups)]
    return rows.groupingSets(sets, *map(c, columns)).agg(F.grouping_id(*columns).alias("grouping"), *rates)


def expected_route(truth: Column, given: Column) -> Column:
    """The route that a document should take: the given one, else that of its class."""
    known = F.create_map(*(F.lit(x) for kv in ROUTE_OF.items() for x in kv))
    return F.coalesce(given, F.try_element_at(known, truth))


def routing_risk(truth: Column, prediction: Column, route: Column, given: Column) -> Column:
    """What a routed document risks: a fixed extractor for a document that isn't standard, that of another form, another wrong route, only a wrong class, or nothing."""
    other = F.lit(False)
    for a in FIXED:
        for b in FIXED:
            if a != b:
                other = other | ((truth == a) & (route == FIXED[b]))
    right = route == expected_route(truth, given)
    return (
        F.when(_yes(route.isin(*FIXED.values()) & ~truth.isin(*FIXED)), RISKS["false_standard"]).when(_yes(other), RISKS["other_standard"]).when(~_yes(right), RISKS["wrong_route"]).when(_yes(truth == prediction), 0).otherwise(RISKS["wrong_class"])
    )


def outcome_rates(rows: DataFrame, truth: Column, prediction: Column, route: Column, abstained: Column, status: Column, verified: Column, given: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rates of routing outcomes, over all rows or by columns: accuracy, false, crossed, unverified and misrouted authorisations, fallbacks, abstentions, mean risk; a rate of nothing is 0.

    ``status`` and ``verified`` are the result of the form's verification and
    the form it found; ``given`` is the right route where it isn't that of the
    class (null else).
    """
    cols = {"__t": truth, "__p": prediction, "__r": route, "__a": _yes(abstained), "__s": status, "__f": verified, "__g": given}
    o = rows.withColumns(cols)
    t, p, r, s, f = (F.col(x) for x in ("__t", "__p", "__r", "__s", "__f"))
    standard, checked, exact = t.isin(*FIXED), s == "VERIFIED", t == p
    fallback = standard & exact & r.isin("LAYOUT_STRUCTURED_EXTRACTOR", "SAFE_UNKNOWN") & ~_yes(checked)
    unverified = F.lit(False)
    for family, own in FIXED.items():
        unverified = unverified | ((r == own) & ~_yes(checked & (f == family)))
    rates = [
        F.count(F.lit(1)).alias("documents"), _share(exact).alias("class_accuracy"), _share(r == expected_route(t, F.col("__g"))).alias("route_accuracy"), _share(r.isin(*FIXED.values()), ~standard).alias("false_standard_rate"),
        *(_share(r == own, ~standard).alias(f"{family}_false_rate") for family, own in FIXED.items()), _share(r.isin(*FIXED.values()) & (r != expected_route(t, F.lit(None).cast("string"))), standard).alias("misroute_rate"),
        *(_share(r == FIXED[b], t == a).alias(f"{a}_to_{b}") for a in FIXED for b in FIXED if a != b), _share(unverified).alias("unverified_rate"), _share(fallback, standard).alias("safe_fallback_rate"),
        *(_share(fallback, t == family).alias(f"{family}_safe_fallback_rate") for family in FIXED), _share(F.col("__a")).alias("abstention_rate"), _share(exact, ~F.col("__a")).alias("accuracy_not_abstained"),
        F.coalesce(F.avg(routing_risk(t, p, r, F.col("__g"))), F.lit(0.0)).alias("mean_risk"),
    ]
    return o.groupBy(*by).agg(*rates)


def route_faults(routes: DataFrame) -> DataFrame:
    """route_id, fault of a registry's rows (route_id, key, field, status, approved_by, approved_at, sample_count, false_agreement_count) that break its rules."""
    shared = routes.groupBy("route_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("route_id", F.lit("DUPLICATE_ROUTE_ID").alias("fault"))
    c = F.col
    unknown = ~_yes(c("status").isin("DISABLED", "DEPRECATED", *MODES["evaluation"]))
    unapproved = _yes(c("status") == "PRODUCTION_APPROVED") & ((F.coalesce("approved_by", F.lit("")) == "") | c("approved_at").isNull())
    checks = F.array_compact(F.array(F.when(~c("key").eqNullSafe(c("field")), "KEY_FIELD_MISMATCH"), F.when(unknown, "UNKNOWN_STATUS"), F.when(unapproved, "APPROVAL_WITHOUT_PROVENANCE"), F.when(~_yes((c("sample_count") >= 0) & (c("false_agreement_count") >= 0)), "COUNT_NOT_VALID")))
    return shared.unionByName(routes.select("route_id", F.explode(checks).alias("fault"))).distinct()


def registered_routes(requests: DataFrame, routes: DataFrame, field: str, family: str, mode: str | None) -> DataFrame:
    """``requests`` with the route_id of the first registered route (by ``position``) for their field and family, or null.

    A route's ``form`` is a family (letter case aside) or ``*`` for any. ``mode``
    names what may be used (``MODES``); None looks at all, to read about a
    route, not to run it. Routes are reduced to the first of a field and form
    before they are joined, by equal keys.
    """
    usable = routes if mode is None else routes.filter(F.col("status").isin(*MODES[mode]))
    first = usable.groupBy(F.col("field").alias("__field"), F.upper("form").alias("__form")).agg(F.min(F.struct("position", "route_id")).alias("__route"))
    own = first.filter("__form <> '*'").select("__field", "__form", F.col("__route").alias("__own"))
    any_ = first.filter("__form = '*'").select(F.col("__field").alias("__field2"), F.col("__route").alias("__any"))
    r = requests.join(own, (F.col(field) == F.col("__field")) & (F.upper(F.col(family)) == F.col("__form")), "left").join(any_, F.col(field) == F.col("__field2"), "left")
    return r.select(*requests.columns, F.least("__own", "__any")["route_id"].alias("route_id"))


def verified_members(requests: DataFrame, reference: DataFrame, least: float = 0.92) -> DataFrame:
    """request, decision, attributes, contradictions of members (request, member_id, dob, similarity, contradicted) against a reference (member_id, dob).

    Only one reference row of the id with the same birth date, a name that is
    similar enough and no contradiction verify a member; all else is for a
    person. Reference rows are counted by id before the join.
    """
    one = reference.groupBy("member_id").agg(F.count(F.lit(1)).alias("__n"), F.min("dob").alias("__dob"))
    j = requests.join(one, "member_id", "left")
    missing = (F.coalesce("member_id", F.lit("")) == "") | (F.coalesce("dob", F.lit("")) == "")
    unique, same, against = _yes(F.col("__n") == 1), _yes(F.col("__dob") == F.col("dob")), _yes(F.col("contradicted"))
    passed = ~missing & unique & same & _yes(F.col("similarity") >= least) & ~against
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    attributes = F.when(missing, texts()).when(unique & same, texts("member_id", "dob", "name")).otherwise(texts("member_id"))
    contra = F.when(missing, texts("MISSING_ID_OR_DOB")).when(~unique, texts("REFERENCE_NOT_UNIQUE")).when(against, texts("ADDRESS_CONTRADICTION")).otherwise(texts())
    return j.select("request", F.when(passed, "REFERENCE_VERIFIED").otherwise("HUMAN_REVIEW_REQUIRED").alias("decision"), attributes.alias("attributes"), contra.alias("contradictions"))


def verified_providers(requests: DataFrame, reference: DataFrame, least: float = 0.92) -> DataFrame:
    """The same of providers (request, npi, similarity, contradicted) against a directory (npi): the number alone, and the name."""
    one = reference.groupBy("npi").agg(F.count(F.lit(1)).alias("__n"))
    j = requests.join(one, "npi", "left")
    known, against = _yes((F.col("__n") == 1) & (F.col("npi") != "")), _yes(F.col("contradicted"))
    passed = known & _yes(F.col("similarity") >= least) & ~against
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    attributes = F.when(passed, texts("npi", "name")).when(known, texts("npi")).otherwise(texts())
    contra = F.when(against, texts("ADDRESS_CONTRADICTION")).when(~known, texts("REFERENCE_NOT_UNIQUE_OR_MISSING")).otherwise(texts())
    return j.select("request", F.when(passed, "REFERENCE_VERIFIED").otherwise("HUMAN_REVIEW_REQUIRED").alias("decision"), attributes.alias("attributes"), contra.alias("contradictions"))
