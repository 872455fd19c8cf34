"""Mixing sources to target weights: budgets down a domain-language-source tree, seeded token prefixes per leaf."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

LEVELS = ("domain", "language", "source")
#: Leaves up to which their table of budgets is broadcast (about 100 bytes each).
BROADCAST_LEAVES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Whole-number weights of nodes among their siblings, by name; a name not listed weighs ``other``."""

    domains: dict[str, int] = field(default_factory=lambda: {"crawl": 4, "curated": 4, "reference": 2})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 5, "fr": 2, "de": 2, "es": 2})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    budget_percent: int = 100  # of the corpus's tokens
    max_epochs: int = 4
    seed: int = 20240607


def default_domain(source: Column) -> Column:
    """Domain of a source: its first ten names are one crawl and nine curated ones, the rest reference works."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "0", "crawl").when(F.length(number) == 1, "curated").otherwise("reference")


def leaf_columns(docs: DataFrame, domain=default_domain) -> list[Column]:
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    return [domain(source).alias("domain"), lang.alias("language"), source.alias("source")]


def _weight(level: str, mix: Mix) -> Column:
    known = {"domain": mix.domains, "language": mix.languages, "source": mix.sources}[level]
    out = F.lit(mix.other)
    for name, w in sorted(known.items()):
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(9,0)")


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget``: the parent's ``given`` shared among its children by ``weight``, none above its ``capacity``.

    What a child can't take goes to its siblings by weight; children in order
    of capacity per weight are full as long as the level reached by the rest
    covers them. Fractions of a token are dropped. A weight of 0 gets nothing.
    """
    order = Window.partitionBy(*parent).orderBy("full_at", *LEVELS)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    d = "decimal(20,0)"
    return (
        children.withColumn("full_at", F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight").cast("double")))
        .withColumn("takes", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)).cast(d))
        .withColumn("rest", (F.col("given").cast(d) - F.coalesce(F.sum("takes").over(before), F.lit(0)).cast(d)).cast(d))
        .withColumn("weights", F.sum("weight").over(after).cast("decimal(12,0)"))
        .withColumn("full", (F.col("weight") > 0) & (F.col("takes") * F.col("weights") <= F.col("rest") * F.col("weight")))
        # a null full_at sorts first, where it takes nothing and weighs nothing
        .withColumn("__r", F.max(F.when(~F.col("full") & (F.col("weight") > 0), F.col("rest"))).over(whole))
        .withColumn("__w", F.max(F.when(~F.col("full") & (F.col("weight") > 0), F.col("weights"))).over(whole))
        .withColumn("budget", F.expr("CASE WHEN weight = 0 THEN 0L WHEN full THEN CAST(takes AS bigint) ELSE (__r * weight) div __w END"))
        .drop("full_at", "takes", "rest", "weights", "full", "__r", "__w")
    )


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, language, source, tokens, capacity, budget of every leaf from its domain, language, source and tokens.

    Capacities add up the tree; budgets come down it. A shortage below a node
    is first made up by siblings there; only what all of them can't take is
    missing from the node's own capacity, and so goes to the node's siblings.
    """
    now = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    given = leaves.agg(F.coalesce((F.sum("tokens") * mix.budget_percent / 100).cast("bigint"), F.lit(0)).alias("given"))
    out = None
    for depth in range(1, len(LEVELS) + 1):
        path = list(LEVELS[:depth])
        level = now.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        for missing in LEVELS[depth:]:
            level = level.withColumn(missing, F.lit(""))
        level = level.withColumn("weight", _weight(LEVELS[depth - 1], mix))
        level = level.crossJoin(F.broadcast(given)) if out is None else level.join(out, path[:-1])  # ``given`` is one row
        level = share_out(level, path[:-1])
        out = level.select(*path, F.col("budget").alias("given"))
    return now.join(out.withColumnRenamed("given", "budget"), list(LEVELS))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def seeded_key(mix: Mix, epoch: Column, doc_id: Column, digest: Column) -> Column:
    """60 bits of md5 of seed, epoch, document and its text's digest: the order of one epoch. Rows without an id, or with one id, are told apart by their texts."""
    text = F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


@dataclass
class Plan:
    """What was measured and decided: a row for each document, and one for each leaf."""

    counted: DataFrame  # doc_id, domain, language, source, tokens, digest
    leaves: DataFrame  # domain, language, source, tokens, budget, epochs, cut_key, equal_rows, equal_taken
    small: bool


def plan(docs: DataFrame, mix: Mix, domain=default_domain) -> Plan:
    """Count tokens, budget the leaves and find each leaf's cut.

    A leaf's budget is whole epochs, then a prefix of one more: its documents
    in seeded order, as long as the tokens before one are fewer than what is
    left. Sums per hash bucket find the bucket with the cut; only it is sorted,
    rows equal in id and text as one. A leaf of n different documents has about
    as many buckets as a bucket has documents.
    """
    tokens = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    counted = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(docs, domain), tokens.alias("tokens"), text_digest(F.col("text")).alias("digest"), F.spark_partition_id().alias("part")), "counted")
    leaves = staged(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    n, most = leaves.agg(F.count(F.lit(1)), F.max("rows")).first()
    small = n <= BROADCAST_LEAVES
    budgets = leaf_budgets(leaves.select(*LEVELS, "tokens"), mix).withColumn("epochs", F.expr("coalesce(try_divide(budget - budget % nullif(tokens, 0), tokens), 0)").cast("int"))
    budgets = staged(budgets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    bits = 1 + (most or 0).bit_length() // 2
    keyed = _with_leaf(counted, budgets.filter("rest > 0").select(*LEVELS, "epochs", "rest"), small).withColumn("key", seeded_key(mix, F.col("epochs"), F.col("doc_id"), F.col("digest")))
    keyed = keyed.withColumn("bucket", F.shiftright("key", 60 - bits))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("in_bucket"), F.max("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut_bucket = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(run), F.lit(0))).filter("before < rest AND before + in_bucket >= rest").select(*LEVELS, "bucket", "before")
    cut_bucket = staged(cut_bucket, "cut-buckets")
    inside = _with_leaf(keyed, cut_bucket, small, ["bucket"]).groupBy(*LEVELS, "key").agg(F.sum("tokens").alias("own"), F.count(F.lit(1)).alias("equal_rows"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    below = F.col("before") + F.coalesce(F.sum("own").over(Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("below", below).filter("below < rest AND below + own >= rest")
    # of equal rows as many as it takes to reach what is left
    taken = F.expr("CAST((CAST(rest - below AS decimal(20,0)) * equal_rows + own - 1) div own AS bigint)")
    out = budgets.join(cut.select(*LEVELS, F.col("key").alias("cut_key"), "equal_rows", taken.alias("equal_taken")), list(LEVELS), "left").select(*LEVELS, "tokens", "budget", "epochs", "cut_key", "equal_rows", "equal_taken")
    return Plan(counted, staged(out, "leaf-plan"), small)


def _with_leaf(rows: DataFrame, leaves: DataFrame, small: bool, more: list[str] | None = None) -> DataFrame:
    return rows.join(F.broadcast(leaves) if small else leaves, [*LEVELS, *(more or [])])


def _numbered(rows: DataFrame, keys: list[str], part: str, name: str) -> DataFrame:
    """``rows`` (written before) with their number, from 1, among those of equal keys: their number in a part and what earlier parts have."""
    order = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, part).orderBy(F.lit(1))
    return rows.withColumn("__in", F.row_number().over(inside)).join(before, [*keys, part]).withColumn(name, F.col("__before") + F.col("__in")).drop("__before", "__in")


def _split(made: Plan) -> bool:
    """Whether some leaf takes a part only of the equal rows at its cut."""
    return not made.leaves.filter("equal_taken < equal_rows").isEmpty()


def mixture(docs: DataFrame, mix: Mix, domain=default_domain) -> DataFrame:
    """doc_id, domain, language, source, tokens, copies, leaf_tokens, leaf_budget of every document taken at least once.

    A null language or source is the empty name. A null text has no tokens: it
    is taken with its leaf's whole epochs, and within the prefix where it falls.
    Every row is taken on its own: rows with one id, or none, are told apart by
    their texts, and of rows equal in both as many are taken as the budget
    needs. An empty table gives an empty result.
    """
    made = plan(docs, mix, domain)
    placed = _with_leaf(made.counted, made.leaves.withColumnsRenamed({"tokens": "leaf_tokens", "budget": "leaf_budget"}), made.small)
    key = seeded_key(mix, F.col("epochs"), F.col("doc_id"), F.col("digest"))
    within = F.coalesce(key <= F.col("cut_key"), F.lit(False))
    if _split(made):
        at_cut = _numbered(staged(placed.filter(key == F.col("cut_key")), "at-cut"), list(LEVELS), "part", "nth").withColumn("copies", F.col("epochs") + (F.col("nth") <= F.col("equal_taken")).cast("int")).drop("nth")
        placed = placed.filter(F.coalesce(key != F.col("cut_key"), F.lit(True))).withColumn("copies", F.col("epochs") + within.cast("int")).unionByName(at_cut)
    else:
        placed = placed.withColumn("copies", F.col("epochs") + within.cast("int"))
    return placed.filter("copies > 0").select("doc_id", *LEVELS, "tokens", "copies", "leaf_tokens", "leaf_budget")


def mixed(docs: DataFrame, mix: Mix, domain=default_domain) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all their columns.

    Texts aren't shuffled as long as the table of leaves is small enough to be
    broadcast; beyond that they are joined to it. Only where a cut falls among
    rows equal in id and text are those rows written and numbered.
    """
    made = plan(docs, mix, domain)
    keys = [f"__{c}" for c in LEVELS]
    own = ("epochs", "cut_key", "equal_taken")
    leaves = made.leaves.select(*(F.col(c).alias(k) for c, k in zip(LEVELS, keys, strict=True)), *own).withColumnsRenamed({c: f"__{c}" for c in own})
    rows = docs.withColumns({k: c for k, c in zip(keys, leaf_columns(docs, domain), strict=True)})
    taken = rows.join(F.broadcast(leaves) if made.small else leaves, keys)
    key = seeded_key(mix, F.col("__epochs"), F.col("doc_id").cast("long"), text_digest(F.col("text")))
    within = F.coalesce(key <= F.col("__cut_key"), F.lit(False))
    if _split(made):
        at_cut = staged(taken.filter(key == F.col("__cut_key")).withColumn("__part", F.spark_partition_id()), "at-cut")
        at_cut = _numbered(at_cut, keys, "__part", "__nth").withColumn("__copies", F.col("__epochs") + (F.col("__nth") <= F.col("__equal_taken")).cast("int")).drop("__nth", "__part")
        taken = taken.filter(F.coalesce(key != F.col("__cut_key"), F.lit(True))).withColumn("__copies", F.col("__epochs") + within.cast("int")).unionByName(at_cut)
    else:
        taken = taken.withColumn("__copies", F.col("__epochs") + within.cast("int"))
    taken = taken.filter("__copies > 0")
    if mix.max_epochs > 1:
        taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))


def _case(column: str, known: dict[str, int], other: int) -> str:
    parts = " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in sorted(known.items()))
    return f"CASE {parts} ELSE {other} END" if parts else str(other)


def mixture_sql(mix: Mix, documents: str = "documents") -> str:
    """DuckDB SQL for ``mixture`` over a table with unique doc_id."""
    steps, parent = [], "SELECT '' AS root, CAST(floor(sum(tokens) * {p} / 100) AS BIGINT) AS given FROM leaf".format(p=mix.budget_percent)
    steps.append(f"b0 AS ({parent})")
    for depth, known in enumerate((mix.domains, mix.languages, mix.sources), 1):
        path, up = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1]) or "1"
        on = " AND ".join(f"n.{c} = b.{c}" for c in LEVELS[: depth - 1]) or "TRUE"
        part = f"PARTITION BY {', '.join(LEVELS[: depth - 1])} " if depth > 1 else ""
        order = f"{part}ORDER BY full_at, {path}"
        steps.append(
            f"""n{depth} AS (SELECT {", ".join("n." + c for c in LEVELS[:depth])}, n.capacity, n.weight, CAST(n.capacity AS DOUBLE) / n.weight AS full_at, b.given
  FROM (SELECT {path}, sum(tokens * {mix.max_epochs})::HUGEINT AS capacity, ({_case(LEVELS[depth - 1], known, mix.other)})::HUGEINT AS weight FROM leaf GROUP BY {path}) n JOIN b{depth - 1} b ON {on}),
r{depth} AS (SELECT *, given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM n{depth}),
f{depth} AS (SELECT *, weight > 0 AND capacity * weights <= rest * weight AS is_full FROM r{depth}),
b{depth} AS (SELECT {path}, CAST(CASE WHEN is_full THEN capacity WHEN weight = 0 THEN 0 ELSE (max(CASE WHEN NOT is_full THEN rest END) OVER ({part}) * weight) // max(CASE WHEN NOT is_full THEN weights END) OVER ({part}) END AS BIGINT) AS given FROM f{depth})"""
        )
    body = ",\n".join(steps)
    return f"""
WITH doc AS (
  SELECT doc_id, digest, CASE WHEN regexp_extract(src, '([0-9]+)$', 1) = '0' THEN 'crawl' WHEN length(regexp_extract(src, '([0-9]+)$', 1)) = 1 THEN 'curated' ELSE 'reference' END AS domain, language, src AS source, tokens
  FROM (SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(lang, '') AS language, coalesce(source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {documents})
), leaf AS (
  SELECT domain, language, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM doc GROUP BY ALL
),
{body},
plan AS (
  SELECT leaf.*, b3.given AS budget, CASE WHEN leaf.tokens > 0 THEN b3.given // leaf.tokens ELSE 0 END AS epochs FROM leaf JOIN b3 USING (domain, language, source)
), keyed AS (
  SELECT doc.*, p.tokens AS leaf_tokens, p.budget AS leaf_budget, p.epochs, p.budget - p.epochs * p.tokens AS rest,
    CAST('0x' || substr(md5('{mix.seed}:' || p.epochs || ':' || doc.doc_id || ':' || doc.digest), 1, 15) AS BIGINT) AS key
  FROM doc JOIN plan p USING (domain, language, source)
), run AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS below FROM keyed
), taken AS (
  SELECT *, CAST(epochs + CASE WHEN below < rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM run
)
SELECT doc_id, domain, language, source, tokens, copies, leaf_tokens, leaf_budget FROM taken WHERE copies > 0
"""
