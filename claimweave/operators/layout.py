"""Page layout from boxes and lines: reading order, labels, tables, anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reading_order(tokens: DataFrame, page: str, tolerance: float = 0.55) -> DataFrame:
    """``tokens`` (page, ord, x0, y0, x1, y1) with the line each is on and its place in reading order.

    Tokens go down the page; one joins the line whose mean centre is within
    ``tolerance`` of the page's median height, else it starts a line. Where a
    line lies depends on the tokens before, so a page is worked through in
    order, and must fit a task's memory; pages come one after the other through
    a task, not in a call for each.
    """
    fields = T.StructType([*tokens.schema, T.StructField("line", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def worked(rows: pa.Table, ends: list[int]) -> pa.RecordBatch:
        x0, y0, y1 = (rows[c].to_numpy().astype(float) for c in ("x0", "y0", "y1"))
        at, centre = rows["ord"].to_numpy(), (y0 + y1) / 2
        line, place = np.zeros(len(x0), np.int32), np.zeros(len(x0), np.int32)
        for lo, hi in zip([0, *ends], ends, strict=False):
            down = lo + np.lexsort((at[lo:hi], x0[lo:hi], centre[lo:hi]))
            line[down] = _lines(centre[down].tolist(), tolerance * float(np.median(y1[lo:hi] - y0[lo:hi])))
            place[lo + np.lexsort((at[lo:hi], x0[lo:hi], line[lo:hi]))] = np.arange(hi - lo)
        return pa.Table.from_arrays([*rows.columns, pa.array(line), pa.array(place)], fields.names).combine_chunks().to_batches()[0]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of one page, which may go on
        for batch in (b for b in batches if b.num_rows):
            key = batch[page]
            start = not rest or bool(_changes(pa.concat_arrays([rest[-1][page].slice(rest[-1].num_rows - 1), key.slice(0, 1)])))
            cuts = [0] * (start and bool(rest)) + _changes(key)
            if not cuts:
                rest.append(batch)
                continue
            before = sum(b.num_rows for b in rest)
            yield worked(pa.Table.from_batches([*rest, batch.slice(0, cuts[-1])]), [before + c for c in cuts])
            rest = [batch.slice(cuts[-1])]
        if rest:
            yield worked(pa.Table.from_batches(rest), [sum(b.num_rows for b in rest)])

    return tokens.repartition(page).sortWithinPartitions(page).mapInArrow(order, fields)


def _changes(keys: pa.Array) -> list[int]:
    """Places at which a key isn't the one before it; nulls are equal."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return (np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist()


def _lines(centres: list[float], limit: float) -> list[int]:
    """The line of each centre, from the top; centres come in order.

    A line's mean is above all that come after, so the last line is the nearest.
    Only where a limit is as small as rounding, or a centre is no number, all lines are looked at.
    """
    sums, counts, lines = [], [], []
    last = limit > 1e-9 * max(map(abs, centres), default=0.0) and np.isfinite(centres).all()
    for c in centres:
        if last:
            k = len(sums) - 1 if sums and abs(sums[-1] / counts[-1] - c) <= limit else len(sums)
        else:
            gaps = [abs(s / n - c) for s, n in zip(sums, counts, strict=True)]
            k = int(np.argmin(gaps)) if gaps and min(gaps) <= limit else len(sums)
        if k == len(sums):
            sums.append(0.0)
            counts.append(0)
        sums[k] += c
        counts[k] += 1
        lines.append(k)
    centre = [s / n for s, n in zip(sums, counts, strict=True)]
    rank = {k: r for r, k in enumerate(sorted(range(len(centre)), key=centre.__getitem__))}
    return [rank[k] for k in lines]


def anchor_scores(pages: DataFrame, page: str, text: Column, anchors: dict[str, list[str]]) -> DataFrame:
    """page, family, matched, confidence: which part of each family's anchor phrases a page has."""
    low = F.lower(text)
    rows = F.array(
        *(F.struct(F.lit(family).alias("family"), F.aggregate(F.array(*(F.contains(F.col("__low"), F.lit(p.lower())).cast("int") for p in phrases)), F.lit(0), lambda a, x: a + x).alias("matched"), F.lit(len(phrases)).alias("of")) for family, phrases in sorted(anchors.items()))
    )
    return pages.select(page, low.alias("__low")).select(page, F.explode(rows).alias("r")).select(page, "r.family", "r.matched", (F.col("r.matched") / F.col("r.of")).alias("confidence"))


def link_values(lines: DataFrame, page: str, number: str, is_label: Column, value: Column, below: int = 2) -> DataFrame:
    """Each label line with the nearest value on it or up to ``below`` lines under it: an equi-join on the lines in reach."""
    labels = lines.filter(is_label).select(page, F.col(number).alias("label_line"), F.explode(F.sequence(F.lit(0), F.lit(below))).alias("gap")).withColumn(number, F.col("label_line") + F.col("gap"))
    values = lines.filter(value.isNotNull()).select(page, number, value.alias("value"))
    return labels.join(values, [page, number]).groupBy(page, "label_line").agg(F.min_by("value", "gap").alias("value"), F.min("gap").alias("gap"))


def reconstruct_rows(tokens: DataFrame, page: str, line: str, column: Column, text: str, order: str, least_cells: int = 2) -> DataFrame:
    """page, line, cells (column: joined text) of the lines that fill at least ``least_cells`` columns."""
    cells = tokens.groupBy(page, line, column.alias("column")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda t: t[text]), " ").alias("cell"))
    rows = cells.groupBy(page, line).agg(F.array_sort(F.collect_list(F.struct("column", "cell"))).alias("c"))
    return rows.filter(F.size("c") >= least_cells).select(page, line, F.array_join(F.transform("c", lambda x: F.concat(x["column"], F.lit("="), x["cell"])), ";").alias("cells"))


def family_scores(pages: DataFrame, page: str, text: Column, anchors: dict[str, list[str]], good: float = 0.55) -> DataFrame:
    """page, family, score: the best phrase found, and 0.12 for each good one up to two; 1 at most.

    Phrases that a text holds are settled by an expression; only the others go
    to the window search.
    """
    from ..functions.similarity import phrase_ratio

    low = F.lower(text)
    phrases = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(p.lower()).alias("phrase")) for f, ps in sorted(anchors.items()) for p in ps))
    # dealt first, as a search takes long and few tasks may read the texts
    rows = pages.select(page, low.alias("__low")).repartition(page).select(page, "__low", F.explode(phrases).alias("p")).select(page, "__low", "p.*").withColumn("held", F.contains("__low", F.col("phrase")))
    sure = rows.filter("held").select(page, "family", F.lit(1.0).alias("ratio"))
    searched = rows.filter("NOT held").select(page, "family", phrase_ratio("phrase", "__low").alias("ratio"))
    g = sure.unionByName(searched).groupBy(page, "family").agg(F.max("ratio").alias("best"), F.count_if(F.col("ratio") >= good).alias("n"))
    return g.select(page, "family", F.least(F.lit(1.0), F.col("best") + 0.12 * F.least("n", F.lit(2))).alias("score"))


def single_row_text(tokens: DataFrame, page: str, text: str, inside: Column) -> DataFrame:
    """page, rows, value: the text of the tokens in a region, if they are on exactly one row, else null."""
    lines = reading_order(tokens.filter(inside), page)
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text))), lambda t: t[text]), " ")
    return lines.groupBy(page).agg(F.countDistinct("line").alias("rows"), value.alias("v")).select(page, "rows", F.when(F.col("rows") == 1, F.col("v")).alias("value"))


def detect_labels(lines: DataFrame, page: str, number: str, text: Column, aliases: list[tuple[str, str]], least: float = 0.84) -> DataFrame:
    """page, number, field, alias, similarity: of each line the label it is, the first alias in order that is similar enough.

    ``aliases``: (field, alias) in order. Lines that hold an alias are settled
    by an expression, and only the others compared.
    """
    from ..functions.similarity import phrase_ratio

    low = F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9 ]", " ")))
    options = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(f).alias("field"), F.lit(a.lower()).alias("alias")) for k, (f, a) in enumerate(aliases)))
    rows = lines.select(page, number, low.alias("__low")).filter("__low <> ''")
    held = F.filter(options, lambda o: F.contains(F.col("__low"), o["alias"]))
    sure = rows.filter(F.size(held) > 0).select(page, number, F.get(held, F.lit(0)).alias("o"), F.lit(1.0).alias("similarity"))
    open_ = rows.filter(F.size(held) == 0).select(page, number, "__low", F.explode(options).alias("o")).withColumn("similarity", phrase_ratio(F.col("o.alias"), F.col("__low")))
    near = open_.filter(F.col("similarity") >= least).groupBy(page, number).agg(F.min_by(F.struct("o", "similarity"), "o.place").alias("x")).select(page, number, "x.o", "x.similarity")
    return sure.unionByName(near).select(page, number, "o.field", "o.alias", "similarity")
