"""Statistics of runs and groups, crosstabs, best and worst, orders and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import ranged, running_totals

#: Student's t for 95 % and two degrees of freedom. Fixed value.
T_TWO = 4.3026527299


def run_aggregate(rows: DataFrame, run: list[str], labels: list[str] = ()) -> DataFrame:
    """Per run: documents, micro precision, recall and F1 of summed counts, means, share of exact documents.

    labels: columns of which a run has one value, or else `mixed`.
    """
    tp, fp, fn = (F.sum(c).cast("double") for c in ("_tp", "_fp", "_fn"))
    rows = rows.withColumns({"_tp": F.col("exact_matches"), "_fp": F.greatest(F.col("fields_pred_present") - F.col("exact_matches"), F.lit(0)), "_fn": F.greatest(F.col("fields_gt_present") - F.col("exact_matches"), F.lit(0))})
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    one = [F.when(F.count_distinct(c) <= 1, F.max(c)).otherwise("mixed").alias(c) for c in labels]
    return rows.groupBy(*run).agg(
        F.count("*").alias("n_docs"),
        p.alias("precision_micro"),
        r.alias("recall_micro"),
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1_micro"),
        (F.count_if("document_correct") * 100.0 / F.count("*")).alias("emr_pct"),
        F.avg("latency_s").alias("latency_avg_s"),
        F.avg("ram_peak_mb").alias("ram_peak_mb_avg"),
        F.avg("match_rate").alias("match_rate_avg"),
        *one,
    )


def config_statistics(runs: DataFrame, config: str, metrics: list[str], n: int = 3, t: float = T_TWO) -> DataFrame:
    """Mean, sample deviation, t interval, least, most and range of each metric over a configuration's runs.

    A configuration with any other number of runs than n fails the query.
    """
    aggs = [F.count("*").alias("n_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    out = runs.groupBy(config).agg(*aggs)
    fine = F.assert_true(F.col("n_runs") == n, F.lit(f"each configuration needs {n} runs"))
    out = out.where(fine.isNull())
    for m in metrics:
        half = F.lit(t) * F.col(f"{m}_sd") / F.sqrt(F.lit(float(n)))
        out = out.withColumns({f"{m}_ci95_low": F.col(f"{m}_mean") - half, f"{m}_ci95_high": F.col(f"{m}_mean") + half, f"{m}_range": F.col(f"{m}_max") - F.col(f"{m}_min")})
    return out


def crosstab(rows: DataFrame, a: str, b: str, within: list[str] = ()) -> DataFrame:
    """Counts of a by b with totals; a total's key is null and total_a or total_b true."""
    cube = rows.groupingSets([[*map(F.col, within), *s] for s in ([F.col(a), F.col(b)], [F.col(a)], [F.col(b)], [])], *map(F.col, within), F.col(a), F.col(b))
    out = cube.agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return out.select(*within, a, b, "n", (F.col("_a") == 1).alias("total_a"), (F.col("_b") == 1).alias("total_b"))


def matrix(rows: DataFrame, row: str, column: str, values: list[str], measure: Column) -> DataFrame:
    """One row for each value of ``row``, a column for each of ``values``."""
    return rows.groupBy(row).pivot(column, values).agg(measure)


def group_rows(rows: DataFrame, key: str, means: list[str], valid: str | None = None, unknown: str = "desconocido") -> DataFrame:
    """Count, valid count and rate, and means without nulls, by key; null keys are ``unknown``."""
    aggs = [F.count("*").alias("n")]
    if valid:
        aggs += [F.count_if(valid).alias("n_valid"), F.round(F.count_if(valid) / F.count("*"), 4).alias("valid_rate")]
    aggs += [F.round(F.avg(m), 4).alias(f"avg_{m}") for m in means]
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(unknown)).alias(key)).agg(*aggs)


def error_patterns(issues: DataFrame, pattern: list[str], sample: list[str], sequence: str) -> DataFrame:
    """Count, first sample and first place of each pattern; most frequent first, ties in order of appearance."""
    first = F.min_by(F.struct(*sample), F.col(sequence))
    out = issues.groupBy(*pattern).agg(F.count("*").alias("n"), first.alias("sample"), F.min(sequence).alias("first_seen"))
    return out.select(*pattern, "n", *[F.col(f"sample.{s}").alias(f"sample_{s}") for s in sample], "first_seen").orderBy(F.desc("n"), "first_seen")


def best_and_worst(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """The best and worst name by the columns in order, and the gap of the first; nulls and zeros are -1 for best, nulls 999 for worst."""
    high = F.struct(*[F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.lit(-1.0)).otherwise(F.col(c).cast("double")).alias(c) for c in by], F.col(name))
    low = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(999.0)).alias(c) for c in by], F.col(name))
    return rows.agg(F.max(high).alias("hi"), F.min(low).alias("lo")).select(F.col(f"hi.{name}").alias("best"), F.col(f"lo.{name}").alias("worst"), (F.col(f"hi.{by[0]}") - F.col(f"lo.{by[0]}")).alias("gap"))


def newest(rows: DataFrame, order: list[str], n: int = 300) -> DataFrame:
    """The n newest rows; a top-k, so no full sort."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def newest_of_each(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_selected(rows: DataFrame, selections: dict[str, list]) -> DataFrame:
    """Rows of which every column with a selection has a selected value; null is never selected, no selection keeps all."""
    for column, chosen in selections.items():
        if chosen:
            rows = rows.where(F.col(column).isin(*chosen))
    return rows


def distinct_options(column: str, *tables: DataFrame) -> DataFrame:
    """Sorted distinct non-empty values of a column of several tables."""
    out = None
    for t in tables:
        own = t.select(F.col(column).cast("string").alias(column))
        out = own if out is None else out.unionAll(own)
    return out.where(F.coalesce(F.col(column), F.lit("")) != "").distinct().orderBy(column)


def histogram(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Count of each of the given keys, zero where there is none."""
    want = rows.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    have = rows.groupBy(column).agg(F.count("*").alias("n"))
    return want.join(have, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def state_ratios(rows: DataFrame, by: list[str], state: str, states: list[str]) -> DataFrame:
    """Rows of each group, and count and share of each of the given states."""
    count = lambda s: F.count_if(F.col(state) == s)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[count(s).alias(f"n_{s.lower()}") for s in states], *[(count(s) / F.count("*")).alias(f"{s.lower()}_ratio") for s in states])


def in_plain_order(rows: DataFrame, column: str) -> DataFrame:
    """Sorted by the column whatever its case, then as it is."""
    return rows.orderBy(F.lower(column), column)


def nested_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """map<inner, count> of each outer value."""
    own = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return own.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), F.col("n"))))).alias("counts"))


def priority(column: Column, order: list[str], last: int = 99) -> Column:
    """Place in a fixed order, from 0; ``last`` for all else."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0)) - 1, F.lit(last)).cast("int")


def running_mean(rows: DataFrame, value: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """Adds running_<value>, the mean of a column's values up to each row, and running_n, the rows up to it, within each group or over all rows.

    Over all rows the totals are carried from range to range of the order, so no task sees them all. Nulls count as rows and
    not in the mean; before the first value it is null. Rows that the order leaves equal come in any order.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({f"running_{value}": F.avg(value).over(w), "running_n": F.count("*").over(w)})
    sums = {"_total": F.col(value).cast("double"), "_there": F.col(value).isNotNull().cast("long"), "running_n": F.lit(1).cast("long")}
    own = running_totals(rows, sums, [F.col(c) for c in order])
    return own.withColumn(f"running_{value}", F.try_divide("_total", "_there")).drop("_total", "_there")


def progress(rows: DataFrame, seconds: str, order: list[str]) -> DataFrame:
    """running_mean of the seconds that documents took, n_left and eta_<seconds>: what the documents that are left will take at that mean."""
    own = running_mean(rows, seconds, order)
    total = rows.agg(F.count("*").alias("_all"))  # one row
    left = F.col("_all") - F.col("running_n")
    return own.join(F.broadcast(total)).withColumns({"n_left": left, f"eta_{seconds}": left * F.col(f"running_{seconds}")}).drop("_all")


def sum_after_triggers(rows: DataFrame, trigger: Column, value: str, order: list[str], by: list[str], ahead: int = 4) -> DataFrame:
    """Per group the sum of the first value within ``ahead`` rows after each trigger row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, ahead)
    own = rows.withColumn("_next", F.first(value, ignorenulls=True).over(w))
    return own.where(trigger).groupBy(*by).agg(F.count("_next").alias("n"), F.sum("_next").alias("total"))


def confusion_from_rates(precision: Column, recall: Column, predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """(tp, fp, fn) as the rates and counts imply them."""
    tp = F.bround((precision * predicted + recall * truth) / 2.0, 0)
    return tp, F.greatest(predicted - tp, F.lit(0.0)), F.greatest(truth - tp, F.lit(0.0))


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by, n and, for each name, the value that stands at a place (from 1, a Column of the count _n) among a group's sorted values; nulls don't count.

    A selection in two passes, so that a group of any size is spread over tasks. Values are counted, and dealt out by ranges of (group, value). The
    first pass adds up each group's counts in each range, which says in which range a place lies; the second puts only the values of such
    ranges in order. Places beyond the ends have nothing; groups without a value are left out; nulls in ``by`` are a group.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(key.alias("_key"), F.col(value).alias("_value")).agg(F.count("*").alias("_c"))
    table = ranged(counts, [F.col("_key"), F.col("_value")], "ordered")
    w = Window.partitionBy("_key")
    coarse = table.groupBy("_key", "_range").agg(F.sum("_c").alias("_own"))
    coarse = coarse.withColumns({"_n": F.sum("_own").over(w), "_to": F.sum("_own").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))})
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("long").alias("place")) for i, c in enumerate(places.values())]))
    held = coarse.withColumn("_asked", asked).select("_key", "_range", "_n", F.col("_asked.i").alias("_i"), (F.col("_asked.place") - F.col("_to") + F.col("_own")).alias("_place"), "_own")
    inside = (F.col("_place") >= 1) & (F.col("_place") <= F.col("_own"))
    fine = table.join(held.where(inside).select(F.col("_key").alias("_k"), F.col("_range").alias("_r")).distinct(), (F.col("_key") == F.col("_k")) & (F.col("_range") == F.col("_r")), "left_semi")
    fine = fine.withColumn("_up", F.sum("_c").over(Window.partitionBy("_key", "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)))
    fine = fine.select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), "_value", "_up", (F.col("_up") - F.col("_c")).alias("_below"))
    # A place outside its range finds no value, and still keeps its group in the result.
    there = (F.col("_key") == F.col("_k")) & (F.col("_range") == F.col("_r")) & (F.col("_place") > F.col("_below")) & (F.col("_place") <= F.col("_up"))
    met = held.join(fine, there, "left")
    out = met.groupBy("_key").agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_i") == i, F.col("_value"))).alias(name) for i, name in enumerate(places)])
    return out.select(*[F.col("_key")[c].alias(c) for c in by], "n", *places)


def p95_rows(rows: DataFrame, by: list[str], value: str, more: dict[str, Column] | None = None) -> DataFrame:
    """by, n, p95 (the last of 20 exclusive quantiles; of one value that value, two may extrapolate), p95_index, the value at 0.95 (n - 1), rounded down, and what stands at more places."""
    n = F.col("_n")
    j = F.greatest(F.lit(1), F.least(F.floor((n + 1) * 19 / 20), n - 1))
    own = order_statistics(rows, by, value, {"_lo": j, "_hi": j + 1, "p95_index": F.floor((n - 1) * 0.95) + 1, **(more or {})})
    j = F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * 19 / 20), F.col("n") - 1))
    d = (F.col("n") + 1) * 19 - j * 20
    return own.withColumn("p95", F.when(F.col("n") == 1, F.col("_lo")).otherwise((F.col("_lo") * (20 - d) + F.col("_hi") * d) / 20)).drop("_lo", "_hi")


def kpis(rows: DataFrame, valid: str, means: list[str], maxima: list[str] = ()) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.round(F.try_divide(F.count_if(valid), F.count("*")), 4).alias("valid_rate"), *[F.round(F.avg(m), 4).alias(f"avg_{m}") for m in means], *[F.round(F.max(m), 4).alias(f"max_{m}") for m in maxima])


def pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side (`both`, `left`, `right`) of all distinct keys."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    paired = a.join(b, key, "left_semi").withColumn("side", F.lit("both"))
    return paired.unionAll(a.join(b, key, "left_anti").withColumn("side", F.lit("left"))).unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def in_states(rows: DataFrame, state: str, wanted: list[str] = ()) -> DataFrame:
    """Rows in one of the wanted states; all if none is named."""
    return rows.where(F.col(state).isin(*wanted)) if wanted else rows
