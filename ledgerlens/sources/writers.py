"""Writers of results: CSV, JSON, Parquet and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.stats import priority


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header and doubled quotes; one file for reports alone."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def union_rows(*tables: DataFrame) -> DataFrame:
    """Rows of tables whose columns differ; columns in order of appearance, missing ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_mismatches(metrics: DataFrame, path: str, key: str) -> None:
    """The mismatch list of each document as a line of JSON with its key, not as a folder for each document."""
    metrics.select(key, "mismatches").write.mode("overwrite").json(path)


def as_document(df: DataFrame, key: str, value_columns: list[str]) -> DataFrame:
    """The rows of a summary as one JSON object a grouping: grouping -> {key: {figures}}."""
    own = df.select("grouping", F.coalesce(F.col(key), F.lit("all")).alias("k"), F.struct(*value_columns).alias("v"))
    return own.groupBy("grouping").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("json"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _text(v) -> str:
    return "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown_table(df: DataFrame, rows: int = 200) -> str:
    """A report's table. It is for aggregates: more rows than asked for are an error, not cut off."""
    got = df.take(rows + 1)
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows")
    lines = [df.columns, ["---"] * len(df.columns), *[[_text(v) for v in r] for r in got]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def evaluation_report(summary: DataFrame, errors: DataFrame) -> str:
    """The readable evaluation: figures by group, then errors by field, most frequent first."""
    return "\n".join(["# Evaluation", "", "## Figures", "", markdown_table(summary.orderBy("grouping", "key")), "## Errors by field", "", markdown_table(errors.orderBy(F.desc("errors"), "field"))])


def write_runs(runs: DataFrame, path: str, config: str = "config_label", seed: str = "seed") -> None:
    """The figures of runs, one row each, as one CSV by configuration and seed."""
    write_csv(runs.orderBy(config, seed), path, one_file=True)


def by_label(rows: DataFrame, config: str, labels: list[str]) -> DataFrame:
    """Rows of configurations in the order of their labels; others follow by name."""
    return rows.orderBy(priority(F.col(config), labels, last=9999), config)


def write_configurations(statistics: DataFrame, path: str, labels: list[str], config: str = "config_label") -> None:
    write_csv(by_label(statistics, config, labels), path, one_file=True)


def master_report(runs: DataFrame, statistics: DataFrame, meta: dict[str, str], config: str = "config_label", seed: str = "seed", names: dict[str, str] | None = None) -> DataFrame:
    """One row, json: meta, every run by configuration and seed, and of each configuration its name, seeds and figures.

    It is for runs of a design, a few dozen rows: they are gathered in one object.
    """
    own = names or {}
    called = F.coalesce(F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col(config)], F.col(config)) if own else F.col(config)
    figures = F.struct(*[c for c in statistics.columns if c != config])
    run = F.struct(config, seed, *[c for c in runs.columns if c not in (config, seed)])
    own_runs = runs.groupBy(config).agg(F.array_sort(F.collect_list(run)).alias("_runs"))
    known = statistics.select(F.col(config).alias("_config"), figures.alias("figures"))
    both = own_runs.join(known, F.col(config) == F.col("_config"), "left")
    seeds = F.transform("_runs", lambda x: x[seed])
    entry = F.struct(F.col(config).alias("key"), F.struct(called.alias("name"), seeds.alias("seeds"), "figures").alias("value"))
    whole = both.agg(F.array_sort(F.flatten(F.collect_list("_runs"))).alias("per_run"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_configuration"))
    said = F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], F.size("per_run").alias("runs"), F.size("per_configuration").alias("configurations"))
    return whole.select(F.to_json(F.struct(said.alias("meta"), "per_run", "per_configuration"), {"ignoreNullFields": "false"}).alias("json"))


def interval_text(mean: str, half: str, low: str, high: str, decimals: int = 4, unit: str = "") -> Column:
    """`mean ± half [low, high]` of four columns."""
    shown = lambda c: F.format_string(f"%.{decimals}f", F.col(c).cast("double"))
    return F.concat(shown(mean), F.lit(f"{unit} ± "), shown(half), F.lit(" ["), shown(low), F.lit(", "), shown(high), F.lit("]"))


def with_intervals(statistics: DataFrame, metrics: dict[str, int]) -> DataFrame:
    """Adds {metric}_text for each metric of config_statistics and its decimals."""
    for m, decimals in metrics.items():
        half = (F.col(f"{m}_ci95_high") - F.col(f"{m}_ci95_low")) / 2
        statistics = statistics.withColumn("_half", half).withColumn(f"{m}_text", interval_text(f"{m}_mean", "_half", f"{m}_ci95_low", f"{m}_ci95_high", decimals)).drop("_half")
    return statistics


def ablation_report(statistics: DataFrame, labels: list[str], tables: dict[str, dict[str, int]], leading: str, config: str = "config_label", names: dict[str, str] | None = None) -> str:
    """Tables of configurations in the order of their labels, and what the leading metric says: best, worst and their gap, and each one's distance from the first.

    tables: title -> {metric: decimals}. It is for the figures of a design: markdown_table refuses more than its rows.
    """
    every = {m: n for columns in tables.values() for m, n in columns.items()}
    if names:
        called = F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col(config)], F.col(config))
    else:
        called = F.col(config)
    rows = by_label(with_intervals(statistics, every), config, labels).withColumn("_name", called)
    parts = ["# Ablation", ""]
    for title, columns in tables.items():
        parts += [f"## {title}", "", markdown_table(rows.select(F.col("_name").alias("configuration"), *[F.col(f"{m}_text").alias(f"{m} ± 95 %") for m in columns], *[F.col(f"{m}_sd").alias(f"{m} sd") for m in columns]))]
    got = [(r["_name"], r["m"]) for r in rows.select("_name", F.col(f"{leading}_mean").alias("m")).where("m is not null").take(200)]
    if got:
        best, worst = max(got, key=lambda x: x[1]), min(got, key=lambda x: x[1])
        parts += ["## Reading", "", f"Best by {leading}: {best[0]} ({best[1]:.4f}); worst: {worst[0]} ({worst[1]:.4f}); gap {best[1] - worst[1]:.4f}.", ""]
        parts += [f"- {name}: Δ {m - got[0][1]:+.4f} against {got[0][0]}" for name, m in got[1:]]
    return "\n".join(parts) + "\n"


def as_manifest(cases: DataFrame, meta: dict[str, str], order: str = "id") -> DataFrame:
    """One row, json: meta and test_cases in order. It is for the cases of a design, a few hundred rows."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cases.columns).alias("_c")))), lambda x: x["_c"])
    return cases.agg(rows.alias("test_cases")).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], "test_cases"), {"ignoreNullFields": "false"}).alias("json"))


def write_text(rows: DataFrame, path: str) -> None:
    """A table of one text column, such as a report or manifest, as one file."""
    rows.coalesce(1).write.mode("overwrite").text(path)
