"""Queries of the engine's operators over the star schema, events, documents and embeddings, each with its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import dates, numbers, repair, text
from ledgerlens.operators import audit, engine, evidence, experiments, merge, metrics, readings, retrieve, stats
from ledgerlens.operators.validate import constraint_rows, issue_rows, validate, validate_many
from ledgerlens.plans.rules import columns_context, compile_rule, with_today
from ledgerlens.plans.schema import Constraint, DecisionRule, Field, Schema
from ledgerlens.streaming import cases, logs

AS_OF = datetime.date(1998, 6, 1)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _unfold(names: list[str], *rows: tuple):
    """Several rows of each row."""
    return F.inline(F.array(*[F.struct(*[(c if hasattr(c, "cast") else F.lit(c)).alias(n) for n, c in zip(names, row, strict=True)]) for row in rows]))


def _is(value: str):
    return lambda x: x == value


LINE_RULES = (
    DecisionRule("L1", "l_discount <= 0.05 and l_tax <= 0.04", "critica", "Small discount and tax"),
    DecisionRule("L2", "l_returnflag in ['A', 'R'] or l_quantity > 25", "advertencia", "Returned or many"),
    DecisionRule("L3", "price_or_null == null or price_or_null > 30000", "advertencia", "Eager: null where the price is null"),
    DecisionRule("L4", "l_extendedprice / (l_quantity - 1) < 1500", "info", "Null where the quantity is 1"),
    DecisionRule("L5", "10 < l_quantity <= 40", "info", "Chained"),
    DecisionRule("L6", "coalesce(price_or_null, 0) != 0 and not (l_linestatus == 'O')", "info", "Coalesce and not"),
)


def _ruled(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    li = li.withColumn("price_or_null", F.when(F.col("l_quantity") % 7 != 0, F.col("l_extendedprice")))
    return li


RULED_SQL = """SELECT l_orderkey, l_linenumber, l_returnflag, u.rule_id, u.holds FROM (
    SELECT *, CASE WHEN l_quantity % 7 != 0 THEN l_extendedprice END AS p FROM lineitem) x,
    LATERAL (VALUES ('L1', l_discount <= 0.05 AND l_tax <= 0.04),
     ('L2', l_returnflag IN ('A', 'R') OR l_quantity > 25),
     ('L3', CASE WHEN p IS NOT NULL THEN p > 30000 END),
     ('L4', CASE WHEN l_quantity != 1 THEN l_extendedprice / (l_quantity - 1) < 1500 END),
     ('L5', l_quantity > 10 AND l_quantity <= 40),
     ('L6', coalesce(p, 0) != 0 AND NOT l_linestatus = 'O')) AS u(rule_id, holds)"""


@query(RULED_SQL.replace("l_returnflag, u.", "u.", 1))
def rule_outcomes_lineitem(spark, d):
    li = _ruled(spark, d)
    return audit.rule_holds(li, LINE_RULES, columns_context(li), ["l_orderkey", "l_linenumber"])


@query(f"SELECT l_returnflag, rule_id, count(*) AS n, count(*) FILTER (holds) AS passed, count(*) FILTER (NOT holds) AS failed, count(*) FILTER (holds IS NULL) AS unknown FROM ({RULED_SQL}) GROUP BY ALL")
def rule_pass_rate_by_flag(spark, d):
    li = _ruled(spark, d)
    return audit.rule_rates(li, LINE_RULES, columns_context(li), ["l_returnflag"])


CUSTOMER = Schema(
    "customer",
    fields=(
        Field("c_name", "string", True, None, (Constraint("regex", "^Customer#[0-9]*[02468]$"),)),
        Field("c_acctbal", "number", True, None, (Constraint("min", 0.0), Constraint("max", 9000.0))),
        Field("c_mktsegment", "string", False, None, (Constraint("enum", ("BUILDING", "MACHINERY", "AUTOMOBILE")),)),
        Field("c_phone", "string", True),
    ),
)
ISSUES_SQL = """SELECT c_custkey, u.* FROM customer, LATERAL (VALUES
    ('c_name', 'regex', 'No cumple el patrón esperado.', NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]')),
    ('c_acctbal', 'min', 'Debe ser >= 0.0.', c_acctbal < 0), ('c_acctbal', 'max', 'Debe ser <= 9000.0.', c_acctbal > 9000),
    ('c_mktsegment', 'enum', 'Valor no permitido. Permitidos: [''BUILDING'', ''MACHINERY'', ''AUTOMOBILE''].', c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')),
    ('c_phone', 'required', 'Campo requerido ausente.', true)) AS u(field, code, message, bad) WHERE bad"""


@query(f"SELECT c_custkey, field, code, message FROM ({ISSUES_SQL})")
def validate_issues_customer(spark, d):
    return issue_rows(validate(t(spark, d, "customer"), CUSTOMER), ["c_custkey"]).drop("position", "level")


def _nation_schemas(spark, d):
    """A schema for each nation of the table: names, bounds, segments and required fields of its own."""
    keys = [r[0] for r in t(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    return [
        Schema(
            f"nation-{k}",
            fields=(
                Field("c_name", "string", True, None, (Constraint("regex", f"Customer#[0-9]*[{k % 10}{(k + 3) % 10}]"),)),
                Field("c_acctbal", "number", True, None, (Constraint("min", 100.0 * k), Constraint("max", 9000.0 - k))),
                Field("c_mktsegment", "string", False, None, (Constraint("enum", ("BUILDING", "MACHINERY", "AUTOMOBILE")[: 1 + k % 3]),)),
                Field("c_phone", "string", k % 2 == 0),
            ),
        )
        for k in keys
    ]


@query("""WITH x AS (SELECT *, c_nationkey AS k, array_to_string(['''BUILDING''', '''MACHINERY''', '''AUTOMOBILE'''][1 : 1 + c_nationkey % 3], ', ') AS allowed FROM customer)
    SELECT c_custkey, u.field, u.code, u.message, u.bit AS verdict FROM x, LATERAL (VALUES
    ('c_name', 'regex', 'No cumple el patrón esperado.', right(c_name, 1) NOT IN ((k % 10)::VARCHAR, ((k + 3) % 10)::VARCHAR), 2),
    ('c_acctbal', 'min', 'Debe ser >= ' || (100.0 * k)::DOUBLE || '.', c_acctbal < 100.0 * k, 5), ('c_acctbal', 'max', 'Debe ser <= ' || (9000.0 - k)::DOUBLE || '.', c_acctbal > 9000.0 - k, 6),
    ('c_mktsegment', 'enum', 'Valor no permitido. Permitidos: [' || allowed || '].', NOT contains(allowed, c_mktsegment), 9),
    ('c_phone', 'required', 'Campo requerido ausente.', k % 2 = 0, 10)) AS u(field, code, message, bad, bit) WHERE u.bad""")
def validate_many_schemas(spark, d):
    """Every customer held to the schema of its nation, with the place of each failed check among its verdicts."""
    values = F.create_map(*[x for c in ("c_name", "c_acctbal", "c_mktsegment") for x in (F.lit(c), F.col(c).cast("string"))])
    rows = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("schema"), values.alias("values"))
    found = validate_many(rows, constraint_rows(spark, _nation_schemas(spark, d)))
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("getbit", F.col("verdicts")[0], i) == 1)
    own = found.select("c_custkey", F.inline(F.arrays_zip(F.col("issues"), bits.alias("bit"))))
    return own.select("c_custkey", "issues.field", "issues.code", "issues.message", F.col("bit").alias("verdict"))


@query(f"""SELECT field, code, count(*) AS n, arg_min(c_custkey, c_custkey) AS sample_c_custkey, min(c_custkey) AS first_seen FROM ({ISSUES_SQL}) GROUP BY ALL""")
def error_patterns(spark, d):
    issues = issue_rows(validate(t(spark, d, "customer"), CUSTOMER), ["c_custkey"])
    return stats.error_patterns(issues, ["field", "code"], ["c_custkey"], "c_custkey")


ORDER = Schema(
    "order",
    fields=(Field("o_orderstatus", "string", True), Field("o_totalprice", "number", True, None, (Constraint("max", 400000.0),)), Field("o_clerk", "string"), Field("line_total", "number")),
    rules=(DecisionRule("O1", "o_totalprice > 1000", "critica", "Price"), DecisionRule("O2", "line_total == null or abs(line_total - o_totalprice) <= 100000", "critica", "Lines"), DecisionRule("O3", "o_orderstatus != 'P'", "info", "Not pending")),
)


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS line_total FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, line_total, o_totalprice <= 400000 AS ok FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
    SELECT o_orderkey, ok AS valid,
      CASE WHEN ok AND o_totalprice > 1000 AND line_total IS NOT NULL AND abs(line_total - o_totalprice) <= 100000 THEN 'APROBADO' ELSE 'REVISAR' END AS status,
      CASE WHEN o_totalprice <= 1000 OR (line_total IS NOT NULL AND abs(line_total - o_totalprice) > 100000) THEN 'CRITICO' WHEN NOT ok THEN 'REVISAR' ELSE 'OK' END AS state,
      round(0.6 * (2 + (line_total IS NOT NULL)::INT) / 4.0 + 0.4 * ok::INT, 6) AS score FROM o""")
def audit_status_orders(spark, d):
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("line_total"))
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return audit.audit(rows, ORDER, as_of=AS_OF).select("o_orderkey", "valid", "status", "state", F.round("score", 6).alias("score"))


@query("""SELECT o_orderkey, round(sum(l_extendedprice), 2) AS base, abs(o_totalprice - sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))) <= 0.05 AS consistent
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def invoice_total_consistency(spark, d):
    li = t(spark, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("base"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total"))
    rows = t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    holds = compile_rule("abs(o_totalprice - total) <= 0.05", columns_context(rows))
    return rows.select("o_orderkey", F.round("base", 2).alias("base"), holds.alias("consistent"))


# A truth and a guess about documents, in long form: the labels, and what their length and signs suggest.
def _truth_and_guess(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = t(spark, d, "labels")
    form = ["field", "value", "number"]
    none = F.lit(None).cast("double")
    as_text = lambda c: F.col(c).cast("string")
    truth = labels.select("doc_id", _unfold(form, ("quality", as_text("quality"), F.col("quality").cast("double")), ("toxic", as_text("toxic"), F.col("toxic").cast("double")), ("id_documento", as_text("doc_id"), none)))
    long_, some = (F.col("n_chars") > 1000).cast("int"), F.col("n_chars") % 3 > 0
    guess = docs.select("doc_id", _unfold(form, ("quality", long_.cast("string"), long_.cast("double")), ("toxic", F.when(some, F.lit("0")), F.when(some, F.lit(0.0))), ("lang", F.col("lang"), none)))
    return truth, guess.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


TG_SQL = """tr AS (SELECT doc_id, u.* FROM labels, LATERAL (VALUES ('quality', quality::VARCHAR), ('toxic', toxic::VARCHAR), ('id_documento', doc_id::VARCHAR)) AS u(field, value)),
    gu AS (SELECT doc_id, u.* FROM documents SEMI JOIN labels USING (doc_id), LATERAL (VALUES ('quality', (n_chars > 1000)::INT::VARCHAR), ('toxic', CASE WHEN n_chars % 3 > 0 THEN '0' END), ('lang', lang)) AS u(field, value)),
    c AS (SELECT tr.doc_id, tr.field, gu.value AS pred, tr.value AS gt, coalesce(gu.value, '') != '' AS ph, coalesce(tr.value, '') != '' AS gh, coalesce(gu.value = tr.value, gu.value IS NULL AND tr.value IS NULL) AS eq
          FROM tr LEFT JOIN gu USING (doc_id, field)),
    m AS (SELECT doc_id, count(*) AS fields_total, count(*) FILTER (gh) AS fields_gt_present, count(*) FILTER (ph) AS fields_pred_present, count(*) FILTER (eq AND gh) AS exact_matches,
          bool_and(eq) AS document_correct, count(*) FILTER (NOT eq) AS mismatch_count FROM c GROUP BY doc_id),
    e AS (SELECT *, coalesce(exact_matches / nullif(fields_pred_present, 0), 0) AS p, exact_matches / fields_gt_present AS r FROM m)"""


@query(f"""WITH {TG_SQL} SELECT doc_id, fields_total, fields_gt_present, fields_pred_present, exact_matches, document_correct, mismatch_count, round(p, 6) AS precision, round(r, 6) AS recall,
    round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM e""")
def field_metrics_m1(spark, d):
    truth, guess = _truth_and_guess(spark, d)
    m = metrics.field_metrics(metrics.compare_by_truth(guess, truth, ["doc_id"]), ["doc_id"])
    return m.select("doc_id", "fields_total", "fields_gt_present", "fields_pred_present", "exact_matches", "document_correct", "mismatch_count", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _f1_sql(tp="tp", fp="fp", fn="fn"):
    return f"round(CASE WHEN {tp} = 0 THEN 0 ELSE 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) END, 6) AS f1"


@query(f"""WITH {TG_SQL}, j AS (SELECT doc_id, gu.value AS p, tr.value AS g, gu.field IS NOT NULL AS ip, tr.field IS NOT NULL AS ig FROM (SELECT *, 1 AS o FROM gu) gu FULL JOIN (SELECT *, 1 AS o FROM tr) tr USING (doc_id, field)),
    k AS (SELECT *, ip AND ig AND p IS NOT DISTINCT FROM g AS s FROM j),
    a AS (SELECT doc_id, count(*) FILTER (s) AS tp, count(*) FILTER (ip AND NOT s) AS fp, count(*) FILTER (ig AND NOT s) AS fn, coalesce(bool_and(s) FILTER (ip AND ig), true) AS exact FROM k GROUP BY 1)
    SELECT doc_id, tp, fp, fn, exact, {_f1_sql()} FROM a""".replace("gu.field IS NOT NULL AS ip, tr.field IS NOT NULL AS ig", "gu.o IS NOT NULL AS ip, tr.o IS NOT NULL AS ig"))
def field_metrics_m2(spark, d):
    truth, guess = _truth_and_guess(spark, d)
    return metrics.strict_metrics(guess, truth, ["doc_id"]).withColumn("f1", F.round("f1", 6))


@query(f"""WITH {TG_SQL}, a AS (SELECT doc_id, count(*) AS fields_total, count(*) FILTER (eq AND gh AND ph) AS hits, count(*) FILTER (ph) AS fields_pred, count(*) FILTER (gh) AS fields_gt FROM c WHERE field != 'id_documento' GROUP BY 1)
    SELECT *, round(coalesce(2.0 * hits / nullif(fields_pred + fields_gt, 0), 0), 6) AS f1 FROM a""")
def field_metrics_m3(spark, d):
    truth, guess = _truth_and_guess(spark, d)
    return metrics.filled_metrics(guess, truth, ["doc_id"]).drop("precision", "recall").withColumn("f1", F.round("f1", 6))


@query(f"""WITH {TG_SQL}, j AS (SELECT doc_id, lower(trim(coalesce(gu.value, ''))) AS p, lower(trim(coalesce(tr.value, ''))) AS g FROM gu FULL JOIN tr USING (doc_id, field)),
    a AS (SELECT doc_id, count(*) FILTER (p = g AND p != '') AS tp, count(*) FILTER (p != '' AND p != g) AS fp, count(*) FILTER (p = '' AND g != '') AS fn FROM j GROUP BY 1)
    SELECT doc_id, tp, fp, fn, {_f1_sql()} FROM a""")
def field_metrics_m4(spark, d):
    truth, guess = _truth_and_guess(spark, d)
    return metrics.union_metrics(guess, truth, ["doc_id"]).withColumn("f1", F.round("f1", 6))


@query(f"""WITH {TG_SQL}, a AS (SELECT field, count(*) FILTER (NOT eq) AS errors, count(*) AS checked FROM c GROUP BY 1) SELECT field, errors, checked, round(errors / checked, 6) AS error_rate FROM a WHERE errors > 0""")
def field_error_rate(spark, d):
    truth, guess = _truth_and_guess(spark, d)
    return metrics.error_counts(metrics.compare_by_truth(guess, truth, ["doc_id"])).withColumn("error_rate", F.round("error_rate", 6))


def _evaluated(spark, d):
    truth, guess = _truth_and_guess(spark, d)
    m = metrics.field_metrics(metrics.compare_by_truth(guess, truth, ["doc_id"]), ["doc_id"])
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return m.join(docs, "doc_id").withColumns({"latency_s": F.col("n_chars") / 100.0, "ram_peak_mb": (F.col("doc_id") % 97).cast("double"), "config": F.concat(F.lit("C"), (F.col("doc_id") % 2 + 1).cast("string")), "seed": F.floor(F.col("doc_id") / 2) % 3})


EV_SQL = f"""{TG_SQL}, v AS (SELECT e.*, lang, source, n_chars / 100.0::DOUBLE AS latency_s, (doc_id % 97)::DOUBLE AS ram_peak_mb, 'C' || (doc_id % 2 + 1) AS config, doc_id // 2 % 3 AS seed, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM e JOIN documents USING (doc_id))"""


@query(f"""WITH {EV_SQL}, g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS grouping, coalesce(lang, source) AS key, count(*) AS runs, avg(f1) AS f1, avg(r) AS mr, avg(latency_s) AS l,
    list_sort(list(latency_s)) AS x, sum(exact_matches) AS em, sum(fields_pred_present) AS fp, sum(fields_gt_present) AS fg, count(*) FILTER (document_correct) AS documents_correct FROM v GROUP BY GROUPING SETS ((), (lang), (source))),
    h AS (SELECT *, len(x) AS n, greatest(1, least(19 * (len(x) + 1) // 20, len(x) - 1)) AS j FROM g)
    SELECT grouping, key, runs, round(f1, 6) AS macro_f1, round(mr, 6) AS macro_match_rate, round(l, 6) AS avg_latency_s,
    round(CASE WHEN n = 1 THEN x[1] ELSE (x[j] * (20 - (19 * (n + 1) - 20 * j)) + x[j + 1] * (19 * (n + 1) - 20 * j)) / 20 END, 6) AS p95_latency_s, documents_correct, round(documents_correct / runs, 6) AS exact_match_rate,
    round(em / fp, 6) AS micro_precision, round(em / fg, 6) AS micro_recall, round(2.0 * em / (fp + fg), 6) AS micro_f1 FROM h""")
def micro_macro_summary(spark, d):
    s = metrics.summarize(_evaluated(spark, d), ["lang", "source"]).drop("avg_ram_peak_mb")
    return s.select("grouping", "key", "runs", "documents_correct", *[F.round(c, 6).alias(c) for c in ("macro_f1", "macro_match_rate", "avg_latency_s", "p95_latency_s", "exact_match_rate", "micro_precision", "micro_recall", "micro_f1")])


RUNS_SQL = f"""{EV_SQL}, q AS (SELECT config, seed, count(*) AS n_docs, sum(exact_matches) AS tp, sum(greatest(fields_pred_present - exact_matches, 0)) AS fp, sum(greatest(fields_gt_present - exact_matches, 0)) AS fn,
    100.0 * count(*) FILTER (document_correct) / count(*) AS emr, avg(latency_s) AS la, CASE WHEN count(DISTINCT source) <= 1 THEN max(source) ELSE 'mixed' END AS source FROM v GROUP BY 1, 2)"""


@query(f"""WITH {RUNS_SQL} SELECT config, seed, n_docs, round(tp / (tp + fp), 6) AS precision_micro, round(tp / (tp + fn), 6) AS recall_micro, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_micro, round(emr, 6) AS emr_pct, round(la, 6) AS latency_avg_s, source FROM q""")
def run_aggregate(spark, d):
    r = stats.run_aggregate(_evaluated(spark, d), ["config", "seed"], ["source"])
    return r.select("config", "seed", "n_docs", "source", *[F.round(c, 6).alias(c) for c in ("precision_micro", "recall_micro", "f1_micro", "emr_pct", "latency_avg_s")])


@query(f"""WITH {RUNS_SQL}, a AS (SELECT config, count(*) AS n_runs, avg(la) AS m, stddev_samp(la) AS s, min(la) AS lo, max(la) AS hi FROM q GROUP BY 1)
    SELECT config, n_runs, round(m, 5) AS mean, round(s, 5) AS sd, round(m - 4.3026527299 * s / sqrt(3), 5) AS low, round(m + 4.3026527299 * s / sqrt(3), 5) AS high, round(hi - lo, 5) AS range FROM a""")
def config_ci95(spark, d):
    c = stats.config_statistics(stats.run_aggregate(_evaluated(spark, d), ["config", "seed"]), "config", ["latency_avg_s"])
    names = {"mean": "mean", "sd": "sd", "ci95_low": "low", "ci95_high": "high", "range": "range"}
    return c.select("config", "n_runs", *[F.round(f"latency_avg_s_{a}", 5).alias(b) for a, b in names.items()])


@query(f"""WITH {EV_SQL}, g AS (SELECT lang, avg(f1) AS f, avg(document_correct::INT) AS c FROM v GROUP BY 1),
    h AS (SELECT lang, CASE WHEN f = 0 THEN -1 ELSE f END AS f, CASE WHEN c = 0 THEN -1 ELSE c END AS c, f AS f0, c AS c0 FROM g)
    SELECT (SELECT lang FROM h ORDER BY f DESC, c DESC, lang DESC LIMIT 1) AS best, (SELECT lang FROM h ORDER BY f0, c0, lang LIMIT 1) AS worst, round((SELECT max(f) FROM h) - (SELECT min(f0) FROM h), 6) AS gap""")
def best_worst_variant(spark, d):
    g = _evaluated(spark, d).groupBy("lang").agg(F.avg("f1").alias("f1"), F.avg(F.col("document_correct").cast("int")).alias("emr"))
    return stats.best_and_worst(g, "lang", ["f1", "emr"]).withColumn("gap", F.round("gap", 6))


@query(f"""WITH {EV_SQL}, a AS (SELECT (SELECT avg(f1) FROM v) AS f, (SELECT max(latency_s) FROM v) AS l) SELECT u.metric, round(u.value, 6) AS value, u.goal, u.met FROM a, LATERAL (VALUES ('f', f, 0.85::DOUBLE, f >= 0.85), ('l', l, 500.0::DOUBLE, l <= 500)) AS u(metric, value, goal, met)""")
def targets_met(spark, d):
    figures = _evaluated(spark, d).agg(F.avg("f1").alias("f"), F.max("latency_s").alias("l"))
    return metrics.targets_met(figures, {"f": (">=", 0.85), "l": ("<=", 500.0)}).withColumn("value", F.round("value", 6))


@query("""WITH p AS (SELECT doc_id, u.* FROM labels, LATERAL (VALUES ('a', quality = 1), ('b', CASE WHEN toxic = 0 THEN true END)) AS u(rule_id, h)),
    g AS (SELECT doc_id, u.* FROM labels, LATERAL (VALUES ('a', doc_id % 2 = 0), ('c', CASE WHEN quality = 1 THEN toxic = 0 END)) AS u(rule_id, h)),
    j AS (SELECT doc_id, p.h AS p, g.h AS t FROM p FULL JOIN g USING (doc_id, rule_id)),
    a AS (SELECT doc_id, count(*) AS rules_total, count(t) AS rules_gt_evaluable, count(p) AS rules_pred_evaluable, count(*) FILTER (p = t) AS rules_matches FROM j GROUP BY 1)
    SELECT *, round(coalesce(rules_matches / nullif(rules_pred_evaluable, 0), 0), 6) AS rules_accuracy, round(rules_pred_evaluable / rules_total, 6) AS rules_coverage FROM a""")
def rule_metrics(spark, d):
    labels = t(spark, d, "labels")
    p = labels.select("doc_id", _unfold(["rule_id", "holds"], ("a", F.col("quality") == 1), ("b", F.when(F.col("toxic") == 0, True))))
    g = labels.select("doc_id", _unfold(["rule_id", "holds"], ("a", F.col("doc_id") % 2 == 0), ("c", F.when(F.col("quality") == 1, F.col("toxic") == 0))))
    m = metrics.rule_metrics(p, g, ["doc_id"])
    return m.withColumns({c: F.round(c, 6) for c in ("rules_accuracy", "rules_coverage")})


@query("""WITH x AS (SELECT event_type, list_sort(list(value)) AS x FROM events GROUP BY 1), h AS (SELECT *, len(x) AS n, greatest(1, least(19 * (len(x) + 1) // 20, len(x) - 1)) AS j FROM x)
    SELECT event_type, round((x[j] * (20 - (19 * (n + 1) - 20 * j)) + x[j + 1] * (19 * (n + 1) - 20 * j)) / 20, 6) AS p95, x[floor(0.95 * (n - 1))::INT + 1] AS p95_index, round(list_median(x), 6) AS p50 FROM h""".replace("list_median(x)", "list_aggregate(x, 'median')"))
def p95_by_type(spark, d):
    e = t(spark, d, "events").select("event_type", "value")
    g = stats.p95_rows(e, ["event_type"], "value", {"lo": F.floor((F.col("_n") + 1) / 2), "hi": F.floor(F.col("_n") / 2) + 1})
    return g.select("event_type", F.round("p95", 6).alias("p95"), "p95_index", F.round((F.col("lo") + F.col("hi")) / 2, 6).alias("p50"))


@query("""SELECT coalesce(CASE WHEN event_type != 'error' THEN event_type END, 'desconocido') AS kind, count(*) AS n, count(*) FILTER (value > 20) AS n_valid, round(count(*) FILTER (value > 20) / count(*), 4) AS valid_rate, round(avg(value), 4) AS avg_value FROM events GROUP BY 1""")
def group_log_rows_type(spark, d):
    e = t(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), "value", (F.col("value") > 20).alias("ok"))
    return stats.group_rows(e, "kind", ["value"], "ok")


@query("SELECT user_id::VARCHAR AS user_id, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY 1")
def group_log_rows_user(spark, d):
    return stats.group_rows(t(spark, d, "events").select("user_id", "value"), "user_id", ["value"])


@query("SELECT count(*) AS n, count(*) FILTER (value > 20) AS n_valid, round(count(*) FILTER (value > 20) / count(*), 4) AS valid_rate, round(avg(value), 4) AS avg_value, round(max(value), 4) AS max_value FROM events WHERE event_type IN ('click', 'error')")
def kpis_of_selection(spark, d):
    e = stats.keep_selected(t(spark, d, "events").select("event_type", "user_id", "value"), {"event_type": ["click", "error"], "user_id": []})
    return stats.kpis(e.withColumn("ok", F.col("value") > 20), "ok", ["value"], ["value"])


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) = 1 AS total_a, grouping(o_orderpriority) = 1 AS total_b FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def crosstab_status_priority(spark, d):
    return stats.crosstab(t(spark, d, "orders").select("o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")


@query("""SELECT c_mktsegment, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS "F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS "O", round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS "P" FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def pivot_route_variant(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return stats.matrix(rows, "c_mktsegment", "o_orderstatus", ["F", "O", "P"], F.round(F.avg("o_totalprice"), 4))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def latest_n_events(spark, d):
    return stats.newest(t(spark, d, "events"), ["ts", "event_id"]).select("event_id", "event_type", "user_id")


@query("""SELECT event_id, round(avg(value) OVER w, 10) AS running_value, count(*) OVER w AS running_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_average(spark, d):
    r = stats.running_mean(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"])
    return r.select("event_id", F.round("running_value", 10).alias("running_value"), "running_n")


@query("""WITH e AS (SELECT *, round(value * 100)::BIGINT AS cents FROM events) SELECT event_id, round(avg(cents) OVER w, 8) AS running_cents, count(*) OVER w AS running_n, count(*) OVER () - count(*) OVER w AS n_left,
    round((count(*) OVER () - count(*) OVER w) * avg(cents) OVER w, 4) AS eta_cents FROM e WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_eta(spark, d):
    """Mean so far and what is left at that mean, over the whole log, without a key; in whole cents, so that sums are exact in any order."""
    e = t(spark, d, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    r = stats.progress(e, "cents", ["ts", "event_id"])
    return r.select("event_id", F.round("running_cents", 8).alias("running_cents"), "running_n", "n_left", F.round("eta_cents", 4).alias("eta_cents"))


@query("""WITH x AS (SELECT source, n_chars, text FROM documents), g AS (SELECT CASE WHEN grouping(source) = 0 THEN source END AS source, list_sort(list(n_chars)) AS x FROM x GROUP BY GROUPING SETS ((), (source)))
    SELECT source, len(x) AS n, x[(len(x) + 1) // 2] AS median_low, x[greatest(1, ceil(len(x) * 0.99)::INT)] AS p99, x[1] AS least, x[len(x)] AS most FROM g""")
def length_quantiles(spark, d):
    """Exact quantiles of text lengths, of each source and of all documents as one group."""
    docs = t(spark, d, "documents").select("source", "n_chars")
    both = docs.select(F.explode(F.array(F.col("source"), F.lit(None))).alias("source"), "n_chars")
    n = F.col("_n")
    return stats.order_statistics(both, ["source"], "n_chars", {"median_low": F.floor((n + 1) / 2), "p99": F.greatest(F.lit(1), F.ceil(n * 0.99)), "least": F.lit(1), "most": n})


#: What the documents of a case file say, by the document's id: its own text, and one of these lines after it.
CASE_LINES = ("pasaporte en regla", "CIRBE al dia", "la Hipoteca vigente", "factura con IVA", "sin datos", "código postal 28001", "nota simple del registro")


@query(f"""WITH d AS (SELECT doc_id // 3 AS case_id, lower(coalesce(text, '') || chr(10) || ['{"', '".join(CASE_LINES)}'][(doc_id % 7) + 1]) AS t FROM documents), c AS (SELECT case_id, string_agg(t, chr(10)) AS t FROM d GROUP BY 1)
    SELECT case_id, CASE WHEN regexp_matches(t, 'hipoteca|hipotecario|irpf|modelo 100|cirbe|incidencias|nota simple|registro de la propiedad|préstamo|prestamo') THEN 'credito_hipotecario'
        WHEN regexp_matches(t, 'kyc|onboarding|pasaporte|empadronamiento|código postal|codigo postal|nacionalidad|fecha de caducidad|fecha caducidad|fecha de expedicion|justificante') THEN 'kyc_onboarding'
        WHEN regexp_matches(t, 'factura|modelo 303|iva|cuota|base imponible|cif') THEN 'auditoria_fiscal' ELSE 'credito_hipotecario' END AS schema_name FROM c""")
def case_kinds(spark, d):
    """Kinds of case files of three documents each."""
    line = F.get(F.array(*map(F.lit, CASE_LINES)), (F.col("doc_id") % len(CASE_LINES)).cast("int"))
    docs = t(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("case_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))
    return engine.case_kind(docs)


@query("""WITH x AS (SELECT user_id, event_type, coalesce(lead(v, 1 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), NULL) AS nx, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS nxt FROM (SELECT *, CASE WHEN value > 10 THEN value END AS v FROM events))
    SELECT user_id, count(nxt) AS n, round(sum(nxt), 4) AS total FROM x WHERE event_type = 'click' GROUP BY 1""".replace("coalesce(lead(v, 1 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), NULL) AS nx, ", ""))
def lookahead_sum(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    return stats.sum_after_triggers(e, F.col("event_type") == "click", "v", ["ts", "event_id"], ["user_id"]).withColumn("total", F.round("total", 4))


MERGE_SQL = """WITH r AS (SELECT conv_id AS case_id, turn AS doc_index, role AS field, CASE WHEN turn % 3 != 0 THEN text END AS value, CASE WHEN turn % 4 != 1 THEN (length(text) % 5) / 5.0 END AS confidence FROM conversations)"""


@query(f"""{MERGE_SQL} SELECT case_id, field, doc_index AS from_doc_index, value, round(confidence, 4) AS confidence FROM r
    QUALIFY row_number() OVER (PARTITION BY case_id, field ORDER BY (value IS NULL)::INT, confidence DESC NULLS LAST, doc_index) = 1""")
def case_merge_best_confidence(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("doc_index"), F.col("role").alias("field"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("value"), F.when(F.col("turn") % 4 != 1, F.char_length("text") % 5 / 5.0).alias("confidence"))
    return merge.merge_fields(rows).select("case_id", "field", "from_doc_index", "value", F.round("confidence", 4).alias("confidence"))


@query(ORACLE["case_merge_best_confidence"])
def stream_case_merge(spark, d):
    """The same merge as a stream: documents are folded into their cases as they arrive."""
    source = t(spark, d, "conversations")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "conversations.parquet").parquet(d) if not _is_folder(spark, f"{d}/conversations.parquet") else spark.readStream.schema(source.schema).parquet(f"{d}/conversations.parquet")
    rows = stream.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("doc_index"), F.col("role").alias("field"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("value"), F.when(F.col("turn") % 4 != 1, F.char_length("text") % 5 / 5.0).alias("confidence"))
    return cases.merge_arrived(spark, rows).select("case_id", "field", "from_doc_index", "value", F.round("confidence", 4).alias("confidence"))


def _is_folder(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


EVIDENCE = Schema("provenance", fields=(Field("source", label="Origin of the text"), Field("lang", label="Language"), Field("note"), Field("n_chars", "integer", label="Size")))
EVIDENCE_LETTERS = "aeinorst"


def _letter_counts(texts: list[str]) -> list[list[float]]:
    """A deterministic embedding: how often each of a few letters stands in a text."""
    return [[float(x.count(c)) for c in EVIDENCE_LETTERS] for x in texts]


def _counted(x: str) -> str:
    return "[" + ", ".join(f"length({x}) - length(replace({x}, '{c}', ''))" for c in EVIDENCE_LETTERS) + "]"


@query(rf"""WITH x AS (SELECT doc_id, source, lang, n_chars::VARCHAR AS n_chars, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
    y AS (SELECT doc_id, i, regexp_replace(substr(t, i * 1000 + 1, 1200), '^\s+|\s+$', '', 'g') AS c FROM x, LATERAL unnest(range(0, greatest(ceil((length(t) - 1200) / 1000.0)::INT, 0) + 1)) AS u(i)),
    z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, c FROM y WHERE c != ''),
    q AS (SELECT doc_id, u.field, CASE WHEN trim(coalesce(u.v, '')) != '' THEN u.label || ': ' || u.v ELSE u.label END AS question FROM x, LATERAL (VALUES ('source', 'Origin of the text', source), ('lang', 'Language', lang), ('note', 'note', NULL), ('n_chars', 'Size', n_chars)) AS u(field, label, v)),
    p AS (SELECT doc_id, field, n, c, list_sum(list_transform(list_zip({_counted("c")}, {_counted("question")}), lambda p: (p[1] - p[2]) ** 2)) AS dist FROM z JOIN q USING (doc_id))
    SELECT doc_id, field, 'c' || n AS id, sha256(c) AS text_sha256, round(sqrt(dist), 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY dist, n) = 1""")
def field_evidence(spark, d):
    """For each field of a record about a document the piece of the document that is nearest to the field's question."""
    docs = t(spark, d, "documents").select("doc_id", "text", "source", "lang", F.col("n_chars").cast("string").alias("n_chars"), F.lit(None).cast("string").alias("note"))
    found = evidence.best_pieces(evidence.questions_of(docs, EVIDENCE, ["doc_id"]), evidence.pieces_of(docs, ["doc_id"]), _letter_counts, ["doc_id"])
    return found.select("doc_id", "field", "id", F.sha2("text", 256).alias("text_sha256"), F.round("distance", 6).alias("distance"))


KINDS = {"identity": ("password", "token", "@"), "legal": ("license", "licensed"), "table": (" | ",)}


@query("""SELECT doc_id, CASE WHEN contains(t, 'password') OR contains(t, 'token') OR contains(t, '@') THEN 'identity' WHEN contains(t, 'license') OR contains(t, 'licensed') THEN 'legal' WHEN contains(t, ' | ') THEN 'table' ELSE 'prose' END AS kind,
    CASE WHEN contains(t, 'license') THEN 'LEGAL_NOTE' WHEN contains(t, 'und') THEN 'GERMAN_TEXT' END AS document_type FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def classify_documents(spark, d):
    c = F.col("text")
    kinds = text.document_type(c, ["LEGAL_NOTE", "GERMAN_TEXT"], ((("license",), ("legal",)), (("und",), ("german",))))
    return t(spark, d, "documents").select("doc_id", text.classify(c, KINDS, "prose").alias("kind"), kinds.alias("document_type"))


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), y AS (SELECT doc_id, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n,
    length(regexp_replace(t, '[\p{L}\p{N}\s]', '', 'g')) AS s, len(regexp_extract_all(t, '[A-Za-z0-9ÁÉÍÓÚÜÑáéíóúüñ]{2,}')) AS w FROM x), z AS (SELECT *, l * 1.6::DOUBLE + n * 0.7::DOUBLE + w * 7.5::DOUBLE - s * 2.0::DOUBLE AS sc FROM y)
    SELECT doc_id, round(sc, 4) AS score, w >= 4 AND sc >= 35 AS meaningful, w >= 3 AND l + n >= 12 AS extractable FROM z""")
def text_signal_score(spark, d):
    score, meaningful, extractable = text.signal_of_counts()
    counted = text.signal_counts(t(spark, d, "documents").select("doc_id", "text"), "text")
    return counted.select("doc_id", F.round(score, 4).alias("score"), meaningful.alias("meaningful"), extractable.alias("extractable"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b')) AS n_email, sha256(regexp_replace(text, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g')) AS redacted_sha256 FROM documents""")
def redact_emails_ascii(spark, d):
    """E-mail addresses alone, of all documents; redact_pii_counts has all kinds."""
    docs = t(spark, d, "documents")
    _, found = text.redact(F.col("text"))
    email = text.PII[0]
    return docs.select("doc_id", F.size(F.filter(found, lambda x: x["kind"] == "email")).cast("long").alias("n_email"), F.sha2(F.regexp_replace("text", email[1], email[2]), 256).alias("redacted_sha256"))


@query()
def redact_pii_counts(spark, d):
    out, found = text.redact(F.col("text"))
    rows = t(spark, d, "documents").select("doc_id", out.alias("redacted"), found.alias("found"))
    return rows.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), *[F.size(F.filter(F.transform("found", lambda x: x["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k, _, _ in text.PII])


@query(r"""WITH x AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), y AS (SELECT doc_id, i, regexp_replace(substr(t, i * 1000 + 1, 1200), '^\s+|\s+$', '', 'g') AS c FROM x, LATERAL unnest(range(0, greatest(ceil((length(t) - 1200) / 1000.0)::INT, 0) + 1)) AS u(i)),
    z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, c FROM y WHERE c != '') SELECT doc_id, 'c' || n AS id, length(c) AS n_chars, sha256(c) AS text_sha256 FROM z""")
def chunk_documents(spark, d):
    return retrieve.chunk_table(t(spark, d, "documents")).select("doc_id", "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query(r"""SELECT x.k AS text_sha256, min(doc_id) AS first_doc, count(*) AS n FROM (SELECT doc_id, sha256(replace(translate(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 'ſς', 'sσ'), 'ß', 'ss')) AS k FROM documents) x GROUP BY 1 HAVING count(*) > 1""")
def compare_normalized_text(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.sha2(text.for_compare(F.col("text")), 256).alias("text_sha256"))
    return rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


NEAR_SQL = """WITH p AS (SELECT q.vec_id AS query_id, r.vec_id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS dist FROM embeddings q JOIN embeddings r ON q.vec_id != r.vec_id WHERE q.vec_id % 20 = 0),
    n AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank, vec_id, dist FROM p QUALIFY rank <= 5)"""


def _near(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieve.nearest(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 5)


@query(f"{NEAR_SQL} SELECT query_id, rank::INT AS rank, vec_id AS id, round(dist, 6) AS distance FROM n")
def nearest_neighbours(spark, d):
    return _near(spark, d).withColumn("distance", F.round("distance", 6))


@query(f"{NEAR_SQL} SELECT query_id, label, count(*) AS votes FROM n JOIN embeddings USING (vec_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) = 1")
def knn_label_vote(spark, d):
    labels = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return retrieve.label_vote(_near(spark, d), labels)


@query(r"""SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, 'AKIA[A-Z0-9]{16}'))[1] AS access_key, nullif(regexp_extract(text, '(?i)version ([0-9]+)', 1), '') AS version FROM documents""")
def pattern_token_extract(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", text.pattern_value(c, "^AKIA[A-Z0-9]{16}$").alias("access_key"), text.pattern_value(c, "version ([0-9]+)").alias("version"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS en, round(l_extendedprice, 2) AS es, round(l_quantity, 2) AS plain FROM lineitem")
def parse_numbers(spark, d):
    li = t(spark, d, "lineitem")
    en, es = F.format_number("l_extendedprice", 2), F.concat(text.money_es(F.col("l_extendedprice")), F.lit(" EUR"))
    return li.select("l_orderkey", "l_linenumber", F.round(numbers.parse_number(en), 2).alias("en"), F.round(numbers.parse_number(es), 2).alias("es"), F.round(numbers.parse_number(F.col("l_quantity").cast("string")), 2).alias("plain"))


@query("""SELECT o_orderkey, round(CASE WHEN r = 0 THEN o_totalprice / n ELSE o_totalprice * r / (1 - power(1 + r, -n)) END, 3) AS payment FROM (SELECT *, (o_orderkey % 8)::DOUBLE / 100.0::DOUBLE / 12.0::DOUBLE AS r, (o_custkey % 300 + 12)::DOUBLE AS n FROM orders)""")
def loan_payment(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", F.round(numbers.monthly_payment(F.col("o_totalprice"), (F.col("o_orderkey") % 8).cast("double"), (F.col("o_custkey") % 300 + 12).cast("double")), 3).alias("payment"))


@query("""SELECT p_partkey, list_sort(list_distinct([p_size::DOUBLE, p_size / 10, round(p_size * 10.0, 4), p_size / 100, p_size * 100.0, p_size / 1000, p_size * 1000.0, p_size / 10000, p_size * 10000.0])) [1] AS least, len(list_distinct([p_size::DOUBLE, p_size / 10, p_size * 10.0, p_size / 100, p_size * 100.0, p_size / 1000, p_size * 1000.0, p_size / 10000, p_size * 10000.0])) AS n,
    CASE WHEN p_size <= 20 THEN p_size::DOUBLE ELSE p_size / 10 END AS rescaled FROM part""")
def rescale_candidates(spark, d):
    size = F.col("p_size").cast("double")
    found = numbers.scaled_candidates(F.array(size))
    fixed = numbers.rescaled(size, size, F.lit(None).cast("string"), F.lit(0.0), F.lit(20.0))
    return t(spark, d, "part").select("p_partkey", F.array_min(F.transform(found, lambda x: x["value"])).alias("least"), F.size(found).cast("long").alias("n"), fixed.alias("rescaled"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN e <= 1.25 THEN r END AS rate FROM (SELECT *, list_sort([{'e': abs(l_tax * 100 - 0), 'i': 0, 'r': 0}, {'e': abs(l_tax * 100 - 4), 'i': 1, 'r': 4}, {'e': abs(l_tax * 100 - 10), 'i': 2, 'r': 10}])[1] AS b FROM lineitem), LATERAL (SELECT b.e AS e, b.r AS r)""".replace("abs(l_tax * 100 - ", "abs(l_tax * l_extendedprice / l_extendedprice * 100.0 - "))
def vat_inference(spark, d):
    base = F.col("l_extendedprice")
    rate = numbers.inferred_rate(base, F.col("l_tax") * base, F.lit(None).cast("double"), F.lit(None).cast("double"), (0, 4, 10))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rate.cast("int").alias("rate"))


@query("""SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-06-01') / 365.25 >= 3 AS older, o_orderdate::DATE <= DATE '1996-12-31' AS before, year(o_orderdate) = 1995 AS in_1995 FROM orders""")
def date_rules(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("placed"), F.lit("1996-12-31").alias("edge"))
    context = with_today(columns_context(o), AS_OF)
    rules = {"older": "(fecha_actual - placed).days / 365.25 >= 3", "before": "placed <= edge", "in_1995": "placed.year == 1995"}
    return o.select("o_orderkey", *[compile_rule(e, context).alias(n) for n, e in rules.items()])


@query("""SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-06-01') AS days, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def parse_dates(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("said"))
    day = dates.parse_date(F.col("said"))
    return o.select("o_orderkey", F.datediff(F.lit(AS_OF), day).cast("long").alias("days"), F.date_format(day, "yyyy-MM-dd").alias("iso"))


@query("""SELECT r_name AS schema_name, n_name AS variant, s.seg AS case_name, r_name || '-' || n_name || '-' || s.seg AS case_id, row_number() OVER (ORDER BY r_name, n_name, s.seg) AS sequence FROM region CROSS JOIN nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) s""")
def manifest_grid(spark, d):
    a = t(spark, d, "region").select(F.col("r_name").alias("schema_name"))
    b = t(spark, d, "nation").select(F.col("n_name").alias("variant"))
    c = t(spark, d, "customer").select(F.col("c_mktsegment").alias("case_name")).distinct()
    return experiments.grid(a, b, c)


@query("""SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' WHEN b.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b USING (doc_id)""")
def paired_unpaired(spark, d):
    return stats.pairing(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT c_mktsegment AS option FROM customer UNION SELECT o_orderpriority FROM orders")
def options_distinct(spark, d):
    return stats.distinct_options("option", t(spark, d, "customer").select(F.col("c_mktsegment").alias("option")), t(spark, d, "orders").select(F.col("o_orderpriority").alias("option")))


@query("SELECT k.s AS o_orderstatus, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X'), ('Y')) k(s) LEFT JOIN orders o ON o.o_orderstatus = k.s GROUP BY 1")
def status_histogram_zero_filled(spark, d):
    return stats.histogram(t(spark, d, "orders").select("o_orderstatus"), "o_orderstatus", ["F", "O", "P", "X", "Y"])


@query("SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, d):
    e = t(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY p, o_orderkey) AS place FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END AS p FROM orders) ORDER BY p, o_orderkey LIMIT 50""")
def priority_sort_limit(spark, d):
    p = stats.priority(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    rows = t(spark, d, "orders").select("o_orderkey", p.alias("p")).orderBy("p", "o_orderkey").limit(50)
    return rows.agg(F.array_sort(F.collect_list(F.struct("p", "o_orderkey"))).alias("x")).select(F.posexplode("x").alias("i", "r")).select("r.o_orderkey", (F.col("i") + 1).cast("long").alias("place"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 20) AS n_valid, round(avg(value), 4) AS avg_value FROM events GROUP BY 1""")
def stream_log_groups(spark, d):
    """The log groups as a stream: the events file is read as a stream and aggregated to the end."""
    return logs.group_once(spark, f"{d}", "events.parquet", "event_type", "value", 20.0)


@query("""WITH r AS (SELECT doc_id, u.* FROM labels, LATERAL (VALUES ('a', quality = 1), ('b', CASE WHEN toxic = 0 THEN true END)) AS u(rule_id, h)), x AS (SELECT doc_id % 4 AS grp, count(*) AS rules_total, count(h) AS rules_pred_evaluable, count(*) FILTER (h = (doc_id % 2 = 0)) AS rules_matches FROM r GROUP BY 1)
    SELECT grp, rules_total::BIGINT AS rules_total, rules_total::BIGINT AS rules_gt_evaluable, rules_pred_evaluable::BIGINT AS rules_pred_evaluable, rules_matches::BIGINT AS rules_matches, round(rules_matches / rules_pred_evaluable, 6) AS micro_rules_accuracy, round(rules_pred_evaluable / rules_total, 6) AS micro_rules_coverage FROM x""")
def micro_rule_metrics(spark, d):
    labels = t(spark, d, "labels")
    p = labels.select("doc_id", _unfold(["rule_id", "holds"], ("a", F.col("quality") == 1), ("b", F.when(F.col("toxic") == 0, True))))
    g = labels.select("doc_id", _unfold(["rule_id", "holds"], ("a", F.col("doc_id") % 2 == 0), ("b", F.col("doc_id") % 2 == 0)))
    m = metrics.micro_rules(metrics.rule_metrics(p, g, ["doc_id"]).withColumn("grp", F.col("doc_id") % 4), ["grp"])
    return m.withColumns({c: F.round(c, 6) for c in ("micro_rules_accuracy", "micro_rules_coverage")})


@query("""WITH r AS (SELECT l_returnflag AS mode, l_orderkey, s.seed, (l_linenumber + s.seed) % 3 AS tp, l_linenumber % 2 AS fp, (l_linenumber + 1) % 2 AS fn, (l_linenumber + s.seed) % 4 = 0 AS ok, l_discount AS acc FROM lineitem, (VALUES (0), (1), (2)) s(seed)),
    a AS (SELECT mode, count(*) AS rows, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) FILTER (ok) AS good, avg(acc) AS acc FROM r GROUP BY 1)
    SELECT mode, rows, tp, fp, fn, rows // 3 AS unique_documents, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(good / 3, 6) AS perfect_mean, round(good / 3 / (rows // 3) * 100, 6) AS emr_pct, round(acc, 6) AS rules_accuracy FROM a""")
def recalculated_by_mode(spark, d):
    li = t(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_discount", F.explode(F.array(*map(F.lit, range(3)))).alias("seed"))
    n, s = F.col("l_linenumber").cast("long"), F.col("seed")
    rows = li.select(F.col("l_returnflag").alias("mode"), "seed", ((n + s) % 3).alias("tp"), (n % 2).alias("fp"), ((n + 1) % 2).alias("fn"), ((n + s) % 4 == 0).alias("document_correct"), F.col("l_discount").alias("rules_accuracy"))
    r = metrics.recalculated(rows, ["mode"])
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "perfect_mean", "emr_pct", "rules_accuracy")})


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS f_ratio, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS p_ratio FROM orders GROUP BY 1""")
def state_ratios_by_customer(spark, d):
    r = stats.state_ratios(t(spark, d, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", ["F", "P"])
    return r.withColumns({c: F.round(c, 6) for c in ("f_ratio", "p_ratio")})


@query(f"""WITH {TG_SQL} SELECT field, count(*) FILTER (NOT eq) AS errors, count(*) AS checked, round(count(*) FILTER (NOT eq) / count(*), 6) AS error_rate FROM c GROUP BY 1 HAVING count(*) FILTER (NOT eq) > 0 ORDER BY errors DESC, field LIMIT 2""")
def top_error_fields(spark, d):
    truth, guess = _truth_and_guess(spark, d)
    return metrics.top_errors(metrics.error_counts(metrics.compare_by_truth(guess, truth, ["doc_id"])), 2).withColumn("error_rate", F.round("error_rate", 6))


NAMES_SQL = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'A/caso_uso_1_auditoria_hipotecaria/x_NATIVE_pdf_' WHEN 1 THEN 'caso_uso_2_auditoria_fiscal_b/scanned_blurry_pdf' WHEN 2 THEN 'z/caso_uso_3_kyc_onboarding/y/image_photo' WHEN 3 THEN 'q/image_handwritten' ELSE 'plain/' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.pdf' ELSE '.txt' END AS path FROM documents"""


@query(f"""SELECT doc_id, CASE WHEN contains(p, 'scanned_blurry_pdf') THEN 'scanned_blurry_pdf' WHEN contains(p, 'native_pdf') THEN 'native_pdf' WHEN contains(p, 'image_photo') THEN 'image_photo' WHEN contains(p, 'image_handwritten') THEN 'image_handwritten' WHEN p LIKE '%.png' THEN 'image' WHEN p LIKE '%.pdf' THEN 'pdf' ELSE 'unknown' END AS kind,
    CASE WHEN contains(path, 'caso_uso_1_auditoria_hipotecaria') THEN 'credito_hipotecario' WHEN contains(path, 'caso_uso_2_auditoria_fiscal') THEN 'auditoria_fiscal' WHEN contains(path, 'caso_uso_3_kyc_onboarding') THEN 'kyc_onboarding' END AS schema_name FROM (SELECT *, lower(path) AS p FROM ({NAMES_SQL}))""")
def kinds_of_names(spark, d):
    i = F.col("doc_id")
    head = F.when(i % 7 == 0, "A/caso_uso_1_auditoria_hipotecaria/x_NATIVE_pdf_").when(i % 7 == 1, "caso_uso_2_auditoria_fiscal_b/scanned_blurry_pdf").when(i % 7 == 2, "z/caso_uso_3_kyc_onboarding/y/image_photo").when(i % 7 == 3, "q/image_handwritten").otherwise("plain/")
    path = F.concat(head, i.cast("string"), F.when(i % 4 == 0, ".PNG").when(i % 4 == 1, ".pdf").otherwise(".txt"))
    return t(spark, d, "documents").select("doc_id", text.kind_of_name(path).alias("kind"), text.schema_of_path(path).alias("schema_name"))


@query("""SELECT event_id, rule_id, holds FROM events, LATERAL (VALUES ('R1', CASE WHEN event_id % 5 != 0 THEN value > 20 END), ('a > b', event_type = 'click')) AS u(rule_id, holds) WHERE event_id % 6 != 5""")
def report_rule_outcomes(spark, d):
    said = F.when(F.col("event_id") % 5 == 0, F.lit('"yes"')).otherwise((F.col("value") > 20).cast("string"))
    rules = F.format_string('[{"id": " R1 ", "cumple": %s}, 7, {"expresion": "a > b", "cumple": %s}]', said, (F.col("event_type") == "click").cast("string"))
    report = F.when(F.col("event_id") % 6 == 5, F.lit('{"json": {"decision_rules": 3}, "decision_rules": [{"id": "x"}]}')).when(F.col("event_id") % 2 == 0, F.format_string('{"json": {"decision_rules": %s}}', rules)).otherwise(F.format_string('{"decision_rules": %s}', rules))
    return metrics.rule_outcomes(t(spark, d, "events").select("event_id", report.alias("report")), ["event_id"])


def _signal_sql(source: str, column: str = "text") -> str:
    """CTEs x, y and z: z has the source's columns, sc (its signal) and w (its words)."""
    return rf"""x AS (SELECT *, trim(regexp_replace(coalesce({column}, ''), '\s+', ' ', 'g')) AS _t FROM {source}), y AS (SELECT *, length(regexp_replace(_t, '[^\p{{L}}]', '', 'g')) AS l, length(regexp_replace(_t, '[^0-9]', '', 'g')) AS n,
    length(regexp_replace(_t, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS s, len(regexp_extract_all(_t, '[A-Za-z0-9ÁÉÍÓÚÜÑáéíóúüñ]{{2,}}')) AS w FROM x), z AS (SELECT *, l * 1.6::DOUBLE + n * 0.7::DOUBLE + w * 7.5::DOUBLE - s * 2.0::DOUBLE AS sc FROM y)"""


@query(f"""WITH {_signal_sql("documents")}, r AS (SELECT doc_id // 4 AS page, text, sc + (doc_id % 5) * 0.25::DOUBLE * 40 AS sc, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY sc + (doc_id % 5) * 0.25::DOUBLE * 40 DESC, doc_id) AS k FROM z)
    SELECT page, round(sc, 4) AS score, sha256(CASE WHEN sc > 0 THEN coalesce(text, '') ELSE '' END) AS text_sha256 FROM r WHERE k = 1""")
def best_readings(spark, d):
    docs = t(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("page"), F.col("doc_id").alias("candidate"), "text", F.array(F.col("doc_id") % 5 * F.lit(0.25)).alias("confidences"))
    return readings.best_reading(docs, ["page"]).select("page", F.round("score", 4).alias("score"), F.sha2("text", 256).alias("text_sha256"))


@query(r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n_lines, CASE event_id % 3 WHEN 0 THEN event_type || chr(10) || 'b' WHEN 1 THEN 'x' || event_type || chr(10) || 'plain' || chr(10) || 'c' ELSE '' END AS text, CASE event_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.75 ELSE 0 END::DOUBLE AS scores FROM events""")
def reader_lines(spark, d):
    kind = F.col("event_type")
    listed = F.format_string('{"rec_texts": ["%s", " ", null, "b"], "rec_scores": [1, 1, 1, 0.5]}', kind)
    boxed = F.format_string('[[[[0, 0], ["x%s", 0.5]], [[0, 0], " plain "], [[1]], [[0], 7], [[0], ["", 0.9]]], {"rec_texts": ["c"], "rec_scores": [0.25]}, 3]', kind)
    output = F.when(F.col("event_id") % 3 == 0, listed).when(F.col("event_id") % 3 == 1, boxed).otherwise("no json")
    e = t(spark, d, "events").select("event_id", "event_type").withColumn("lines", readings.lines_of(output))
    said, scores = readings.reading_of(F.col("lines"))
    return e.select("event_id", F.size("lines").cast("long").alias("n_lines"), said.alias("text"), F.aggregate(scores, F.lit(0.0), lambda a, x: a + x).alias("scores"))


@query("""SELECT doc_id // 3 AS page, doc_id % 3 AS position, strlen(text) AS n_bytes FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY strlen(text) DESC, doc_id) AS k FROM documents WHERE strlen(text) > 0) WHERE k = 1""")
def largest_page_images(spark, d):
    images = t(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("page"), (F.col("doc_id") % 3).alias("position"), F.encode("text", "UTF-8").alias("content"))
    return readings.largest_images(images, ["page"]).select("page", "position", F.octet_length("content").cast("long").alias("n_bytes"))


@query(f"""WITH p AS (SELECT doc_id // 4 AS doc, doc_id % 4 AS page, doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(coalesce(text, ''), 1, 20) ELSE coalesce(text, '') END AS ocr FROM documents), {_signal_sql("p", "ocr")},
    q AS (SELECT doc, page, w < 4 OR sc < 35 AS back, CASE WHEN w >= 4 AND sc >= 35 THEN ocr WHEN doc_id % 7 = 0 THEN '' ELSE 'seen ' || doc_id END AS said FROM z),
    d AS (SELECT doc, count(*) AS n_images, bool_or(back) AS back, string_agg(said, chr(10) || chr(10) ORDER BY page) FILTER (said != '') AS said FROM q GROUP BY 1)
    SELECT doc, 4::BIGINT AS n_pages, n_images, CASE WHEN NOT back THEN 'easyocr' WHEN said IS NULL THEN 'vision' ELSE 'easyocr+vision' END AS method, sha256(coalesce(regexp_replace(said, '^\\s+|\\s+$', '', 'g'), '')) AS text_sha256 FROM d
    UNION ALL SELECT -1, 4, 0, 'vision', sha256('')""")
def scanned_document_texts(spark, d):
    i = F.col("doc_id")
    whole = F.coalesce("text", F.lit(""))
    pages = t(spark, d, "documents").select(F.floor(i / 4).alias("doc"), (i % 4).alias("page"), "doc_id", F.when(i % 3 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("ocr"))
    read = readings.page_texts(pages, second=lambda p: p.withColumn("seen", F.when(i % 7 != 0, F.format_string(" seen %d ", i))))
    docs = pages.select("doc").distinct().union(spark.range(-1, 0)).withColumn("n_pages", F.lit(4).cast("long"))
    return readings.document_texts(docs, read, "doc", readings.DEFAULT_READER).select("doc", "n_pages", "n_images", "method", F.sha2("text", 256).alias("text_sha256"))


def _with_backends(rows: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    backend = F.when(i % 3 == 0, "llm").when(i % 3 == 1, "heuristic").otherwise("none")
    return rows.withColumns({"extractor_backend": backend, "llm_returned_empty": i % 5 == 0, "rules_total": F.lit(4), "rules_pred_evaluable": i % 4, "rules_matches": F.floor(i % 4 / 2), "rules_accuracy": i % 4 / 4.0, "rules_coverage": F.when(i % 6 > 0, 0.5)})


@query(f"""WITH {EV_SQL} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'overall' END AS grouping, lang AS key, count(*) AS runs, count(*) FILTER (doc_id % 3 = 0) AS runs_llm, count(*) FILTER (doc_id % 3 = 1) AS runs_heuristic, count(*) FILTER (doc_id % 5 = 0) AS llm_returned_empty_count,
    round(avg(doc_id % 4 / 4.0), 6) AS avg_rules_accuracy, round(avg(CASE WHEN doc_id % 6 > 0 THEN 0.5 ELSE 0 END), 6) AS avg_rules_coverage FROM v GROUP BY GROUPING SETS ((), (lang))""")
def backend_summary(spark, d):
    s = metrics.summarize(_with_backends(_evaluated(spark, d)), ["lang"], metrics.backend_figures())
    return s.select("grouping", "key", "runs", "runs_llm", "runs_heuristic", "llm_returned_empty_count", F.round("avg_rules_accuracy", 6).alias("avg_rules_accuracy"), F.round("avg_rules_coverage", 6).alias("avg_rules_coverage"))


@query(f"""WITH {EV_SQL}, b AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'heuristic' ELSE 'none' END AS extractor_backend, doc_id % 4 AS pe, doc_id % 4 // 2 AS ma FROM v)
    SELECT lang, extractor_backend, count(*) AS runs, round(coalesce(sum(exact_matches) / nullif(sum(fields_pred_present), 0), 0), 6) AS micro_precision, round(sum(exact_matches) / sum(fields_gt_present), 6) AS micro_recall, round(2.0 * sum(exact_matches) / (sum(fields_pred_present) + sum(fields_gt_present)), 6) AS micro_f1,
    round(coalesce(sum(ma) / nullif(sum(pe), 0), 0), 6) AS micro_rules_accuracy, round(sum(pe) / (4 * count(*)), 6) AS micro_rules_coverage, round(avg(latency_s), 6) AS avg_latency_s, round(count(*) FILTER (document_correct) / count(*), 6) AS document_exact_match FROM b GROUP BY 1, 2""")
def reader_benchmark(spark, d):
    m = metrics.reader_matrix(_with_backends(_evaluated(spark, d)), "lang", "extractor_backend")
    return m.withColumns({c: F.round(c, 6) for c in ("micro_precision", "micro_recall", "micro_f1", "micro_rules_accuracy", "micro_rules_coverage", "avg_latency_s", "document_exact_match")})


@query(f"""WITH {EV_SQL} SELECT coalesce(nullif(source, ''), 'desconocido') AS source, count(*) AS n, count(*) FILTER (document_correct) AS n_exact, round(count(*) FILTER (document_correct) / count(*), 4) AS exact_match_rate, round(avg(f1), 4) AS avg_f1, round(avg(r), 4) AS avg_match_rate, sum(fields_total)::BIGINT AS fields_total, sum(exact_matches)::BIGINT AS fields_matched FROM v GROUP BY 1""")
def evaluation_by_source(spark, d):
    rows = _evaluated(spark, d).withColumns({"exact_match": F.col("document_correct"), "fields_matched": F.col("exact_matches")})
    return metrics.evaluation_groups(rows, "source")


@query("""WITH c AS (SELECT o_orderkey AS case_index, CASE o_orderkey % 3 WHEN 0 THEN 'credito_hipotecario' WHEN 1 THEN 'auditoria_fiscal' ELSE 'kyc_onboarding' END AS s, CASE o_orderkey % 3 WHEN 0 THEN 'Hipotecario' WHEN 1 THEN 'Auditoria fiscal' ELSE 'KYC / onboarding' END AS lab,
    CASE o_custkey % 4 WHEN 0 THEN 'native_pdf' WHEN 1 THEN 'scanned_blurry_pdf' WHEN 2 THEN 'image_photo' ELSE 'image_handwritten' END AS v, CASE WHEN o_custkey % 4 < 2 THEN '.pdf' ELSE '.png' END AS x, CASE WHEN o_orderstatus = 'F' THEN 'conforme' ELSE 'no_conforme' END AS k, o_orderpriority[1]::INT <= 2 AS ready FROM orders)
    SELECT case_index, s || '_' || v || '_' || k || '_' || lpad(case_index::VARCHAR, greatest(3, length(case_index::VARCHAR))::INT, '0') AS id, lab || ' - ' || v || ' - ' || k || ' - ' || lpad(case_index::VARCHAR, greatest(3, length(case_index::VARCHAR))::INT, '0') AS name,
    CASE WHEN ready THEN 'data/o' || case_index || '.pdf' ELSE 'test_data/experimentos_120/' || s || '/' || v || '/' || k || '/o' || case_index || '_' || v || '_' || k || x END AS file_path, CASE WHEN ready AND k = 'conforme' THEN 'ready' ELSE 'pending_adjustment' END AS ground_truth_status,
    CASE WHEN ready THEN 'ready' ELSE 'pending_generation' END AS acquisition_status, CASE s WHEN 'auditoria_fiscal' THEN 4 ELSE 5 END::BIGINT AS n_norms, CASE WHEN k = 'conforme' THEN 0 ELSE 3 END::BIGINT AS n_breaks, CASE WHEN ready THEN 0 ELSE CASE v WHEN 'scanned_blurry_pdf' THEN 3 WHEN 'native_pdf' THEN 1 ELSE 2 END END::BIGINT AS n_notes FROM c""")
def manifest_case_entries(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    cases = t(spark, d, "orders").select(
        k.alias("case_index"), of(("credito_hipotecario", "auditoria_fiscal", "kyc_onboarding"), k % 3).alias("schema_name"), of(("native_pdf", "scanned_blurry_pdf", "image_photo", "image_handwritten"), c % 4).alias("variant"),
        of((".pdf", ".pdf", ".png", ".png"), c % 4).alias("extension"), F.when(F.col("o_orderstatus") == "F", "conforme").otherwise("no_conforme").alias("compliance"), F.format_string("data/o%d.pdf", k).alias("source_pdf_path"), (F.substring("o_orderpriority", 1, 1).cast("int") <= 2).alias("ready"),
    )
    e = experiments.case_entries(cases)
    number = F.regexp_extract("source_pdf_path", r"o(\d+)\.pdf", 1).cast("long")
    return e.select(number.alias("case_index"), "id", "name", "file_path", "ground_truth_status", "acquisition_status", *[F.size(a).cast("long").alias(b) for a, b in (("legal_basis", "n_norms"), ("rule_break_plan", "n_breaks"), ("generation_notes", "n_notes"))])


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'samples/caso_uso_1_auditoria_hipotecaria/ground_truth_esp_' || doc_id || '.json' WHEN doc_id % 4 = 1 THEN 'high/a/f' || doc_id || '.json' ELSE 'samples/z/f' || doc_id || '_ground_truth.json' END AS truth_path FROM documents WHERE doc_id % 4 != 3""")
def truths_of_logs(spark, d):
    i = F.col("doc_id")
    docs = t(spark, d, "documents").select("doc_id", F.when(i % 4 == 0, F.format_string("x/contrato_hipoteca_esp_%d.pdf", i)).otherwise(F.format_string("f%d.png", i)).alias("file_name"))
    path = lambda form, root: F.struct(F.format_string(form, i).alias("path"), F.lit(root).alias("root"))
    of_contract = F.array(path("base/contrato_hipoteca_esp_%d.json", 2), path("samples/caso_uso_1_auditoria_hipotecaria/ground_truth_esp_%d.json", 0))
    of_file = F.array(path("samples/z/f%d_ground_truth.json", 0), path("base/b/f%d_ground_truth.json", 2))
    truths = docs.where(i % 4 != 3).select(F.inline(F.when(i % 4 == 0, of_contract).when(i % 4 == 1, F.concat(of_file, F.array(path("high/b/f%d.json", 1), path("high/a/f%d.json", 1), path("base/f%d.json", 2)))).otherwise(of_file)))
    return experiments.found_truths(docs, truths, "doc_id")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 4 THEN '7' ELSE NULL END AS a, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 0 END::BIGINT AS n_fields, CASE event_id % 5 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS n_details FROM events""")
def coerced_payloads(spark, d):
    e, kind = F.col("event_id") % 5, F.col("event_type")
    payload = F.when(e == 0, F.format_string('{"fields": {"a": "%s", "b": null}, "details": {"a": {"confidence": 1}}}', kind)).when(e == 1, F.format_string('{"a": "%s"}', kind))
    payload = payload.when(e == 2, "[1]").when(e == 3, '{"fields": null, "details": {}}').otherwise('{"fields": 3, "a": 7}')
    p = t(spark, d, "events").select("event_id", repair.coerced_payload(payload).alias("p"))
    return p.select("event_id", F.col("p.fields")["a"].alias("a"), F.size("p.fields").cast("long").alias("n_fields"), F.size("p.details").cast("long").alias("n_details"))
