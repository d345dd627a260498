"""Queries over labelled flow tables: cleaning, features, labels, profiles, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..contract import (CLASS_GROUPING, DERIVED_FEATURES, EPS, FEATURE_ENG_VERSION,
                        FLAG_NUMBER_COLUMNS, GROUPED_CLASSES, HIGH_FREQUENCY_RATE,
                        MODEL_FEATURES, PREVIEW_ROWS, PROTOCOL_MIX_COLUMNS, all_feature_names)
from ..functions import features as fe
from ..operators import labels, profile
from .registry import r, register, sql_ts_text, sr

q = fx.q_sql
FLOW_NUMERIC = [n for n, _ in fx.FLOW_NUMERIC]
RAW = sorted(n for n in FLOW_NUMERIC if n != "file_id")          # the 37 model features
VECTOR = all_feature_names(RAW)
DROPPED = ["HTTP", "syn_count", "Rate", "Number"]               # for the defaults variant


# -- SQL twins of the feature functions --------------------------------------

def sql_clean(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NULL OR isnan({e}) OR isinf({e}) THEN 0.0 ELSE cast(({e}) AS double) END)"


def sql_derived(present: set[str]) -> dict[str, str]:
    g = lambda n: f"cast({q(n)} AS double)" if n in present else "0.0"
    ratio = lambda a, b: f"({g(a)} / ({g(b)} + {EPS!r}))"
    return {
        "syn_to_fin_ratio": ratio("syn_count", "fin_count"),
        "ack_to_syn_ratio": ratio("ack_count", "syn_count"),
        "rst_ratio": ratio("rst_count", "Number"),
        "size_variance_ratio": ratio("Variance", "AVG"),
        "size_range": f"({g('Max')} - {g('Min')})",
        "pkts_per_second": g("Rate"),
        "bytes_per_packet": ratio("Tot size", "Number"),
        "flag_diversity": "(" + " + ".join(g(n) for n in FLAG_NUMBER_COLUMNS) + ")",
        "has_web_traffic": f"(CASE WHEN {g('HTTP')} > 0 OR {g('HTTPS')} > 0 THEN 1.0 ELSE 0.0 END)",
        "has_system_traffic": f"(CASE WHEN {g('SSH')} > 0 OR {g('Telnet')} > 0 OR {g('DNS')} > 0 "
                              "THEN 1.0 ELSE 0.0 END)",
        "protocol_mix": "(" + " + ".join(g(n) for n in PROTOCOL_MIX_COLUMNS) + ")",
        "high_frequency_flag": f"(CASE WHEN {g('Rate')} > {HIGH_FREQUENCY_RATE!r} THEN 1.0 ELSE 0.0 END)",
    }


def sql_grouped(e: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_GROUPING.items())
    return f"(CASE {e} {whens} ELSE {e} END)"


def _clean_cte(src: str, cols: list[str]) -> str:
    sel = ", ".join(f"{sql_clean(q(n))} AS {q(n)}" for n in cols)
    return f"SELECT {sel} FROM {src}"


# -- 2.2 projections and predicates ------------------------------------------

@register("clean_nonfinite", fx.with_ctes(
    "SELECT " + ", ".join([f"{sql_clean(q(n))} AS {q(n)}" for n in MODEL_FEATURES] + ["file_id", "label"])
    + " FROM flows_dirty", "flows_dirty"))
def q_clean_nonfinite(spark, sf_dir):
    df = fx.load(spark, sf_dir, "flows_dirty")
    return fe.clean_nonfinite(df, MODEL_FEATURES)


@register("downcast_numeric", fx.with_ctes(
    "SELECT " + ", ".join([f"cast({q(n)} AS FLOAT) AS {q(n)}" for n in FLOW_NUMERIC] + ["label"])
    + " FROM flows", "flows"))
def q_downcast_numeric(spark, sf_dir):
    return fe.downcast_numeric(fx.load(spark, sf_dir, "flows"))


def _derived_sql(present: set[str]) -> str:
    d = sql_derived(present)
    sel = ", ".join(f"{sr(sql_clean(d[n]))} AS {n}" for n in DERIVED_FEATURES)
    cols = sorted(present)
    return fx.with_ctes(f"SELECT {sel} FROM ({_clean_cte('flows', cols)}) AS f", "flows")


def _derived_spark(df, present):
    df = fe.clean_nonfinite(df.select(*[fe.c(n) for n in sorted(present)]), sorted(present))
    derived = df.select(*fe.derived_features(present))
    # rounding (for the oracle) in its own projection: it reads each value several
    # times, so Spark keeps the derived values computed once underneath
    return derived.select(*[r(n).alias(n) for n in DERIVED_FEATURES])


@register("derive_features", _derived_sql(set(RAW)))
def q_derive_features(spark, sf_dir):
    return _derived_spark(fx.load(spark, sf_dir, "flows"), set(RAW))


@register("derive_features_defaults", _derived_sql(set(RAW) - set(DROPPED)))
def q_derive_features_defaults(spark, sf_dir):
    df = fx.load(spark, sf_dir, "flows").drop(*DROPPED)
    return _derived_spark(df, set(RAW) - set(DROPPED))


def _vector_sql() -> str:
    d = sql_derived(set(RAW))
    exprs = {n: q(n) for n in RAW}
    exprs.update({n: sql_clean(d[n]) for n in DERIVED_FEATURES})
    parts = [f"SELECT cast({i} AS INTEGER) AS pos, '{n}' AS feature, count(*) AS n, "
             f"{sr(f'avg({exprs[n]})')} AS mean FROM cleaned" for i, n in enumerate(VECTOR)]
    body = (f"SELECT * FROM (WITH cleaned AS ({_clean_cte('flows', RAW)}) "
            + " UNION ALL ".join(parts) + ") AS v")
    return fx.with_ctes(body, "flows")


@register("feature_vector", _vector_sql())
def q_feature_vector(spark, sf_dir):
    df = fe.clean_nonfinite(fx.load(spark, sf_dir, "flows").select(*[fe.c(n) for n in RAW]), RAW)
    full = fe.add_derived_features(df)
    # the vector is assembled by name in VECTOR order; its per-position means
    # show every position holds the right feature
    vec = full.select(fe.feature_vector(VECTOR).alias("v"))
    s = vec.agg(F.count("v").alias("n"), F.array(*[F.avg(F.col("v")[i]) for i in range(len(VECTOR))]).alias("s"))
    names = F.array(*[F.lit(n) for n in VECTOR])
    per_pos = s.select("n", F.posexplode("s").alias("pos", "mean"))
    return per_pos.select(F.col("pos").cast("int").alias("pos"), F.element_at(names, F.col("pos") + 1).alias("feature"),
                          "n", r("mean").alias("mean"))


@register("feature_label_split", fx.with_ctes(
    "SELECT " + ", ".join([q(n) for n in RAW] + ["label"]) + " FROM flows", "flows"))
def q_feature_label_split(spark, sf_dir):
    return profile.feature_label_split(fx.load(spark, sf_dir, "flows"))


def _profile_sql() -> str:
    schema = T.StructType([T.StructField(n, T.StringType() if n == "label" else T.DoubleType())
                           for n, _ in fx.FLOWS_DIRTY])
    roles = profile.detect_columns(schema)
    aggs, rows = [], []
    for i, f in enumerate(schema.fields):
        n = q(f.name)
        aggs.append(f"cast(sum(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n{i}")
        nf = f"{n} IS NULL OR isnan({n}) OR isinf({n})" if f.name != "label" else f"{n} IS NULL"
        aggs.append(f"cast(sum(CASE WHEN {nf} THEN 1 ELSE 0 END) AS BIGINT) AS f{i}")
        if f.name == roles.label:
            role, pos = "label", "NULL"
        elif f.name in roles.features:
            role, pos = "feature", str(roles.features.index(f.name))
        else:
            role, pos = "ignored", "NULL"
        rows.append(f"SELECT '{f.name}' AS column_name, '{role}' AS role, cast({pos} AS INTEGER) AS position, "
                    f"n{i} AS n_null, f{i} AS n_nonfinite FROM one")
    for m in roles.missing:
        rows.append(f"SELECT '{m}', 'missing', cast(NULL AS INTEGER), cast(NULL AS BIGINT), "
                    "cast(NULL AS BIGINT) FROM one")
    body = (f"SELECT * FROM (WITH one AS (SELECT {', '.join(aggs)} FROM flows_dirty) "
            + " UNION ALL ".join(rows) + ") AS p")
    return fx.with_ctes(body, "flows_dirty")


@register("column_profile", _profile_sql())
def q_column_profile(spark, sf_dir):
    return profile.column_profile(fx.load(spark, sf_dir, "flows_dirty"))


# -- 2.3 lookups --------------------------------------------------------------

@register("group_labels", fx.with_ctes(
    f"SELECT label, {sql_grouped('label')} AS label_group FROM flows", "flows"))
def q_group_labels(spark, sf_dir):
    return labels.group_labels(fx.load(spark, sf_dir, "flows").select("label"))


_CLASS_LIST = ", ".join(f"'{c}'" for c in GROUPED_CLASSES)


@register("known_class_semi", fx.with_ctes(
    f"SELECT file_id, label_group FROM (SELECT file_id, {sql_grouped('label')} AS label_group FROM flows) AS g "
    f"WHERE label_group IN ({_CLASS_LIST})", "flows"))
def q_known_class_semi(spark, sf_dir):
    df = labels.group_labels(fx.load(spark, sf_dir, "flows").select("file_id", "label"))
    return labels.known_class_semi(df, GROUPED_CLASSES).select("file_id", "label_group")


# -- 2.4 aggregations ---------------------------------------------------------

@register("class_distribution", fx.with_ctes(
    f"SELECT class_name, n, {sr('pct')} AS pct, rank, n_other_classes FROM ("
    "SELECT class_name, n, cast(100 AS double) * n / sum(n) OVER () AS pct, "
    "row_number() OVER (ORDER BY n DESC, class_name) AS rank, "
    "0 AS n_other_classes "
    "FROM (SELECT label AS class_name, count(*) AS n FROM flows GROUP BY 1) AS c) AS x",
    "flows"))
def q_class_distribution(spark, sf_dir):
    out = labels.class_distribution(fx.load(spark, sf_dir, "flows"))
    return out.select("class_name", "n", r("pct").alias("pct"), F.col("rank").cast("long").alias("rank"),
                      "n_other_classes")


@register("balance_check", fx.with_ctes(
    "SELECT count(DISTINCT label) AS n_classes, count(DISTINCT label) >= 2 AS balanced FROM flows", "flows"))
def q_balance_check(spark, sf_dir):
    return labels.balance_check(fx.load(spark, sf_dir, "flows"))


@register("dataset_summary", fx.with_ctes(
    f"SELECT count(DISTINCT file_id) AS files, count(*) AS rows, {len(RAW) + 1} AS columns, "
    f"{len(RAW)} AS raw_features, {len(DERIVED_FEATURES)} AS derived_features, "
    f"{len(RAW) + len(DERIVED_FEATURES)} AS total_features, "
    f"count(DISTINCT {sql_grouped('label')}) AS classes, '{FEATURE_ENG_VERSION}' AS feature_eng_version "
    "FROM flows", "flows"))
def q_dataset_summary(spark, sf_dir):
    return profile.dataset_summary(fx.load(spark, sf_dir, "flows"))


@register("class_share_top5", fx.with_ctes(
    f"SELECT bucket, cast(sum(n) AS BIGINT) AS n, {sr('sum(n) / sum(sum(n)) OVER ()')} AS share FROM ("
    "SELECT CASE WHEN row_number() OVER (ORDER BY n DESC, class_name) <= 5 THEN class_name ELSE 'others' END "
    f"AS bucket, n FROM (SELECT {sql_grouped('label')} AS class_name, count(*) AS n FROM flows GROUP BY 1) AS c"
    ") AS b GROUP BY bucket", "flows"))
def q_class_share_top5(spark, sf_dir):
    df = labels.group_labels(fx.load(spark, sf_dir, "flows").select("label"))
    out = labels.class_share_top(df, "label_group", 5)
    return out.select("bucket", "n", r("share").alias("share"))


# -- 2.6 / 2.7 sorts, sets ----------------------------------------------------

@register("class_scan", fx.with_ctes(
    f"SELECT DISTINCT {sql_grouped('label')} AS class_name FROM flows WHERE label IS NOT NULL", "flows"))
def q_class_scan(spark, sf_dir):
    return labels.class_scan(fx.load(spark, sf_dir, "flows"))


@register("label_index", fx.with_ctes(
    "SELECT class_name, cast(row_number() OVER (ORDER BY class_name) - 1 AS INTEGER) AS class_index FROM "
    f"(SELECT DISTINCT {sql_grouped('label')} AS class_name FROM flows WHERE label IS NOT NULL) AS c", "flows"))
def q_label_index(spark, sf_dir):
    return labels.label_index(labels.class_scan(fx.load(spark, sf_dir, "flows")))


@register("union_files", fx.with_ctes(
    "SELECT file_id, label, Rate FROM flows WHERE file_id < 5 UNION ALL "
    "SELECT file_id, label, Rate FROM flows WHERE file_id >= 5", "flows"))
def q_union_files(spark, sf_dir):
    flows = fx.load(spark, sf_dir, "flows").select("file_id", "label", "Rate")
    return flows.where("file_id < 5").unionByName(flows.where("file_id >= 5"))


@register("preview_limit",
          f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {sql_ts_text('o_orderdate')} AS o_orderdate, "
          f"o_orderpriority FROM orders ORDER BY o_orderkey LIMIT {PREVIEW_ROWS}")
def q_preview_limit(spark, sf_dir):
    from ..sources.tables import table
    from .registry import ts_text
    orders = table(spark, sf_dir, "orders")
    top = orders.orderBy("o_orderkey").limit(PREVIEW_ROWS)
    return top.withColumn("o_orderdate", ts_text("o_orderdate"))
