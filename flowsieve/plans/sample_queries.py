"""Queries for chunking, sampling, splitting, scaling and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..contract import DERIVED_FEATURES, TUNING_FILES, TUNING_ROWS_PER_FILE
from ..functions import features as fe
from ..operators import labels, sampling, scaling
from .flow_queries import RAW, VECTOR, sql_clean, sql_derived, sql_grouped
from .registry import r, register, sr

q = fx.q_sql

# Test parameters chosen so every cap binds on the test tables.
TEST_CHUNK = 250
TEST_HEAD = 300
TEST_ROWS_PER_FILE = 300
TEST_CLASS_CAP = 500
SEED = 42


def _pick_sql(col: str, seed: int = SEED) -> str:
    return f"((({col} % 1000003) * 7919 + {seed} * 104729) % 1000003)"


def _ev():
    return fx.load


@register("chunk_assign", fx.with_ctes(
    "SELECT row_key, file_id, cast(floor((row_number() OVER (PARTITION BY file_id ORDER BY row_key) - 1) "
    f"/ {TEST_CHUNK}) AS BIGINT) AS chunk_id FROM flows_ev", "flows_ev"))
def q_chunk_assign(spark, sf_dir):
    ev = fx.load(spark, sf_dir, "flows_ev").select("row_key", "file_id")
    return sampling.chunk_assign(ev, "file_id", "row_key", TEST_CHUNK)


@register("head_per_file", fx.with_ctes(
    "SELECT * FROM (SELECT row_key, file_id, x, label, row_number() OVER (PARTITION BY file_id ORDER BY row_key) "
    f"AS rn FROM flows_ev) AS h WHERE rn <= {TEST_HEAD}", "flows_ev"))
def q_head_per_file(spark, sf_dir):
    ev = fx.load(spark, sf_dir, "flows_ev")
    return sampling.head_per_file(ev, "file_id", "row_key", TEST_HEAD)


_STRAT_CTE = (
    "strat AS (SELECT row_key, file_id, x, label_group FROM ("
    "SELECT *, row_number() OVER (PARTITION BY label_group ORDER BY file_id, row_key) AS crn FROM ("
    f"SELECT row_key, file_id, x, {sql_grouped('label')} AS label_group FROM ("
    "SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_key) AS rn FROM flows_ev) AS h "
    f"WHERE rn <= {TEST_ROWS_PER_FILE} AND label IS NOT NULL) AS g) AS c WHERE crn <= {TEST_CLASS_CAP})")


def _strat_sql(body: str) -> str:
    return fx.with_ctes("SELECT 1", "flows_ev")[:-len("\nSELECT 1")] + ",\n" + _STRAT_CTE + "\n" + body


def stratified(spark, sf_dir):
    ev = labels.group_labels(fx.load(spark, sf_dir, "flows_ev")).drop("label")
    return sampling.stratified_cap_sample(ev, "file_id", "row_key", "label_group",
                                          TEST_ROWS_PER_FILE, TEST_CLASS_CAP)


@register("stratified_cap_sample", _strat_sql("SELECT * FROM strat"))
def q_stratified_cap_sample(spark, sf_dir):
    return stratified(spark, sf_dir)


@register("holdout_split", _strat_sql(
    "SELECT row_key, file_id, label FROM flows_ev WHERE row_key NOT IN (SELECT row_key FROM strat)"))
def q_holdout_split(spark, sf_dir):
    ev = fx.load(spark, sf_dir, "flows_ev").select("row_key", "file_id", "label")
    return sampling.holdout_split(ev, stratified(spark, sf_dir), "row_key")


@register("test_set_composition", _strat_sql(
    "SELECT label_group AS class_name, count(*) AS n, sum(count(*)) OVER () AS total, "
    "count(*) OVER () AS n_classes FROM strat GROUP BY label_group"))
def q_test_set_composition(spark, sf_dir):
    counts = labels.class_counts(stratified(spark, sf_dir), "label_group")
    from pyspark.sql import Window
    w = Window.partitionBy()
    return counts.select("class_name", "n", F.sum("n").over(w).alias("total"),
                         F.count(F.lit(1)).over(w).alias("n_classes"))


@register("round_robin_order", fx.with_ctes(
    "SELECT row_key, file_id, chunk_id, cast(dense_rank() OVER (ORDER BY chunk_id, file_id) - 1 AS BIGINT) AS seq "
    "FROM (SELECT row_key, file_id, cast(floor((row_number() OVER (PARTITION BY file_id ORDER BY row_key) - 1) "
    f"/ {TEST_CHUNK}) AS BIGINT) AS chunk_id FROM flows_ev) AS c", "flows_ev"))
def q_round_robin_order(spark, sf_dir):
    ev = fx.load(spark, sf_dir, "flows_ev").select("row_key", "file_id")
    chunks = sampling.chunk_assign(ev, "file_id", "row_key", TEST_CHUNK)
    return sampling.round_robin_order(chunks, "file_id", "chunk_id")


def _hash_sql(v: str, key: str, r: str) -> str:
    """The shuffle's hash, step by step."""
    t0 = f"(({v} % 2147483647 * 48271 + {key} * 69621 + {r} * 16807 + 12345) % 2147483647)"
    t1 = f"(({t0} * 48271 + ({t0} >> 7)) % 2147483647)"
    return f"((xor({t1}, {t1} >> 13) * 69621) % 2147483647)"


def _shuffle_sql() -> str:
    """Swap-or-not, round after round, by a fold over the round numbers."""
    partner = f"(({_hash_sql('0', 'k', 'r')} % n - x) % n + n) % n"
    trade = f"CASE WHEN ({_hash_sql(f'(greatest(x, {partner}) + 1)', 'k', 'r')} >> 11) & 1 = 1 THEN {partner} ELSE x END"
    return (f"""SELECT row_key, file_id, chunk_id, list_reduce(range(24), lambda x, r: {trade}, i) + 1 AS pos
FROM (SELECT row_key, file_id, c AS chunk_id, (rn - 1) - c * {TEST_CHUNK} AS i,
        count(*) OVER (PARTITION BY file_id, c) AS n, c + {SEED} AS k
      FROM (SELECT row_key, file_id, rn, cast(floor((rn - 1) / {TEST_CHUNK}) AS BIGINT) AS c
            FROM (SELECT row_key, file_id, row_number() OVER (PARTITION BY file_id ORDER BY row_key) AS rn
                  FROM flows_ev) AS a) AS b) AS d""")


@register("chunk_shuffle", fx.with_ctes(_shuffle_sql(), "flows_ev"))
def q_chunk_shuffle(spark, sf_dir):
    """Seeded in-chunk permutation: a keyed bijection of the row's number in its chunk."""
    ev = fx.load(spark, sf_dir, "flows_ev").select("row_key", "file_id")
    return sampling.chunk_shuffle(sampling.chunk_places(ev, "file_id", "row_key", TEST_CHUNK), "chunk_id", SEED)


@register("ordered_split", fx.with_ctes(
    "SELECT row_key, CASE WHEN rn <= floor(cast(n AS double) * 0.8) THEN 'train' ELSE 'val' END AS tune_part, "
    "CASE WHEN rn <= floor(cast(n AS double) * 0.9) THEN 'test' ELSE 'calibration' END AS calib_part "
    "FROM (SELECT row_key, row_number() OVER (ORDER BY row_key) AS rn, count(*) OVER () AS n FROM flows_ev) AS s",
    "flows_ev"))
def q_ordered_split(spark, sf_dir):
    ev = fx.load(spark, sf_dir, "flows_ev").select("row_key")
    return sampling.ordered_split(ev, "row_key")


@register("tuning_sample", fx.with_ctes(
    "SELECT row_key, file_id, x, label FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_key) "
    "AS rn FROM flows_ev WHERE file_id IN (SELECT file_id FROM (SELECT DISTINCT file_id FROM flows_ev) AS d "
    f"ORDER BY {_pick_sql('file_id')}, file_id LIMIT {TUNING_FILES})) AS h WHERE rn <= {TUNING_ROWS_PER_FILE}",
    "flows_ev"))
def q_tuning_sample(spark, sf_dir):
    ev = fx.load(spark, sf_dir, "flows_ev")
    return sampling.tuning_sample(ev, "file_id", "row_key", TUNING_FILES, TUNING_ROWS_PER_FILE, SEED)


@register("file_manifest", fx.with_ctes(
    "SELECT file_id, count(*) AS n_rows, sum(count(*)) OVER () AS total_rows FROM flows GROUP BY file_id", "flows"))
def q_file_manifest(spark, sf_dir):
    return sampling.file_manifest(fx.load(spark, sf_dir, "flows"), "file_id")


# -- scaling --------------------------------------------------------------------

def _vector_exprs() -> dict[str, str]:
    d = sql_derived(set(RAW))
    ex = {n: q(n) for n in RAW}
    ex.update({n: sql_clean(d[n]) for n in DERIVED_FEATURES})
    return ex


def _cleaned_cte() -> str:
    sel = ", ".join(f"{sql_clean(q(n))} AS {q(n)}" for n in RAW)
    return f"cleaned AS (SELECT {sel}, label FROM flows)"


def _scaler_sql() -> str:
    ex = _vector_exprs()
    parts = [f"SELECT '{n}' AS feature, cast({i} AS INTEGER) AS position, count(*) AS n, "
             f"{sr(f'avg({ex[n]})')} AS mean, "
             f"{sr(f'CASE WHEN stddev_pop({ex[n]}) = 0 THEN 1.0 ELSE stddev_pop({ex[n]}) END')} AS scale "
             "FROM cleaned" for i, n in enumerate(VECTOR)]
    body = "SELECT * FROM (" + " UNION ALL ".join(parts) + ") AS s"
    return fx.with_ctes("SELECT 1", "flows")[:-len("\nSELECT 1")] + ",\n" + _cleaned_cte() + "\n" + body


def _flow_vectors(spark, sf_dir):
    flows = fx.load(spark, sf_dir, "flows")
    return fe.add_derived_features(fe.clean_nonfinite(flows.select(*[fe.c(n) for n in RAW], "label"), RAW))


@register("fit_scaler", _scaler_sql())
def q_fit_scaler(spark, sf_dir):
    stats = scaling.fit_scaler(_flow_vectors(spark, sf_dir), VECTOR)
    return stats.select("feature", "position", "n", r("mean").alias("mean"), r("scale").alias("scale"))


@register("fit_scaler_sampled", fx.with_ctes(
    f"SELECT 'x' AS feature, 0 AS position, count(*) AS n, {sr('avg(x)')} AS mean, "
    f"{sr('CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END')} AS scale FROM ("
    "SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_key) AS rn FROM flows_ev "
    "WHERE file_id IN (SELECT file_id FROM (SELECT DISTINCT file_id FROM flows_ev) AS d "
    f"ORDER BY {_pick_sql('file_id')}, file_id LIMIT 8)) AS h WHERE rn <= 50000", "flows_ev"))
def q_fit_scaler_sampled(spark, sf_dir):
    ev = fx.load(spark, sf_dir, "flows_ev")
    stats = scaling.fit_scaler_sampled(ev, "file_id", "row_key", ["x"], seed=SEED, derive=False)
    return stats.select("feature", "position", "n", r("mean").alias("mean"), r("scale").alias("scale"))


SCALED_DIGITS = 4


def _apply_sql() -> str:
    ex = _vector_exprs()
    stats = ", ".join(f"avg({ex[n]}) AS m{i}, CASE WHEN stddev_pop({ex[n]}) = 0 THEN 1.0 "
                      f"ELSE stddev_pop({ex[n]}) END AS s{i}" for i, n in enumerate(VECTOR))
    cols = ", ".join(f"{sr(f'({ex[n]} - m{i}) / s{i}', SCALED_DIGITS)} AS {q(n)}" for i, n in enumerate(VECTOR))
    body = (f"SELECT {cols}, label FROM cleaned, (SELECT {stats} FROM cleaned) AS st")
    return fx.with_ctes("SELECT 1", "flows")[:-len("\nSELECT 1")] + ",\n" + _cleaned_cte() + "\n" + body


@register("apply_scaler", _apply_sql())
def q_apply_scaler(spark, sf_dir):
    vecs = _flow_vectors(spark, sf_dir)
    params = scaling.scaler_params(scaling.fit_scaler(vecs, VECTOR))
    scaled = scaling.apply_scaler(vecs, params)
    return scaled.select(*[r(fe.c(n), SCALED_DIGITS).alias(n) for n in VECTOR], "label")


@register("balanced_weights", fx.with_ctes(
    f"SELECT f.file_id, f.label_group, {sr('w.weight')} AS weight FROM "
    f"(SELECT file_id, {sql_grouped('label')} AS label_group FROM flows) AS f JOIN "
    "(SELECT file_id, label_group, sum(nc) OVER (PARTITION BY file_id) / "
    "(count(*) OVER (PARTITION BY file_id) * nc) AS weight FROM "
    f"(SELECT file_id, {sql_grouped('label')} AS label_group, count(*) AS nc FROM flows GROUP BY 1, 2) AS c) AS w "
    "ON f.file_id = w.file_id AND f.label_group = w.label_group", "flows"))
def q_balanced_weights(spark, sf_dir):
    df = labels.group_labels(fx.load(spark, sf_dir, "flows").select("file_id", "label"))
    out = sampling.balanced_weights(df, "file_id", "label_group")
    return out.select("file_id", "label_group", r("weight").alias("weight"))
