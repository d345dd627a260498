"""Scoring queries: decision values, probabilities, softmax, soft vote, argmax.

Test models are built from the ``embeddings`` table itself: class means give
three one-vs-rest linear models (one aggregation over the table, K x 64
numbers collected), so the scoring work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import isotonic, linear
from ..operators.linear import LinearModel
from ..sources.tables import table
from .registry import r, register, sr

DIM = 64
VOTE = {"m_centroid": 1.0, "m_centered": 1.0, "m_scaled": 0.8}
LOSS = {"m_centroid": "modified_huber", "m_centered": "log_loss", "m_scaled": "modified_huber"}


def embedding_models(spark, sf_dir) -> tuple[list[LinearModel], list]:
    emb = table(spark, sf_dir, "embeddings")
    means = linear.class_means(emb, "embedding", "label", DIM)
    classes = sorted(means)
    mat = [means[c] for c in classes]
    centre = [sum(col) / len(mat) for col in zip(*mat)]
    sq = [sum(x * x for x in row) for row in mat]
    models = [
        LinearModel("m_centroid", LOSS["m_centroid"], mat, [-0.5 * s for s in sq], VOTE["m_centroid"]),
        LinearModel("m_centered", LOSS["m_centered"], [[a - b for a, b in zip(row, centre)] for row in mat],
                    [0.0] * len(mat), VOTE["m_centered"]),
        LinearModel("m_scaled", LOSS["m_scaled"], [[2.0 * a for a in row] for row in mat], [-s for s in sq],
                    VOTE["m_scaled"]),
    ]
    return models, classes


def _long(df, cols_by_model: dict, value: str):
    """Explode per-model arrays into (vec_id, model, class_index, value)."""
    parts = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("arr")) for m, c in cols_by_model.items()])
    one = df.select("vec_id", F.inline(parts))
    return one.select("vec_id", "model", F.posexplode("arr").alias("class_index", value)).select(
        "vec_id", "model", F.col("class_index").cast("int").alias("class_index"), r(value).alias(value))


def _scored(spark, sf_dir):
    models, classes = embedding_models(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    return models, classes, linear.score_frame(emb, "embedding", models, ["vec_id"])


_SQL_MODELS = f"""
ks AS (SELECT label, cast(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS k
  FROM (SELECT DISTINCT label FROM embeddings) AS d),
means AS (SELECT ks.k, t.i, avg(cast(e.embedding[t.i] AS double)) AS m
  FROM embeddings e JOIN ks ON e.label = ks.label, generate_series(1, {DIM}) AS t(i) GROUP BY ks.k, t.i),
gm AS (SELECT i, avg(m) AS g FROM means GROUP BY i),
coef AS (SELECT 'm_centroid' AS model, k, i, m AS w FROM means
  UNION ALL SELECT 'm_centered', k, means.i, m - g FROM means JOIN gm ON means.i = gm.i
  UNION ALL SELECT 'm_scaled', k, i, 2 * m FROM means),
bias AS (SELECT 'm_centroid' AS model, k, -0.5 * sum(m * m) AS b FROM means GROUP BY k
  UNION ALL SELECT 'm_centered', k, 0.0 FROM means GROUP BY k
  UNION ALL SELECT 'm_scaled', k, -sum(m * m) FROM means GROUP BY k),
scores AS (SELECT e.vec_id, c.model, c.k AS class_index,
    sum(cast(e.embedding[c.i] AS double) * c.w) + any_value(b.b) AS d
  FROM embeddings e, coef c JOIN bias b ON b.model = c.model AND b.k = c.k
  GROUP BY e.vec_id, c.model, c.k),
nk AS (SELECT count(*) AS kk FROM ks),
p0 AS (SELECT s.*, CASE WHEN model = 'm_centered' THEN 1.0 / (1.0 + exp(-d))
    ELSE (least(greatest(d, -1.0), 1.0) + 1.0) / 2.0 END AS q FROM scores s),
probs AS (SELECT vec_id, model, class_index, CASE WHEN sum(q) OVER w = 0 THEN 1.0 / (SELECT kk FROM nk)
    ELSE q / sum(q) OVER w END AS p FROM p0 WINDOW w AS (PARTITION BY vec_id, model)),
vote AS (SELECT vec_id, class_index, sum(p * CASE model WHEN 'm_scaled' THEN 0.8 ELSE 1.0 END) / 2.8 AS p
  FROM probs GROUP BY vec_id, class_index)"""


def models_sql(body: str) -> str:
    return "WITH" + _SQL_MODELS + "\n" + body


@register("score_linear", models_sql(
    f"SELECT vec_id, model, class_index, {sr('d')} AS score FROM scores"))
def q_score_linear(spark, sf_dir):
    models, _, scored = _scored(spark, sf_dir)
    return _long(scored, {m.name: F.col(f"scores_{m.name}") for m in models}, "score")


@register("class_probability", models_sql(
    f"SELECT vec_id, model, class_index, {sr('p')} AS p FROM probs"))
def q_class_probability(spark, sf_dir):
    models, classes, scored = _scored(spark, sf_dir)
    k = len(classes)
    return _long(scored, {m.name: linear.probabilities(F.col(f"scores_{m.name}"), m.loss, k) for m in models}, "p")


@register("softmax_scores", models_sql(
    f"SELECT vec_id, model, class_index, {sr('e / sum(e) OVER (PARTITION BY vec_id, model)')} AS p FROM ("
    "SELECT *, exp(d - max(d) OVER (PARTITION BY vec_id, model)) AS e FROM scores) AS x"))
def q_softmax_scores(spark, sf_dir):
    models, _, scored = _scored(spark, sf_dir)
    return _long(scored, {m.name: linear.softmax(F.col(f"scores_{m.name}")) for m in models}, "p")


@register("soft_vote", models_sql(f"SELECT vec_id, class_index, {sr('p')} AS p FROM vote"))
def q_soft_vote(spark, sf_dir):
    models, classes, scored = _scored(spark, sf_dir)
    k = len(classes)
    probs = [linear.probabilities(F.col(f"scores_{m.name}"), m.loss, k) for m in models]
    vote = linear.soft_vote(probs, [m.vote_weight for m in models], k)
    out = scored.select("vec_id", F.posexplode(vote).alias("class_index", "p"))
    return out.select("vec_id", F.col("class_index").cast("int").alias("class_index"), r("p").alias("p"))


@register("ensemble_predict", models_sql(
    "SELECT vec_id, cast(arg_max(class_index, {'p': p, 'k': -class_index}) AS INTEGER) AS class_index, "
    "'class_' || cast(arg_max(class_index, {'p': p, 'k': -class_index}) AS VARCHAR) AS label, "
    f"{sr('max(p)')} AS confidence FROM vote GROUP BY vec_id"))
def q_ensemble_predict(spark, sf_dir):
    models, classes, _ = _scored(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    names = [f"class_{c}" for c in classes]
    out = linear.predict(emb, "embedding", models, names, ["vec_id"])
    return out.select("vec_id", "class_index", "label", r("confidence").alias("confidence"))


@register("argmax_class",
          "SELECT vec_id, cast(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax, "
          f"{sr('list_max(embedding)')} AS max_value FROM embeddings")
def q_argmax_class(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", linear.argmax(F.col("embedding")).alias("argmax"),
                      r(F.array_max("embedding")).alias("max_value"))


# -- calibration -------------------------------------------------------------------

_ISOTONIC_SQL = f"""
, pc AS (SELECT p.vec_id, p.class_index, {sr('p.p')} AS p, CASE WHEN ks.k = p.class_index THEN 1.0 ELSE 0.0 END AS y
  FROM probs p JOIN embeddings e ON e.vec_id = p.vec_id JOIN ks ON ks.label = e.label WHERE p.model = 'm_centered'),
pt AS (SELECT class_index, p, sum(y) AS t, count(*) AS n, row_number() OVER (PARTITION BY class_index ORDER BY p) AS i
  FROM pc GROUP BY class_index, p),
cum AS (SELECT class_index, i, p, sum(t) OVER w AS st, sum(n) OVER w AS sn FROM pt
  WINDOW w AS (PARTITION BY class_index ORDER BY i ROWS UNBOUNDED PRECEDING)),
-- greatest over all beginnings a <= i of the least mean of a .. b over all ends b >= i
spans AS (SELECT b.class_index, a.i AS a, b.i AS b, (b.st - coalesce(z.st, 0)) / (b.sn - coalesce(z.sn, 0)) AS m
  FROM cum a JOIN cum b ON a.class_index = b.class_index AND a.i <= b.i
  LEFT JOIN cum z ON z.class_index = a.class_index AND z.i = a.i - 1),
least_end AS (SELECT class_index, a, b AS i, min(m) OVER (PARTITION BY class_index, a ORDER BY b DESC
  ROWS UNBOUNDED PRECEDING) AS m FROM spans),
iso AS (SELECT class_index, i, max(m) AS v FROM least_end GROUP BY class_index, i),
cal AS (SELECT pc.vec_id, pc.class_index, iso.v FROM pc JOIN cum ON cum.class_index = pc.class_index AND cum.p = pc.p
  JOIN iso ON iso.class_index = cum.class_index AND iso.i = cum.i)
SELECT vec_id, class_index, {sr('CASE WHEN sum(v) OVER w = 0 THEN 1.0 / (SELECT kk FROM nk) ELSE v / sum(v) OVER w END')} AS p
FROM cal WINDOW w AS (PARTITION BY vec_id)"""


@register("calibrate_isotonic", "WITH" + _SQL_MODELS + _ISOTONIC_SQL)
def q_calibrate_isotonic(spark, sf_dir):
    """Isotonic calibration of all classes of one model, fitted on and applied to every row."""
    models, classes, _ = _scored(spark, sf_dir)
    model = next(m for m in models if m.name == "m_centered")
    index = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.element_at(index, F.col("label")).alias("y"), linear.decision_udf([model])(F.col("embedding")).alias("s"))
    p = linear.probabilities(F.col(f"s.{model.name}"), model.loss, len(classes))
    rows = rows.select("vec_id", "y", F.transform(p, lambda x: r(x)).alias("p"))
    out = isotonic.calibrate(rows, "p", isotonic.fit(rows, "p", "y").collect())
    return out.select("vec_id", F.posexplode("calibrated").alias("class_index", "p")).select(
        "vec_id", F.col("class_index").cast("int").alias("class_index"), r("p").alias("p"))
