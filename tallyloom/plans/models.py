"""Neighbours, a regression and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import models, neighbours
from ..operators.prefix import sequence_number
from . import query
from .inputs import table


@query("""WITH dims AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, d, avg(x) AS x FROM dims GROUP BY 1, 2),
centres AS (SELECT label, list(x ORDER BY d) AS c FROM means GROUP BY 1),
scored AS (SELECT c.label AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c.c) AS similarity
  FROM embeddings e, centres c)
SELECT query_id, vec_id, row_number() OVER w AS rank, round(similarity, 6) AS similarity FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id) QUALIFY row_number() OVER w <= 10""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to the mean vector of each label."""
    vectors = table(spark, sf_dir, "embeddings")
    size = vectors.select(F.max(F.size("embedding")).alias("d")).first()["d"]
    batch = neighbours.centroids(vectors, "label", "embedding", size).withColumnRenamed("label", "query_id")
    found = neighbours.knn(vectors.select("vec_id", "embedding"), batch, 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""WITH rows AS (SELECT l_quantity AS x, l_extendedprice AS y,
  ('0x' || substr(sha256(l_orderkey || '|' || l_partkey || '|' || l_linenumber), 1, 4))::INT < 13107 AS test FROM lineitem),
fit AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 0.5) AS b FROM rows WHERE NOT test)
SELECT count(*) FILTER (WHERE NOT test) AS train_rows, count(*) FILTER (WHERE test) AS test_rows,
  0 AS left_out, round(any_value(my - b * mx), 4) AS intercept, round(any_value(b), 4) AS coef_l_quantity,
  round(avg((y - (my - b * mx) - b * x) ** 2) FILTER (WHERE test), 2) AS mse FROM rows, fit""")
def ridge_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    test = models.held_out(["l_orderkey", "l_partkey", "l_linenumber"])
    fitted = models.ridge(items, ["l_quantity"], "l_extendedprice", 0.5, test)
    return fitted.withColumns({
        "intercept": F.round("intercept", 4), "coef_l_quantity": F.round("coef_l_quantity", 4),
        "mse": F.round("mse", 2)})


@query("""WITH given AS (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS x1, l_discount AS x2,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS y,
  ('0x' || substr(sha256(l_orderkey || '|' || l_partkey || '|' || l_linenumber), 1, 4))::INT < 13107 AS test FROM lineitem),
rows AS (SELECT * FROM given WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL),
m AS (SELECT count(*) AS n, avg(x1) AS a, avg(x2) AS b, avg(y) AS c, var_pop(x1) * count(*) + 0.5 AS s11,
  var_pop(x2) * count(*) + 0.5 AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS t1,
  covar_pop(x2, y) * count(*) AS t2 FROM rows WHERE NOT test),
fit AS (SELECT (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS w1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS w2, m.* FROM m)
SELECT count(*) FILTER (WHERE NOT test) AS train_rows, count(*) FILTER (WHERE test) AS test_rows,
  (SELECT count(*) FROM given) - count(*) AS left_out, round(any_value(c - w1 * a - w2 * b), 3) AS intercept,
  round(any_value(w1), 3) AS coef_l_quantity, round(any_value(w2), 2) AS coef_l_discount,
  round(avg((y - (c - w1 * a - w2 * b) - w1 * x1 - w2 * x2) ** 2) FILTER (WHERE test), 1) AS mse FROM rows, fit""")
def ridge_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features; rows that lack one of them or the label are left out."""
    items = table(spark, sf_dir, "lineitem").withColumns({
        "l_quantity": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")),
        "l_extendedprice": F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice"))})
    test = models.held_out(["l_orderkey", "l_partkey", "l_linenumber"])
    fitted = models.ridge(items, ["l_quantity", "l_discount"], "l_extendedprice", 0.5, test)
    return fitted.withColumns({
        "intercept": F.round("intercept", 3), "coef_l_quantity": F.round("coef_l_quantity", 3),
        "coef_l_discount": F.round("coef_l_discount", 2), "mse": F.round("mse", 1)})


@query("""WITH runs AS (SELECT user_id % 5 AS run_id, event_type AS key, value,
  row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY event_id) AS step FROM events)
SELECT run_id, key, count(*) AS steps, arg_max(value, step) AS last_value, max(step) AS last_step,
  min(value) AS best_value, arg_min(step, (value, step)) AS best_step FROM runs GROUP BY 1, 2""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("run_id"), F.col("event_type").alias("key"), "event_id", "value")
    return models.run_metrics(sequence_number(events, ["run_id", "key"], "event_id", "step"))
