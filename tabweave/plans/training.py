"""Queries for models, clustering, sequences and training."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabweave.models import factory
from tabweave.models.dbscan import dbscan as density
from tabweave.models.epochs import train_epochs as run_epochs
from tabweave.models.forecast import fit_forecast
from tabweave.models.forecast import sequence_windows as windows_of
from tabweave.models.training import train_classical as run_classical
from tabweave.models.ward import hierarchical as ward
from tabweave.operators.split import split_random, split_stratified
from tabweave.plans.registry import query
from tabweave.plans.tables import frame, table, with_
from tabweave.session import scratch_path
from tabweave.sources.checkpoints import read_checkpoints


def _r(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- classification ------------------------------------------------------


def _flags(spark, sf):
    """Orders' lines: return flag by quantity, discount and tax."""
    df = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"), "l_linestatus",
    )
    return df, ["l_quantity", "l_discount", "l_tax", "price"]


def _confusion(df, label):
    return df.groupBy(F.col(label).alias("actual"), "predicted").agg(F.count("*").alias("n"))


def _spread(df):
    """A hundred trees for each row are much work, and a table of a few MB is one task to the reader."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


@query("logistic_regression")
def logistic_regression(spark, sf):
    df, features = _flags(spark, sf)
    model = factory.fit("classification", "logistic_regression", df, features=features, label="l_linestatus")
    return _confusion(model.transform(df), "l_linestatus")


@query("decision_tree")
def decision_tree(spark, sf):
    df = table(spark, sf, "embeddings")
    model = factory.fit("classification", "decision_tree", df, features=["embedding"], label="label")
    return _confusion(model.transform(df), "label")


DEEP = """WITH c AS (SELECT embedding, label, COUNT(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY embedding, label),
    p AS (SELECT embedding, label AS predicted, ROW_NUMBER() OVER (PARTITION BY embedding ORDER BY n DESC, label) AS i FROM c)
    SELECT e.label AS actual, p.predicted, COUNT(*) AS n FROM embeddings e LEFT JOIN p ON e.embedding = p.embedding AND p.i = 1 GROUP BY ALL"""


@query("decision_tree_unlimited", DEEP)
def decision_tree_unlimited(spark, sf):
    """Grown to pure leaves, a tree gives the rows it was fitted on their own labels."""
    df = table(spark, sf, "embeddings")
    model = factory.fit("classification", "decision_tree", df, features=["embedding"], label="label", max_depth=None, node_rows=512)
    return _confusion(model.transform(df), "label")


@query("random_forest")
def random_forest(spark, sf):
    df = table(spark, sf, "embeddings")
    model = factory.fit("classification", "random_forest", df, features=["embedding"], label="label")
    return _confusion(model.transform(_spread(df)), "label")


@query("svm")
def svm(spark, sf):
    df = table(spark, sf, "embeddings")
    model = factory.fit("classification", "svm", df, features=["embedding"], label="label")
    return _confusion(model.transform(df), "label")


@query(
    "knn",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
        near AS (SELECT a.vec_id, b.label, ROW_NUMBER() OVER (PARTITION BY a.vec_id
                 ORDER BY LIST_DISTANCE(a.e, b.e), b.vec_id) AS rn FROM v a, v b),
        votes AS (SELECT vec_id, label, COUNT(*) AS n FROM near WHERE rn <= 5 GROUP BY vec_id, label),
        won AS (SELECT vec_id, label, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS rn FROM votes)
        SELECT vec_id, label AS predicted FROM won WHERE rn = 1""",
)
def knn(spark, sf):
    df = table(spark, sf, "embeddings")
    model = factory.fit("classification", "knn", df, features=["embedding"], label="label", key="vec_id")
    return model.transform(df.select("vec_id", "embedding")).select("vec_id", "predicted")


@query("knn_approximate")
def knn_approximate(spark, sf):
    df = table(spark, sf, "embeddings")
    model = factory.fit("classification", "knn", df, features=["embedding"], label="label", key="vec_id", method="lsh")
    return model.transform(df.select("vec_id", "embedding")).select("vec_id", "predicted")


NORMAL = "(-0.5E0 * LN(2 * PI() * ({v})) - ({x} - ({m})) * ({x} - ({m})) / (2 * ({v})))"


@query(
    "naive_bayes",
    f"""WITH f AS (SELECT event_id, event_type, value AS a, CAST(HOUR(ts) AS DOUBLE) AS b FROM events),
        eps AS (SELECT 1E-9 * GREATEST(VAR_POP(a), VAR_POP(b)) AS e FROM f),
        p AS (SELECT event_type AS label, LN(COUNT(*) / (SELECT COUNT(*) FROM f)) AS prior,
                 AVG(a) AS ma, VAR_POP(a) + (SELECT e FROM eps) AS va,
                 AVG(b) AS mb, VAR_POP(b) + (SELECT e FROM eps) AS vb FROM f GROUP BY event_type),
        s AS (SELECT event_id, label, prior + {NORMAL.format(x="a", m="ma", v="va")}
                 + {NORMAL.format(x="b", m="mb", v="vb")} AS score FROM f, p),
        r AS (SELECT event_id, label, score, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY score DESC, label) AS rn,
                 EXP(score - MAX(score) OVER (PARTITION BY event_id)) AS w FROM s)
        SELECT event_id, MAX(CASE WHEN rn = 1 THEN label END) AS predicted, ROUND(MAX(w) / SUM(w), 6) AS confidence
        FROM r GROUP BY event_id""",
)
def naive_bayes(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", "event_type", F.col("value").alias("a"), F.hour("ts").cast("double").alias("b")
    )
    model = factory.fit("classification", "naive_bayes", df, features=["a", "b"], label="event_type")
    return model.transform(df).select(
        "event_id", "predicted", F.round(F.array_max("probability"), 6).alias("confidence")
    )


@query("mlp")
def mlp(spark, sf):
    df = table(spark, sf, "embeddings")
    model = factory.fit("classification", "mlp", df, features=["embedding"], label="label")
    return _confusion(model.transform(df), "label")


@query("frozen_feature_head")
def frozen_feature_head(spark, sf):
    df = split_stratified(table(spark, sf, "embeddings"), "vec_id", "label")
    model = factory.fit("classification", "resnet18", df.where("split = 'train'"), features=["embedding"], label="label")
    return model.transform(df).groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("int")), 4).alias("accuracy")
    )


# ---- regression ----------------------------------------------------------

LINES = """f AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
    s AS (SELECT COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, VAR_POP(x) AS vx, COVAR_POP(x, y) AS cxy FROM f)"""


def _line(spark, sf, name, **params):
    df = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")
    )
    fitted = factory.fit("regression", name, df, features=["x"], label="y", **params).stages[-2]
    rows = [("slope", float(fitted.coefficients[0])), ("intercept", float(fitted.intercept))]
    return _r(spark.createDataFrame(rows, "name string, value double"), "value", digits=4)


def _line_sql(slope: str) -> str:
    return f"""WITH {LINES}, w AS (SELECT {slope} AS b, mx, my FROM s)
        SELECT 'slope' AS name, ROUND(b, 4) AS value FROM w UNION ALL SELECT 'intercept', ROUND(my - b * mx, 4) FROM w"""


@query("linear_regression", _line_sql("cxy / vx"))
def linear_regression(spark, sf):
    return _line(spark, sf, "linear_regression")


@query("ridge", _line_sql("n * cxy / (n * vx + 5000.0E0)"))
def ridge(spark, sf):
    return _line(spark, sf, "ridge", alpha=5000.0)


@query("lasso", _line_sql("SIGN(cxy) * GREATEST(ABS(cxy) - 2.5E0, 0) / vx"))
def lasso(spark, sf):
    return _line(spark, sf, "lasso", alpha=2.5)


@query("random_forest_regressor")
def random_forest_regressor(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    model = factory.fit(
        "regression", "random_forest_regressor", df, features=["p_size"], label="p_retailprice"
    )
    return _r(model.transform(_spread(df)).select("p_partkey", "predicted"), "predicted", digits=2)


# ---- clustering ----------------------------------------------------------


@query("kmeans")
def kmeans(spark, sf):
    df = frame(spark, sf, "points")
    model = factory.fit("clustering", "kmeans", df, features=["x", "y"], n_clusters=4)
    return model.transform(df).groupBy("predicted").agg(F.count("*").alias("n"))


@query(
    "dbscan",
    f"""WITH RECURSIVE points AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 5 AS x,
                (p_retailprice - 900) / 10 AS y FROM part),
        near AS (SELECT a.id AS a, b.id AS b FROM points a, points b
                 WHERE SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.25E0),
        core AS (SELECT a AS id FROM near GROUP BY a HAVING COUNT(*) >= 5),
        links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
        reach AS (SELECT id AS start, id FROM core
                  UNION SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.id),
        comp AS (SELECT id, MIN(start) AS c FROM reach GROUP BY id),
        numbered AS (SELECT id, DENSE_RANK() OVER (ORDER BY c) - 1 AS k FROM comp),
        border AS (SELECT a AS id, MIN(k) AS k FROM near JOIN numbered n ON n.id = b GROUP BY a)
        SELECT p.id, CAST(COALESCE(n.k, b.k, -1) AS INT) AS predicted
        FROM points p LEFT JOIN numbered n ON n.id = p.id LEFT JOIN border b ON b.id = p.id""",
)
def dbscan(spark, sf):
    return density(frame(spark, sf, "points"), "id", ["x", "y"], eps=0.25, min_samples=5).select("id", "predicted")


@query(
    "dbscan_embeddings",
    """WITH RECURSIVE v AS (SELECT vec_id AS id, LIST_TRANSFORM(CAST(embedding AS DOUBLE[]),
                LAMBDA x, i: x / 20 + CASE WHEN i = 6 * label + 1 THEN 3 ELSE 0 END) AS e FROM embeddings),
        near AS (SELECT a.id AS a, b.id AS b FROM v a, v b WHERE LIST_DISTANCE(a.e, b.e) <= 0.0647E0),
        core AS (SELECT a AS id FROM near GROUP BY a HAVING COUNT(*) >= 4),
        links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
        reach AS (SELECT id AS start, id FROM core
                  UNION SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.id),
        comp AS (SELECT id, MIN(start) AS c FROM reach GROUP BY id),
        numbered AS (SELECT id, DENSE_RANK() OVER (ORDER BY c) - 1 AS k FROM comp),
        border AS (SELECT a AS id, MIN(k) AS k FROM near JOIN numbered n ON n.id = b GROUP BY a)
        SELECT v.id, CAST(COALESCE(n.k, b.k, -1) AS INT) AS predicted
        FROM v LEFT JOIN numbered n ON n.id = v.id LEFT JOIN border b ON b.id = v.id""",
)
def dbscan_embeddings(spark, sf):
    # The given vectors have no clusters: each label gets a corner of its own.
    corner = F.transform(
        F.col("embedding").cast("array<double>"), lambda x, i: x / 20 + F.when(i == 6 * F.col("label"), 3.0).otherwise(0.0)
    )
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), corner.alias("e"))
    return density(df, "id", ["e"], eps=0.0647, min_samples=4, block_rows=128).select("id", "predicted")


# Groups far apart: every clustering has to find them, numbered by their smallest key.
def _groups_sql(group: str) -> str:
    return f"""{with_("groups")}, named AS (SELECT {group} AS g, DENSE_RANK() OVER (ORDER BY MIN(id)) - 1 AS k FROM groups GROUP BY {group})
        SELECT id, CAST(k AS INT) AS predicted FROM groups JOIN named ON named.g = {group.replace("g", "groups.g")}"""


@query("hierarchical_groups", _groups_sql("g"))
def hierarchical_groups(spark, sf):
    return ward(frame(spark, sf, "groups"), "id", ["x", "y"], n_clusters=4).select("id", "predicted")


@query("hierarchical_bisecting", _groups_sql("g"))
def hierarchical_bisecting(spark, sf):
    df = frame(spark, sf, "groups")
    model = factory.fit("clustering", "hierarchical", df, features=["x", "y"], key="id", method="bisecting", n_clusters=4)
    return model.transform(df).select("id", "predicted")


@query("kmeans_groups", _groups_sql("g // 2"))
def kmeans_groups(spark, sf):
    df = frame(spark, sf, "groups")
    found = factory.fit("clustering", "kmeans", df, features=["x", "y"], n_clusters=2).transform(df)
    numbers = found.groupBy("predicted").agg(F.min("id").alias("first")).withColumn(
        "k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")) - 1
    )
    return found.join(numbers, "predicted").select("id", F.col("k").alias("predicted"))


@query("hierarchical")
def hierarchical(spark, sf):
    return ward(frame(spark, sf, "points"), "id", ["x", "y"], n_clusters=4).groupBy("predicted").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id")
    )


# ---- sequences -----------------------------------------------------------

WINDOWED = f"""{with_("series")}, w AS (SELECT series, CAST(t AS VARCHAR) AS t, y,
    LIST(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS win,
    LEAD(y, 2) OVER (PARTITION BY series ORDER BY t) AS target FROM series)"""


@query(
    "sequence_windows",
    f"""{WINDOWED} SELECT series, t, ROUND(win[1], 6) AS y0, ROUND(win[2], 6) AS y1, ROUND(win[3], 6) AS y2,
        ROUND(target, 6) AS target FROM w WHERE LEN(win) = 3 AND target IS NOT NULL""",
)
def sequence_windows(spark, sf):
    w = windows_of(frame(spark, sf, "series"), "series", "t", "y", length=3, horizon=2)
    lags = [F.round(F.col("window")[i], 6).alias(f"y{i}") for i in range(3)]
    return w.select("series", F.col("t").cast("string").alias("t"), *lags, F.round("target", 6).alias("target"))


@query(
    "forecast",
    f"""{with_("series")}, lagged AS (SELECT series, CAST(t AS VARCHAR) AS t, y,
            LEAD(y) OVER (PARTITION BY series ORDER BY t) AS target FROM series),
        line AS (SELECT REGR_SLOPE(target, y) AS b, REGR_INTERCEPT(target, y) AS a FROM lagged WHERE target IS NOT NULL)
        SELECT series, t, ROUND(a + b * y, 4) AS predicted FROM lagged, line""",
)
def forecast(spark, sf):
    df = frame(spark, sf, "series")
    model = fit_forecast(windows_of(df, "series", "t", "y", length=1), length=1)
    scored = model.transform(windows_of(df, "series", "t", "y", length=1, with_target=False))
    return scored.select("series", F.col("t").cast("string").alias("t"), F.round("predicted", 4).alias("predicted"))


# ---- training ------------------------------------------------------------


@query(
    "train_classical",
    f"""{with_("classes")}, cut AS (SELECT *, ROW_NUMBER() OVER (ORDER BY MD5('42|' || id)) AS rn, COUNT(*) OVER () AS n
            FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)),
        parts AS (SELECT *, CEIL(n * 0.15E0) AS k1, CEIL((n - CEIL(n * 0.15E0)) * (0.15E0 / (1 - 0.15E0))) AS k2 FROM cut),
        line AS (SELECT REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a FROM parts WHERE rn > k1 + k2),
        v AS (SELECT y, a + b * x AS p FROM parts, line WHERE rn > k1 AND rn <= k1 + k2),
        e AS (SELECT AVG(ABS(y - p)) AS mae, AVG((y - p) * (y - p)) AS mse, VAR_POP(y) AS spread FROM v)
        SELECT 'val_mae' AS metric, ROUND(mae, 3) AS value FROM e UNION ALL SELECT 'val_mse', ROUND(mse, 3) FROM e
        UNION ALL SELECT 'val_rmse', ROUND(SQRT(mse), 3) FROM e UNION ALL SELECT 'val_r2', ROUND(1 - mse / spread, 3) FROM e""",
)
def train_classical(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")
    )
    run = run_classical(
        split_random(df, "id"), "regression", "linear_regression", ["x"], "y", path=scratch_path(spark, "trained")
    )
    rows = spark.createDataFrame(list(run.metrics.items()), "metric string, value double")
    return _r(rows, "value", digits=3)


@query("train_epochs")
def train_epochs(spark, sf):
    df = split_stratified(table(spark, sf, "embeddings"), "vec_id", "label")
    store = scratch_path(spark, "epochs")
    run_epochs(df, "classification", "embedding", "label", learning_rate=0.005, run_id="head", store=store, batch_size=32)
    return read_checkpoints(spark, store).select(
        "run_id", "epoch", F.size("params").alias("n_params"), F.round(F.col("metrics")["val_loss"], 4).alias("val_loss"), "is_best"
    )
