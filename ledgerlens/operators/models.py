"""Model training, calibration, scoring and federated averaging on Spark ML.

The data never leaves the executors: Spark ML estimators train distributed,
and the federated loop keeps the clients' models as a table; only the averaged
model (a few dozen numbers) reaches the driver between rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.graph import prior_link_edges, sage_encode
from ledgerlens.sources.io import written


def class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Positive rows weighted max(neg/pos, 1) (the reference's scale_pos_weight / balanced classes)."""
    c = df.agg(F.sum(F.col(label)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = F.greatest(F.lit(1.0), (F.col("_n") - F.col("_p")) / F.greatest(F.col("_p"), F.lit(1)))
    return df.crossJoin(c).withColumn("weight", F.when(F.col(label) == 1, w).otherwise(F.lit(1.0))).drop("_p", "_n")


def gbt_pipeline(features: list[str], max_iter: int = 120, max_depth: int = 5, step: float = 0.1,
                 subsample: float = 0.8, columns: float = 0.8, seed: int = 42) -> Pipeline:
    """Boosted trees on the feature columns (depth 5, lr 0.1, 0.8 of the rows a tree and of the columns a node, weighted positives)."""
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol="is_fraud", weightCol="weight", maxIter=max_iter,
                        maxDepth=max_depth, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=str(columns), seed=seed)
    return Pipeline(stages=[va, gbt])


def positive_probability(pred: DataFrame, col: str = "probability", out: str = "raw_score") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col(col))[1])


TASK_ROWS = 100_000  # training rows a task


def _fit_weighted(estimator, train: DataFrame, inputs: list[str] | None = None):
    """Fit on a persisted training frame, the label and the ``inputs`` alone (default: all columns): the class-weight count,
    the metadata pass and every iteration read one materialisation (lost blocks are recomputed from lineage).

    A fit runs thousands of short stages, so its tasks hold ``TASK_ROWS`` rows, however many parts the frame came in."""
    train = (train if inputs is None else train.select("is_fraud", *inputs)).persist()
    try:
        tasks = max(1, -(-train.count() // TASK_ROWS))
        return estimator.fit(class_weights(train).withColumn("is_fraud", F.col("is_fraud").cast("double")).coalesce(tasks))
    finally:
        train.unpersist()


def train_gbt(train: DataFrame, features: list[str], max_iter: int = 120) -> PipelineModel:
    return _fit_weighted(gbt_pipeline(features, max_iter=max_iter), train, features)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch scoring of every row (the reference scores only row 0 of a frame)."""
    return positive_probability(model.transform(df)).drop("features", "rawPrediction", "probability", "prediction")


def sage_embeddings(split: DataFrame, features: list[str]) -> DataFrame:
    """Graph embeddings of one split (edges never cross splits)."""
    nodes = split.select("tx_id", *[F.col(c).cast("double").alias(c) for c in features])
    return sage_encode(nodes, written(prior_link_edges(split, places=True), "split-edges"), features)  # read by both layers


def train_sage_lr(train: DataFrame, features: list[str]) -> PipelineModel:
    emb_cols = [f"emb_{j}" for j in range(16)]
    va = VectorAssembler(inputCols=emb_cols, outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="is_fraud", weightCol="weight", maxIter=1000)
    return _fit_weighted(Pipeline(stages=[va, lr]), train.join(sage_embeddings(train, features), "tx_id"), emb_cols)


def train_hybrid(train: DataFrame, features: list[str], max_iter: int = 160) -> PipelineModel:
    emb_cols = [f"emb_{j}" for j in range(16)]
    return _fit_weighted(gbt_pipeline(features + emb_cols, max_iter=max_iter),
                         train.join(sage_embeddings(train, features), "tx_id"), features + emb_cols)


def fit_platt(valid: DataFrame, score_col: str = "raw_score"):
    """Logistic regression on the score; fewer than 2 rows -> identity (None)."""
    if valid.limit(2).count() < 2:
        return None
    va = VectorAssembler(inputCols=[score_col], outputCol="_s")
    lr = LogisticRegression(featuresCol="_s", labelCol="is_fraud", probabilityCol="_p", rawPredictionCol="_raw",
                            predictionCol="_pred", maxIter=200, tol=1e-10)
    return Pipeline(stages=[va, lr]).fit(valid.withColumn("is_fraud", F.col("is_fraud").cast("double")))


def fit_isotonic(valid: DataFrame, score_col: str = "raw_score"):
    """Monotone fit of label on score; predictions outside the fitted range are clipped.

    Rows of equal score are one point with their mean label and their number as weight, which gives the same fit.
    """
    if valid.limit(2).count() < 2:
        return None
    known = F.count("is_fraud") == F.count(F.lit(1))  # a null label stays an error
    points = valid.groupBy(F.col(score_col)).agg(F.when(known, F.avg(F.col("is_fraud").cast("double"))).alias("is_fraud"),
                                                 F.count(F.lit(1)).cast("double").alias("_points"))
    iso = IsotonicRegression(featuresCol=score_col, labelCol="is_fraud", weightCol="_points", predictionCol="_cal")
    return iso.fit(points)


def calibrate(model, df: DataFrame, score_col: str = "raw_score", out: str = "score") -> DataFrame:
    if model is None:
        return df.withColumn(out, F.col(score_col))
    pred = model.transform(df)
    if "_p" in pred.columns:
        pred = pred.withColumn(out, vector_to_array("_p")[1]).drop("_s", "_p", "_raw", "_pred")
    else:
        pred = pred.withColumn(out, F.least(F.greatest(F.col("_cal"), F.lit(0.0)), F.lit(1.0))).drop("_cal")
    return pred


# ---------------------------------------------------------------- federated averaging

def scaled(train: DataFrame, others: list[DataFrame], features: list[str]) -> list[DataFrame]:
    """Standardise by the training mean / population std (0 -> 1), computed in one aggregate."""
    st = train.agg(*[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(features)],
                   *[F.stddev_pop(c).alias(f"_s_{i}") for i, c in enumerate(features)])
    out = []
    for df in [train, *others]:
        j = df.crossJoin(st)  # one-row statistics
        cols = [((F.col(c) - F.col(f"_m_{i}")) / F.when(F.col(f"_s_{i}") == 0, 1.0).otherwise(F.col(f"_s_{i}"))).alias(f"x_{i}")
                for i, c in enumerate(features)]
        keep = [c for c in df.columns if c not in features]
        out.append(j.select(*keep, *cols))
    return out


CLIENT_PARTS = 32  # a client's rows meet its model in so many parts


def _local_step(data: DataFrame, weights: DataFrame, d: int, client: str, lr: float, l2: float) -> DataFrame:
    """One full-batch gradient step of every client from its own row of ``weights`` (client, b, w_i): the new table, with n."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(CLIENT_PARTS - 1))).alias("_part")
    j = data.join(weights.select("*", parts), [client, "_part"])
    logit = F.col("b")
    for i in range(d):
        logit = logit + F.col(f"x_{i}") * F.col(f"w_{i}")
    p = 1.0 / (1.0 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))
    own = ["b", *[f"w_{i}" for i in range(d)]]
    e = j.select(client, *own, *[F.col(f"x_{i}") for i in range(d)], (p - F.col("is_fraud")).alias("_err"))
    g = e.groupBy(client).agg(F.count(F.lit(1)).alias("n"), F.sum("_err").alias("_se"), *[F.first(c).alias(c) for c in own],
                              *[F.sum(F.col(f"x_{i}") * F.col("_err")).alias(f"_g_{i}") for i in range(d)])
    return g.select(client, "n", (F.col("b") - lr * F.col("_se") / F.col("n")).alias("b"), *[
        (F.col(f"w_{i}") - lr * (F.col(f"_g_{i}") / F.col("n") + l2 * F.col(f"w_{i}"))).alias(f"w_{i}") for i in range(d)])


def fedavg(train_scaled: DataFrame, d: int, client: str = "channel", rounds: int = 5, epochs: int = 3,
           lr: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float, DataFrame]:
    """Federated averaging: per round, every client runs ``epochs`` full-batch gradient steps
    from the global model; the new global model is the sample-weighted mean of the local ones.

    Local models are a table with a row a client, joined to the data by client; only the averaged model (d + 1
    numbers) reaches the driver, once a round.  Returns (weights, bias, samples per client).
    """
    data = train_scaled.select(F.col(client).cast("string").alias(client), F.col("is_fraud").cast("double").alias("is_fraud"),
                               *[F.col(f"x_{i}") for i in range(d)])
    rows = [F.col(f"x_{i}") for i in range(d)]
    data = data.withColumn("_part", F.pmod(F.xxhash64(client, *rows), F.lit(CLIENT_PARTS)).cast("int")).persist()
    clients = data.groupBy(client).agg(F.count(F.lit(1)).cast("long").alias("samples"))
    w, b = np.zeros(d), 0.0
    for _ in range(rounds):
        local = clients.select(client, F.lit(float(b)).alias("b"), *[F.lit(float(w[i])).alias(f"w_{i}") for i in range(d)])
        for _ in range(epochs):
            local = _local_step(data, local.drop("n"), d, client, lr, l2)
        mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
        r = local.agg(mean("b"), *[mean(f"w_{i}") for i in range(d)]).first()
        w, b = np.array([r[f"w_{i}"] for i in range(d)]), float(r["b"])
    return w, b, clients


def fed_predict(df_scaled: DataFrame, w: np.ndarray, b: float, out: str = "raw_score") -> DataFrame:
    z = F.lit(float(b))
    for i, wi in enumerate(w):
        z = z + F.col(f"x_{i}") * float(wi)
    return df_scaled.withColumn(out, 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))
