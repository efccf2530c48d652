"""Supervised and anomaly models of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.operators.metrics import class_weights
from tidemark.operators.windows import running_total
from tidemark.session import cut, ship


def random_forest(train: DataFrame, features: list[str], label: str, trees: int = 100, seed: int = 42):
    """Fitted pipeline (index, assemble, forest) with balanced class weights; fit on as many rows as given."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    weights = class_weights(train, label).select(F.col(label).alias("__l"), "weight")
    rows = train.join(weights, F.col(label) == F.col("__l")).drop("__l")
    steps = [
        StringIndexer(inputCol=label, outputCol="__y", handleInvalid="keep"),
        VectorAssembler(inputCols=features, outputCol="__x"),
        RandomForestClassifier(featuresCol="__x", labelCol="__y", weightCol="weight", numTrees=trees, maxDepth=8, seed=seed)
    ]
    return Pipeline(stages=steps).fit(rows)


def boosted_trees(train: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 5, seed: int = 42):
    """Fitted pipeline of gradient-boosted trees, one against the rest for each class, with balanced class weights.

    depth 5 is what the library's boosted trees allow to be fitted at this many rounds in reasonable time; step 0.1, rows 0.8.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    weights = class_weights(train, label).select(F.col(label).alias("__l"), "weight")
    rows = train.join(weights, F.col(label) == F.col("__l")).drop("__l")
    one = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="__y", handleInvalid="error"),
        VectorAssembler(inputCols=features, outputCol="__x"),
        OneVsRest(classifier=one, featuresCol="__x", labelCol="__y", weightCol="weight")
    ]).fit(rows)


def class_of(model, df: DataFrame) -> DataFrame:
    """`df` with model_class, of models that give no probabilities."""
    name = F.element_at(F.array(*[F.lit(x) for x in model.stages[0].labels]), F.col("prediction").cast("int") + 1)
    return model.transform(df).select(*df.columns, name.alias("model_class"))


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: str = "42") -> DataFrame:
    """`df` with fold (0 to k - 1): each label is dealt out evenly, in the order of a hash of `key`."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    bucket = F.conv(F.substring(h, 1, 2), 16, 10).cast("bigint")
    placed = running_total(
        df.select("*", h.alias("__h"), bucket.alias("__bucket")), "__bucket", "__h", F.lit(1).cast("bigint"), "__place", [label],
        block_us=8
    )
    return placed.select(*df.columns, F.pmod(F.col("__place") - 1, F.lit(k)).cast("int").alias("fold"))


def cross_validate(df: DataFrame, features: list[str], label: str, key: str, fit, k: int = 5) -> DataFrame:
    """fold, n, accuracy, macro_precision, macro_recall, macro_f1 of models fitted by fit(train) on the other folds."""
    from functools import reduce

    from tidemark.operators.metrics import class_report, macro

    rows = cut(folds(df.select(key, label, *features), label, key, k), "folds")
    out = []
    for f in range(k):
        test = class_of(fit(rows.where(F.col("fold") != f)), rows.where(F.col("fold") == f))
        accuracy = test.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col("model_class")).cast("int")).alias("accuracy"))
        out.append(accuracy.crossJoin(macro(class_report(test, label, "model_class"))).select(F.lit(f).alias("fold"), "*"))  # two single rows
    return reduce(DataFrame.unionByName, out)


def size_sweep(train: DataFrame, test: DataFrame, features: list[str], label: str, sizes: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """trees, accuracy, macro_f1, agreement with the largest forest: what smaller forests cost."""
    from functools import reduce

    from tidemark.operators.metrics import class_report, macro

    test = cut(test.select(label, *features).withColumn("__id", F.monotonically_increasing_id()), "sweep")
    guesses = {n: class_of(random_forest(train, features, label, n), test).select("__id", label, "model_class") for n in sizes}
    most = guesses[max(sizes)].select(F.col("__id").alias("i"), F.col("model_class").alias("reference"))
    out = []
    for n, g in guesses.items():
        both = g.join(most, F.col("__id") == F.col("i"))
        one = both.agg(
            F.avg((F.col(label) == F.col("model_class")).cast("int")).alias("accuracy"),
            F.avg((F.col("reference") == F.col("model_class")).cast("int")).alias("agreement")
        )
        out.append(one.crossJoin(macro(class_report(g, label, "model_class")).select("macro_f1")).select(
            F.lit(n).alias("trees"), "*"
        ))  # two single rows
    return reduce(DataFrame.unionByName, out)


def classify(model, df: DataFrame) -> DataFrame:
    """`df` with model_class and model_confidence."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    scored = model.transform(df)
    p = vector_to_array("probability")
    name = F.element_at(F.array(*[F.lit(x) for x in labels], F.lit("UNKNOWN_ANOMALY")), F.col("prediction").cast("int") + 1)
    return scored.select(*df.columns, name.alias("model_class"), F.array_max(p).alias("model_confidence"))


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random cuts on small samples; few cuts isolate what is odd. Scores fall with oddness, around 0."""

    def __init__(self, sample: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 42):
        draw = np.random.default_rng(seed)
        self.rows = min(rows, len(sample))
        self.trees = [self._grow(sample[draw.choice(len(sample), self.rows, replace=False)], draw) for _ in range(trees)] if self.rows else []

    def _grow(self, x: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        stack = [(x, 0, -1, 0)]
        while stack:
            part, depth, parent, side = stack.pop()
            me = len(feature)
            if parent >= 0:
                (left if side == 0 else right)[parent] = me
            spread = part.max(0) - part.min(0) if len(part) else np.zeros(x.shape[1])
            free = np.flatnonzero(spread > 0)
            left.append(-1)
            right.append(-1)
            if depth >= limit or len(part) <= 1 or not len(free):
                feature.append(-1)
                cut.append(0.0)
                length.append(depth + float(average_path(len(part))))
                continue
            f = int(draw.choice(free))
            at = float(draw.uniform(part[:, f].min(), part[:, f].max()))
            feature.append(f)
            cut.append(at)
            length.append(0.0)
            below = part[:, f] < at
            stack += [(part[below], depth + 1, me, 0), (part[~below], depth + 1, me, 1)]
        return tuple(np.array(v) for v in (feature, cut, left, right, length))

    def path(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, length in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inside := np.flatnonzero(feature[node] >= 0)).size:
                n = node[inside]
                node[inside] = np.where(x[inside, feature[n]] < cut[n], left[n], right[n])
            total += length[node]
        return total / max(1, len(self.trees))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 - 2.0 ** (-self.path(x) / max(float(average_path(self.rows)), 1e-9))


def isolation_forest(
    train: DataFrame, features: list[str], trees: int = 100, rows: int = 256, sample_rows: int = 20_000, seed: int = 42
) -> IsolationForest:
    """Fitted on about `sample_rows` rows at most, drawn from all partitions alike (each tree needs only `rows` of them)."""
    n = train.count()
    share = min(1.0, sample_rows / max(1, n))
    some = train.select(*features) if share == 1 else train.select(*features).sample(fraction=share, seed=seed)  # its size is bounded up to chance
    return IsolationForest(some.toPandas().to_numpy(float), trees, rows, seed)


def anomaly_scores(df: DataFrame, forest: IsolationForest, features: list[str]) -> DataFrame:
    """`df` with anomaly_score: the lower, the odder."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(forest)

    @pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(sent.value.score(b.to_numpy(float)))

    return df.withColumn("anomaly_score", score(F.struct(*features)))


def contamination_threshold(scored: DataFrame, share: float = 0.01) -> float:
    """The score below which `share` of the training rows lie: what is lower is anomalous. 0 for no rows."""
    from tidemark.operators.metrics import percentiles

    found = percentiles(scored, "anomaly_score", [share]).first()
    return float(found.value) if found else 0.0


def save(model, path: str, metadata: dict) -> None:
    """The model and, beside it, what it was made of."""
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    SparkSession.getActiveSession().createDataFrame([(k, str(v)) for k, v in metadata.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_latest(root: str, prefix: str):
    """The model of the greatest name with `prefix` below `root`, on whatever file system."""
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{prefix}*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(x.getPath().toString() for x in found or [])
    if not names:
        raise FileNotFoundError(f"{root}/{prefix}*")
    return PipelineModel.load(f"{names[-1]}/model")
