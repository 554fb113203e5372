"""``pyspark.ml`` estimators over the DataFrame functions.

``fit`` builds the cell index (k-means cells and the blocked point table,
written once to the checkpoint folder); ``transform`` runs the k-NN join for
the input rows and appends the prediction. ``k``, ``threshold`` and every
other setting are ``Param``s, so ``copy`` keeps them and models keep their
index.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.functions.vectors import as_array
from vicinity.operators.cells import DEFAULT_BLOCK_ROWS, DEFAULT_MAX_CELLS, DEFAULT_SEED, CellIndex, build_index
from vicinity.operators.outliers import indegree, outliers
from vicinity.operators.predict import (
    attach,
    check_class_labels,
    class_count,
    classify_predictions,
    raw_predictions,
    regress_predictions,
)
from vicinity.operators.search import SEARCH_MODES, knn_join
from vicinity.operators.tree import TreeIndex, build_tree_index
from vicinity.sources.points import ensure_id

# "tree" is the pruned search over a centre tree.
MODES = (*SEARCH_MODES, "tree")


class _KNNParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    k = Param(Params._dummy(), "k", "number of neighbours (>= 1)", typeConverter=TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique row id column; added when missing", typeConverter=TypeConverters.toString)
    search = Param(Params._dummy(), "search", "pruned | exact | single_cell | blocks | tree", typeConverter=TypeConverters.toString)
    maxCells = Param(Params._dummy(), "maxCells", "cap on k-means cells", typeConverter=TypeConverters.toInt)
    blockRows = Param(Params._dummy(), "blockRows", "points per join block", typeConverter=TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(
            k=1, idCol="id", search="pruned", maxCells=DEFAULT_MAX_CELLS, blockRows=DEFAULT_BLOCK_ROWS,
            seed=DEFAULT_SEED, featuresCol="features", predictionCol="prediction",
        )

    def setK(self, value: int):
        return self._set(k=value)

    def getK(self) -> int:
        return self.getOrDefault(self.k)

    def setIdCol(self, value: str):
        return self._set(idCol=value)

    def setSearch(self, value: str):
        return self._set(search=value)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def setSeed(self, value: int):
        return self._set(seed=value)

    def _validate(self) -> None:
        k = self.getOrDefault(self.k)
        if k < 1:
            raise ValueError(f"k must be at least 1, got {k}")
        if self.getOrDefault(self.search) not in MODES:
            raise ValueError(f"search must be one of {MODES}")

    def _mode(self) -> str:
        search = self.getOrDefault(self.search)
        return "pruned" if search == "tree" else search

    def _build(self, dataset: DataFrame, label_col: str | None) -> CellIndex | TreeIndex:
        """The index of the training rows; without ``idCol`` they are numbered, rows without a label are left out."""
        self._validate()
        search = self.getOrDefault(self.search)
        if label_col is not None:
            dataset = dataset.where(F.col(label_col).isNotNull())
        if search == "tree":
            return build_tree_index(
                ensure_id(dataset, self.getOrDefault(self.idCol)), self.getOrDefault(self.idCol), self.getOrDefault(self.featuresCol), label_col,
                seed=self.getOrDefault(self.seed), block_rows=self.getOrDefault(self.blockRows),
            )
        return build_index(
            ensure_id(dataset, self.getOrDefault(self.idCol)),
            self.getOrDefault(self.idCol),
            self.getOrDefault(self.featuresCol),
            label_col,
            centers={"exact": "single", "blocks": "single", "single_cell": "kmeans", "pruned": "auto"}[search],
            max_cells=self.getOrDefault(self.maxCells),
            seed=self.getOrDefault(self.seed),
            block_rows=self.getOrDefault(self.blockRows),
        )


class _KNNModelBase(Model, _KNNParams):
    def __init__(self, index: CellIndex | None = None):
        super().__init__()
        self.index = index

    def _made(self) -> list[T.StructField]:
        """The columns that ``transform`` appends."""
        raise NotImplementedError

    def transformSchema(self, schema: T.StructType) -> T.StructType:  # noqa: N802 (the name that Spark ML gives it)
        """Schema of ``transform``'s result for a table of ``schema``, without a job."""
        made = self._made()
        clash = [f.name for f in made if f.name in schema.names]
        if clash:
            raise ValueError(f"output column(s) {clash} already exist")
        if made and self.getOrDefault(self.featuresCol) not in schema.names:
            raise ValueError(f"no column {self.getOrDefault(self.featuresCol)!r}")
        return T.StructType([*schema.fields, *made])

    def _predict(self, dataset: DataFrame, predictions, output_cols: list[str]) -> DataFrame:
        """``dataset`` with ``output_cols`` of ``predictions(neighbours)`` after its own columns.

        Rows are matched by a key of our own, so ids of the input may be
        missing, null or repeated.
        """
        self._validate()
        if not output_cols:
            return dataset
        clash = [c for c in output_cols if c in dataset.columns]
        if clash:
            raise ValueError(f"output column(s) {clash} already exist")
        key = "_knn_row"
        while key in dataset.columns:
            key = f"_{key}"
        ds = ensure_id(dataset, key)
        nn = knn_join(ds, self.index, self.getOrDefault(self.k), key, self.getOrDefault(self.featuresCol),
                      search=self._mode())
        return attach(ds, predictions(nn), key, output_cols).drop(key)


class KNNClassifier(Estimator, _KNNParams, HasLabelCol):
    """k-NN classification by majority vote; ties go to the smallest label."""

    probabilityCol = Param(Params._dummy(), "probabilityCol", "vote-share column; empty for none", typeConverter=TypeConverters.toString)
    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "column of votes per class; empty for none", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, k=1, featuresCol="features", labelCol="label", predictionCol="prediction",
                 idCol="id", probabilityCol="", rawPredictionCol="", search="pruned", maxCells=DEFAULT_MAX_CELLS,
                 blockRows=DEFAULT_BLOCK_ROWS, seed=DEFAULT_SEED):
        super().__init__()
        self._setDefault(labelCol="label", probabilityCol="", rawPredictionCol="")
        self._set(**self._input_kwargs)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setProbabilityCol(self, value: str):
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value: str):
        return self._set(rawPredictionCol=value)

    def _fit(self, dataset: DataFrame) -> "KNNClassificationModel":
        label = self.getOrDefault(self.labelCol)
        if self.getOrDefault(self.probabilityCol) or self.getOrDefault(self.rawPredictionCol):
            check_class_labels(dataset, label)
        index = self._build(dataset, label)
        model = KNNClassificationModel(index, class_count(dataset, label))
        return self._copyValues(model)


class KNNClassificationModel(_KNNModelBase, HasLabelCol):
    probabilityCol = KNNClassifier.probabilityCol
    rawPredictionCol = KNNClassifier.rawPredictionCol

    def __init__(self, index: CellIndex | None = None, num_classes: int = 0):
        super().__init__(index)
        self._setDefault(labelCol="label", probabilityCol="", rawPredictionCol="")
        self.numClasses = num_classes

    def _made(self) -> list[T.StructField]:
        kinds = [(self.predictionCol, T.DoubleType()), (self.rawPredictionCol, T.ArrayType(T.DoubleType())), (self.probabilityCol, T.ArrayType(T.DoubleType()))]
        return [T.StructField(self.getOrDefault(p), t) for p, t in kinds if self.getOrDefault(p)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Append the prediction, and votes and vote shares per class where their columns are named."""
        names = {"prediction": self.predictionCol, "raw": self.rawPredictionCol, "probability": self.probabilityCol}
        names = {k: self.getOrDefault(p) for k, p in names.items() if self.getOrDefault(p)}

        def predictions(nn: DataFrame) -> DataFrame:
            out = classify_predictions(nn)
            if len({"raw", "probability"} & names.keys()):
                out = out.join(raw_predictions(nn, self.numClasses), "q_id")
            return out.select("q_id", *[F.col(k).alias(v) for k, v in names.items()])

        return self._predict(dataset, predictions, list(names.values()))


class KNNRegressor(Estimator, _KNNParams, HasLabelCol):
    """k-NN regression: inverse-distance weighted mean of neighbour labels."""

    exactMatch = Param(Params._dummy(), "exactMatch", "mean | sum of labels at distance 0", typeConverter=TypeConverters.toString)
    power = Param(Params._dummy(), "power", "weight = 1 / distance^power", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, k=1, featuresCol="features", labelCol="label", predictionCol="prediction",
                 idCol="id", exactMatch="mean", power=2.0, search="pruned", maxCells=DEFAULT_MAX_CELLS,
                 blockRows=DEFAULT_BLOCK_ROWS, seed=DEFAULT_SEED):
        super().__init__()
        self._setDefault(labelCol="label", exactMatch="mean", power=2.0)
        self._set(**self._input_kwargs)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def _fit(self, dataset: DataFrame) -> "KNNRegressionModel":
        index = self._build(dataset, self.getOrDefault(self.labelCol))
        return self._copyValues(KNNRegressionModel(index))


class KNNRegressionModel(_KNNModelBase, HasLabelCol):
    exactMatch = KNNRegressor.exactMatch
    power = KNNRegressor.power

    def __init__(self, index: CellIndex | None = None):
        super().__init__(index)
        self._setDefault(labelCol="label", exactMatch="mean", power=2.0)

    def _made(self) -> list[T.StructField]:
        name = self.getOrDefault(self.predictionCol)
        return [T.StructField(name, T.DoubleType())] if name else []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pred_col = self.getOrDefault(self.predictionCol)

        def predictions(nn: DataFrame) -> DataFrame:
            out = regress_predictions(nn, self.getOrDefault(self.exactMatch), self.getOrDefault(self.power))
            return out.withColumnRenamed("prediction", pred_col)

        return self._predict(dataset, predictions, [pred_col] if pred_col else [])


class KNNOutlierDetector(Estimator, _KNNParams):
    """Outliers: points that few others list among their k nearest."""

    threshold = Param(Params._dummy(), "threshold", "largest in-degree of an outlier (>= 0)", typeConverter=TypeConverters.toInt)
    key = Param(Params._dummy(), "key", "id | value: count per row or per distinct vector", typeConverter=TypeConverters.toString)
    countSelf = Param(Params._dummy(), "countSelf", "take k+1 places with the point in its own list", typeConverter=TypeConverters.toBoolean)
    indegreeCol = Param(Params._dummy(), "indegreeCol", "in-degree output column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, k=1, threshold=0, key="id", countSelf=False, featuresCol="features",
                 predictionCol="prediction", indegreeCol="indegree", idCol="id", search="pruned",
                 maxCells=DEFAULT_MAX_CELLS, blockRows=DEFAULT_BLOCK_ROWS, seed=DEFAULT_SEED):
        super().__init__()
        self._setDefault(threshold=0, key="id", countSelf=False, indegreeCol="indegree")
        self._set(**self._input_kwargs)

    def setThreshold(self, value: int):
        return self._set(threshold=value)

    def getThreshold(self) -> int:
        return self.getOrDefault(self.threshold)

    def _fit(self, dataset: DataFrame) -> "KNNOutlierModel":
        if self.getOrDefault(self.threshold) < 0:
            raise ValueError("threshold must be at least 0")
        id_col = self.getOrDefault(self.idCol)
        if id_col in dataset.columns:
            n, known, ids = dataset.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
            if not n == known == ids:
                raise ValueError(f"{id_col!r} must name every row once; drop it and rows are numbered")
        return self._copyValues(KNNOutlierModel(self._build(dataset, None)))


class KNNOutlierModel(_KNNModelBase):
    threshold = KNNOutlierDetector.threshold
    key = KNNOutlierDetector.key
    countSelf = KNNOutlierDetector.countSelf
    indegreeCol = KNNOutlierDetector.indegreeCol

    def __init__(self, index: CellIndex | None = None):
        super().__init__(index)
        self._setDefault(threshold=0, key="id", countSelf=False, indegreeCol="indegree")

    def setThreshold(self, value: int):
        return self._set(threshold=value)

    def getThreshold(self) -> int:
        return self.getOrDefault(self.threshold)

    def _made(self) -> list[T.StructField]:
        kinds = [(self.indegreeCol, T.LongType()), (self.predictionCol, T.DoubleType())]
        return [T.StructField(self.getOrDefault(p), t) for p, t in kinds if self.getOrDefault(p)]

    def indegrees(self) -> DataFrame:
        """In-degree of every training point (``key="id"``) or distinct vector (``key="value"``)."""
        self._validate()
        return indegree(self.index, self.getOrDefault(self.k), key=self.getOrDefault(self.key),
                        count_self=self.getOrDefault(self.countSelf), search=self._mode())

    def detect(self) -> DataFrame:
        """Training points (or vectors) with in-degree at most ``threshold``. A pure function: call it as often as you like."""
        return outliers(self.indegrees(), self.getOrDefault(self.threshold))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Append the in-degree and ``prediction`` (1.0 = outlier) to training rows.

        Rows are matched by id, or by vector where they have none (or for
        ``key="value"``); rows of equal vectors then take the largest
        in-degree among them. Empty column names add no column.
        """
        deg_col = self.getOrDefault(self.indegreeCol)
        pred_col = self.getOrDefault(self.predictionCol)
        named = [c for c in (deg_col, pred_col) if c]
        clash = [c for c in named if c in dataset.columns]
        if clash:
            raise ValueError(f"output column(s) {clash} already exist")
        deg = self.indegrees()
        id_col = self.getOrDefault(self.idCol)
        if self.getOrDefault(self.key) == "id" and id_col in dataset.columns:
            out = dataset.join(deg.select(F.col("id").alias(id_col), F.col("indegree").alias("_degree")), id_col, "left")
        else:
            deg = deg.groupBy(F.col("features").alias("_fv")).agg(F.max("indegree").alias("_degree"))
            keyed = dataset.withColumn("_fv", as_array(dataset, self.getOrDefault(self.featuresCol)))
            out = keyed.join(deg, "_fv", "left")
        made = {deg_col: F.col("_degree"), pred_col: (F.col("_degree") <= self.getOrDefault(self.threshold)).cast("double")}
        return out.select(*dataset.columns, *[made[c].alias(c) for c in named])
