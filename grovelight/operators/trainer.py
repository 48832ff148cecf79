"""From parameters to a tested model: load, split, train, test, write."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.operators import prediction as pr
from grovelight.operators import sampling as sa
from grovelight.operators.growth import is_sparse
from grovelight.operators.training import Trained, select_model, train
from grovelight.params import ForestParams, from_file
from grovelight.sources import formats


@dataclass
class Report:
    """What a run came to: the model, accuracy on the test part, seconds of each step, scores of model selection."""

    model: Trained
    accuracy: float | None  # None where it was not asked for, or without test rows
    n_test: int
    seconds: dict[str, float]
    scores: list[dict] = field(default_factory=list)
    tests: list[dict] = field(default_factory=list)
    dump: str = ""


@dataclass
class Trainer:
    """A run over a data set. Standard and rotation forests use parts of 70 and 30 %, model selection 60, 20 and 20 %."""

    spark: SparkSession
    params: ForestParams

    @classmethod
    def of_file(cls, spark: SparkSession, path: str | Path) -> Trainer:
        return cls(spark, from_file(path))

    def load(self) -> DataFrame:
        """row_id, label, features (idx, val where sparse working data are wanted) of the data set; row_id is a hash of the record where the file has none."""
        p = self.params
        if p.num_features <= 0:
            p = self.params = p.with_features(formats.count_features(self.spark, p.dataset, p.file_type))
        arity, remap = p.category_specs()
        kind = "SPARSE" if p.sparse and p.file_type.upper() in ("LIBSVM", "SVM") else p.file_type
        d = formats.read(self.spark, p.dataset, kind, p.num_features, remap, arity)
        cols = ["idx", "val"] if is_sparse(d) else ["features"]
        if "row_id" in d.columns:
            return d.select("row_id", "label", *cols)
        # equal records may share a number: they then fall into the same part and bags, which is harmless
        return d.select(F.xxhash64("label", *cols).alias("row_id"), "label", *cols)

    def run(self) -> Report:
        p, took = self.params, {}
        began = time.time()

        def step(name: str) -> None:
            nonlocal began
            took[name] = round(time.time() - began, 3)
            began = time.time()

        rows = self.load()
        p = self.params
        shares, names = ((0.6, 0.2, 0.2), ("train", "check", "test")) if p.model_selection else ((0.7, 0.3), ("train", "test"))
        rows = sa.split(rows, shares, names, p.seed).persist()
        part = {n: rows.filter(F.col("split") == n).drop("split") for n in names}
        n_test = part["test"].count()
        step("load")
        scores, tests = [], []
        if p.model_selection:
            s = select_model(part["train"], part["check"], p, part["test"])
            model, scores, tests = s.best, s.scores, s.tests
        else:
            model = train(part["train"], p)
        step("train")
        got = None
        if not p.skip_accuracy:
            label = F.greatest(F.col("label"), F.lit(0)).cast("int")
            got = pr.accuracy(model.predict(part["test"]).withColumn("label", label)).first().accuracy
            step("test")
        out = Report(model, got, n_test, took, scores, tests, model.dump() if p.output_tree else "")
        rows.unpersist()
        if p.output:
            self.write(out)
        return out

    def write(self, r: Report) -> None:
        """Below the output folder: the model, and where asked for statistics (appended) and the tree dump."""
        at, spark = self.params.output, self.spark
        formats.save_trained(spark, r.model, f"{at}/model")
        if self.params.log_stats:
            formats.append_stats(spark.createDataFrame([(self.params.dataset, r.n_test, r.accuracy)], "dataset string, n_test long, accuracy double"), f"{at}/stats")
            formats.append_stats(spark.createDataFrame([(k, v) for k, v in r.seconds.items()], "step string, seconds double"), f"{at}/stats-time")
            for name, rows in (("checking", r.scores), ("testing", r.tests)):
                if rows:
                    formats.append_stats(spark.createDataFrame([tuple(x.values()) for x in rows], "forest int, bins int, multiplier double, trees int, depth int, accuracy double"), f"{at}/stats-model-selection-{name}")
        if r.dump:
            spark.createDataFrame([(r.dump,)], "value string").write.mode("overwrite").text(f"{at}/trees")
