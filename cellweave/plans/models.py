"""Queries that train and apply window models on the grid of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lattice import SIDE, document_cells
from ..operators import training
from .core import query

# Each fourth scenario tests; a cell's load is a hundredth of its quantity.
_CHANNELS = ["fuel", "slope", "elevation"]
_SMALL = {"channels": _CHANNELS, "label": "load", "size": SIDE, "by": ["scenario"], "widths": (6, 6, 6), "dense": 12, "steps": 2, "tile": SIDE, "rate": 5e-3}


def _cells(spark, sf_dir: str) -> DataFrame:
    split = F.when(F.col("scenario") % 4 == 3, "test").otherwise("train")
    return document_cells(spark, sf_dir).withColumns({"split": split, "load": F.col("q") / 100})


@query("load_model_history")
def load_model_history(spark, sf_dir: str) -> DataFrame:
    """Losses of each epoch: training scenarios train, the others test."""
    model = training.train(_cells(spark, sf_dir), window=9, epochs=6, **_SMALL)
    return spark.createDataFrame(model.history, "epoch int, train_loss double, test_loss double, burned_mse double, burned_rmse double, rate double")


@query("load_model_sweep")
def load_model_sweep(spark, sf_dir: str) -> DataFrame:
    """The best test loss of each window size."""
    return spark.createDataFrame(training.sweep(_cells(spark, sf_dir), epochs=2, **_SMALL), "atomic_size int, best_test_loss double, n_params int, epochs int")


@query("predicted_load")
def predicted_load(spark, sf_dir: str) -> DataFrame:
    """A trained model's load of every cell of all scenarios."""
    cells = _cells(spark, sf_dir)
    model = training.train(cells, window=9, epochs=4, **_SMALL)
    return model.predict(cells, SIDE, ["scenario"], SIDE, 100.0)


@query("burn_probability")
def burn_probability(spark, sf_dir: str) -> DataFrame:
    """The probability of every cell to hold a load above 0.75, by a classifier."""
    cells = _cells(spark, sf_dir).withColumn("load", F.greatest(F.col("load") - 0.75, F.lit(0.0)))
    model = training.train(cells, window=9, epochs=4, target="burn", **_SMALL)
    return model.predict(cells, SIDE, ["scenario"], SIDE, value="probability")
