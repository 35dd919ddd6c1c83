"""What the two text classifiers share: held-out rows, the bounded training sample, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelry.llm.shared import among, saved

#: A model is fitted on at most so many labelled documents, half of them of either label where there are enough.
SAMPLE_DOCS = 8000
#: Hashed features.
BITS = 18

#: From Arrow texts to, per slice: first text, how many, and feature numbers with the text each belongs to.
Features = Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


def is_held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; a null id is never held out and never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE_DOCS) -> DataFrame:
    """(text, y) of at most ``size`` labelled documents outside the held-out fifth, chosen by hash.

    Documents with a null label or id are left out; of rows that share an id one is used.
    """
    named = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = named.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    many = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Only about twice the rows that are wanted of a label get as far as its window.
    draw, scale = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)), 1 << 20
    most = F.when(F.col("y") == 1, F.lit(size * scale // max(1, many.get(1, 0)))).otherwise(F.lit(size * scale // max(1, many.get(0, 0))))
    ranked = known.withColumn("draw", draw).where(F.col("draw") < most).withColumn(
        "n", F.row_number().over(Window.partitionBy("y").orderBy("draw", "doc_id"))
    )
    chosen = saved(ranked.where(F.col("n") <= size // 2).select("doc_id", "y"), "chosen")
    texts = among(docs.select("doc_id", "text"), chosen, "doc_id").join(chosen, "doc_id")
    return texts.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "y")


def rows_of(features: Features, texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    out: list[np.ndarray] = []
    for _, n, owner, feature in features(texts):
        pairs = np.unique((owner.astype(np.int64) << BITS) | feature)
        cuts = np.searchsorted(pairs, np.arange(1, n) << BITS)
        out += [x & ((1 << BITS) - 1) for x in np.split(pairs, cuts)]
    return out


def fitted(sample: DataFrame, features: Features, fit: Callable[[list[np.ndarray], np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The model that ``fit`` makes of the sample's features. Features are made on all executors; the bounded
    sample is fitted in one task, in the order of its content, so a rerun gives the same model."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.astype("<i4").tobytes() for x in rows_of(features, batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "y"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"])
        model = fit([np.frombuffer(x, "<i4") for x in rows["x"]], rows["y"].to_numpy(np.int64))
        return pd.DataFrame({"name": list(model), "value": [np.ascontiguousarray(v, np.float64).tobytes() for v in model.values()]})

    learnt = sample.mapInArrow(featured, "x binary, y int").withColumn("whole", F.lit(1)).groupBy("whole").applyInPandas(learn, "name string, value binary")
    return {r["name"]: np.frombuffer(bytes(r["value"])) for r in learnt.collect()}


def score_column(score: Callable[[pa.Array], np.ndarray], text: Column) -> Column:
    """The score of a text column, computed on whole Arrow batches."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts), pa.float64())

    return run(text)


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], least: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return docs.select(
        F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), score_column(score, F.col("text")).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
