"""Quality of labelled predictions. All of it comes from one table of label pairs and their counts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventlens.functions.numbers import known
from eventlens.operators.ordered import CHUNK, range_chunks
from eventlens.session import settle


def label_pairs(df: DataFrame, true: Column, predicted: Column) -> DataFrame:
    """(true, pred, n); a missing label is a label of its own, ``None``."""
    none = F.lit("None")
    return df.groupBy(
        F.coalesce(true.cast("string"), none).alias("true"), F.coalesce(predicted.cast("string"), none).alias("pred")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """(true, pred, n): the cells that occur, or with ``labels`` every cell of these, 0 where none occurs."""
    if labels is None:
        return pairs.where(F.col("n") > 0).select("true", "pred", "n")
    cells = F.array(*[F.struct(F.lit(str(t)).alias("true"), F.lit(str(p)).alias("pred")) for t in labels for p in labels])
    grid = pairs.sparkSession.range(1).select(F.inline(cells))
    return grid.join(pairs, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support, hits) per label; what is undefined is 0."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("true") == F.col("pred"), n).otherwise(zero)
    sides = F.inline(
        F.array(
            F.struct(F.col("true").alias("label"), n.alias("support"), zero.alias("predicted"), hit.alias("hits")),
            F.struct(F.col("pred").alias("label"), zero.alias("support"), n.alias("predicted"), zero.alias("hits")),
        )
    )
    per = pairs.select(sides).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    hits = F.col("hits")
    return per.select(
        "label",
        share(hits, F.col("predicted")).alias("precision"),
        share(hits, F.col("support")).alias("recall"),
        share(2 * hits, F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hits",
    )


def weighted_scores(pairs: DataFrame) -> DataFrame:
    """One row (precision, recall, f1), weighted by support."""
    total = F.sum("support")
    return class_metrics(pairs).agg(
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("precision", "recall", "f1")]
    )


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support): the labels, then accuracy, macro and weighted averages.

    Accuracy stands in the f1 column.
    """
    per = class_metrics(pairs)
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    none = F.lit(None).cast("double")
    averages = per.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                none.alias("precision"),
                none.alias("recall"),
                (F.sum("hits") / total).alias("f1"),
                total.alias("support"),
            ),
            F.struct(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in names], total.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in names],
                total.alias("support"),
            ),
        ).alias("rows")
    )
    return per.drop("hits").unionByName(averages.select(F.inline("rows")))


def roc_auc(df: DataFrame, true: Column, score: Column, by: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """(by, roc_auc): exact area under the ROC curve, ties counting half; null with one class only.

    Labels are 0 and 1, any other raises. Rows without a label or a score (null, NaN) do not count.
    Scores are counted first; each chunk of the sorted scores keeps its own running count, and the
    chunk totals supply what lies below a chunk.
    """
    refused = F.raise_error(F.concat(F.lit("not a label of two classes: "), true.cast("string"))).cast("int")
    positive = F.when(true == 1, 1).when(true == 0, 0).otherwise(refused)
    labelled = df.where(true.isNotNull()).select(*by, known(score).alias("s"), positive.alias("p"))
    counts = labelled.groupBy(*by, "s").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("q"))
    rows = range_chunks(counts.where(F.col("s").isNotNull()), by, ["s"], chunks)
    running = W.partitionBy(CHUNK, *by).orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)
    below = F.sum("q").over(running) - F.col("q") / 2
    per_chunk = (
        rows.withColumn("wins", F.col("p") * below)
        .groupBy(*by, CHUNK)
        .agg(F.sum("wins").alias("wins"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    )
    before = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("q").over(before), F.lit(0))
    total = per_chunk.withColumn("wins", F.col("wins") + F.col("p") * offset).groupBy(*by).agg(
        F.sum("wins").alias("wins"), F.sum("p").alias("p"), F.sum("q").alias("q")
    )
    area = F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("q"))
    return total.select(*by, area.alias("roc_auc"))


def evaluate(
    df: DataFrame,
    true: Column,
    predicted: Column,
    timestamp: str,
    score: Column | None = None,
    model_info: Mapping | None = None,
    seq: int = 0,
) -> DataFrame:
    """One metrics record, as ``write_metrics`` stores it: seq, timestamp, precision, recall, f1, roc_auc,
    confusion_matrix, classification_report and model_info.

    The matrix is the list of its cells that occur, by label; the report is a map from label to its
    scores. Both have as many entries as there are labels and pairs of labels. ``model_info`` becomes JSON text.
    """
    # Written once: one small row per pair of labels, read by all of the below.
    pairs = settle(label_pairs(df, true, predicted))
    cells = confusion_matrix(pairs).agg(F.array_sort(F.collect_list(F.struct("true", "pred", "n"))))
    entry = F.struct("label", F.struct("precision", "recall", "f1", "support").alias("v"))
    nested = class_report(pairs).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))))
    area = roc_auc(df, true, score).scalar() if score is not None else F.lit(None).cast("double")
    return weighted_scores(pairs).select(
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(timestamp).alias("timestamp"),
        "precision",
        "recall",
        "f1",
        area.alias("roc_auc"),
        cells.scalar().alias("confusion_matrix"),
        nested.scalar().alias("classification_report"),
        F.lit(json.dumps(model_info, sort_keys=True) if model_info is not None else None).cast("string").alias("model_info"),
    )
