"""TF-IDF of short texts, refitted per scope: smooth idf, unit length per text, mean over all texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventlens.operators.joins import join_null_safe
from eventlens.operators.ranked import first_ranked

# Fixed value: words of two or more word characters.
WORD = r"(?U)\b\w\w+\b"


def words_of(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case words in order, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def runs_of(words: str, size: int) -> Column:
    """Every ``size`` neighbouring words of a list column, joined by a blank."""
    kept = F.col(words)
    if size == 1:
        return kept
    none = F.array().cast("array<int>")
    starts = F.when(F.size(kept) >= size, F.sequence(F.lit(1), F.size(kept) - F.lit(size - 1))).otherwise(none)
    return F.transform(starts, lambda i: F.array_join(F.slice(kept, i, size), " "))


def term_counts(texts: DataFrame, stop_words: Sequence[str], ngrams: tuple[int, int]) -> DataFrame:
    """The other columns of ``texts`` with one row per different term of ``text``: (term, tf).

    The empty term occurs once in every text. A text's terms are sorted in place and the lengths of
    equal runs read off, so counting needs no shuffle. Each list is a column of its own before
    lambdas look into it, or Spark would build it anew for every element.
    """
    rest = [c for c in texts.columns if c != "text"]
    low, high = ngrams
    listed = texts.select(*rest, words_of(F.col("text"), stop_words).alias("words"))
    ordered = listed.select(
        *rest, F.sort_array(F.concat(F.array(F.lit("")), *[runs_of("words", n) for n in range(low, high + 1)])).alias("terms")
    )
    # Positions, from 1, at which a new term begins.
    terms, starts = F.col("terms"), F.col("starts")
    begins = F.filter(
        F.sequence(F.lit(1), F.size(terms)), lambda i: ~F.get(terms, i - 1).eqNullSafe(F.get(terms, i - 2))
    )
    cut = ordered.select(*rest, "terms", begins.alias("starts"))
    counts = F.transform(
        starts,
        lambda i, j: F.struct(
            F.get(terms, i - 1).alias("term"), (F.coalesce(F.get(starts, j + 1), F.size(terms) + 1) - i).alias("tf")
        ),
    )
    # A plain inline would first filter on the list's size, and Spark moves that below the grouping
    # of the texts: every text would be split into words twice.
    return cut.select(*rest, counts.alias("counts")).select(*rest, F.inline_outer("counts"))


def text_counts(df: DataFrame, by: Sequence[str], text: Column, times: Column | None = None) -> DataFrame:
    """(by, text, n): how often each text occurs, a null one as the empty text; a row may stand for several."""
    times = F.lit(1) if times is None else times
    return df.select(*by, F.coalesce(text, F.lit("")).alias("text"), times.cast("bigint").alias("n")).groupBy(*by, "text").agg(F.sum("n").alias("n"))


def mean_tfidf(
    df: DataFrame,
    by: Sequence[str],
    text: Column,
    max_features: int = 100,
    stop_words: Sequence[str] | None = None,
    ngrams: tuple[int, int] = (1, 1),
) -> DataFrame:
    """``mean_tfidf_of`` the rows' texts."""
    return mean_tfidf_of(text_counts(df, by, text), by, max_features, stop_words, ngrams)


def mean_tfidf_of(
    texts: DataFrame,
    by: Sequence[str],
    max_features: int = 100,
    stop_words: Sequence[str] | None = None,
    ngrams: tuple[int, int] = (1, 1),
) -> DataFrame:
    """(by, i, term, weight): the ``max_features`` most frequent terms, numbered alphabetically.

    A null text is an empty one and counts as a text. Equal texts are handled once with their
    number. A scope without any term has no row. Ties at the cut go to the alphabetically first.
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    # The text's hash stands for it from here on. The empty term's row counts the texts.
    hashed = texts.select(*by, F.unhex(F.sha2("text", 256)).alias("doc"), "n", "text")
    tf = term_counts(hashed, stop_words, ngrams).where(F.col("term").isNotNull())
    counter = F.col("term") == ""
    totals = tf.groupBy(*by, "term").agg(F.sum(F.col("tf") * F.col("n")).alias("total"), F.sum("n").alias("df"))
    # One more for the empty term, which stays in front.
    kept = first_ranked(totals, by, [F.desc(counter), F.desc("total"), "term"], max_features + 1)
    vocabulary = (
        kept.withColumn("texts", F.max(F.when(counter, F.col("df"))).over(W.partitionBy(*by)))
        .withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("term")) - 2)
        .where(F.col("i") >= 0)
        .select(*by, "term", "i", "texts", (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    # Both sides start from the same term counts, which Spark computes once.
    weighted = join_null_safe(tf, vocabulary, [*by, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    # At most max_features rows per text.
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*by, "doc")))
    return (
        weighted.withColumn("unit", F.col("n") * F.col("w") / length)
        .groupBy(*by, "i", "term")
        .agg((F.sum("unit") / F.max("texts")).alias("weight"))
    )
