"""Language: first the family, then one-versus-one linear support vector machines inside it.

Features are the shares of hashed byte triples of a text. A family is chosen by one-versus-rest linear
machines; then every pair of its languages has a machine of its own, and the language with most votes wins
(ties: larger sum of margins, then the name). All machines are linear in the shares, so the tasks add up one
row of weights per byte and never build a feature vector.

Fitting takes chunks of at most ``ROWS`` rows over all languages, shared evenly, but ``LEAST`` of each language
however many there are (``samples``). Every language is learned; those missing from ``FAMILIES`` form families of
their own.

Cases: a text that is null or has no letter is ``und`` with score 0; so is every text when nothing could be
learned. With one language learned it is predicted with score 1. Repeated rows are predicted each; an empty
table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.samples import held_out, labelled_chunks
from eventlens.llm.texts import lowered, prepare, slices, spread

FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
}
ROWS = 2000
LEAST = 2
# Hashed byte triples.
FEATURES = 4096
EPOCHS = 12
# Strength of the regulariser of the machines.
LAMBDA = 1e-4
UNKNOWN = "und"
# Bytes of text per step of a task.
STEP_BYTES = 4 << 20


class Model(NamedTuple):
    families: list[str]
    members: list[list[str]]
    # One column per family, then one per pair of languages of a family, in the order of ``combinations``.
    weights: np.ndarray
    shifts: np.ndarray


def triples(flat: np.ndarray) -> np.ndarray:
    """The hashed triple that starts at every byte but the last two."""
    wide = lowered(flat).astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int32)


def shares(texts: list[bytes]) -> np.ndarray:
    """The features of every text, scaled so that they are about 1 in length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in enumerate(texts):
        found = triples(np.frombuffer(b" " + text + b"  ", np.uint8))
        out[row] = np.bincount(found, minlength=FEATURES) / len(found)
    return out * SCALE


SCALE = np.float32(8.0)


def machine(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged stochastic subgradients; y is -1 or 1, both sides weigh the same."""
    rng = np.random.default_rng(seed)
    weight, shift = np.zeros(x.shape[1], np.float32), 0.0
    mean, mean_shift, steps = np.zeros_like(weight), 0.0, 0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    batch = 32
    for epoch in range(EPOCHS):
        rate = 4.0 / (1 + epoch)
        for at in np.split(rng.permutation(len(y)), range(batch, len(y), batch)):
            own, sign = x[at], y[at]
            wrong = (sign * (own @ weight + shift) < 1) * sign * share[at] / len(at)
            weight = weight * (1 - rate * LAMBDA) + (rate * (wrong @ own)).astype(np.float32)
            shift += 0.1 * rate * float(wrong.sum())
            if epoch >= EPOCHS // 2:
                mean, mean_shift, steps = mean + weight, mean_shift + shift, steps + 1
    return mean / max(1, steps), mean_shift / max(1, steps)


def fit(chunks: dict[str, list[bytes]], families: dict[str, str] | None = None) -> Model:
    known = FAMILIES if families is None else families
    languages = sorted(chunks)
    of = {language: known.get(language, language) for language in languages}
    names = sorted(set(of.values()))
    members = [[lang for lang in languages if of[lang] == name] for name in names]
    x = shares([c for lang in languages for c in chunks[lang]])
    which = np.repeat(np.arange(len(languages)), [len(chunks[lang]) for lang in languages])
    family = np.array([names.index(of[lang]) for lang in languages], int)[which] if languages else which
    columns = [machine(x, np.where(family == i, 1.0, -1.0), i) if len(names) > 1 else (np.zeros(FEATURES, np.float32), 0.0) for i in range(len(names))]
    for own in members:
        for a, b in combinations(own, 2):
            some = (which == languages.index(a)) | (which == languages.index(b))
            columns.append(machine(x[some], np.where(which[some] == languages.index(a), 1.0, -1.0), len(columns)))
    weights = np.stack([w for w, _ in columns], axis=1) * SCALE if columns else np.zeros((FEATURES, 0), np.float32)
    return Model(names, members, np.ascontiguousarray(weights, np.float32), np.array([s for _, s in columns]))


def margins(model: Model, flat: np.ndarray, offsets: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """All machines' answers for the texts of a slice. A blank stands before a text and two behind it, so n bytes have n + 1 triples."""
    sizes = np.diff(offsets)
    starts = offsets[:-1] + 3 * np.arange(len(sizes))
    ends = starts + sizes + 3
    padded = np.full(int(ends[-1]), 0x20, np.uint8)
    padded[spread(sizes, starts + 1)] = flat
    used = np.ones(len(padded), bool)
    used[ends - 1] = used[ends - 2] = False
    found = triples(padded)[used[:-2]]
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    total = np.zeros((len(sizes), model.weights.shape[1]))
    row = 0
    while row < len(sizes):  # rows together up to a step, a longer one in parts
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + step, side="right")) - 1)
        if stop > row + 1 or bounds[stop] - bounds[row] <= step:
            total[row:stop] = np.add.reduceat(model.weights[found[bounds[row] : bounds[stop]]], bounds[row:stop] - bounds[row], axis=0, dtype=np.float64)
        else:
            for at in range(int(bounds[row]), int(bounds[stop]), step):
                total[row] += model.weights[found[at : min(at + step, bounds[stop])]].sum(axis=0, dtype=np.float64)
        row = stop
    return total / (sizes + 1)[:, None] + model.shifts


def decide(model: Model, answers: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of every row of answers: the family's share, times the language's share within it."""
    names, score = [], np.zeros(len(answers))
    if not model.families:
        return [UNKNOWN] * len(answers), score
    count = len(model.families)
    family = answers[:, :count].argmax(axis=1)
    shares_ = np.exp(2 * (answers[:, :count] - answers[:, :count].max(axis=1, keepdims=True)))
    score = (shares_ / shares_.sum(axis=1, keepdims=True))[np.arange(len(answers)), family]
    out = np.empty(len(answers), object)
    first = count
    for i, own in enumerate(model.members):
        pairs = list(combinations(range(len(own)), 2))
        rows = np.flatnonzero(family == i)
        votes, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
        for k, (a, b) in enumerate(pairs):
            answer = answers[rows, first + k]
            votes[:, a] += answer > 0
            votes[:, b] += answer <= 0
            sums[:, a] += answer
            sums[:, b] -= answer
        best = np.lexsort((np.broadcast_to(-np.arange(len(own)), votes.shape), sums, votes), axis=1)[:, -1]
        out[rows] = np.array(own, object)[best]
        within = np.exp(2 * (sums - sums.max(axis=1, keepdims=True)))
        score[rows] *= within[np.arange(len(rows)), best] / within.sum(axis=1)
        first += len(pairs)
    return out.tolist(), score


def learn(docs: DataFrame, families: dict[str, str] | None = None) -> Model:
    """The machines fitted on rows outside the held-out fold. Learns from text and language alone."""
    prepare(docs.sparkSession)
    marks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"))
    marks = marks.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    languages = marks.agg(F.count_distinct("label").alias("n")).first().n
    if not languages:
        return fit({}, families)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("text").rlike(r"\p{L}"))
    return fit(labelled_chunks(texts, marks, max(LEAST, ROWS // languages)), families)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in slices(batches, size=STEP_BYTES):
            names, score = decide(model, margins(model, flat, offsets))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("letters"), pa.array(names, pa.string()), pa.array(score)],
                names=["doc_id", "letters", "lang", "found"],
            )

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return read.mapInArrow(run, "doc_id long, letters boolean, lang string, found double").select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        F.when(F.col("letters"), F.col("lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("letters"), F.col("found")).otherwise(F.lit(0.0)).alias("score"),
    )
