"""Quality classifier: a convolutional network over bytes, in numpy.

A text is read in overlapping chunks of two blocks, one block apart, that cover all of it. Filters of
``WIDTH`` bytes, learned as one weight per byte value and place, move over every byte; each filter's highest
answer in a chunk goes through a hidden layer to the chunk's logit, and the mean logit over all chunks gives
the text's probability. Blocks are filtered once and pooled in pairs.

Fitting takes chunks of at most ``PER_LABEL`` labelled rows per label (``samples``); the network of some
tens of thousands of weights goes to the tasks with their code.

Cases: a null or empty text is one chunk of padding and gets a score like any other. With labels of one kind
only, every score is that label; with none, 0.5. Labels of unknown ids and null labels are left out. Repeated
rows are scored each; an empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.samples import CHUNK, held_out, labelled_chunks
from eventlens.llm.texts import prepare, released, slices

BLOCK = CHUNK // 2
WIDTH = 4
FILTERS = 32
HIDDEN = 16
# Rows per label that the network is fitted on.
PER_LABEL = 2000
# Passes over the sample, and batches at least: a small sample is passed more often.
EPOCHS = 16
STEPS = 1200
BATCH = 64
RATE = 0.004
# Bytes of text per step of a task: blocks and their answers take some twenty times as much.
STEP = 4 << 20
# Score from which a text counts as good.
CUTOFF = 0.3

Network = dict[str, np.ndarray]


def blocks(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of BLOCK bytes and the WIDTH - 1 that follow, as 1 to 256 with 0 behind the end of a text; the blocks of each text."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // BLOCK))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[row] + (np.arange(len(row)) - bounds[row]) * BLOCK
    places = starts[:, None] + np.arange(BLOCK + WIDTH - 1)
    inside = places < offsets[row + 1][:, None]
    out = np.zeros(places.shape, np.uint16)
    out[inside] = flat[places[inside]].astype(np.uint16) + 1
    return out, bounds


def answers(net: Network, block: np.ndarray) -> np.ndarray:
    """Every filter at every place of the blocks."""
    total = net["filters"][0].take(block[:, :BLOCK], axis=0)
    for k in range(1, WIDTH):
        total += net["filters"][k].take(block[:, k : k + BLOCK], axis=0)
    return total


def pooled(net: Network, block: np.ndarray, step: int = 128) -> np.ndarray:
    return np.concatenate([answers(net, block[i : i + step]).max(axis=1) for i in range(0, len(block), step)])


def logits(net: Network, pools: np.ndarray) -> np.ndarray:
    hidden = np.maximum(np.maximum(pools + net["shift"], 0) @ net["inner"] + net["inner_shift"], 0)
    return hidden @ net["outer"] + net["outer_shift"]


def scores(net: Network, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of every text of a slice."""
    if "constant" in net:
        return np.full(len(offsets) - 1, float(net["constant"]))
    block, bounds = blocks(flat, offsets)
    pools = pooled(net, block)
    # Chunk i is blocks i and i + 1; a text's last block is the second one of its last chunk.
    pairs = pools.copy()
    pairs[:-1] = np.maximum(pools[:-1], pools[1:])
    counts = np.diff(bounds)
    lasts = bounds[1:] - 1
    chunk = np.ones(len(pools), bool)
    chunk[lasts[counts > 1]] = False
    pairs[lasts] = pools[lasts]
    found = np.where(chunk, logits(net, pairs).astype(np.float64), 0.0)
    mean = np.add.reduceat(found, bounds[:-1]) / np.maximum(1, counts - 1)
    return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def fit(chunks: dict[int, list[bytes]], seed: int = 7) -> Network:
    """The network for chunks labelled 1 (good) and 0, by Adam on the logistic loss."""
    if not chunks.get(0) or not chunks.get(1):
        return {"constant": np.array(1.0 if chunks.get(1) else 0.0 if chunks.get(0) else 0.5)}
    rng = np.random.default_rng(seed)
    texts = chunks[0] + chunks[1]
    target = np.repeat([0.0, 1.0], [len(chunks[0]), len(chunks[1])]).astype(np.float32)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    block, bounds = blocks(flat, offsets)
    second = np.minimum(bounds[:-1] + 1, bounds[1:] - 1)
    net = {
        "filters": rng.normal(0, 0.5, (WIDTH, 257, FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32),
        "inner": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32),
        "inner_shift": np.zeros(HIDDEN, np.float32),
        "outer": rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32),
        "outer_shift": np.zeros((), np.float32),
    }
    first_moment = {k: np.zeros_like(v) for k, v in net.items()}
    second_moment = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            step += 1
            for name, grad in _gradients(net, block, bounds[:-1][own], second[own], target[own]).items():
                first_moment[name] = 0.9 * first_moment[name] + 0.1 * grad
                second_moment[name] = 0.999 * second_moment[name] + 0.001 * grad * grad
                rate = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                net[name] = (net[name] - rate * first_moment[name] / (np.sqrt(second_moment[name]) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Network, block: np.ndarray, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> Network:
    both = np.concatenate((first, second))
    found = answers(net, block[both])
    place = found.argmax(axis=1)
    best = np.take_along_axis(found, place[:, None], axis=1)[:, 0]
    half = len(first)
    later = best[half:] > best[:half]
    pools = np.where(later, best[half:], best[:half])
    rows, places = np.where(later, second[:, None], first[:, None]), np.where(later, place[half:], place[:half])
    opened = np.maximum(pools + net["shift"], 0)
    inner = opened @ net["inner"] + net["inner_shift"]
    hidden = np.maximum(inner, 0)
    error = (1 / (1 + np.exp(-np.clip(hidden @ net["outer"] + net["outer_shift"], -30, 30))) - target) / len(target)
    to_inner = error[:, None] * net["outer"] * (inner > 0)
    to_pools = (to_inner @ net["inner"].T) * (opened > 0)
    filters = np.zeros_like(net["filters"])
    column = np.broadcast_to(np.arange(FILTERS), places.shape)
    for k in range(WIDTH):
        np.add.at(filters[k], (block[rows, places + k], column), to_pools)
    return {
        "filters": filters, "shift": to_pools.sum(0), "inner": opened.T @ to_inner, "inner_shift": to_inner.sum(0),
        "outer": hidden.T @ error, "outer_shift": error.sum(),
    }


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """The network fitted on labelled rows outside the held-out fold. Learns from text and the label alone."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.where(~held_out(F.col("doc_id"), 5, 0) & F.col("label").isin(0, 1))
    return fit(labelled_chunks(texts, marks, PER_LABEL))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in slices(batches, size=STEP):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(net, flat, offsets))], names=["doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(released(run), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, net: Network) -> DataFrame:
    """The rows that score at least CUTOFF, with all their columns: one pass, no shuffle. Only texts go to Python, and answers come back."""
    prepare(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        found = [scores(net, flat, offsets) >= CUTOFF for _, flat, offsets in slices(iter([batch]), size=STEP)]
        return pa.array(np.concatenate([np.empty(0, bool), *found]))

    return docs.where(good(F.col("text").cast("string")))
