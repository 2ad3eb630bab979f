"""Quality of documents by a convolutional network over their bytes, in numpy.

A text is read as bytes. At every ``STRIDE``-th byte (each one, as set here) a set of learned
filters looks at ``WIDTH`` embedded bytes; positions are pooled by maximum within chunks of ``CHUNK`` bytes, where a
chunk also sees the first ``WIDTH - STRIDE`` bytes of the next one, so that chunks overlap
and every window of the document lies in one. The chunks of a document are combined by
their maximum and their mean; from these and the logarithm of the length two dense layers
make one probability.

The network is trained on a bounded sample of labelled documents (:mod:`labelled`), with
Adam, from a fixed seed; scoring reads every byte of every document. Labels, language,
source and id are no inputs.

With a stride of one a pattern is seen wherever it stands: bytes put in front of a text change
the windows at its start and where chunks are cut, nothing else.

Defined cases: null and empty texts get the score of a text without any byte; very long
texts are scored whole; a score at the threshold counts as label 1; rows that repeat get one
score each, a null ``doc_id`` is never held out; a table without labels of both kinds gives
every document the share of label 1 (0.5 without any); an empty table gives no rows. Columns
other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_row, joined_bytes, text_or_empty
from tidemark.llm.labelled import batches, sample, scored

EMBEDDING = 6
WIDTH = 12
STRIDE = 1
FILTERS = 24
HIDDEN = 16
CHUNK = 512
STEPS = 1000
BATCH = 48
RATE = 4e-3
SEED = 8
# Weights of a document of label 0 and of label 1 in training: losing a good one costs more.
COSTS = (0.6, 1.4)
THRESHOLD = 0.3

# Positions convolved at once.
BLOCK = 1 << 16


def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "embedding": normal(256, EMBEDDING, scale=0.5),
        "filters": normal(WIDTH * EMBEDDING, FILTERS, scale=(WIDTH * EMBEDDING) ** -0.5),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
        "length": np.zeros(HIDDEN, np.float32),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, scale=HIDDEN**-0.5),
        "out_bias": np.zeros((), np.float32),
    }


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, first window (in strides) and end of each chunk, chunks and size of each text.

    A text takes a whole number of strides and is followed by zero bytes. Windows start
    within their text (the only one of an empty text, behind it), so none reaches the next.
    """
    padded = [t + b"\0" * (-len(t) % STRIDE) for t in texts]
    data, starts, lengths = joined_bytes(padded, gap=-(-WIDTH // STRIDE) * STRIDE)
    n_chunks = np.maximum(1, -(-lengths // CHUNK))
    begin = np.repeat(starts // STRIDE, n_chunks)
    end = begin + np.repeat(np.maximum(1, lengths // STRIDE), n_chunks)
    nth = np.arange(int(n_chunks.sum())) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    sizes = np.log2(1 + np.fromiter(map(len, texts), np.float32, len(texts))) / 10
    first = begin + nth * (CHUNK // STRIDE)
    return data, first, np.minimum(first + CHUNK // STRIDE, end), n_chunks, sizes


def _activations(model: dict, data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Filter outputs at windows ``a`` to ``b``."""
    rows = model["embedding"][data[a * STRIDE : (b - 1) * STRIDE + WIDTH]]
    flat = np.lib.stride_tricks.as_strided(
        rows, (b - a, WIDTH * EMBEDDING), (STRIDE * rows.strides[0], rows.strides[1]), writeable=False
    )
    # Overlapping rows are copied: the product is a plain one then.
    return np.ascontiguousarray(flat) @ model["filters"]


def _maxima(outputs: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maxima from ``first`` to ``end``; ``outputs`` stops where the last range does."""
    cuts = np.column_stack((first, end)).ravel()[:-1]
    return np.maximum.reduceat(outputs, cuts, axis=0)[::2]


def chunk_maxima(model: dict, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest output of each filter in each chunk."""
    out = np.empty((len(first), FILTERS), model["filters"].dtype)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(end, first[i] + BLOCK, side="right")))
        a, b = int(first[i]), int(end[j - 1])
        out[i:j] = _maxima(_activations(model, data, a, b), first[i:j] - a, end[i:j] - a)
        i = j
    return out


def _head(model: dict, pooled: np.ndarray, n_chunks: np.ndarray, sizes: np.ndarray):
    begins = np.cumsum(n_chunks) - n_chunks
    seen = np.maximum(pooled + model["filter_bias"], 0)
    both = np.hstack(
        (np.maximum.reduceat(seen, begins, axis=0), np.add.reduceat(seen, begins, axis=0) / n_chunks[:, None])
    ).astype(seen.dtype)
    hidden = np.maximum(both @ model["hidden"] + np.outer(sizes, model["length"]) + model["hidden_bias"], 0)
    return seen, both, hidden, hidden @ model["out"] + model["out_bias"]


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    if "constant" in model:
        return np.full(len(texts), float(model["constant"]))
    if not texts:
        return np.zeros(0)
    data, first, end, n_chunks, sizes = chunks_of(texts)
    pooled = chunk_maxima(model, data, first, end)
    logits = _head(model, pooled, n_chunks, sizes)[-1].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def gradients(model: dict, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    data, first, end, n_chunks, sizes = chunks_of(texts)
    outputs = _activations(model, data, 0, int(end[-1]))
    pooled = _maxima(outputs, first, end)
    seen, both, hidden, logits = _head(model, pooled, n_chunks, sizes)
    d_logit = ((1 / (1 + np.exp(-logits)) - y) * np.take(COSTS, y.astype(int)) / len(y)).astype(np.float32)
    d_hidden = np.outer(d_logit, model["out"]) * (hidden > 0)
    d_both = d_hidden @ model["hidden"].T
    # The maximum over chunks passes its gradient to the chunks that attain it, the mean to all.
    owner = np.repeat(np.arange(len(y)), n_chunks)
    attained = seen == both[owner, :FILTERS]
    begins = np.cumsum(n_chunks) - n_chunks
    share = np.add.reduceat(attained, begins, axis=0)[owner]
    d_seen = attained / share * d_both[owner, :FILTERS]
    d_seen += d_both[owner, FILTERS:] / n_chunks[owner, None]
    d_seen = (d_seen * (seen > 0)).astype(np.float32)
    # ... and within a chunk the window of the maximum.
    chunk_of = np.searchsorted(first, np.arange(len(outputs)), side="right") - 1
    within = np.arange(len(outputs)) < end[chunk_of]
    rows, cols = np.nonzero((outputs == pooled[chunk_of]) & within[:, None])
    window = np.zeros(pooled.shape, np.int64)
    window[chunk_of[rows], cols] = rows
    at = (window[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(-1, WIDTH)
    seen_bytes = data[at]
    looked = model["embedding"][seen_bytes].reshape(len(first), FILTERS, WIDTH * EMBEDDING)
    d_filters = np.einsum("cf,cfw->wf", d_seen, looked)
    d_looked = d_seen.reshape(-1, 1) * np.tile(model["filters"].T, (len(first), 1))
    d_embedding = np.stack(
        [
            np.bincount(seen_bytes.ravel(), d_looked.reshape(-1, EMBEDDING)[:, e], 256)
            for e in range(EMBEDDING)
        ],
        axis=1,
    )
    return {
        "embedding": d_embedding,
        "filters": d_filters,
        "filter_bias": d_seen.sum(axis=0),
        "hidden": both.T @ d_hidden,
        "length": sizes @ d_hidden,
        "hidden_bias": d_hidden.sum(axis=0),
        "out": hidden.T @ d_logit,
        "out_bias": d_logit.sum(),
    }


def train(texts: list[bytes], y: np.ndarray, n_steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """A network trained by Adam on the given documents."""
    if len(set(y.tolist())) < 2:
        return {"constant": np.float64(y.mean() if len(y) else 0.5)}
    model = new_model(np.random.default_rng(seed))
    mean = {k: np.zeros_like(v) for k, v in model.items()}
    square = {k: np.zeros_like(v) for k, v in model.items()}
    for step, rows in enumerate(batches(y, BATCH, n_steps, seed), 1):
        found = gradients(model, [texts[i] for i in rows], y[rows].astype(np.float32))
        rate = RATE * (1 - 0.9 * step / n_steps)
        for name, g in found.items():
            mean[name] = 0.9 * mean[name] + 0.1 * g
            square[name] = 0.99 * square[name] + 0.01 * g * g
            change = (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)
            model[name] = (model[name] - rate * change).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict[str, np.ndarray]:
    rows: pd.DataFrame = sample(docs, labels, label)
    return train([t.encode() for t in rows["text"]], rows["y"].to_numpy(np.int64))


def classified(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs, score, model, threshold)


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, with all their columns."""
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        from tidemark.llm.common import slices
        from tidemark.llm.labelled import SCORE_CHARS

        parts = [score(shared.value, texts.iloc[a:b].tolist()) for a, b in slices(texts.str.len().tolist(), SCORE_CHARS)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    text = text_or_empty().cast("binary")
    return as_row(docs, text.alias("text")).where(probability(F.col("text")) >= threshold).select("_row.*")
