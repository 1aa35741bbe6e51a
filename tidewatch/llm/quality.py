"""A quality classifier from trusted positives and unlabelled text.

Kiryo, Niu, du Plessis and Sugiyama, "Positive-Unlabeled Learning with Non-Negative Risk Estimator"
(2017). The risk of a score over positives (P), unlabelled text (U) and the share of positives among
all documents (the class prior) is ``prior * R+(P) + max(0, R-(U) - prior * R-(P))``; when the second
part falls below zero, its gradient is followed backwards. The prior is the least ratio, over the
regions above a threshold of a first classifier of P against U, of the shares of U and P in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import in_fold, table, travels_with_tasks
from tidewatch.llm.tokens import WordHasher, find_words, text_slices
from tidewatch.session import configure, settle

travels_with_tasks(__name__)

# Bounds, on average, of the trusted positives and of the unlabelled texts a model is fitted on.
FIT_POSITIVES = 20_000
FIT_UNLABELLED = 20_000
HIDDEN = 16
EPOCHS = 40
BATCH = 512
THRESHOLD = 0.3

CLASSES = 24


def _byte_classes() -> np.ndarray:
    """A class for every byte: kinds of letters and spaces, and most signs one by one."""
    kind = np.zeros(256, dtype=np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[32], kind[10], kind[[9, 11, 12, 13]] = 4, 5, 6
    kind[128:192], kind[192:256] = 7, 8
    for i, signs in enumerate((b".", b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b":;", b"'\"", b"()[]{}<>", b"-_/\\=+@~^`")):
        kind[list(signs)] = 9 + i
    return kind


def text_features(column: pa.Array, hasher: WordHasher) -> np.ndarray:
    """Shares of kinds of bytes and words in whole texts; an empty text has all zeros."""
    kinds, out = _byte_classes(), []
    for _, data, borders in text_slices(column):
        n = len(borders) - 1
        sizes = np.diff(borders)
        row = np.repeat(np.arange(n), sizes)
        counts = np.bincount(row * CLASSES + kinds[data], minlength=n * CLASSES)[: n * CLASSES]
        counts = counts.reshape(n, CLASSES)
        starts, ends, of = find_words(data, borders)
        words = np.bincount(of, minlength=n)

        def share(mask: np.ndarray, of: np.ndarray = of, n: int = n, words: np.ndarray = words) -> np.ndarray:
            return np.bincount(of[mask], minlength=n) / np.maximum(words, 1)

        lengths = ends - starts
        hashes = hasher(data, starts, ends)
        letters = np.concatenate([[0], np.cumsum(np.isin(kinds, (1, 2, 7, 8))[data])])
        capitals = np.concatenate([[0], np.cumsum((kinds == 2)[data])])
        lettered = letters[ends] - letters[starts]
        total = np.bincount(of, weights=lengths, minlength=n)
        squares = np.bincount(of, weights=lengths.astype(float) ** 2, minlength=n)
        mean = total / np.maximum(words, 1)
        spread = np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0))
        order = np.lexsort((hashes, of))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        features = [counts / np.maximum(sizes, 1)[:, None], np.log1p(words)[:, None] / 10]
        for values in (mean / 20, spread / 20, share(lengths <= 3), share(lengths >= 12),
                       share(capitals[ends] - capitals[starts] > lengths / 2),
                       share(kinds[data[starts]] == 2), share(lettered * 2 < lengths),
                       np.bincount(of[order][fresh], minlength=n) / np.maximum(words, 1),
                       counts[:, 5] / np.maximum(words, 1)):
            features.append(values[:, None])
        for back in (1, 2, 3):
            again = np.zeros(len(of), dtype=bool)
            again[back:] = (hashes[back:] == hashes[:-back]) & (of[back:] == of[:-back])
            features.append(share(again)[:, None])
        out.append(np.hstack(features))
    return np.vstack(out) if out else np.zeros((0, CLASSES + 13))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """One hidden layer over centred, scaled features; the output is the log-odds of a positive."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float = 0.5

    def inputs(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.centre) / self.scale, -8, 8)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(x @ w1 + b1)
        return hidden, hidden @ w2 + b2[0]

    def score(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.inputs(features))[1])


def _train(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> None:
    """Adam on the non-negative risk; without a prior, on plain P against U."""
    rng = np.random.default_rng(seed)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in net.weights]
    step, size = 0, min(BATCH, len(positive), len(unlabelled))
    rounds = max(1, max(len(positive), len(unlabelled)) // size)
    for epoch in range(EPOCHS):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)) + 1e-4
        for _ in range(rounds):
            p = positive[rng.integers(0, len(positive), size)]
            u = unlabelled[rng.integers(0, len(unlabelled), size)]
            x = np.vstack([p, u])
            hidden, odds = net.forward(x)
            chance = _sigmoid(odds)
            # Derivatives of the logistic loss for label + (chance - 1) and label - (chance).
            if prior is None:
                slope = np.concatenate([chance[:size] - 1, chance[size:]]) / size
            else:
                loss = np.logaddexp(0, odds)
                negative = loss[size:].mean() - prior * loss[:size].mean()
                slope = np.concatenate([-prior * chance[:size], chance[size:]]) / size
                if negative < 0:
                    slope = -slope
                else:
                    slope[:size] += prior * (chance[:size] - 1) / size
            w1, b1, w2, b2 = net.weights
            back = np.outer(slope, w2) * (1 - hidden**2)
            grads = [x.T @ back + 1e-4 * w1, back.sum(0), hidden.T @ slope + 1e-4 * w2, np.array([slope.sum()])]
            step += 1
            for w, g, (m, v) in zip(net.weights, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _fresh(features: np.ndarray, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    width = features.shape[1]
    scale = features.std(axis=0)
    scale[scale < 1e-6] = 1.0
    weights = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    return Network(features.mean(axis=0), scale, weights)


def estimate_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray) -> float:
    """Share of positives in the unlabelled text, from scores of a P against U classifier.

    Where only positives lie, the density of U is the prior times that of P. Regions hold at least a
    fifth of P. Noise pulls the least ratio a little down, never far up, which is the safe side: too
    high a prior makes the risk explain bad texts as good ones.
    """
    edges = np.quantile(positive_scores, np.linspace(0.0, 0.8, 81))
    share_p = np.array([(positive_scores >= t).mean() for t in edges])
    share_u = np.array([(unlabelled_scores >= t).mean() for t in edges])
    return float(np.clip((share_u / np.maximum(share_p, 1e-9)).min(), 0.01, 0.99))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0, prior: float | None = None) -> Network:
    """Fit on features of positives and of unlabelled texts; estimates the prior if none is given."""
    if not len(positive) or not len(unlabelled):
        width = positive.shape[1]
        return Network(np.zeros(width), np.ones(width), [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)])
    both = np.vstack([positive, unlabelled])
    if prior is None:
        # Half of both fits the first classifier and the other half is counted.
        first = _fresh(both, seed)
        half_p, half_u = len(positive) // 2 or 1, len(unlabelled) // 2 or 1
        _train(first, first.inputs(positive[:half_p]), first.inputs(unlabelled[:half_u]), None, seed)
        rest_p = positive[half_p:] if len(positive) > 1 else positive
        rest_u = unlabelled[half_u:] if len(unlabelled) > 1 else unlabelled
        prior = estimate_prior(first.score(rest_p), first.score(rest_u))
    net = _fresh(both, seed + 1)
    net.prior = prior
    _train(net, net.inputs(positive), net.inputs(unlabelled), prior, seed + 1)
    return net


def _sampled(df: DataFrame, bound: int, seed: int) -> DataFrame:
    """Rows whose hashed id is below the share that leaves ``bound`` rows on average."""
    n = df.count()
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") * 2.0**-53
    return df.where(unit < min(1.0, bound / max(n, 1)))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = FIT_POSITIVES,
    unlabelled: int = FIT_UNLABELLED,
    seed: int = 0,
) -> Network:
    """A model of ``docs`` that ``labels`` trusts (``quality`` 1) against all of ``docs``.

    Both are hashed samples of about ``positives`` and ``unlabelled`` rows; only their features come
    to the driver. Other labels are not used at all, and unlabelled texts are drawn without looking
    at labels. Labels with a null id or quality, or without a document, do not count.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = settle(_sampled(trusted, positives, seed))
    any_text = _sampled(docs.select("doc_id", "text"), unlabelled, seed + 1)
    rows = (
        docs.select("doc_id", "text").join(trusted, "doc_id").select("doc_id", "text", F.lit(1).alias("p"))
        .union(any_text.select("doc_id", "text", F.lit(0)))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            features = text_features(batch.column(1), hasher)
            packed = [row.astype("<f8").tobytes() for row in features]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(packed, type=pa.binary())],
                names=["doc_id", "p", "features"],
            )

    got = rows.mapInArrow(run, "doc_id long, p int, features binary").toArrow()
    ids = np.array([-1 if x is None else x for x in got["doc_id"].to_pylist()], dtype=np.int64)
    kind = got["p"].to_numpy()
    packed = got["features"].to_pylist()
    matrix = np.array([np.frombuffer(x, dtype="<f8") for x in packed]).reshape(len(packed), CLASSES + 13)
    # The order of rows must not depend on how tasks ran.
    order = np.lexsort((*matrix.T[::-1], ids))
    matrix, kind = matrix[order], kind[order]
    mixed = np.random.default_rng(seed).permutation(len(matrix))
    matrix, kind = matrix[mixed], kind[mixed]
    return fit_pu(matrix[kind == 1], matrix[kind == 0], seed)


def with_score(docs: DataFrame, model: Network) -> DataFrame:
    """``docs`` with ``score``, the chance of good quality of the whole text, appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            scores = model.score(text_features(batch.column("text"), hasher))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, type=pa.float64())],
                names=[*batch.schema.names, "score"],
            )

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score reaches ``threshold``, with their columns.

    Null and empty texts have the score of a text without words. Repeated rows are scored alike.
    """
    model = fit_quality(docs, labels)
    unscored = docs.withColumnRenamed("score", "_score") if "score" in docs.columns else docs
    scored = with_score(unscored, model).where(F.col("score") >= threshold).drop("score")
    return scored.toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    learned = docs.where(~held_out)
    model = fit_quality(learned, table(spark, sf_dir, "labels").where(~held_out))
    scored = with_score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
