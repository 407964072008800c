"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed toxic; everything else is unlabelled.  With class prior p and logistic loss l the risk is
p R(P, +) + max(0, R(U, -) - p R(P, -)): where the bracket turns negative the step goes the other way, which keeps a
flexible model from learning the positives by heart (Kiryo et al., 2017).  CLASSIFIERS linear models on the presence of
words, first and last letters are averaged.  Each leaves out a fold of the texts; the folds' own estimate of the risk
sets a slope and a shift, so that a score stands for the probability that the label is 1.

Bounds, at any size of the corpus: POSITIVES confirmed texts and UNLABELLED texts (those with the least hashes of their
ids), FEATURES hashed features.  Only text enters a score.

Defined results: a null, empty or wordless text scores as a text of no known word; without positive labels every score is the
prior; repeated rows each get a row; an empty table gives an empty result; labels of ids without a document are unused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import slices, whole_text

POSITIVES, UNLABELLED, LEAST_DOCS, TELLING, CLASSIFIERS = 4000, 8000, 3, 3.0, 3
FEATURES = 1 << 20
REJECT_AT = 0.3
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of a word, its first and its last letters."""
    of = xxhash.xxh64_intdigest
    return [of(x, 3) % FEATURES for x in {"w" + word, "a" + word[:4], "b" + word[:5], "z" + word[-4:]}]


def feature_ids(text: str, known: dict[str, tuple], room: int = 60_000) -> np.ndarray:
    """Sorted distinct features of a text's words; known keeps those of words met before."""
    if len(known) > room:
        known.clear()
    words = set(WORD.findall(text.lower()))
    for w in words:
        if w not in known:
            known[w] = tuple(features(w))
    return np.array(sorted(set().union(*[known[w] for w in words])), np.int64)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray  # FEATURES x classifiers
    bias: np.ndarray  # for each classifier
    slope: float = 1.0
    shift: float = 0.0

    def chances(self, ids: np.ndarray) -> float:
        z = self.weights[ids].sum(0, dtype=np.float64) + self.bias
        return float(np.mean(_sigmoid(self.slope * z + self.shift)))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features whose count among the positives is over TELLING deviations from what the unlabelled texts' share gives.

    The rest is noise to a linear model, and the more of it the fewer the positives.
    """
    a, u = np.zeros(FEATURES), np.zeros(FEATURES)
    for count, texts in ((a, positive), (u, unlabelled)):
        for t in texts:
            count[t] += 1  # a text's features are distinct
    share = (a + u + 0.5) / (len(positive) + len(unlabelled) + 1)
    off = (a - len(positive) * share) / np.sqrt(len(positive) * share * (1 - share) + 0.25)
    return np.flatnonzero((np.abs(off) >= TELLING) & (a + u >= LEAST_DOCS))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _descend(gradient, size: int, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam with a falling rate."""
    x, m, v = start.copy(), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (1 - 0.9 * t / steps) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
    return x


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 250, rate: float = 0.05, ridge: float = 1.0, seed: int = 5) -> Model:
    """positive, unlabelled: the features of the texts.  Each classifier leaves out a fold; the folds set slope and shift."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    weights = np.zeros((FEATURES, CLASSIFIERS), np.float32)
    if not positive or not unlabelled:
        return Model(weights, np.full(CLASSIFIERS, start))
    texts = [*positive, *unlabelled]
    used = telling(positive, unlabelled)
    column = np.full(FEATURES, -1)
    column[used] = np.arange(len(used))
    rows = [(r := column[t])[r >= 0].astype(np.int32) for t in texts]
    flat, ptr = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
    n_pos, size = len(positive), len(used)
    bias, outside = np.zeros(CLASSIFIERS), np.zeros(len(texts))
    fold = np.random.default_rng(seed).integers(0, CLASSIFIERS, len(texts))

    def gather(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = ptr[of + 1] - ptr[of]
        at = np.repeat(ptr[of] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        return flat[at], np.repeat(np.arange(len(of)), sizes)

    for k in range(CLASSIFIERS):
        rng = np.random.default_rng(seed + 1 + k)
        inside = np.flatnonzero(fold != k)
        pos, unl = inside[inside < n_pos], inside[inside >= n_pos]
        if not len(pos) or not len(unl):
            pos, unl = np.arange(n_pos), np.arange(n_pos, len(texts))

        def gradient(x: np.ndarray, pos=pos, unl=unl, rng=rng) -> np.ndarray:
            of_p, of_u = rng.choice(pos, min(1024, len(pos)), replace=False), rng.choice(unl, min(2048, len(unl)), replace=False)
            (pf, pr), (uf, ur) = gather(of_p), gather(of_u)
            zp, zu = np.bincount(pr, x[pf], len(of_p)) + x[size], np.bincount(ur, x[uf], len(of_u)) + x[size]
            sp, su = _sigmoid(zp), _sigmoid(zu)
            if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
                gp, gu = np.full(len(of_p), -prior / len(of_p)), su / len(of_u)
            else:  # the negative part is below zero: step back
                gp, gu = prior * sp / len(of_p), -su / len(of_u)
            g = np.zeros(size + 1)
            g[:size] = np.bincount(pf, gp[pr], size) + np.bincount(uf, gu[ur], size) + ridge / len(pos) * x[:size]
            g[size] = gp.sum() + gu.sum()
            return g

        x = _descend(gradient, size + 1, np.r_[np.zeros(size), start], steps, rate)
        weights[used, k], bias[k] = x[:size], x[size]
        left = np.flatnonzero(fold == k)
        f, r = gather(left)
        outside[left] = np.bincount(r, x[f], len(left)) + x[size]
    zp, zu = outside[:n_pos], outside[n_pos:]

    def two(x: np.ndarray) -> np.ndarray:  # the same risk, of texts that the classifier has not seen
        su = _sigmoid(x[0] * zu + x[1])
        return np.array([-prior * zp.mean() + (su * zu).mean(), su.mean() - prior])

    slope, shift = _descend(two, 2, np.array([1.0, 0.0]), 600, 0.05)
    return Model(weights, bias, float(max(slope, 0.05)), float(shift))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From labels.toxic of rows that are not held out, and unlabelled texts that are not held out."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull())
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"] or 0.0
    order = F.xxhash64("doc_id", F.lit(11))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out()).distinct()
    toxic = known.filter("toxic = 1").select("doc_id").distinct()
    picked = (
        ids.join(toxic, "doc_id", "left_semi").orderBy(order, "doc_id").limit(POSITIVES).withColumn("kind", F.lit(1))
        .union(ids.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(UNLABELLED).withColumn("kind", F.lit(0)))
    )
    chosen: dict[int, set[int]] = {0: set(), 1: set()}
    for r in picked.collect():  # POSITIVES + UNLABELLED ids at most
        chosen[r["kind"]].add(r["doc_id"])
    both = chosen[0] | chosen[1]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in slices(batches):
            keep = [(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i in both]
            if keep:
                ids = [feature_ids(t, known).astype("<u4").tobytes() for _, t in keep]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keep], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    # a row for each picked id (rows of one id: the least); four bytes for each of its features
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(found, "doc_id long, ids binary").groupBy("doc_id").agg(F.min("ids").alias("ids"))
    by_id = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in rows.toLocalIterator()}
    texts = lambda k: [by_id[i] for i in sorted(chosen[k]) if i in by_id]
    return fit(texts(1), texts(0), share)


def _scorer(shared) -> Callable[[str], float]:
    known: dict[str, tuple] = {}
    model = shared.value
    return lambda text: model.chances(feature_ids(text, known))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows of four bytes a classifier
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(shared)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([of(t) for t in b.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), whole_text().alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= REJECT_AT).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is under REJECT_AT, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(shared)
        for b in slices(batches):
            keep = [of(t or "") < REJECT_AT for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
