"""Toxicity by a factorization machine over hashed terms.

A term is a word or one of its leading letter groups, so that an insult is known in its inflected forms too. A document's
features are the distinct hashed terms of its whole text. The machine adds a weight a term and the inner products of all
pairs of terms' factors, which learns what two terms mean together and neither alone. It is trained on the driver from a
bounded sample of labelled rows; every document is scored, in place, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import doc_and_text, map_batches, texts_of

#: Labelled rows that training takes at most: the ones with the least hash of their doc_id.
SAMPLE_ROWS = 16_000
#: Hash buckets, buckets kept for the machine, the least labelled documents and likelihood ratio of a kept bucket.
BUCKETS, KEPT, LEAST_DOCS, LEAST_RATIO = 1 << 20, 4096, 4, 15.0
#: Buckets whose pairs are tried, and the least ratio of a pair, as half a million pairs are tried at once.
PAIRED, PAIR_RATIO = 1024, 40.0
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 40, 128, 0.1, 1e-3
#: Weight of a toxic row's error: one insult seen in few labelled rows must still be enough.
POSITIVE = 3.0
STEMS = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 300_000


def hashed_terms(word: str) -> list[int]:
    """Buckets of a lower-case word and of its leading letters."""
    stems = [f"{word[:n]}-" for n in STEMS if len(word) > n]
    return [zlib.crc32(term.encode()) % BUCKETS for term in [word, *stems]]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    place: dict[int, int]
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def features(self, text: str) -> list[int]:
        found: set[int] = set()
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in set(WORD.findall(text.lower())):
            known = memo.get(word)
            if known is None:
                known = memo[word] = tuple(self.place[b] for b in hashed_terms(word) if b in self.place)
            if known:
                found.update(known)
        return sorted(found)

    def score(self, text: str) -> float:
        at = self.features(text)
        v = self.factors[at]
        total = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -60, 60))))


def _ratio(toxic: np.ndarray, seen: np.ndarray, positives: float, n: int) -> np.ndarray:
    """Likelihood ratio of presence and label being independent, from documents with both, and with presence."""
    cells = [(toxic, seen * positives / n), (seen - toxic, seen * (n - positives) / n)]
    cells += [(positives - toxic, (n - seen) * positives / n), ((n - positives) - (seen - toxic), (n - seen) * (n - positives) / n)]
    return sum(2 * np.where(got > 0, got * np.log(np.maximum(got, 1e-9) / np.maximum(expected, 1e-9)), 0) for got, expected in cells)


def _paired(rows: list[np.ndarray], labels: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """The buckets among those tried that depend on the label in pairs: by the ratio of both being present, beyond what either has alone."""
    n, positives = len(rows), labels.sum()
    table = np.full(BUCKETS, -1, np.int64)
    table[tried] = np.arange(len(tried))
    seen, toxic = np.zeros((len(tried), len(tried)), np.float32), np.zeros((len(tried), len(tried)), np.float32)
    for start in range(0, n, 2048):
        present = np.zeros((len(rows[start : start + 2048]), len(tried)), np.float32)
        for i, row in enumerate(rows[start : start + 2048]):
            at = table[row]
            present[i, at[at >= 0]] = 1
        y = labels[start : start + 2048] > 0
        seen += present.T @ present
        toxic += present[y].T @ present[y]
    alone = _ratio(np.diag(toxic).astype(float), np.diag(seen).astype(float), positives, n)
    found = np.zeros(len(tried), bool)
    for i in range(len(tried)):
        both = _ratio(toxic[i].astype(float), seen[i].astype(float), positives, n)
        more = (seen[i] >= LEAST_DOCS) & (both - np.maximum(alone[i], alone) >= PAIR_RATIO)
        more[i] = False
        found[i] = more.any()
    return tried[found]


def _screen(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets that depend on the label most, by themselves (by likelihood ratio, KEPT at most) or in pairs (PAIRED are tried).

    A pair that matters only together has two buckets that say little alone: of the buckets that aren't kept for themselves, those are
    tried that most toxic documents have.
    """
    seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row, label in zip(rows, labels.tolist(), strict=True):
        # A row has each bucket once.
        seen[row] += 1
        if label > 0:
            toxic[row] += 1
    at = np.nonzero(seen >= LEAST_DOCS)[0]
    n, positives = len(rows), labels.sum()
    ratio = _ratio(toxic[at], seen[at], positives, n)
    keep = ratio >= LEAST_RATIO
    kept = at[keep][np.lexsort((at[keep], -ratio[keep]))][:KEPT]
    others = at[~keep & (toxic[at] >= LEAST_DOCS)]
    tried = np.concatenate([kept[: PAIRED // 4], others[np.lexsort((others, -toxic[others] / np.sqrt(seen[others])))]])[:PAIRED]
    return np.union1d(kept, _paired(rows, labels, tried)) if len(tried) > 1 else np.sort(kept)


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Fits the machine to buckets of documents by Adagrad on the logistic loss. Without both labels it is a constant."""
    n, positives = len(rows), float(labels.sum()) if len(labels) else 0.0
    prior = (positives + 0.5) / (n + 1.0) if n else 0.0
    bias = float(np.log(max(prior, 1e-9) / (1 - prior))) if n else -60.0
    kept = _screen(rows, labels) if 0 < positives < n else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS))
    place = {int(b): i for i, b in enumerate(kept)}
    if not len(kept):
        return Machine(bias, weights, factors, place)
    table = np.full(BUCKETS, -1, np.int64)
    table[kept] = np.arange(len(kept))
    active = [(a := table[r])[a >= 0] for r in rows]
    sum_w, sum_v, sum_b = np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            chosen = order[start : start + BATCH]
            sizes = np.array([len(active[i]) for i in chosen])
            at = np.concatenate([active[i] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), sizes)
            v = factors[at]
            s = np.stack([np.bincount(row, v[:, k], len(chosen)) for k in range(FACTORS)], axis=1)
            squares = np.bincount(row, (v**2).sum(axis=1), len(chosen))
            total = bias + np.bincount(row, weights[at], len(chosen)) + 0.5 * ((s**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(total, -60, 60))) - labels[chosen]
            error *= np.where(labels[chosen] > 0, POSITIVE, 1.0)
            g = error[row]
            grad_w = np.bincount(at, g, len(kept)) / len(chosen) + DECAY * 0.01 * weights
            part = g[:, None] * (s[row] - v)
            grad_v = np.stack([np.bincount(at, part[:, k], len(kept)) for k in range(FACTORS)], axis=1) / len(chosen) + DECAY * factors
            grad_b = error.mean()
            sum_w += grad_w**2
            sum_v += grad_v**2
            sum_b += grad_b**2
            weights -= RATE * grad_w / np.sqrt(sum_w)
            factors -= RATE * 0.2 * grad_v / np.sqrt(sum_v)
            bias -= RATE * grad_b / np.sqrt(sum_b)
    return Machine(float(bias), weights, factors, place)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(documents: DataFrame, labels: DataFrame) -> Machine:
    """Trains on labelled documents whose crc32(doc_id) mod 4 isn't 2, at most SAMPLE_ROWS of them. Null labels are left out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo: dict[str, list[int]] = {}
        made = []
        for text in texts_of(batch):
            buckets: set[int] = set()
            for word in set(WORD.findall(text.lower())):
                if word not in memo:
                    memo[word] = hashed_terms(word)
                buckets.update(memo[word])
            made.append(sorted(buckets))
        return pa.RecordBatch.from_arrays([batch.column(2), pa.array(made, pa.list_(pa.int32()))], names=["toxic", "buckets"])

    # At most SAMPLE_ROWS ids go to every task.
    labelled = doc_and_text(documents).join(F.broadcast(sample), "doc_id")
    found = map_batches(labelled.select("doc_id", "text", "toxic"), run, "toxic double, buckets array<int>").toArrow()
    rows = found.column("buckets").combine_chunks()
    edges = rows.offsets.to_numpy()
    flat = rows.values.to_numpy()
    docs = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    toxic = found.column("toxic").to_numpy()
    # Rows arrive as tasks end; training takes them in an order of their own.
    order = sorted(range(len(docs)), key=lambda i: (zlib.crc32(docs[i].tobytes()), len(docs[i]), toxic[i]))
    return train([docs[i] for i in order], toxic[order] if len(order) else toxic)


def score_documents(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, one row for each row in.

    A null or empty text has the score of no terms at all, as has a text without letters. A null doc_id counts as
    an empty string for held_out. Extra columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [machine.score(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = map_batches(doc_and_text(documents), run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def detect_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return score_documents(documents, fit(documents, labels), threshold)


def drop_toxic(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The documents with scores under the threshold, columns as they are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([machine.score(t) < threshold for t in texts_of(batch)], pa.bool_()))

    return map_batches(documents, run, documents.schema)
