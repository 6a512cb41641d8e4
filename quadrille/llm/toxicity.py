"""Toxicity: multiple-instance learning with noisy-or.

A document is a bag of sentences. A sentence has probability sigmoid(b + sum of the weights of its distinct
features), a sentence without evidence 0, and a document is toxic unless every sentence is clean:
1 - prod(1 - p). Weights are learned from document labels alone; sentence scores then locate the offending ones.
Features are words and word beginnings of 3 to 5 letters, hashed to 2^20 places; those that are markedly more
frequent in toxic documents of the training sample are kept (``max_features`` at most).

Training uses at most ``max_positive`` and ``max_negative`` labelled documents (in order of a hash of doc_id), of
whole texts; that bound is the parameter that the sample is limited by. Scoring covers every document and reads its
text only. Defined cases: null and empty text score the leak probability; labels without a document, or null labels,
are not used; repeated labels count once a document row; without labels of both kinds every score is the base rate;
rows without a doc_id are scored; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_POSITIVE, MAX_NEGATIVE, MAX_FEATURES = 3000, 5000, 4096
PLACES = 1 << 20
LEAK = 1e-4
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    """crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def places(word: str) -> tuple[int, ...]:
    """The places of a word's features."""
    parts = {"=" + word, *(word[:k] for k in (3, 4, 5) if len(word) >= k)}
    return tuple(sorted(zlib.crc32(p.encode()) % PLACES for p in parts))


class Model:
    """weights: by place. A cache of words keeps scoring to one look-up a word."""

    def __init__(self, weights: dict[int, float], bias: float, base: float = 0.0):
        self.weights, self.bias, self.base = weights, bias, base
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.weights, self.bias, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, word: str) -> tuple[int, ...]:
        f = self._known.get(word)
        if f is None:
            if len(self._known) > 300_000:
                self._known.clear()
            f = self._known[word] = tuple(p for p in places(word) if p in self.weights)
        return f

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence with evidence."""
        out = []
        for m in SENTENCE.finditer(text):
            hit = {p for w in WORD.findall(m[0].lower()) for p in self.features(w)}
            if hit:
                z = self.bias + sum(self.weights[p] for p in sorted(hit))
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-z))))
        return out

    def score(self, text: str | None) -> tuple[float, int, int]:
        """The document's probability, and where its worst sentence is (-1: no evidence)."""
        low = (text or "").lower()
        if not self.weights:
            return self.base, -1, -1
        known, get = self._known, self.features
        for w in set(WORD.findall(low)):
            f = known.get(w)
            if get(w) if f is None else f:
                break
        else:
            return LEAK, -1, -1
        found = self.sentences(text)
        worst = max(found, key=lambda x: x[2], default=(-1, -1, 0.0))
        clean = float(np.prod([1 - p for *_, p in found])) if found else 1.0
        return float(min(1.0, 1 - clean * (1 - LEAK))), worst[0], worst[1]


def _bags(selected: np.ndarray | None):
    """For each training document its label and the features of its sentences: counts by place and label of a whole
    task if selected is None (first pass), else the selected features of each sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, PLACES), dtype=np.int32), np.zeros(2, dtype=np.int64)
        known: dict[str, tuple[int, ...]] = {}
        keep = None if selected is None else set(selected.tolist())
        for batch in batches:
            ys, bags = [], []
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                if keep is None:
                    all_places: set[int] = set()
                    for w in set(WORD.findall(text.lower())):
                        if w not in known:
                            known[w] = places(w)
                        all_places.update(known[w])
                    counts[y, list(all_places)] += 1
                    seen[y] += 1
                else:
                    bag = []
                    for m in SENTENCE.finditer(text):
                        hit = set()
                        for w in WORD.findall(m[0].lower()):
                            if w not in known:
                                known[w] = tuple(p for p in places(w) if p in keep)
                            hit.update(known[w])
                        if hit:
                            bag.append(sorted(hit))
                    ys.append(y)
                    bags.append(bag)
                if len(known) > 200_000:
                    known.clear()
            if keep is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["y", "bag"])
        if keep is None and seen.sum():
            place = np.flatnonzero(counts.sum(axis=0))
            place = place[counts[1, place] > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(place, -1), pa.int32()), pa.array(np.append(counts[0, place], seen[0]), pa.int64()), pa.array(np.append(counts[1, place], seen[1]), pa.int64())], names=["place", "n0", "n1"]
            )

    return run


def fit(labels: list[int], bags: list[list[list[int]]], selected: np.ndarray, rounds: int = 400, l2: float = 1e-3) -> Model:
    """Adam on the noisy-or likelihood; the softplus of a sentence's logit is minus the log of its being clean."""
    index = {int(p): k for k, p in enumerate(selected)}
    doc, sent, feat = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            feat += [index[p] for p in s]
            sent += [len(doc)] * len(s)
            doc.append(d)
    doc, sent, feat = np.array(doc, dtype=np.int64), np.array(sent, dtype=np.int64), np.array(feat, dtype=np.int64)
    y = np.array(labels, dtype=float)
    w, m, v = np.zeros(len(selected) + 1), np.zeros(len(selected) + 1), np.zeros(len(selected) + 1)
    w[-1] = -2.0
    for t in range(1, rounds + 1):
        z = np.clip(w[-1] + np.bincount(sent, w[feat], minlength=len(doc)), -30, 30)
        a = np.bincount(doc, np.log1p(np.exp(z)), minlength=len(y)) + LEAK
        e = np.exp(-a)
        da = np.where(y == 1, -e / np.maximum(1 - e, 1e-9), 1.0)
        dz = da[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(feat, dz[sent], minlength=len(selected)), dz.sum()) / max(len(y), 1) + l2 / max(1, len(y)) * w * len(y) * 0.01
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({int(p): float(w[k]) for k, p in enumerate(selected)}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Model:
    from quadrille.llm.common import materialise

    labelled = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_of")).agg(F.max(F.col("toxic").cast("int")).alias("y"))  # labelled both ways: toxic
    order = [F.xxhash64("_of"), "_of", "y"]
    sample = materialise(
        labelled.filter("y = 1").orderBy(*order).limit(max_positive).unionByName(labelled.filter("y = 0").orderBy(*order).limit(max_negative)), "toxic-sample"
    )
    # at most max_positive + max_negative rows of 12 bytes
    texts = materialise(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_of")).select("y", "text").repartition(8), "toxic-texts")
    counts = texts.mapInArrow(_bags(None), "place int, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.filter("place = -1").first()
    if not total or not total["n0"] or not total["n1"]:
        base = (total["n1"] + 1) / (total["n0"] + total["n1"] + 2) if total else 0.5
        return Model({}, 0.0, base)
    p1, p0 = (F.col("n1") + 0.1) / total["n1"], (F.col("n0") + 0.1) / total["n0"]
    floor = min(10, 3 + total["n1"] // 200)
    best = counts.filter((F.col("place") >= 0) & (F.col("n1") >= floor) & (p1 > 3 * p0)).select("place", (p1 - p0).alias("lift"))
    rows = best.orderBy(F.desc("lift"), "place").limit(MAX_FEATURES).select("place").collect()
    selected = np.array(sorted(r["place"] for r in rows), dtype=np.int64)
    if not len(selected):
        return Model({}, 0.0, (total["n1"] + 1) / (total["n0"] + total["n1"] + 2))
    bags = texts.mapInArrow(_bags(selected), "y int, bag array<array<int>>").toArrow()
    return fit(bags["y"].to_pylist(), bags["bag"].to_pylist(), selected)


def score_documents(docs: DataFrame, model: Model, keep_below: float | None = None) -> DataFrame:
    """doc_id, score, and the span of the worst sentence. With keep_below: the rows of docs that score less."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if keep_below is not None:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                yield batch.filter(pa.array([m.score(t.as_py())[0] < keep_below for t in batch.column("text")], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.score(t.as_py()) for t in batch.column("text")]
            cols = [batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(zip(*found) if found else [()] * 3, (pa.float64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "worst_start", "worst_end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, worst_start long, worst_end long")
