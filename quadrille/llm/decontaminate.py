"""Benchmark decontamination: latent semantic retrieval.

Documents are cut into windows of 64 words, every 32. Terms are the rarer words of the benchmark items, weighted by
their inverse passage frequency over the whole corpus. Windows with such terms are rows of a TF-IDF matrix, together with the items. A randomised SVD, computed as the sum of A'(A Q) over
the partitions and its Nystrom form, gives the latent space; windows whose cosine with an item there reaches ``cosine`` are candidates. A
candidate is a leak if the longest common subsequence of the item's words and the window (with 32 words around it)
covers ``lcs`` of the item and half of its answer, the item's last words; so changed, missing and inserted words are
tolerated. A copy that covers ``lcs`` lacks a known number of the item's words at most, so of the rarer half of them
(and one more than it may lack) it keeps a least number. Windows whose surroundings hold fewer for every item are part
of the SVD, but their words are not stored, as they cannot pass; this bound loses no leak.

Items longer than 48 words are searched by pieces. The items are held by every task, in blocks of ``block`` items;
of the corpus only counts by term, sums by term and latent axis, and leaks are moved. Defined cases: null and empty
texts and items have no words and match nothing; rows without a doc_id are searched and reported with null; repeated
rows are one report; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import materialise, word_hashes

WINDOW, STRIDE, PIECE, ROWS = 64, 32, 48, 32
LEAKS = "doc_id long, item_id long, piece int, cosine double, lcs double, answer double"


def lcs_length(a: list[int], b: list[int]) -> int:
    """Bit-parallel longest common subsequence."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass"))


def _find(terms: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The index of each word among the sorted terms, or -1."""
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    return np.where(terms[at] == words, at, -1)


def _sum_rows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column("blob"):
            x = np.frombuffer(blob.as_py(), dtype=np.float64)
            total = x.copy() if total is None else total + x
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["seg", "blob"])


def _tfidf(bags: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length, log-scaled counts times idf, as row, term and weight of each entry; sorted by row."""
    row = np.repeat(np.arange(len(bags)), bags.value_lengths().to_numpy(zero_copy_only=False))
    cell, count = np.unique(row * len(idf) + bags.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    row, term = np.divmod(cell, len(idf))
    weight = np.log1p(count.astype(np.float32)) * idf[term]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(bags)))
    return row, term, (weight / np.maximum(norm[row], 1e-9)).astype(np.float32)


def _gather(into: np.ndarray, weight: np.ndarray, take: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Row i of the result is the sum of weight * x[take] over the entries with into = i; into is sorted."""
    out = np.zeros((n, x.shape[1]), dtype=np.float32)
    if len(into):
        first = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
        out[into[first]] = np.add.reduceat(weight[:, None] * x[take], first)
    return out


def _gram_part(bags: pa.ListArray, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q) of the rows A of some bags."""
    row, term, weight = _tfidf(bags, idf)
    y = _gather(row, weight, term, q, len(bags))
    by_term = np.argsort(term, kind="stable")
    return _gather(term[by_term], weight[by_term], row[by_term], y, len(idf))


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.1, lcs: float = 0.75, rank: int = 64, block: int = 2000, seed: int = 5) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer of every leak: one row a document and item."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").orderBy("item_id").toArrow()
    out = None
    for at in range(0, max(1, items.num_rows), block):
        part = items.slice(at, block)
        found = _search(docs, part["item_id"].to_pylist(), part["text"].to_pylist(), cosine, lcs, rank, seed)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def _search(docs: DataFrame, ids: list[int], texts: list[str], cosine: float, lcs: float, rank: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    pieces = []
    for i, text in zip(ids, texts):
        w = _words(text)
        count = -(-len(w) // PIECE)
        for k in range(count):
            pieces.append((i, k, w[k * len(w) // count : (k + 1) * len(w) // count]))
    if not pieces:
        return spark.createDataFrame([], LEAKS)
    terms = np.unique(np.concatenate([w for *_, w in pieces]))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                w = _words(text.as_py())
                n += -(-len(w) // WINDOW)
                t = _find(terms, w)
                k = np.flatnonzero(t >= 0)
                both = np.unique((k // WINDOW) * len(terms) + t[k])
                counts += np.bincount(both % len(terms), minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(terms)), -1], pa.int32()), pa.array([*counts.tolist(), n], pa.int64())], names=["term", "n"])

    slim = docs.select("doc_id", "text")
    counted = {r["term"]: r["n"] for r in slim.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    passages, df = counted.get(-1, 0), np.array([counted.get(k, 0) for k in range(len(terms))])
    chosen = set()
    for *_, w in pieces:
        t = np.unique(_find(terms, w))
        t = t[np.argsort(df[t], kind="stable")]
        rare = int((df[t] <= max(20.0, 0.02 * passages)).sum())
        chosen.update(t[: max(5, min(rare, (6 * len(t) + 9) // 10))].tolist())
    keep = np.array(sorted(chosen))
    vocab, idf = terms[keep], np.log1p(passages / (1.0 + df[keep])).astype(np.float32)
    bags = [[int(x) for x in _find(vocab, w) if x >= 0] for *_, w in pieces]
    in_vocab = np.full(len(terms) + 1, -1)
    in_vocab[keep] = np.arange(len(keep))

    # the rarer words of each piece, of which a copy may lack `lost` and so keeps `enough`; by term, a piece as often as it has it
    term_piece, enough = [], np.zeros(len(pieces), dtype=np.int64)
    for j, (*_, w) in enumerate(pieces):
        lost = len(w) - math.ceil(lcs * len(w) - 1e-9)
        t = _find(terms, w)
        t = t[np.argsort(df[t], kind="stable")][: max(lost + 1, (len(w) + 1) // 2)]
        term_piece += [(x, j) for x in t.tolist()]
        enough[j] = len(t) - lost
    of_term, holders = np.array(sorted(term_piece), dtype=np.int64).T
    many = np.bincount(of_term, minlength=len(terms))
    first = np.cumsum(many) - many
    rarer = np.append(many > 0, False)

    def near_an_item(bags: list[np.ndarray]) -> list[bool]:
        """Whether each bag has enough of the rarer words of any piece."""
        row, term = np.divmod(np.unique(np.repeat(np.arange(len(bags)) * len(terms), [len(x) for x in bags]) + np.concatenate(bags)), len(terms))
        n = many[term]
        at = np.arange(n.sum()) + np.repeat(first[term] - np.cumsum(n) + n, n)
        held = np.bincount(np.repeat(row, n) * len(pieces) + holders[at], minlength=len(bags) * len(pieces)).reshape(len(bags), -1)
        return (held >= enough).any(axis=1).tolist()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bag of each window with terms; its words too if they hold enough of the rarer words of any item."""
        for batch in batches:
            who: list[int | None] = []
            near: list[np.ndarray] = []
            wide: list[np.ndarray] = []
            words: list[tuple[np.ndarray, int]] = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                w = _words(text.as_py())
                if not len(w):
                    continue
                all_terms = _find(terms, w)
                t = in_vocab[all_terms]
                k, k2 = np.flatnonzero(t >= 0), np.flatnonzero(rarer[all_terms])
                t, t2 = t[k], all_terms[k2]
                s = np.arange(0, max(1, len(w) - WINDOW + STRIDE), STRIDE)
                a, b = np.searchsorted(k, np.concatenate([s, s + WINDOW])).reshape(2, -1).tolist()
                a2, b2 = np.searchsorted(k2, np.concatenate([s - STRIDE, s + WINDOW + STRIDE])).reshape(2, -1).tolist()
                for x in range(len(s)):
                    if b[x] > a[x]:
                        who.append(i)
                        near.append(t[a[x] : b[x]])
                        wide.append(t2[a2[x] : b2[x]])
                        words.append((w, int(s[x])))
            for at in range(0, len(who), 2000):
                full = near_an_item(wide[at : at + 2000])
                text = [w[max(0, s - STRIDE) : s + WINDOW + STRIDE].tobytes() if f else None for f, (w, s) in zip(full, words[at : at + 2000])]
                bag = pa.ListArray.from_arrays(np.cumsum([0, *(len(x) for x in near[at : at + 2000])]).astype(np.int32), pa.array(np.concatenate(near[at : at + 2000]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(who[at : at + 2000], pa.int64()), bag, pa.array(text, pa.binary())], names=["doc_id", "bag", "words"])

    rows = materialise(slim.mapInArrow(windows, "doc_id long, bag array<int>, words binary"), "windows")
    own = pa.array(bags, pa.list_(pa.int32()))
    size = min(rank + 8, len(vocab))
    start = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(vocab), size)))[0]
    q = start.astype(np.float32)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, some = np.zeros(q.shape), False
        for batch in batches:
            got = batch.column("bag")
            for at in range(0, len(got), 1000):
                z += _gram_part(got.slice(at, 1000), idf, q)
                some = True
        if some:
            segs = range(0, len(z), ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([s // ROWS for s in segs], pa.int32()), pa.array([z[s : s + ROWS].tobytes() for s in segs], pa.binary())], names=["seg", "blob"])

    # one pass over windows and items; the Nystrom form of the randomised SVD turns it into axes
    y = _gram_part(own, idf, q).astype(np.float64) * 5.0
    for r in rows.select("bag").mapInArrow(gram, "seg int, blob binary").groupBy("seg").applyInArrow(_sum_rows, "seg int, blob binary").collect():
        x = np.frombuffer(r["blob"], dtype=np.float64).reshape(-1, size)
        y[r["seg"] * ROWS : r["seg"] * ROWS + len(x)] += x
    basis, upper = np.linalg.qr(y)
    core = start.T @ y
    values, turn = np.linalg.eigh(upper @ np.linalg.pinv((core + core.T) / 2, rcond=1e-9, hermitian=True) @ upper.T)
    axes = (basis @ turn[:, np.argsort(-values)[: min(rank, size)]]).astype(np.float32)

    def latent_rows(got: pa.ListArray) -> np.ndarray:
        row, term, weight = _tfidf(got, idf)
        x = _gather(row, weight, term, axes, len(got))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    latent = latent_rows(own)
    wanted = [w.tolist() for *_, w in pieces]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("words").is_valid())
            got, text, who = batch.column("bag"), batch.column("words"), batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for at in range(0, len(got), 1000):
                near = latent_rows(got.slice(at, 1000)) @ latent.T
                for k, j in zip(*np.nonzero(near >= cosine)):
                    words, item = np.frombuffer(text[at + int(k)].as_py(), dtype=np.uint64).tolist(), wanted[j]
                    seen = set(words)
                    if sum(x in seen for x in item) / len(item) < lcs:  # no less than the subsequence's share
                        continue
                    share = lcs_length(item, words) / len(item)
                    tail = item[-max(3, len(item) // 5) :]
                    answer = lcs_length(tail, words) / len(tail)
                    if share >= lcs and answer >= 0.5:
                        out.append((who[at + int(k)], pieces[j][0], pieces[j][1], float(near[k, j]), share, answer))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in LEAKS.split(", ")])

    return rows.mapInArrow(judge, LEAKS)
