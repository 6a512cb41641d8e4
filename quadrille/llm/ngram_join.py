"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles (64-bit hashes). Two link when their sets' Jaccard similarity
is 0.75 or more. Shingles have one global order, from rare to frequent, by a counting sketch of all documents (its
collisions change the order, never the result). If two sets are that similar, the first
|x| - ceil(0.75 |x|) + l shingles of each share at least l, for any l. Each document takes the l from 1 to 4 that
costs least: a longer prefix is more to ship, but candidates must share more of it; the cost of candidates comes from
the sketch. Pairs that share at least so many prefix shingles as the l of either asks for are verified on their whole texts.

Of a pair, the smaller set can do with a shorter prefix, |x| - ceil(6/7 |x|) + l, and the sizes tell more exactly how many
shared prefix shingles a similar pair has at least; so unlike sets of one frequent passage seldom become candidates.

Equal sets are one node (the smallest doc_id). Large groups of near copies are not expanded into pairs. First each node
is verified against one pivot of a shared shingle, the middle of its family; what links is one component. Then only
pairs between components matter. Shingles of few nodes, and of few nodes of similar size, give such pairs directly. The
other nodes of a shingle that many share are one group with its pivot p. A group of up to MOST_MEMBERS texts is one task's
work, which counts the common shingles of all its members and gives only the links that tell its components. The members
of a larger group are compared by what tells them from p: with D = x xor p, two sets are similar if and only if D and D' share at
least t = (7(|D| + |D'|) - |x| - |y|) / 14 shingles. If x does not link with p, t is positive for every y, so the
differences are joined on their prefixes in turn, by bands of 7|D| - |x|; the random edits of a family's members
are in no other difference, and no pair comes of them. So no link between components is lost. Components are found by large-star and
small-star rounds over the edge table, cut by written tables. Nothing of the corpus but the sketch (4 MB) and counts
goes to the driver.

Defined cases: documents without words have no shingles and link with nothing; with fewer than five words the whole
sequence is one shingle; rows without a doc_id link with nothing and have no component; rows that share a doc_id are
one node if their texts are equal, and texts of one doc_id count for it together; a very long text is one row's work,
of memory in proportion to it; doc_ids are whole numbers; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrille.llm.common import materialise, mix, release, shingle_hashes, word_hashes

BITS, SEGMENT = 20, 1024
BROADCAST_NODES = 500_000
MOST_MATCHES = 4
#: Nodes of a shingle that are paired directly; so each posting meets 15 others at most.
FEW = 16
#: A group of up to so many texts and shingles is linked in one task; keys of differences would be hundreds a member.
MOST_MEMBERS, MOST_SHINGLES = 1024, 500_000
#: A shingle with more postings than this is dealt to many tasks.
HOT_POSTINGS = 50_000
DIFFERENCES = "a long, b long, key long, bands long, n int, d int, pos int"
POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("l", "i1"), ("hub", "<u2"), ("pos", "<i4"), ("part", "<u2")])
_PLACE = np.uint64(64 - BITS)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    return shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass")), width)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n and key of each document; at the end of a task its part of the sketch, by segment."""
    counts = np.zeros(1 << BITS, dtype=np.uint32)
    names = ["doc_id", "n", "key", "segment", "counts"]
    for batch in batches:
        n, keys = [], []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            n.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            np.add.at(counts, (s >> _PLACE).astype(np.int64), 1)
        size = len(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=names)
    if counts.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(-1, SEGMENT)]
        size = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.array(range(size), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _sum_segments(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SEGMENT, dtype=np.uint64)
    for batch in batches:
        for part in batch.column("counts"):
            total += np.frombuffer(zlib.decompress(part.as_py()), dtype=np.uint32)
    capped = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([capped.tobytes()], pa.binary())], names=["segment", "counts"])


def prefix(s: np.ndarray, sketch: np.ndarray, load: float) -> tuple[np.ndarray, int, int]:
    """The prefix of a set, in order; its l; and a score of how frequent the set's shingles are, high for the middle of a
    family of near copies."""
    n = len(s)
    freq = sketch[(s >> _PLACE).astype(np.int64)].astype(np.float64)
    order = np.lexsort((s, freq))
    base = n - (3 * n + 3) // 4
    extra = np.cumsum(np.maximum(freq[order] - load - 1, 0.0))
    best, least = 1, None
    for k in range(1, min(MOST_MATCHES, n) + 1):
        end = min(base + k, n)
        cost = end + 4.0 * extra[end - 1] / k
        if least is None or cost < least:
            best, least = k, cost
    hub = int(min(np.log1p(np.maximum(freq - load, 0.0)).mean() * 4000, 65535)) if n else 0
    return s[order[: min(base + best, n)]], best, hub


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both) and both > 0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by pivot: first the pivot's texts, then its partners'."""
    pivot, sets = None, []
    for batch in batches:
        out: list[tuple[int, int]] = []
        for a, salt, member, b, text in zip(*(batch.column(k).to_pylist() for k in ("a", "salt", "member", "b", "text"))):
            if pivot != (a, salt):
                pivot, sets = (a, salt), []
            s = shingles(text)
            if not member:
                sets.append(s)
            elif any(_linked(p, s) for p in sets):
                out.append((a, b))
        cols = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _beside(docs: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The texts of pairs (a, b), by a: first those of a itself, then those of b; and the tables to release. A pivot a
    with many partners is dealt to 16 salts, but not where the pairs' column whole is true (salt -1)."""
    need = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-need")
    small = need.count() <= BROADCAST_NODES
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(need) if small else need, "id", "left_semi")
    texts = materialise(texts, f"{name}-texts")
    salt = F.pmod(F.xxhash64("b"), F.lit(16)).cast("int")
    salted = pairs.select("a", "b", (F.when(F.col("whole"), -1).otherwise(salt) if "whole" in pairs.columns else salt).alias("salt"))
    members = salted.join(texts, salted["b"] == texts["id"]).select("a", "salt", F.lit(1).alias("member"), "b", "text")
    heads = salted.select("a", "salt").distinct()
    pivots = heads.join(texts, heads["a"] == texts["id"]).select("a", "salt", F.lit(0).alias("member"), F.col("a").alias("b"), "text")
    return members.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "text"), [need, texts]


def verify_pairs(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The linked ones of pairs (a, b), from the whole texts."""
    rows, held = _beside(docs, pairs, name)
    out = materialise(rows.mapInArrow(_verify, "a long, b long").distinct(), f"{name}-links")
    release(*held)
    return out


def difference_rows(x: np.ndarray, p: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """The prefixes of x xor p, one for each band of partners that x can be similar to: the bands of both, the prefix in
    order (words only in x, from rare to frequent, then those only in p), and |x xor p|."""
    added, gone = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
    d, n, linked = len(added) + len(gone), len(x), len(p)
    excess, width = 7 * d - n, max(14, len(p))
    whole = np.concatenate([added[np.lexsort((added, sketch[(added >> _PLACE).astype(np.int64)]))], gone])
    own, low = excess // width, max(excess - 8 * n // 3 - 1, -(4 * n // 3) - 1)
    if excess <= linked:  # of two that both link with p nothing is asked
        low = max(low, linked + 1)
    for band in range(low // width, (excess + 2 * n) // width + 1):
        t = max(1, -(-(excess + max(low, band * width)) // 14))
        if t <= d:
            yield (min(own, band) + 4096) * 65536 + max(own, band) + 4096, whole[: d - t + 1], d


def links_within(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the sets of one group, fewer than it has members: a tree of each component."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(count), sizes)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    held = np.flatnonzero(often[token])
    owner, token = owner[held], (np.cumsum(often) - 1)[token[held]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((count, count), dtype=np.float32)
    for at in range(0, int(often.sum()), 2048):
        low, high = np.searchsorted(token, (at, at + 2048))
        block = np.zeros((count, 2048), dtype=np.float32)
        block[owner[low:high], token[low:high] - at] = 1
        both += block @ block.T
    both = both.astype(np.int64)
    linked = (100 * both >= 75 * (sizes[:, None] + sizes - both)) & (both > 0)
    out, unseen = [], np.ones(count, dtype=bool)
    for root in range(count):
        reached = [root] if unseen[root] else []
        unseen[root] = False
        while reached:
            i = reached.pop()
            found = np.flatnonzero(linked[i] & unseen).tolist()
            unseen[found] = False
            reached += found
            out += [(ids[i], ids[j]) for j in found]
    return out


def _differences(shared) -> Callable:
    """Links (key null) of the pivots with their members and of whole groups; keys of the members of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sets, group = None, [], []
        for batch in batches:
            made: list[tuple] = []
            for a, salt, member, b, text in zip(*(batch.column(k).to_pylist() for k in ("a", "salt", "member", "b", "text"))):
                if pivot != (a, salt):
                    made += _of_group(group)
                    pivot, sets, group = (a, salt), [], []
                s = shingles(text)
                if salt < 0:
                    group.append((b, s))
                    continue
                if not member:
                    sets.append(s)
                    continue
                if any(_linked(p, s) for p in sets):
                    made.append((a, b, None, None, 0, 0, 0))
                for k, p in enumerate(sets):
                    mark = mix(np.array([a, k], dtype=np.int64).view(np.uint64))
                    for bands, head, d in difference_rows(s, p, shared.value) if len(s) else ():
                        keys = mix(head ^ mix(mark[:1] + mark[1:] * np.uint64(bands))).view(np.int64)
                        made += [(a, b, key, bands, len(s), d, j) for j, key in enumerate(keys.tolist())]
                if len(made) > 100_000:
                    yield _posted(made)
                    made = []
            yield _posted(made)
        yield _posted(_of_group(group))

    return run


def _of_group(group: list[tuple[int, np.ndarray]]) -> list[tuple]:
    return [(a, b, None, None, 0, 0, 0) for a, b in links_within(*map(list, zip(*group)))] if group else []


def _posted(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in DIFFERENCES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.int32()) for c, (_, k) in zip(list(zip(*rows)) or [()] * 7, fields)], names=[f for f, _ in fields])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of an edge table (a, b)."""
    now = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("c")).distinct(), "edges")
    before = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("p", "c"))).first()
    while True:
        both = now.union(now.select(F.col("c").alias("p"), F.col("p").alias("c")))
        low = both.groupBy("p").agg(F.least(F.min("c"), F.first("p")).alias("m"))
        large = both.join(low, "p").filter("c > p").select(F.col("m").alias("p"), "c").filter("p <> c").distinct()
        # small star: c's smaller neighbours and c itself point to the smallest of them
        low = large.groupBy("c").agg(F.min("p").alias("m"))
        small = large.join(low, "c").select("c", "p", "m")
        after = small.filter("p <> m").select(F.col("m").alias("p"), F.col("p").alias("c")).union(low.select(F.col("m").alias("p"), "c")).distinct()
        after = materialise(after, "edges")
        state = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("p", "c"))).first()
        if state == before:  # the same distinct edges
            return after.groupBy(F.col("c").alias("node")).agg(F.min("p").alias("component"))
        release(now)
        now, before = after, state


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    profile = materialise(docs.select("doc_id", "text").mapInArrow(_profile, "doc_id long, n long, key binary, segment int, counts binary"), "profiles")
    rows = profile.filter("segment is null").select("doc_id", "n", "key")
    parts = profile.filter("segment is not null").select("segment", "counts").groupBy("segment").applyInArrow(_sum_segments, "segment int, counts binary").collect()
    sketch = np.zeros((1 << BITS) // SEGMENT * SEGMENT, dtype=np.uint32).reshape(-1, SEGMENT)
    for p in parts:
        sketch[p["segment"]] = np.frombuffer(p["counts"], dtype=np.uint32)
    total = int((rows.agg(F.sum("n")).first()[0]) or 0)
    shared = docs.sparkSession.sparkContext.broadcast(sketch.reshape(-1))
    load, buckets = total / (1 << BITS), max(12, total // 750_000)
    hot = max(HOT_POSTINGS, 8 * load)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            made = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                s = shingles(text.as_py())
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if i is None or not len(s) or (key, ) in seen:
                    continue
                if len(seen) > 50_000:
                    seen.clear()
                seen.add((key,))
                head, match, hub = prefix(s, table, load)
                p = np.empty(len(head), dtype=POSTING)
                p["token"], p["node"], p["n"], p["l"], p["hub"], p["pos"], p["part"] = head, i, len(s), match, hub, np.arange(len(head)), int.from_bytes(key[:2], "little")
                made.append(p)
            if made:
                whole = np.concatenate(made)
                bucket = (mix(whole["token"].copy()) % np.uint64(buckets)).astype(np.int64)
                # a shingle of very many documents is no rare one; its postings are dealt by node and need no look at each other
                often = table[(whole["token"] >> _PLACE).astype(np.int64)] > hot
                bucket[often] = buckets + whole["node"][often] % buckets
                order = np.argsort(bucket, kind="stable")
                whole, ends = whole[order], np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
                some = [k for k in range(2 * buckets) if ends[k] < ends[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([whole[ends[k] : ends[k + 1]].tobytes() for k in some], pa.binary())], names=["bucket", "blob"])

    def shared_tokens(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.frombuffer(b"".join(x.as_py() for b in batches for x in b.column("blob")), dtype=POSTING)
        token = whole["token"]
        order = np.argsort(token, kind="stable")
        token = token[order]
        again = token[1:] == token[:-1]
        keep = order[np.append(again, False) | np.insert(again, 0, False)] if len(token) and key[0].as_py() < buckets else order
        for at in range(0, len(keep), 200_000):
            x = whole[keep[at : at + 200_000]]
            cols = [x["token"].view("<u8").astype(np.int64), x["node"], x["n"], *(x[k].astype(np.int32) for k in ("l", "hub", "pos", "part"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["token", "id", "n", "l", "hub", "pos", "part"])

    blobs = docs.select("doc_id", "text").mapInArrow(postings, "bucket int, blob binary")
    found = blobs.groupBy("bucket").applyInArrow(shared_tokens, "token long, id long, n int, l int, hub int, pos int, part int")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"))
    known = materialise(rows.join(classes, "key", "left").withColumn("node", F.coalesce("node", "doc_id")).select("doc_id", "n", "node"), "nodes")
    copies = known.filter("node <> doc_id").select(F.col("doc_id").alias("id"), "node")
    several = materialise(found, "shared-shingles")
    found = several.join(copies, "id", "left").select("token", F.coalesce("node", "id").alias("node"), "n", "l", "hub", "pos", "part").distinct()
    found = materialise(found, "postings")
    release(several)

    # each node against one pivot of its shingles, the middle of a family
    labelled = found.withColumn("comp", F.col("node"))
    tops = labelled.groupBy("token").agg(F.max_by(F.struct("node", "n", "l", "comp", "pos", "part"), F.struct("hub", -F.col("node"))).alias("t"))
    star = _enough(labelled.join(tops, "token"), "t.", "")
    best = materialise(star.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b"), "star")
    links = verify_pairs(docs, best, "star")
    comp = materialise(components(links), "components")
    # shingles of one component can link nothing new; main is the component with the most nodes of a shingle
    labelled = _labelled(found, comp, "node")
    sizes = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("token")
    sizes = sizes.agg(F.sum("size").alias("g"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("size", "comp")).alias("main"))
    mixed = materialise(labelled.join(sizes.filter("comps > 1").select("token", "main", "g"), "token"), "mixed")
    # the nodes of a shingle that many share meet by bands of sizes: sets in similar pairs are of one band or the next
    wide = mixed.filter(F.col("g") > FEW).withColumn("own", F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1).cast("int")).withColumn("band", F.explode(F.array("own", F.col("own") + 1))).drop("g", "main")
    sizes = wide.groupBy("token", "band", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("token", "band")
    sizes = sizes.agg(F.sum("size").alias("g"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("size", "comp")).alias("main"))
    wide = wide.join(sizes.filter("comps > 1").drop("comps"), ["token", "band"])
    narrow = mixed.filter(F.col("g") <= FEW).withColumn("own", F.lit(0)).withColumn("band", F.lit(0))
    banded = materialise(narrow.unionByName(wide), "banded")
    few, many = banded.filter(F.col("g") <= FEW), banded.filter(F.col("g") > FEW)
    met = few.filter("comp <> main").alias("a").join(few.alias("b"), ["token", "band"]).filter("band = greatest(a.own, b.own) and (b.comp = b.main or a.node < b.node)")
    pairs = _enough(met, "a.", "b.", unordered=True).select("a", "b")
    tops = many.groupBy("token", "band").agg(F.max_by("node", F.struct("hub", -F.col("node"))).alias("a"))
    groups = materialise(many.join(tops, ["token", "band"]).select("a", F.col("node").alias("b")).filter("a <> b").distinct(), "groups")
    # of the rows of documents, as several may share a doc_id
    texts = groups.union(groups.select("a", "a").distinct()).join(known.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    whole = texts.select("a", ((F.col("texts") <= MOST_MEMBERS) & (F.col("n") <= MOST_SHINGLES)).alias("whole"))
    rows, used = _beside(docs, groups.join(whole, "a"), "groups")
    rows = materialise(rows.mapInArrow(_differences(shared), DIFFERENCES), "differences")
    links = links.union(rows.filter("key is null").select("a", "b").distinct())
    keyed = _labelled(rows.filter("key is not null"), comp, "b")
    # of the keys with the same nodes, the first in order comes first for each of them, and one suffices
    sets = keyed.groupBy("key").agg(F.first("a").alias("a"), F.count(F.lit(1)).alias("g"), F.bit_xor(F.xxhash64("b", "n", "d")).alias("who"), F.min("pos").alias("at"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    firsts = sets.filter("low <> high").groupBy("a", "g", "who").agg(F.min_by("key", F.struct("at", "key")).alias("key")).select("key")
    # where two have the same key just before, their pair comes of that one
    order = W.partitionBy("a", "b", "n", "d", "bands").orderBy("pos", "key")
    keyed = materialise(keyed.join(firsts, "key", "left_semi").withColumn("before", F.lag("key").over(order)), "keyed")
    t = "greatest(1, ceil((7 * (x.d + y.d) - x.n - y.n) / 14))"
    near = keyed.alias("x").join(keyed.alias("y"), "key").filter(f"x.b < y.b and (x.before is null or y.before is null or x.before <> y.before) and x.comp <> y.comp and 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n) and x.pos <= x.d - {t} and y.pos <= y.d - {t}")
    pairs = pairs.union(near.select(F.col("x.b").alias("a"), F.col("y.b").alias("b")))
    pairs = materialise(pairs.distinct(), "pairs")
    links = links.union(verify_pairs(docs, pairs, "cross"))
    comp = materialise(components(links), "components")
    release(profile, found, mixed, banded, best, groups, *used, rows, keyed, pairs)
    out = known.join(comp, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def _enough(joined: DataFrame, x: str, y: str, unordered: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that share enough prefix tokens (c) to be similar.

    The smaller set takes part with its short prefix, of n - ceil(6n/7) + l tokens, the larger one with
    n - ceil(3n/4) + l. Beyond the prefix that ends first, a pair shares at most the rest of that set, so of the
    ceil(3(n + m)/7) tokens that a similar pair must share, all but the larger rest lie in both prefixes. Where the
    places of a shared token are far apart, too few tokens can be shared before and after it. part tells apart the texts
    that share a doc_id."""
    x_small = f"({x}n < {y}n or ({x}n = {y}n and {x}node < {y}node))"
    rest = [f"(if({is_small}, (6 * {p}n + 6) div 7, (3 * {p}n + 3) div 4) - {p}l)" for p, is_small in ((x, x_small), (y, f"not {x_small}"))]
    short = [f"{p}pos < {p}n - (6 * {p}n + 6) div 7 + {p}l" for p in (x, y)]
    least, after = f"(3 * ({x}n + {y}n) + 6) div 7", f"least({x}n - {x}pos, {y}n - {y}pos)"
    fit = joined.filter(
        f"{x}comp <> {y}comp and 4 * least({x}n, {y}n) >= 3 * greatest({x}n, {y}n) and if({x_small}, {short[0]}, {short[1]}) and least({x}pos, {y}pos) + {after} >= {least}"
    )
    one, two = F.expr(f"{x}node"), F.expr(f"{y}node")
    if unordered:
        one, two = F.least(one, two), F.greatest(one, two)
    keys = [F.expr(f"least({x}part, {y}part)").alias("p"), F.expr(f"greatest({x}part, {y}part)").alias("q")]
    counted = fit.groupBy(one.alias("a"), two.alias("b"), *keys).agg(F.count(F.lit(1)).alias("c"), F.expr(f"min({after})").alias("after"), F.expr(f"min({least})").alias("least"), F.expr(f"max(greatest(0, {rest[0]}, {rest[1]}))").alias("rest"))
    return counted.filter("c >= least - rest and c + after - 1 >= least").groupBy("a", "b").agg(F.max("c").alias("c"))


def _labelled(rows: DataFrame, comp: DataFrame, node: str) -> DataFrame:
    """rows with the component (comp) of the node in a column."""
    known = comp.select(F.col("node").alias("_node"), F.col("component").alias("_comp"))
    return rows.join(known, rows[node] == known["_node"], "left").withColumn("comp", F.coalesce("_comp", node)).drop("_node", "_comp")
