"""MinHash near-duplicates with odd sketches.

1. Each text becomes the set of its distinct word shingles (64-bit hashes). ROWS * BANDS MinHash samples make the band
   keys, and the same samples are folded into an odd sketch: a bitmap in which each sample flips one bit.
2. Texts with equal sets are one node, named by the least doc_id among them.
3. Nodes that share a band key are candidates. Inside a bucket the count of unequal sketch bits estimates the
   similarity (odd sketches are precise where it is high); nodes whose estimate is at least the threshold less MARGIN,
   far outside the estimate's error, are joined by a breadth-first search, which gives a forest and not all pairs.
4. The connected components of these forests are small regions that hold every true link. Within a region the full
   shingle sets are compared: a breadth-first search over exact intersections, counted through an inverted index,
   gives the true components. Texts outside regions are never shuffled again.

Buckets beyond CHUNK nodes and regions beyond REGION_SHINGLES shingles are cut into chunks and all pairs of chunks are searched, so that memory is
bounded and no link is lost. Components come from min-label rounds with pointer jumping on edge tables.

Edge cases. Null, empty and blank texts have an empty set: they link with nothing and are their own component. Texts
shorter than a shingle have their whole word sequence as the only shingle. A row whose doc_id is null is alone: its
component_id is null and it is kept. Rows that repeat a doc_id are one node: each gets a result row, and their
links unite. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, shuffle_width, stored

ROWS = 5
BANDS = 24
SKETCH_BITS = 512
MARGIN = 0.2
CHUNK = 4096
REGION_SHINGLES = 750_000
MOST_BROADCAST = 2_000_000

_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIP = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD[4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[5]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to sorted distinct 64-bit shingle hashes."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        self.factors = [(int(_ODD[k % 4]) * (2 * k + 1) * (k // 4 * 2 + 1)) | 1 for k in range(n)]
        self.factors = np.array([f & 0xFFFFFFFFFFFFFFFF for f in self.factors], np.uint64)

    def _word(self, w: bytes) -> int:
        if len(self.known) > 1_000_000:
            self.known.clear()
        h = self.known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        known, word = self.known, self._word
        hashes = [known.get(w) or word(w) for w in (text or "").encode().lower().split()]  # bytes: blanks and A-Z are ASCII's
        if not hashes:
            return np.zeros(0, np.uint64)
        h = np.array(hashes, np.uint64)
        n = min(self.n, len(h))
        total = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            total += _mix(h[k : len(h) - n + 1 + k] ^ self.factors[k]) * self.factors[k]
        return np.unique(_mix(total))


def samples(shingles: np.ndarray) -> np.ndarray:
    """ROWS * BANDS MinHash samples, 32 bits each."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_FLIP), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 256):
        least = np.minimum(least, ((folded[at : at + 256, None] ^ _FLIP) * _MULTIPLY).min(0))
    return least


def band_keys(s: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row of samples."""
    x = s.reshape(len(s), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0], (len(s), BANDS)).copy()
    for k in range(ROWS):
        out = _mix(out * _ODD[1] + x[:, :, k])
    return out.view(np.int64)


def odd_sketches(s: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits per row of samples: bit b is the parity of the samples that hash to b."""
    place = _mix(s.astype(np.uint64) * _ODD[2] + np.arange(s.shape[1], dtype=np.uint64) * _ODD[3]) % np.uint64(SKETCH_BITS)
    bits = np.zeros((len(s), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(bits, (np.repeat(np.arange(len(s)), s.shape[1]), place.ravel().astype(np.int64)), 1)
    return np.packbits(bits, axis=1).view(np.uint64)


def most_unequal_bits(similarity: float) -> int:
    """The expected number of unequal sketch bits at a similarity."""
    return int(SKETCH_BITS * (1 - np.exp(-4 * ROWS * BANDS * (1 - similarity) / SKETCH_BITS)) / 2)


def search(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Breadth-first forest over 0..n-1. near(i, others): those of others linked with i."""
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if len(hit):
                yield from ((i, int(j)) for j in hit)
                left = left[~np.isin(left, hit, assume_unique=True)]
                queue += hit.tolist()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), keys, sketch."""

    def run(batches):
        make = Shingler(shingle)
        for batch in batches:
            for part in range(0, len(batch), 1024):
                piece = batch.slice(part, 1024)
                sets = [make(t.as_py()) for t in piece.column(1)]
                filled = [i for i, s in enumerate(sets) if len(s)]
                keys, sketch = [None] * len(sets), [None] * len(sets)
                if filled:
                    s = np.stack([samples(sets[i]) for i in filled])
                    for i, k, o in zip(filled, band_keys(s), odd_sketches(s), strict=True):
                        keys[i], sketch[i] = k, o.tobytes()
                yield pa.record_batch({
                    "doc_id": piece.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    "keys": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary()),
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary")


def _bucket_forest(limit: int) -> Callable:
    """For batches of rows sorted by (key, low, high): edges of each bucket's forest."""

    def edges(node: np.ndarray, sketch: np.ndarray, side: np.ndarray, own: bool) -> list[tuple[int, int]]:
        def near(i, others):
            ok = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1) <= limit
            if not own:
                ok &= side[others] != side[i]
            return others[ok]

        return [(node[i], node[j]) for i, j in search(len(node), near) if node[i] != node[j]]

    def run(frames):
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            last = f.iloc[-1][["key", "low", "high"]]
            open_rows = (f.key == last.key) & (f.low == last.low) & (f.high == last.high)
            done, rest = f[~open_rows], f[open_rows]
            if len(done):
                yield one(done)
        if rest is not None and len(rest):
            yield one(rest)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        node, side = f.node.to_numpy(), f.chunk.to_numpy()
        sketch = np.frombuffer(b"".join(f.sketch), np.uint64).reshape(len(f), -1)
        key, low, high = f.key.to_numpy(), f.low.to_numpy(), f.high.to_numpy()
        new = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(f)])
        first = np.repeat(start, size)
        same = np.bitwise_count(sketch ^ sketch[first]).sum(1) <= limit
        star = np.logical_and.reduceat(same, start) & (low[start] == high[start])  # the first row is near to all others
        wide = np.repeat(star, size) & (node != node[first])
        out = list(zip(node[first[wide]].tolist(), node[wide].tolist(), strict=True))
        for s, n in zip(start[~star], size[~star], strict=True):
            out += edges(node[s : s + n], sketch[s : s + n], side[s : s + n], low[s] == high[s])
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node reachable) for every node of an edge table a, b.

    Rounds of least-neighbour labels and pointer jumping; each round's table is written to the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    label = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), f"{name}-0")
    k = 0
    while True:
        k += 1
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = label.join(seen, "node").select("node", "component", F.least("component", "near").alias("next"))
        # the component of the label itself, looked up as another node
        jump = label.select(F.col("node").alias("next"), F.col("component").alias("further"))
        new = lower.join(jump, "next", "left").select("node", F.col("component").alias("old"), F.least("next", F.coalesce("further", "next")).alias("component"))
        new = stored(new, f"{name}-{k}")
        changed = new.filter("old <> component").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label


def _paired(rows: DataFrame, by: str, chunk: int, weight: str | None = None) -> DataFrame:
    """rows with size, chunk, low, high: groups of up to `chunk` rows (or of that weight) once, larger ones once for
    every pair of their chunks."""
    own = F.lit(1).cast("long") if weight is None else F.col(weight)
    w = Window.partitionBy(by)
    so_far = F.sum(own).over(w.orderBy("node").rowsBetween(Window.unboundedPreceding, 0)) - own
    ranked = rows.withColumn("chunk", F.floor(so_far / chunk).cast("int"))
    ranked = ranked.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("last", F.max("chunk").over(w))
    return ranked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        *rows.columns, "size", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    )


def regions(nodes: DataFrame, threshold: float) -> DataFrame:
    """node, region for nodes that have a candidate. nodes: node, keys, sketch."""
    width = shuffle_width(nodes.sparkSession)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    bucketed = stored(_paired(keyed, "key", CHUNK).filter("size > 1").drop("size"), "buckets")
    full = bucketed.join(nodes.select("node", "sketch"), "node")
    sorted_rows = full.repartition(width, "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    forest = sorted_rows.mapInPandas(_bucket_forest(most_unequal_bits(threshold - MARGIN)), "a long, b long")
    return components(stored(forest.distinct(), "candidates"), "regions").withColumnRenamed("component", "region")


def _true_links(shingle: int, percent: int) -> Callable:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        make = Shingler(shingle)
        node, side, own = f.node.to_numpy(), f.chunk.to_numpy(), bool((f.low == f.high).all())
        sets = [make(t) for t in f.text]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, term = np.unique(flat, return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), size)
        starts = np.r_[0, np.cumsum(size)]
        by_term = np.argsort(term, kind="stable")
        posting = doc[by_term]
        edge = np.r_[0, np.cumsum(np.bincount(term))]

        def near(i, others):
            mine = term[starts[i] : starts[i + 1]]
            if len(others) < 24:
                mark = np.zeros(len(edge), bool)
                mark[mine] = True
                common = np.array([mark[term[starts[j] : starts[j + 1]]].sum() for j in others])
            else:
                lists = [posting[edge[t] : edge[t + 1]] for t in mine]
                common = np.bincount(np.concatenate(lists), minlength=len(sets))[others]
            ok = 100 * common >= percent * (size[i] + size[others] - common)
            if not own:
                ok &= side[others] != side[i]
            return others[ok]

        out = [(node[i], node[j]) for i, j in search(len(node), near) if node[i] != node[j]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sig = stored(signatures(docs, shingle), "signatures")
    empty = sig.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    known = sig.filter("digest is not null and doc_id is not null")
    nodes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "keys", "sketch")).alias("x"))
    nodes = stored(nodes.select("digest", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), F.col("x.keys").alias("keys"), F.col("x.sketch").alias("sketch")), "nodes")
    region = regions(nodes.select("node", "keys", "sketch"), percent / 100)
    heavy = region.join(nodes.groupBy("node").agg(F.sum("n").alias("n")), "node")
    placed = _paired(heavy, "region", REGION_SHINGLES, "n").drop("size", "n")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").filter("node is not null")
    sets = placed.join(texts, "node")
    links = stored(sets.groupBy("region", "low", "high").applyInPandas(_true_links(shingle, percent), "a long, b long"), "links")
    ids = known.select("doc_id", "n_shingles", "digest").join(nodes.select("digest", "node"), "digest")
    shared = ids.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # an id that stands for two sets ties them together; ids that stand for one need no edge
    twice = known.groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).filter("d1 <> d2").select(F.col("doc_id").alias("a"))
    ties = shared.join(twice, "a", "left_semi")
    label = components(links.unionByName(ties), "links").select("node", "component")
    out = ids.join(label, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_near_dup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 4, 80)


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with the input's columns.

    A group's document is that with the least id. Rows without an id stay. Of rows that repeat an id with the same text
    one stays, that with the least other columns; rows that repeat an id with other texts are documents of their own
    and stay or go with their id. Only the rows of repeated ids are sorted; no other text is shuffled but for the
    anti-join where the ids that go don't fit a broadcast."""
    drop = near_duplicates(docs, shingle, percent).filter("not kept").select("doc_id").distinct()
    repeated = stored(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    left = docs.join(broadcast_if(stored(drop, "dropped-ids"), MOST_BROADCAST), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = broadcast_if(repeated, MOST_BROADCAST)
    once = left.join(again, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if repeated.isEmpty():
        return once
    name = "row"
    while name in docs.columns:
        name += "_"
    order = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order, F.lit(1)))
    several = left.join(again, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(several.withColumn(name, place).filter(F.col(name) == 1).drop(name))
