"""Katz back-off language model over words, of any order, counted from and evaluated on whole corpora.

P(w | h) = d_k(r) r / c(h) for a k-gram hw seen r > 0 times in training, else alpha(h) P(w | h'), where h' is h without
its first word; the recursion ends at words: P(w) is the discounted share, or what the discounts leave over for the one
unknown word. d_k is Good-Turing's discount of level k up to K counts. alpha(h) is (1 - sum of the seen followers'
shares) / (1 - sum of their P(w | h')), computed for every context from all its distinct followers, so each context's
distribution sums to one exactly. A context whose discounts leave nothing over has its shares scaled by c / (c + 1).
A document's first words have shorter contexts, which begin with the mark START.

The model is a set of tables, each partitioned by ranges of the n-gram's 64-bit key, with sorted compressed columns:
  grams/level=k    range, keys, counts: the k-grams of the training documents
  alphas/level=k   range, keys, alphas, bare: the contexts of level k (n-grams of k - 1 words), bare where scaled
  stats            per level the sums that the discounts come from, and the tables' number of ranges
`load` reads it back and `score_with` scores other documents from the tables alone.

Documents are packed into batches: distinct word hashes and token numbers. Batches lie in a table bucketed by their
number, so that answers join them without moving them. Per level every batch sends its distinct k-grams with training
counts to their ranges and gets corpus counts back, and the news which of them it owns (one batch of those that have
it). Then it sends per context what its owned followers add up to, and gets alpha back where one of its tokens backs
off. So a frequent n-gram crosses once per batch, not once per occurrence, and a context with very many followers is
spread over the ranges of all of them.

Edge cases. A null text has the end token only. A null doc_id counts as empty text in the choice of training rows.
Rows that repeat count and score each. Without training rows every token has probability 1. An empty table gives no
rows. Other columns are ignored. A text of any length is in one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, new_path, stored

ORDER = 2
K = 5
TOKENS_A_BATCH = 2_000_000
KEYS_A_RANGE = 1_000_000
END, START = 0x0123456789ABCDEF, 0x0FEDCBA987654321

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(x: np.ndarray, deltas: bool = False) -> bytes:
    """An array's byte planes, compressed; deltas for sorted numbers."""
    x = np.ascontiguousarray(x)
    if deltas and len(x):
        x = np.r_[x[:1], np.diff(x)]
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind, deltas: bool = False) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    x = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if deltas else x


def pack_bits(x: np.ndarray) -> bytes:
    return pack(np.packbits(x))


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(data, np.uint8), count=n).astype(bool)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ _A) * _B + (b ^ (b >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def batches(docs: DataFrame, is_held) -> DataFrame:
    """batch, ids, held, sizes, words (sorted hashes), tokens (numbers of words): one row per batch of documents."""

    def run(arrow):
        from pyspark import TaskContext

        known: dict[bytes, int] = {}
        part, k = TaskContext.get().partitionId(), 0
        ids, held, docs_tokens, n = [], [], [], 0

        def word(w: bytes) -> int:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            return h

        def row():
            nonlocal k
            flat = np.concatenate(docs_tokens)
            words, tokens = np.unique(flat, return_inverse=True)
            out = pa.record_batch({
                "batch": pa.array([part << 32 | k], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([pack(np.array(held, np.uint8))]),
                "sizes": pa.array([pack(np.array([len(x) for x in docs_tokens], np.uint32))]), "words": pa.array([pack(words, True)]),
                "tokens": pa.array([pack(tokens.astype(np.uint32))]), "n_words": pa.array([len(words)], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64()),
                "n_train": pa.array([len(held) - sum(held)], pa.int64()),
            })
            k += 1
            return out

        for batch in arrow:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = [known.get(w) or word(w) for w in (text.as_py() or "").encode().lower().split()]
                x.append(END)
                ids.append(doc_id)
                held.append(bool(is_held(doc_id)))
                docs_tokens.append(np.array(x, np.uint64))
                n += len(x)
                if n >= TOKENS_A_BATCH:
                    yield row()
                    ids, held, docs_tokens, n = [], [], [], 0
        if ids:
            yield row()

    schema = "batch long, ids array<long>, held binary, sizes binary, words binary, tokens binary, n_words long, n_tokens long, n_train long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Batch:
    """A batch row, unpacked."""

    def __init__(self, row):
        self.ids, self.held, self.sizes = row.ids, unpack(row.held, np.uint8), unpack(row.sizes, np.uint32).astype(np.int64)
        self.words, self.tokens = unpack(row.words, np.uint64, True), unpack(row.tokens, np.uint32)
        self.first = np.r_[0, np.cumsum(self.sizes)[:-1]].astype(np.int64)
        self.levels: dict[int, tuple] = {}

    @cached_property
    def in_training(self) -> np.ndarray:
        return np.repeat(self.held == 0, self.sizes)

    def _raw(self, level: int) -> np.ndarray:
        if level == 1:
            return self.words[self.tokens]
        return pair_keys(self.contexts(level), self.words[self.tokens])

    def contexts(self, level: int) -> np.ndarray:
        """Each token's context at a level: the key of the level - 1 words before it, START at a document's first."""
        out = np.empty(len(self.tokens), np.uint64)
        out[1:] = self._raw(level - 1)[:-1]
        out[self.first] = START
        return out

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct k-gram keys, and each token's."""
        if level not in self.levels:
            self.levels[level] = (self.words, self.tokens) if level == 1 else np.unique(self._raw(level), return_inverse=True)
        return self.levels[level]


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(range, slice) of sorted keys by their highest bits."""
    if not len(keys):
        return
    top = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(top)) + 1, len(keys)]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(top[lo]), slice(lo, hi)


def _bits(n_keys: int) -> int:
    return max(4, int(np.ceil(np.log2(max(1, n_keys / KEYS_A_RANGE)))))


#: What batches send: kind is "grams" or "contexts" of a level.
_SENT = "range int, batch long, keys binary, values binary"
#: What ranges hold and answer. batch is null in the model's own rows.
_BACK = "range int, batch long, kind string, keys binary, values binary, stats array<long>"


def _columns(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def send_grams(packed: DataFrame, level: int, bits: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                b = Batch(row)
                keys, of = b.grams(level)
                counts = np.bincount(of[b.in_training], minlength=len(keys)).astype(np.uint32)
                rows = [(r, row.batch, pack(keys[s], True), pack(counts[s])) for r, s in _ranges(keys, bits)]
                yield _frame(rows, _SENT)

    return packed.mapInPandas(run, _SENT)


def _count_stats(counts: np.ndarray) -> list[int]:
    """N, V, n1 .. n(K+1) of a range."""
    return [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, K + 2))]


def merge_grams(f: pd.DataFrame) -> pd.DataFrame:
    """For the rows of a range: the model's keys and counts; for each batch corpus counts and which keys it owns."""
    f = f.sort_values("batch")
    keys = [unpack(x, np.uint64, True) for x in f["keys"]]
    sizes = [len(x) for x in keys]
    flat, of_keys = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.zeros(len(of_keys), bool)
    first = np.full(len(flat), len(of_keys))
    np.minimum.at(first, of_keys, np.arange(len(of_keys)))
    own[first] = True
    counts = np.bincount(of_keys, np.concatenate([unpack(x, np.uint32) for x in f["values"]]), minlength=len(flat)).astype(np.uint32)
    at, rows, r = 0, [], int(f["range"].iloc[0])
    for batch, n in zip(f.batch, sizes, strict=True):
        rows.append((r, batch, "answer", pack_bits(own[at : at + n]), pack(counts[of_keys[at : at + n]]), None))
        at += n
    seen = counts > 0
    rows.append((r, None, "model", pack(flat[seen], True), pack(counts[seen]), _count_stats(counts)))
    return _back(rows)


def _back(rows: list) -> pd.DataFrame:
    out = _frame(rows, _BACK)
    return out.assign(batch=out["batch"].astype("Int64"))


def discounts(n: list[int]) -> np.ndarray:
    """d(1) .. d(K) from n1 .. n(K+1): Good-Turing's where they are sound, else an absolute discount."""
    r = np.arange(1, K + 1)
    n = np.asarray(n, float)
    if (n > 0).all():
        rest = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - rest) / (1 - rest) if rest < 1 else np.zeros(K)
        if (d > 0).all() and (d < 1).all():
            return d
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return (r - min(cut, 0.99)) / r


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return r * np.r_[1.0, d, 1.0][np.minimum(r, K + 1)]


class Unigrams:
    """P of words by their training counts."""

    def __init__(self, stats: list[int]):
        self.n, self.v, of = stats[0], stats[1], stats[2:]
        self.d = discounts(of)
        # what is left over belongs to the unknown word; every count above K keeps its full share
        self.unknown = sum(c * r * (1 - self.d[r - 1]) for r, c in zip(range(1, K + 1), of[:K], strict=True)) / self.n if self.n else 1.0
        self.scale = 1.0
        if self.unknown <= 1e-12:
            self.scale, self.unknown = self.n / (self.n + 1), 1 / (self.n + 1)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        seen = discounted(c, self.d) * self.scale / max(1, self.n)
        return np.where(c > 0, seen, self.unknown)


@dataclass
class Model:
    """What every task needs to know of a model: per level its sums and its tables' bits; the number of documents."""

    path: str
    stats: list[list[int]]
    bits: list[int]
    documents: int

    @property
    def order(self) -> int:
        return len(self.stats)

    @cached_property
    def unigrams(self) -> Unigrams:
        return Unigrams(self.stats[0])

    @cached_property
    def discounts(self) -> list[np.ndarray]:
        return [discounts(s[2:]) for s in self.stats]


class Answers:
    """A batch's answers, by level: counts (and owned keys) of its k-grams, and what came back for its contexts."""

    def __init__(self, b: Batch, back: pd.DataFrame, model: Model):
        self.b, self.model = b, model
        self.rows = {k: f.sort_values("range") for k, f in back.groupby(["level", "kind"])}
        self.found: dict[int, np.ndarray] = {}

    def counts(self, level: int) -> np.ndarray:
        """Each token's k-gram's training count."""
        if level not in self.found:
            got = self.rows[level, "answer"]
            self.found[level] = np.concatenate([unpack(x, np.uint32) for x in got["values"]]).astype(np.int64)[self.b.grams(level)[1]]
        return self.found[level]

    def owned(self, level: int) -> np.ndarray:
        keys, got = self.b.grams(level)[0], self.rows[level, "answer"]
        parts = zip(got["keys"], _ranges(keys, self.model.bits[level - 1]), strict=True)
        return np.concatenate([unpack_bits(x, s.stop - s.start) for x, (_, s) in parts])

    def totals(self, level: int) -> np.ndarray:
        """Each token's context's training count."""
        c = self.counts(level - 1)
        out = np.r_[0, c[:-1]]
        out[self.b.first] = self.model.documents
        return out

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of which a token backs off, and those that may be bare: sorted keys each."""
        total, context = self.totals(level), self.b.contexts(level)
        return np.unique(context[(total > 0) & (self.counts(level) == 0)]), np.unique(context[total > K])

    def p(self, level: int) -> np.ndarray:
        """Each token's probability at a level, from those below."""
        r = self.counts(level)
        if level == 1:
            return self.model.unigrams(r)
        total, context = self.totals(level), self.b.contexts(level)
        alpha, bare = np.ones(len(r)), np.zeros(len(r), bool)
        off, wide = self.asked(level)
        got = self.rows.get((level, "alpha"))
        if got is not None:
            parts = [_split(x) for x in got["values"]]
            of_off = np.concatenate([unpack(x[0], np.float64) for x in parts])
            of_wide = np.concatenate([unpack(x[1], np.uint8) for x in parts]).astype(bool)
            use = (total > 0) & (r == 0)
            alpha[use] = of_off[np.searchsorted(off, context[use])]
            use = total > K
            bare[use] = of_wide[np.searchsorted(wide, context[use])]
        seen = discounted(r, self.model.discounts[level - 1]) / np.maximum(total, 1) * np.where(bare, total / (total + 1.0), 1.0)
        return np.where(r > 0, seen, alpha * self.p(level - 1))


_SUMS = [("c", np.uint32), *((f"m{r}", np.uint32) for r in range(1, K + 1)), ("den", np.float64)]


def send_contexts(level: int, model: Model, adds: bool) -> Callable:
    """For a batch: the contexts that it asks about and, where adds, what its owned followers add up to."""

    def run(left: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            b = Batch(row)
            a = Answers(b, back, model)
            off, wide = a.asked(level)
            names, sums = np.zeros(0, np.uint64), {}
            if adds:
                keys, of = b.grams(level)
                place = np.empty(len(keys), np.int64)
                place[of[::-1]] = np.arange(len(of))[::-1]
                r = a.counts(level)[place]
                use = a.owned(level) & (r > 0)
                place, r = place[use], r[use]
                names, of_name = np.unique(b.contexts(level)[place], return_inverse=True)
                add = lambda w, of_name=of_name, n=len(names): np.bincount(of_name, w, minlength=n)
                total = np.zeros(len(names))
                total[of_name] = a.totals(level)[place]
                sums = {"c": total, "den": add(a.p(level - 1)[place])} | {f"m{k}": add(r == k) for k in range(1, K + 1)}
            every = np.unique(np.concatenate([names, off, wide]))
            at = np.searchsorted(names, every) if len(names) else np.zeros(len(every), np.int64)
            has = (names[np.minimum(at, len(names) - 1)] == every) if len(names) else np.zeros(len(every), bool)
            is_off, is_wide = np.isin(every, off, assume_unique=True), np.isin(every, wide, assume_unique=True)
            for rng, s in _ranges(every, model.bits[max(0, level - 2)]):
                mine = at[s][has[s]]
                values = [pack_bits(has[s]), pack_bits(is_off[s]), pack_bits(is_wide[s]), *(pack(sums[n][mine].astype(t)) for n, t in _SUMS if adds)]
                out.append((rng, row.batch, pack(every[s], True), _columns(*values)))
        return _frame(out, _SENT)

    return run


def _answer_contexts(rows: list, asks: list, r: int, flat: np.ndarray, alpha: np.ndarray, bare: np.ndarray) -> None:
    """asks: batch, keys, and the bits of those that back off and those that may be bare. flat: known contexts."""
    for batch, mine, off, wide in asks:
        at = np.minimum(np.searchsorted(flat, mine), max(0, len(flat) - 1))
        ok = flat[at] == mine if len(flat) else np.zeros(len(mine), bool)
        a, z = (np.where(ok, x[at] if len(flat) else 0, other) for x, other in ((alpha, 1.0), (bare, False)))
        rows.append((r, batch, "alpha", None, _columns(pack(a[off].astype(np.float64)), pack(z[wide].astype(np.uint8))), None))


def merge_contexts(level: int, model: Model) -> Callable:
    """alpha of every context of a range, for the model and for the batches that asked."""
    d = model.discounts[level - 1]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("batch")
        asks, names, sums = [], [], {n: [] for n, _ in _SUMS}
        for batch, keys, values in zip(f.batch, f["keys"], f["values"], strict=True):
            keys, (has, off, wide, *cols) = unpack(keys, np.uint64, True), _split(values)
            has, off, wide = (unpack_bits(x, len(keys)) for x in (has, off, wide))
            asks.append((batch, keys, off, wide))
            names.append(keys[has])
            for (n, t), x in zip(_SUMS, cols, strict=True):
                sums[n].append(unpack(x, t))
        flat, of = np.unique(np.concatenate(names), return_inverse=True)
        add = lambda n: np.bincount(of, np.concatenate(sums[n]), minlength=len(flat))
        c = np.zeros(len(flat))
        c[of] = np.concatenate(sums["c"])
        left = sum(k * (1 - d[k - 1]) * add(f"m{k}") for k in range(1, K + 1)) / np.maximum(c, 1)
        bare = left < 1e-9
        alpha = np.where(bare, 1 / (c + 1), left) / np.maximum(1 - add("den"), 1e-300)
        rows, r = [], int(f["range"].iloc[0])
        _answer_contexts(rows, asks, r, flat, alpha, bare)
        rows.append((r, None, "model", pack(flat, True), _columns(pack(alpha), pack_bits(bare)), None))
        return _back(rows)

    return run


def _by_range(sent: DataFrame, merge: Callable, path: str) -> DataFrame:
    """The ranges' rows, written once: the model's under path, split from the answers by partition."""
    sent.groupBy("range").applyInPandas(merge, _BACK).write.option("compression", "none").partitionBy("kind").parquet(path)
    return sent.sparkSession.read.schema(_BACK).parquet(path)


def _answers(spark: SparkSession, tables: list[tuple[int, DataFrame]]) -> DataFrame:
    out = None
    for level, t in tables:
        t = t.filter("kind <> 'model'").select("batch", "range", F.lit(level).alias("level"), "kind", "keys", "values")
        out = t if out is None else out.unionByName(t)
    return out


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def evaluate(model: Model) -> Callable:
    """A batch and its answers to the result's rows."""

    def run(left: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({x.split()[0]: pd.array([], {"long": "Int64", "boolean": "boolean", "double": "float64"}[x.split()[1]]) for x in _RESULT.split(", ")})]
        for row in left.itertuples():
            b = Batch(row)
            a = Answers(b, back, model)
            c, uni = a.counts(1), model.unigrams
            base = (c + 0.1) / (uni.n + 0.1 * (uni.v + 1))
            per_doc = lambda x, b=b: np.add.reduceat(x, b.first)
            out.append(pd.DataFrame({
                "doc_id": pd.array([None if i is None or i != i else int(i) for i in row.ids], "Int64"),
                "held_out": b.held == 1, "n_tokens": b.sizes, "n_known": per_doc((c > 0).astype(np.int64)), "train_tokens": uni.n,
                "base_score": per_doc(np.log10(base)), "score": per_doc(np.log10(a.p(model.order))),
            }))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    return run


def score(docs: DataFrame, is_held, model_path: str | None = None, order: int = ORDER) -> DataFrame:
    """Trains on the documents for whose id is_held is false, keeps the model at model_path, and scores all documents.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    path = model_path or new_path(spark, "lm-model")
    packed = bucketed(batches(docs, is_held), "lm_batches", "batch")
    n_words, n_tokens, n_train = (x or 0 for x in packed.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_train")).first())
    bits = [_bits(n_words), *[_bits(int(n_tokens * 0.6))] * (order - 1)]
    grams, stats = [], []
    for k in range(1, order + 1):
        grams.append((k, _by_range(send_grams(packed, k, bits[k - 1]), merge_grams, f"{path}/grams/level={k}")))
        sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(K + 3)]
        stats.append([int(x) for x in grams[-1][1].filter("kind = 'model'").agg(*sums).first()])
    model = Model(path, stats, bits, int(n_train))
    rows = [(k + 1, stats[k], bits[k], int(n_train)) for k in range(order)]
    spark.createDataFrame(rows, "level int, sums array<long>, bits int, documents long").coalesce(1).write.parquet(f"{path}/stats")
    by_batch = lambda back: packed.groupBy("batch").cogroup(back.groupBy("batch"))
    alphas: list[tuple[int, DataFrame]] = []
    for k in range(2, order + 1):
        known = _answers(spark, grams[:k] + alphas)
        sent = by_batch(known).applyInPandas(send_contexts(k, model, True), _SENT)
        alphas.append((k, _by_range(sent, merge_contexts(k, model), f"{path}/alphas/level={k}")))
    return by_batch(_answers(spark, grams + alphas)).applyInPandas(evaluate(model), _RESULT)


def load(spark: SparkSession, path: str) -> Model:
    """The model whose tables are at path."""
    rows = spark.read.parquet(f"{path}/stats").orderBy("level").collect()  # a row per level
    return Model(path, [list(r.sums) for r in rows], [r.bits for r in rows], rows[0].documents)


def score_with(docs: DataFrame, model: Model) -> DataFrame:
    """The same columns for other documents, all of them held out, from the model's tables alone."""
    spark = docs.sparkSession
    packed = bucketed(batches(docs, lambda _: True), "lm_batches", "batch")
    table = lambda what, k: spark.read.schema(_BACK).parquet(f"{model.path}/{what}/level={k}").filter("kind = 'model'").select("range", "keys", "values")
    by_range = lambda sent, rows: sent.groupBy("range").cogroup(rows.groupBy("range"))

    def counts(sent: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        flat, of = ((unpack(rows["keys"].iloc[0], np.uint64, True), unpack(rows["values"].iloc[0], np.uint32)) if len(rows) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32)))
        out = []
        for r, batch, keys in zip(sent["range"], sent.batch, sent["keys"], strict=True):
            keys = unpack(keys, np.uint64, True)
            at = np.minimum(np.searchsorted(flat, keys), max(0, len(flat) - 1))
            got = np.where(flat[at] == keys, of[at], 0) if len(flat) else np.zeros(len(keys))
            out.append((r, batch, "answer", None, pack(got.astype(np.uint32)), None))
        return _back(out)

    def contexts(sent: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        flat, alpha, bare = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)
        if len(rows):
            flat = unpack(rows["keys"].iloc[0], np.uint64, True)
            a, z = _split(rows["values"].iloc[0])
            alpha, bare = unpack(a, np.float64), unpack_bits(z, len(flat))
        out: list = []
        for r, batch, keys, values in zip(sent["range"], sent.batch, sent["keys"], sent["values"], strict=True):
            keys = unpack(keys, np.uint64, True)
            off, wide = (unpack_bits(x, len(keys)) for x in _split(values)[1:3])
            _answer_contexts(out, [(batch, keys, off, wide)], r, flat, alpha, bare)
        return _back(out)

    by_batch = lambda back: packed.groupBy("batch").cogroup(back.groupBy("batch"))
    known: list[tuple[int, DataFrame]] = []
    for k in range(1, model.order + 1):
        sent = send_grams(packed, k, model.bits[k - 1])
        known.append((k, stored(by_range(sent, table("grams", k)).applyInPandas(counts, _BACK), "lm-counts")))
    for k in range(2, model.order + 1):
        sent = by_batch(_answers(spark, known)).applyInPandas(send_contexts(k, model, False), _SENT)
        known.append((k, stored(by_range(sent, table("alphas", k)).applyInPandas(contexts, _BACK), "lm-contexts")))
    return by_batch(_answers(spark, known)).applyInPandas(evaluate(model), _RESULT)


def is_held(doc_id: int | None) -> bool:
    """Ids whose crc32 leaves no remainder modulo 10 are not learned from."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def op2_katz(docs: DataFrame) -> DataFrame:
    return score(docs, is_held)
