"""Toxicity as a factorization machine over hashed terms.

A text's terms are its distinct words (runs of letters, lower case) and the four- and five-letter beginnings of longer
words, hashed into a fixed number of buckets. The machine adds a weight per term and, for every pair of terms, the
inner product of their latent vectors, so that a pair can count for more or less than the sum of its parts.

Fitting. Labelled documents come from at most MOST_PER_CLASS documents of each label (those with the smallest hash of
their id); the bound makes the sample's size, and so the driver's part, the same at any scale. Every bucket of the sample has a
weight and a latent vector, so that terms which tell nothing alone can count as a pair. A term's value in a text is
its scale, FLOOR for a term that alone says nothing about the labels and near 1 for one that says much (by its
likelihood ratio), divided by the length of the text's vector of scales. For pairs the scales start from PAIR_FLOOR,
as a term that says nothing alone can say much there. Scoring reads every whole text.

Edge cases. Null and empty texts have no terms and get the bias alone. A document with several labels counts as toxic
if one of them is. Null labels and null ids are left out of the fit. Without labelled rows of both kinds there is
nothing to learn: every text then gets the share of toxic labels among them, or 0. Repeated rows score alike. Other
columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod

BUCKETS = 1 << 20
MOST_PER_CLASS = 6000
FACTORS = 4
FLOOR, PAIR_FLOOR = 0.03, 0.3
HALF_GAIN = 16.0
THRESHOLD = 0.7

_LETTERS = re.compile(r"[^\W\d_]+")


def term_ids(text: str | None, cache: dict) -> set:
    """The distinct hashed terms of a text. cache: word to its buckets, emptied when it gets large."""
    out: set = set()
    for word in set(_LETTERS.findall((text or "").lower())):
        ids = cache.get(word)
        if ids is None:
            if len(cache) > 300_000:
                cache.clear()
            terms = [word] + [f"^{word[:n]}" for n in (4, 5) if len(word) > n]
            ids = cache[word] = tuple(crc32(t.encode()) % BUCKETS for t in terms)
        out.update(ids)
    return out


def _values(scales: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Scales divided by the length of their text's vector. of: the text of each, one of n."""
    length = np.sqrt(np.bincount(of, scales**2, minlength=n))
    return scales / length[of]


@dataclass
class Machine:
    """bias; terms: sorted buckets; scales, weight and latent vectors in their order."""

    bias: float
    terms: np.ndarray
    scale: np.ndarray
    pair_scale: np.ndarray
    weight: np.ndarray
    latent: np.ndarray

    def places(self, buckets: np.ndarray) -> np.ndarray:
        """Positions in terms of those of the buckets that are there."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, buckets), len(self.terms) - 1)
        return at[self.terms[at] == buckets]

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: positions in terms, one array for each text."""
        out = np.full(len(rows), self.bias)
        for k, r in enumerate(rows):
            if len(r):
                x, z = (_values(of_term[r], np.zeros(len(r), np.int64), 1) for of_term in (self.scale, self.pair_scale))
                vx = self.latent[r] * z[:, None]
                out[k] += (self.weight[r] * x).sum() + 0.5 * (vx.sum(0) ** 2 - (vx**2).sum(0)).sum()
        return out


def _added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The rows of values, summed by their place at."""
    return np.stack([np.bincount(at, values[:, f], minlength=n) for f in range(values.shape[1])], axis=1)


def gains(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Each term's likelihood ratio against the labels. pos, neg: its documents of each label."""
    p, q, r = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1), (pos + neg + 1) / (n_pos + n_neg + 2)
    part = lambda k, of_n, x: k * np.log(x / r) + (of_n - k) * np.log((1 - x) / (1 - r))
    return np.maximum(0, 2 * (part(pos, n_pos, p) + part(neg, n_neg, q)))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = 12) -> Machine:
    """Adagrad on the logistic loss. rows: distinct buckets of each text."""
    n, n_pos = len(rows), int(labels.sum())
    none = Machine(-30.0, np.zeros(0, np.int64), *[np.zeros(0)] * 3, np.zeros((0, FACTORS)))
    if not n_pos or n_pos == n:
        share = n_pos / n if n else 0.0
        none.bias = float(np.log(max(share, 1e-13)) - np.log(max(1 - share, 1e-13)))
        return none
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # places through a table over the buckets: sorting all entries would take several times their size
    flat = np.concatenate(rows).astype(np.int32, copy=False)
    present = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    present[flat] = True
    terms = np.flatnonzero(present)
    cols = (np.cumsum(present, dtype=np.int32) - 1)[flat]
    del flat
    of = np.repeat(np.arange(n, dtype=np.int32), sizes)
    pos = np.bincount(cols[(labels == 1)[of]], minlength=len(terms))
    gain = gains(pos, np.bincount(cols, minlength=len(terms)) - pos, n_pos, n - n_pos)
    scale, pair_scale = (least + (1 - least) * gain / (gain + HALF_GAIN) for least in (FLOOR, PAIR_FLOOR))
    values, pair_values = (_values(x.astype(np.float32)[cols], of, n).astype(np.float32) for x in (scale, pair_scale))
    del of

    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)), 0.0
    # the sums of squares start high, else a rare term's first step would be as large as a frequent term's whole way
    gw, gv, gb = np.full(len(terms), 10.0), np.full((len(terms), FACTORS), 1.0), 1e-6
    rate, l2, batch = 5.0, 2e-4, 64
    class_weight = np.where(labels == 1, 0.5 * n / n_pos, 0.5 * n / (n - n_pos))
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(n), max(1, n // batch)):
            d = np.repeat(np.arange(len(chunk)), sizes[chunk])
            c, x, z = (np.concatenate([all_[starts[i] : starts[i + 1]] for i in chunk]) for all_ in (cols, values, pair_values))
            u, inverse = np.unique(c, return_inverse=True)
            vx = v[c] * z[:, None]
            summed = _added(d, vx, len(chunk))
            squares = np.bincount(d, (vx**2).sum(1), minlength=len(chunk))
            m = b + np.bincount(d, w[c] * x, minlength=len(chunk)) + 0.5 * ((summed**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[chunk]) * class_weight[chunk]
            dw = np.bincount(inverse, g[d] * x, minlength=len(u)) + l2 * w[u]
            dv = _added(inverse, (g[d] * z)[:, None] * (summed[d] - vx), len(u)) + l2 * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            gb += g.sum() ** 2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= 0.3 * rate * dv / np.sqrt(gv[u])
            b -= 0.1 * g.sum() / np.sqrt(gb)
    return Machine(float(b), terms, scale, pair_scale, w, v)


def training_rows(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and labels of the bounded sample. Ids with remainder 1 never take part."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    picks = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class) for k in (0, 1)]
    # not more than 2 * most_per_class rows of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")

    def buckets(frames):
        cache: dict = {}
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "toxic": f.toxic, "terms": [np.fromiter(sorted(term_ids(t, cache)), np.int32) for t in f.text]})

    got = (
        sample.mapInPandas(buckets, "doc_id long, toxic int, terms array<int>")
        .groupBy("doc_id").agg(F.min("terms").alias("terms"), F.max("toxic").alias("toxic"))
        .orderBy("doc_id").toArrow()
    )
    terms = got["terms"].combine_chunks() if got.num_rows else None
    rows = [np.asarray(x.values) for x in terms] if got.num_rows else []  # views
    return rows, np.asarray(got["toxic"], np.int64)


def train(docs: DataFrame, labels: DataFrame, **kw) -> Machine:
    return fit(*training_rows(docs, labels, **kw))


def scored(docs: DataFrame, machine: Machine, column: str = "toxicity") -> DataFrame:
    """docs with one more column, the probability that a text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS terms at most

    def score(texts: pd.Series) -> np.ndarray:
        m = sent.value
        rows = [m.places(np.sort(np.fromiter(term_ids(t, score_cache), np.int64))) for t in texts]
        return 1 / (1 + np.exp(-np.clip(m.margins(rows), -30, 30)))

    score_cache: dict = {}
    kept = [c for c in docs.columns if c != column]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(column, T.DoubleType())])

    def run(frames):
        for f in frames:
            yield f[kept].assign(**{column: score(f["text"])})

    return docs.mapInPandas(run, schema)


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = train(docs, labels)
    return scored(docs.select("doc_id", "text"), machine, "score").select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    machine = train(docs, labels)
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return scored(docs, machine, name).filter(F.col(name) < threshold).drop(name)
