"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file whose batches have two fixed-size lists per row: `ids` (16-bit where the vocabulary
allows, else 32-bit) and `real` (a bit per position, false where the file's last sequence is padded). A file holds a
range of documents in ascending id order; a second, small Arrow file beside it says where each document begins. A
memory-mapped reader gets at any sequence, mask or document without copying or decoding.

Texts are encoded piece by piece, a piece being what stands between blanks: the tokenizer drops white space before
it splits and merges, so no token crosses a blank (the tests compare with whole texts). A batch's distinct pieces are
looked up once each; a worker remembers frequent pieces, and the words in them, in two generations.

Edge cases. Null and empty texts have the end id alone. Null ids come first; rows that share an id follow in the order of
their texts' hashes, then of their texts. Repeated rows are written once each.
An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, shuffle_width, stored

LENGTH = 2048
ROWS_A_BATCH = 256
END_ID = 2
MOST_PIECES = 250_000
PIECES_A_CALL = 64
BYTES_A_CALL = 4_000_000
#: A piece of letters (ASCII and Latin-1), then marks: the tokenizer splits the two whatever they are.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = "%&#$*.,;:|!?"
_LATIN = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)]]
#: Steps of the tokenizers whose texts can be encoded piece by piece; other tokenizers get whole texts.
_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
_encoders: dict[tuple[str, int], Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """A map that remembers its last keys: at least `most` of them, not more than twice as many and a batch's.

    Keys are learned into a young generation; when that is full it becomes the old one, from which keys that are
    asked for again come back. Frequent keys stay so, keys seen once go."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def many(self, keys: list, learn: Callable[[list], list]) -> list:
        """The values of distinct keys; learn gives the values of those that aren't known."""
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            for i in missing:
                out[i] = old.get(keys[i])
            unknown = [i for i in missing if out[i] is None]
            for i, x in zip(unknown, learn([keys[i] for i in unknown]), strict=True):
                out[i] = x
            young.update((keys[i], out[i]) for i in missing)
            if len(young) > self.most:
                self.old, self.young = young, {}
        return out


class Encoder:
    """Texts to 32-bit little-endian ids, by pieces between blanks where the tokenizer allows it."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.lib, self.end = Tokenizer.from_file(path), end_id
        self.pieces, self.parts = Recent(MOST_PIECES), Recent(MOST_PIECES)
        self.vocabulary, self.model = self.lib.get_vocab_size(), self.lib.model
        spec = json.loads(self.lib.to_str())
        steps = tuple([x["type"] for x in (spec[part] or {}).get(inner, [])] for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.by_pieces = steps == _STEPS
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words are remembered here
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {ord(c): signs.pre_tokenize_str(c.lower())[0][0] for c in _LATIN}

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids, from calls on many pieces at once: a token belongs to the piece that its first character is in."""
        out = []
        for i in range(0, len(pieces), PIECES_A_CALL):
            some = pieces[i : i + PIECES_A_CALL]
            got = self.lib.encode(" ".join(some), add_special_tokens=False)
            first = np.array([a for a, _ in got.offsets], np.int64)
            cuts = np.searchsorted(first, np.cumsum([len(p) + 1 for p in some])).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, in the model's own signs."""
        tokenize = self.model.tokenize
        return [array("I", [x.id for x in tokenize(w)]).tobytes() for w in words]

    def _learn(self, new: list[str]) -> list[bytes]:
        words, marks, other = [], [], []  # a word of None: the piece is one of the others
        for p in new:
            w = p.rstrip(_MARKS)
            if w.isascii() and w.isalpha():
                words.append(w.lower())
                marks.append(p[len(w) :])
            elif _LETTERS.fullmatch(w):
                words.append(w.translate(self.signs))
                marks.append(p[len(w) :])
            else:
                words.append(None)
                marks.append("")
                other.append(p)
        distinct, kinds = [w for w in dict.fromkeys(words) if w is not None], list(set(marks))
        of_word = dict(zip(distinct, self.parts.many(distinct, self._words), strict=True))
        of_mark = dict(zip(kinds, self._joined(kinds), strict=True))
        of_other = iter(self._joined(other))
        return [next(of_other) if w is None else of_word[w] + of_mark[m] for w, m in zip(words, marks, strict=True)]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after the other, and their numbers."""
        if not self.by_pieces:
            got = [[*x.ids, self.end] for x in self.lib.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in got for i in x], "<u4"), np.array([len(x) for x in got], np.int64)
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        known = self.pieces.many(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn)
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.array([len(x) >> 2 for x in known], np.int64)
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        start = np.concatenate([[0], np.cumsum(sizes)])[codes]
        ids = flat[np.repeat(start - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        return np.insert(ids, ends, self.end), np.diff(ends, prepend=0) + 1

    def __call__(self, text: str | None) -> bytes:
        return self.many(pa.array([text], pa.string()))[0].tobytes()


def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that later tasks find its pieces known."""
    key = (path, END_ID)
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


class _File:
    """Writes one file under another name first; it gets its own when it is whole, so a retried task leaves no halves."""

    def __init__(self, folder: str, name: str, kind: pa.DataType, length: int):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.part, self.length, self.kind = f"{base}/{name}.arrow", f"{base}/.{name}-{uuid.uuid4().hex}", length, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("real", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.left, self.n_left, self.docs, self.total = [], 0, [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= self.length * ROWS_A_BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.left) if self.left else np.zeros(0, self.kind.to_pandas_dtype())
        step = self.length * ROWS_A_BATCH
        n = len(flat) if last else len(flat) // step * step  # all batches but the last have the same number of rows
        for at in range(0, n, step):
            ids = flat[at : min(n, at + step)]
            pad = -len(ids) % self.length
            real = np.ones(len(ids) + pad, bool)
            real[len(ids) :] = False
            ids = np.concatenate([ids, np.zeros(pad, ids.dtype)])
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length), pa.FixedSizeListArray.from_arrays(pa.array(real), self.length)], schema=self.schema))
        self.left, self.n_left = ([flat[n:]], len(flat) - n) if n < len(flat) else ([], 0)

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array([d for d, _, _ in self.docs], pa.int64()), "at": pa.array([a for _, a, _ in self.docs], pa.int64()), "n": pa.array([n for _, _, n in self.docs], pa.int64())})
        with self.fs.open_output_stream(f"{self.part}i") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index, max_chunksize=65536)
        self.fs.move(f"{self.part}i", self.path + ".index")
        self.fs.move(self.part, self.path)


def by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BYTES_A_CALL bytes of text; a longer text is a slice of its own."""
    of = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // BYTES_A_CALL
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, files: int | None = None) -> DataFrame:
    """Writes the files; returns name, first (least id rank of the file), n_ids: one small row per file, in order.

    Texts are dealt by ranges of doc_id once and encoded where they arrive."""
    ordered = docs.select("doc_id", "text").repartitionByRange(files or shuffle_width(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(frames):
        from pyspark import TaskContext

        encoder, out = None, None
        k = TaskContext.get().partitionId()
        for batch in frames:
            if out is None and batch.num_rows:
                encoder = worker_encoder(tokenizer)
                out = _File(folder, f"part-{k:06d}", pa.uint16() if encoder.vocabulary <= 1 << 16 else pa.uint32(), length)
            for some in by_size(batch):
                ids, sizes = encoder.many(some.column(1))
                ids = ids.astype(out.kind.to_pandas_dtype())
                for doc_id, one in zip(some.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    out.add(doc_id, one)
        if out:
            out.close()
            yield pa.record_batch({"name": pa.array([f"part-{k:06d}"]), "n_ids": pa.array([out.total], pa.int64()), "n_docs": pa.array([len(out.docs)], pa.int64())})

    return stored(ordered.mapInArrow(write, "name string, n_ids long, n_docs long"), "token-files")


def open_tokens(folder: str, name: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """A file's reader, memory-mapped where the folder is local, and its documents' places."""
    fs, base = _open(folder)
    local = isinstance(fs, pafs.LocalFileSystem)
    get = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
    return pa.ipc.open_file(get(f"{base}/{name}.arrow")), pa.ipc.open_file(get(f"{base}/{name}.arrow.index")).read_all()


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the i-th sequence; the ids are a view of the file."""
    batch = reader.get_batch(i // ROWS_A_BATCH)
    n = batch.schema.field("ids").type.list_size
    row = i % ROWS_A_BATCH
    return batch.column(0).values.slice(row * n, n).to_numpy(), batch.column(1).values.slice(row * n, n).to_numpy(zero_copy_only=False)


def doc_ids(reader: pa.ipc.RecordBatchFileReader, at: int, n: int) -> np.ndarray:
    """A document's ids, across batches where it must be."""
    size = reader.schema.field("ids").type.list_size * ROWS_A_BATCH
    parts = []
    while n:
        values = reader.get_batch(at // size).column(0).values
        part = values.slice(at % size, min(n, size - at % size)).to_numpy()
        parts.append(part)
        at, n = at + len(part), n - len(part)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: one task a file, a batch at a time."""
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    n = max(1, min(files.count(), 4 * shuffle_width(spark)))

    def read(frames):
        for f in frames:
            for name, first in zip(f.name, f["first"], strict=True):
                reader, index = open_tokens(folder, name)
                for batch in index.to_batches(max_chunksize=16384):
                    ids, at, length = (batch.column(k).to_pylist() for k in range(3))
                    crcs = [crc32(doc_ids(reader, a, m).astype("<u4").tobytes()) for a, m in zip(at, length, strict=True)]
                    yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": [first + a for a in at], "n_tokens": length, "ids_crc32": crcs})

    return placed.repartition(n).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_tokens(docs: DataFrame) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    files = write_tokens(docs, folder, default_tokenizer())
    return read_tokens(docs.sparkSession, folder, files)
