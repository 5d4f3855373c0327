"""Sequence packing along a space-filling curve.

Each document becomes token ids and a small vector: the seeded random projection
of its hashed set of distinct tokens to ``dims`` dimensions.  The vector's
Hilbert key orders the corpus; a range partitioning on (key, id) deals out runs
of the curve, and each run is laid end to end and cut every ``length`` tokens.
So neighbours on the curve share sequences, and only the last sequence of a run
is short.  A run is streamed: a task holds one Arrow batch at a time.

White space in ASCII never joins two tokens of the vocabularies used, so words
are encoded by the tokenizer itself once and remembered in a table of fixed size
per Python worker.

Edge cases: a null or empty text is the end token alone; a text longer than a
sequence spans several; rows with equal or null ids are packed as separate
documents; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import Scratch

_WORKER: dict[str, "_Ids"] = {}


STOPS = b".,;:!?|"


class _Ids:
    """Token ids of white-space-free pieces, remembered in a direct-mapped table.

    A piece's place follows from its 64-bit hash; a second hash, of that one with
    length and first eight bytes, must agree.  Pieces that are not there are encoded together and take
    their places over, so memory is bounded and frequent pieces come back soon."""

    def __init__(self, path: str, bits: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.kind = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for x, k in vocab.items() if x.endswith("</w>")]] = True
        self.mask = tk.U((1 << bits) - 1)
        self.sign, self.n, self.at = np.zeros(1 << bits, tk.U), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.pool, self.used = np.zeros(12 << bits, self.kind), 0

    def ids(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a block, end to end, and the words' offsets."""
        padded = np.zeros(len(w.data) + 8, np.uint8)
        padded[: len(w.data)] = w.data
        heads = np.ndarray((len(w.data) + 1,), "<u8", padded, strides=(1,))
        size = w.end - w.start
        head = heads[w.start] & (tk.U(0xFFFFFFFFFFFFFFFF) >> (tk.U(8) * np.maximum(8 - size, 0).astype(tk.U)))
        sign = tk.mix(w.hash ^ (head * tk.U(0x9E3779B97F4A7C15)) ^ size.astype(tk.U)) | tk.U(1)
        spot = (w.hash & self.mask).astype(np.int64)
        hit = self.sign[spot] == sign
        at, n = self.at[spot].astype(np.int64), self.n[spot]
        lost = np.flatnonzero(~hit)
        pool = self.pool
        if len(lost):
            _, first, back = np.unique(w.hash[lost], return_index=True, return_inverse=True)
            one = lost[first]
            raw = w.data.tobytes()
            new, offs = self._encode([raw[a:b] for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)])
            if self.used + len(new) > len(pool):
                # a full pool is started anew; this block still reads the old one
                self.pool, self.used = np.zeros(max(len(pool), 2 * len(new)), self.kind), 0
                self.sign[:] = 0
                pool = np.concatenate([pool, new])
                at[lost] = (offs[:-1] + len(pool) - len(new))[back]
            else:
                pool[self.used : self.used + len(new)] = new
                at[lost] = (offs[:-1] + self.used)[back]
            self.pool[self.used : self.used + len(new)] = new
            n[lost] = np.diff(offs)[back]
            k = spot[one]
            self.sign[k] = sign[one]
            self.at[k], self.n[k] = offs[:-1] + self.used, np.diff(offs)
            self.used += len(new)
        return tk.gather(pool, at, at + n)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words.  Letters with at most some stops after them are encoded as
        one text: each of the two stretches has one end-of-word id, its last."""
        plain, stretches, odd = [], [], []
        for k, x in enumerate(words):
            core = x.rstrip(STOPS)
            if core.isalpha() or (core and not core.isascii() and _letters(core)):
                plain.append(k)
                stretches.append(1 + (len(core) < len(x)))
            else:
                odd.append(k)
        parts: list[np.ndarray] = [np.zeros(0, self.kind)] * len(words)
        if plain:
            text = b" ".join([words[k] for k in plain]).decode()
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            stop = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(stretches)
            if len(stop) != last[-1]:
                odd, plain = list(range(len(words))), []
            else:
                cut = stop[last - 1]
                sizes = np.diff(cut, prepend=0)
        if not odd:
            return ids, np.append(0, np.cumsum(sizes))
        for k in odd:
            parts[k] = np.array(self.model.encode(words[k].decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind)
        if plain:
            lo = (cut - sizes).tolist()
            for k, a, b in zip(plain, lo, cut.tolist(), strict=True):
                parts[k] = ids[a:b]
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


def _letters(core: bytes) -> bool:
    """Letters only, and below U+0130, where case folds letter by letter and
    nothing composes."""
    text = core.decode("utf-8", "replace")
    return max(text) < "İ" and text.isalpha()


def _ids(path: str, most: int) -> _Ids:
    if path not in _WORKER:
        _WORKER[path] = _Ids(path, most)
    return _WORKER[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (rows), ``bits`` bits a dimension."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class HilbertPacker:
    """Packs documents into sequences of at most ``length`` ids."""

    def __init__(
        self,
        tokenizer: str,
        length: int = 2048,
        end_id: int = 1,
        dims: int = 3,
        bits: int = 10,
        seed: int = 17,
        run_tokens: int = 4_000_000,
        most_runs: int = 100_000,
        table_bits: int = 21,
    ):
        self.tokenizer, self.length, self.end_id = tokenizer, length, end_id
        self.dims, self.bits, self.seed = dims, bits, seed
        self.run_tokens, self.most_runs, self.table_bits = run_tokens, most_runs, table_bits

    def _encode(self):
        path, end_id, dims, bits, seed, most = self.tokenizer, self.end_id, self.dims, self.bits, self.seed, self.table_bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = _ids(path, most)
            table = np.random.default_rng(seed).standard_normal((1 << 16, dims)).astype(np.float32)
            flag = np.zeros(1 << 16, bool)
            for b in batches:
                doc = b.column(0)
                for w in tk.blocks(b.column(1)):
                    flat, offs = ids.ids(w)
                    edge = offs[w.first]  # where each document's ids begin and end
                    size = np.diff(edge) + 1
                    out = np.empty(len(flat) + w.rows, ids.kind)
                    last = edge[1:] + np.arange(w.rows)
                    keep = np.ones(len(out), bool)
                    keep[last] = False
                    out[keep] = flat
                    out[last] = end_id
                    stops = np.append(0, np.cumsum(size))
                    vec = np.zeros((w.rows, dims))
                    for r in range(w.rows):
                        spot = out[stops[r] : stops[r + 1]] & 0xFFFF
                        flag[spot] = True
                        seen = np.flatnonzero(flag)
                        flag[spot] = False
                        vec[r] = table[seen].sum(0) / np.sqrt(len(seen))
                    unit = 0.5 + 0.5 * np.tanh(vec * 0.6)
                    cell = np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                    raw = tk.binary_column(out.view(np.uint8), stops * ids.kind.itemsize)
                    yield pa.record_batch(
                        [doc.slice(w.row0, w.rows), pa.array(hilbert(cell, bits)), pa.array(size), raw],
                        names=["doc_id", "curve_key", "doc_tokens", "ids"],
                    )

        return run

    def _lay(self, wide: bool):
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            base = TaskContext.get().partitionId() << 32
            spot = 0
            for b in batches:
                out: list[tuple] = []
                for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2").astype("<u4")
                    at = 0
                    while at < len(ids):
                        take = min(len(ids) - at, length - spot % length)
                        out.append((doc, at, take, ids[at : at + take].tobytes(), len(ids), base + spot // length, spot % length))
                        at += take
                        spot += take
                    if len(out) >= 2000:
                        yield _pieces(out)
                        out = []
                if out:
                    yield _pieces(out)

        return run

    def encode(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, curve_key, doc_tokens, ids) of every document."""
        src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
        return src.mapInArrow(tk.tidy(self._encode()), "doc_id long, curve_key long, doc_tokens long, ids binary")

    def pack(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per piece: doc_id, start, length, ids (little-endian unsigned
        32-bit), doc_tokens, sequence_id, offset."""
        scratch = Scratch(docs.sparkSession, "packing")
        coded = scratch.table(self.encode(docs, doc, text), "ids")
        total = coded.agg(F.sum("doc_tokens")).first()[0] or 0
        runs = int(min(self.most_runs, max(1, -(-total // self.run_tokens))))
        along = coded.repartitionByRange(runs, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")
        from tokenizers import Tokenizer

        wide = Tokenizer.from_file(self.tokenizer).get_vocab_size() > 1 << 16
        return along.select("doc_id", "ids").mapInArrow(
            tk.tidy(self._lay(wide)),
            "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
        )


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))
