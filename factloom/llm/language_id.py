"""Language identification with error-correcting output codes.

Each language has a binary codeword.  One binary classifier per bit predicts it
from hashed character n-grams (one to four bytes inside words, with word edges):
a naive-Bayes log-odds weight per n-gram cell, averaged over the text, so length
does not matter.  Decoding takes the codeword with the least total logistic loss
over the bits' margins; the softmax of the negative losses is the score, and a
document whose two best codewords are close is flagged ambiguous.

Learning reads a bounded sample: at most about ``sample_rows`` labelled rows per
language, chosen by a hash of the id.  The model has a row for each language; more
than ``languages`` of them are an error, so its size does not depend on the corpus.  Prediction reads every whole
text and nothing but the text.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; the
same holds when there is nothing to learn from.  Ties go to the language that
sorts first.  Further columns pass through ``annotate`` untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

CELL_BITS = 15
CELLS = 1 << CELL_BITS
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1 bits.  Up to six classes: the exhaustive code; above: the
    best of some seeded dense random codes by least row distance."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 6:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    rng = np.random.default_rng(20250801)
    length = int(np.ceil(12 * np.log2(n)))
    best, code = -1, None
    for _ in range(50):
        c = rng.choice(np.array([1, -1], np.int8), (n, length))
        c = c[:, np.abs(c.sum(0)) < n]
        wide = c.astype(np.float32)
        d = ((c.shape[1] - wide @ wide.T) / 2 + np.eye(n) * 10**6).min()
        if d > best:
            best, code = d, c
    return code


def cells(data: np.ndarray) -> np.ndarray:
    """Cells of all byte n-grams of a block, one row per order; grams that cross
    white space count as that order's cell 0."""
    low = tk._FOLD[data]
    space = tk._SPACE[data]
    low = np.where(space, np.uint8(32), low).astype(np.uint32)
    size = len(low)
    out = np.zeros((len(ORDERS), size), np.uint16)
    word = np.zeros(size, np.uint32)
    for k, n in enumerate(ORDERS):
        shift = np.zeros(size, np.uint32)
        shift[: size - n + 1] = low[n - 1 :]
        word = (word << np.uint32(8)) | shift
        h = (word + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out[k] = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CELL_BITS)).astype(np.uint16)
        if n > 2:  # an inner space: keep only grams that begin or end with it
            inner = np.zeros(size, bool)
            for j in range(1, n - 1):
                inner[: size - j] |= space[j:]
            out[k][inner] = 0
        out[k][size - n + 1 :] = 0
    return out


def _lettered(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _counts(names: list[str]):
    place = {x: k for k, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), CELLS), np.int64)
        rows = np.zeros(len(names), np.int64)
        for b in batches:
            lang = np.array([place.get(x, -1) for x in b.column(1).to_pylist()])
            for part, offs, row0, n in _texts(b.column(0)):
                c = cells(part)
                for r in range(n):
                    k = lang[row0 + r]
                    if k >= 0:
                        total[k] += np.bincount(c[:, offs[r] : offs[r + 1]].ravel(), minlength=CELLS)
                        rows[k] += 1
        on = np.flatnonzero(rows)
        yield pa.record_batch(
            [pa.array(on), pa.array([total[k].tobytes() for k in on], pa.binary())], names=["lang", "counts"]
        )

    return run


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Byte blocks of a string column: bytes, offsets, first row, rows."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    large = pa.types.is_large_string(column.type)
    _, off_buf, val_buf = column.buffers()
    offs = np.frombuffer(off_buf, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    vals = np.frombuffer(val_buf, np.uint8) if val_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + tk.BLOCK // 2, "right")) - 1)
        yield vals[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row], row, stop - row
        row = stop


class LanguageModel:
    """Codewords and one weight per bit and n-gram cell."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.code = codewords(len(names)) if names else np.zeros((0, 0), np.int8)
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if names else counts
        bits = []
        for col in self.code.T:
            on, off = share[col > 0], share[col < 0]
            if len(on) and len(off):
                bits.append(np.log(on.mean(0)) - np.log(off.mean(0)))
            else:
                bits.append(np.ones(CELLS))
        self.weights = np.array(bits, np.float32).T.copy() if bits else np.zeros((CELLS, 0), np.float32)
        if bits:
            self.weights[0] = 0

    def decode(self, margin: np.ndarray, scale: float = 6.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and the runner-up's score, by least loss."""
        loss = np.logaddexp(0.0, -scale * margin[:, None, :] * self.code[None, :, :]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, score, p.max(1)

    def margins(self, part: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean weight over the n-grams of each text of a block."""
        c = cells(part)
        out = np.zeros((len(offs) - 1, self.weights.shape[1]))
        for r in range(len(offs) - 1):
            own = np.bincount(c[:, offs[r] : offs[r + 1]].ravel(), minlength=CELLS)
            own[0] = 0
            on = np.flatnonzero(own)
            if len(on):
                out[r] = own[on] @ self.weights[on] / own[on].sum()
        return out


def _predict(model: LanguageModel, gap: float, at: int, keep: int):
    """Adds the prediction for the text in column ``at`` to the first ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            ok = _lettered(column)
            pred = np.full(b.num_rows, UNKNOWN, object)
            score, unsure = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            if model.names:
                for part, offs, row0, n in _texts(column):
                    best, top, second = model.decode(model.margins(part, offs))
                    on = ok[row0 : row0 + n]
                    spot = row0 + np.flatnonzero(on)
                    pred[spot] = [model.names[k] for k in best[on]]
                    score[spot] = top[on]
                    unsure[spot] = (top - second)[on] < gap
            yield pa.record_batch(
                [*b.columns[:keep], pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(unsure)],
                names=[*b.schema.names[:keep], "lang_pred", "lang_score", "lang_ambiguous"],
            )

    return run


def _summed(table: pa.Table) -> pa.Table:
    """The sum of one language's counts."""
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
    return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


class LanguageIdentifier:
    """``fit`` on labelled rows, then ``annotate`` any rows that have a text.

    ``sample_rows`` bounds the labelled rows of a language, and ``languages`` the
    number of languages: more are an error, as the model has a row for each."""

    def __init__(self, sample_rows: int = 4000, languages: int = 1000, gap: float = 0.2):
        self.sample_rows, self.languages, self.gap = sample_rows, languages, gap
        self.model = LanguageModel([], np.zeros((0, CELLS)))

    def fit(self, rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageIdentifier:
        rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        counted = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
        known = counted.orderBy(F.desc("n"), "lang").limit(self.languages + 1).collect()
        if len(known) > self.languages:
            raise ValueError(f"there are more than {self.languages} languages; raise that parameter")
        names = sorted(r["lang"] for r in known)
        if not names:
            return self
        share = {r["lang"]: min(1.0, self.sample_rows / r["n"]) for r in known}
        limit = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(int(v * 2**32))) for k, v in share.items()))
        draw = F.xxhash64(F.lit(7), F.col(key).cast("string")).bitwiseAND(F.lit(2**32 - 1))
        sample = rows.where(draw < limit[F.col(lang)]).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        parts = sample.repartition(12).mapInArrow(tk.tidy(_counts(names)), "lang long, counts binary")
        counts = np.zeros((len(names), CELLS))
        for r in parts.groupBy("lang").applyInArrow(_summed, "lang long, counts binary").collect():
            counts[r["lang"]] += np.frombuffer(bytes(r["counts"]), np.int64)
        self.model = LanguageModel(names, counts)
        return self

    def annotate(self, rows: DataFrame, text: str = "text", keep: list[Column | str] | None = None) -> DataFrame:
        """The kept columns (all but reserved ones, if not named) with
        lang_pred, lang_score and lang_ambiguous."""
        new = {"lang_pred", "lang_score", "lang_ambiguous"}
        cols = keep if keep is not None else [F.col(f"`{c}`") for c in rows.columns if c not in new]
        df = rows.select(*cols)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        schema += ("," if schema else "") + " lang_pred string, lang_score double, lang_ambiguous boolean"
        n = at = len(df.columns)
        if keep is None:
            at = df.columns.index(text)
        else:
            df = rows.select(*cols, F.col(text).alias("__text"))
        return df.mapInArrow(tk.tidy(_predict(self.model, self.gap, at, n)), schema)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is the held-out fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4
