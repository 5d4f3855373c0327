"""I-Match document fingerprints.

A first pass counts in how many documents each distinct term occurs.  Terms
whose share of documents lies in a band, that is an inverse-document-frequency
band, form the lexicon.  As a document has a bounded number of distinct terms
on average, at most (mean distinct terms) / ``low`` terms reach the lower share
whatever the corpus size; that bound is checked before the lexicon is broadcast
as sorted 64-bit hashes.

A fingerprint holds one 32-bit hash for each of several seeded random subsets of
the lexicon, thinned at different rates: the hash of the document's distinct
terms in that subset, taken in sorted order.  Equal texts have equal fingerprints.
The likeness of two fingerprints is the share of subsets with equal hashes,
weighted by thinness, among those in which either holds a term; without any it is 1 for equal term sets'
stand-ins (the last hash, over all terms) and else 0.

Edge cases: a null text is an empty one; texts without lexicon terms have empty
subset hashes and are told apart by the last hash; rows with equal ids follow
one another by text; null ids come last; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import Scratch

EMPTY = np.uint32(0)


def _distinct(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a block, sorted in each row, and their offsets."""
    order = np.lexsort((w.hash, w.doc))
    h, doc = w.hash[order], w.doc[order]
    if len(h):
        keep = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(w.rows + 1))


def _term_counts(most: int = 1 << 20):
    """Document counts of terms, summed over a part of the rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([tk.signed(term), pa.array(n)], names=["term", "n"])

        for b in batches:
            for w in tk.blocks(b.column(0), fold=True):
                h, _ = _distinct(w)
                held.append(h)
                size += len(h)
                if size >= most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


class IMatch:
    """Lexicon and subset seeds; ``prints`` makes fingerprints of a batch."""

    def __init__(self, lexicon: np.ndarray, rates: tuple[int, ...], each: int, seed: int):
        self.lexicon, self.rates, self.each, self.seed = lexicon, rates, each, seed
        self.weights = np.repeat(np.array(rates, float), each)

    def prints(self, texts: pa.Array) -> np.ndarray:
        """One row of 32-bit hashes per text: the subsets', then that of all terms."""
        out = np.zeros((len(texts), len(self.rates) * self.each + 1), np.uint32)
        for w in tk.blocks(texts, fold=True):
            h, offs = _distinct(w)
            rows = slice(w.row0, w.row0 + w.rows)
            doc = np.repeat(np.arange(w.rows), np.diff(offs))
            out[rows, -1] = _fold(h, doc, w.rows, 0)
            if len(self.lexicon) and len(h):
                spot = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
                on = self.lexicon[spot] == h
                h, doc = h[on], doc[on]
            else:
                h, doc = h[:0], doc[:0]
            k = 0
            for rate in self.rates:
                for _ in range(self.each):
                    k += 1
                    draw = tk.mix(h ^ tk.U(self.seed * 1_000_003 + k * 7_919))
                    on = draw % tk.U(rate) == 0
                    out[rows, k - 1] = _fold(h[on], doc[on], w.rows, k)
        return out


def _fold(h: np.ndarray, doc: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """A 32-bit hash of each row's sorted terms; 0 for none."""
    n = np.bincount(doc, minlength=rows)
    first = np.cumsum(n) - n
    place = (np.arange(len(h)) - first[doc]).astype(tk.U)
    total = np.zeros(len(h) + 1, tk.U)
    np.cumsum(tk.mix(h + place * tk.U(0x9E3779B97F4A7C15) + tk.U(salt)), out=total[1:])
    end = first + n
    out = (tk.mix(total[end] - total[first] + n.astype(tk.U)) >> tk.U(32)).astype(np.uint32)
    out[(out == 0) & (n > 0)] = 1
    out[n == 0] = EMPTY
    return out


def likeness(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted share of equal subset hashes among subsets where either is not
    empty.  Thin subsets weigh more: one term changes a thick one."""
    same, held = a[:, :-1] == b[:, :-1], (a[:, :-1] != EMPTY) | (b[:, :-1] != EMPTY)
    n = held @ weights
    return np.where(n > 0, ((same & held) @ weights) / np.maximum(n, 1), (a[:, -1] == b[:, -1]).astype(float))


def _hex(prints: np.ndarray) -> list[str]:
    raw = prints.astype(">u4").tobytes().hex()
    step = prints.shape[1] * 8
    return [raw[k : k + step] for k in range(0, len(raw), step)]


def _edits(model: IMatch):
    """Rows sorted by block and, in it, from the first document to the one after
    its last (``tail``): fingerprints of each text and of its edited text."""

    def digest(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        nexts = [r[2] for r in rows]
        edited = []
        for t, n in zip(texts, nexts, strict=True):
            cut = len(t) // 2
            edited.append(t[: len(t) - cut] + n[:cut])
        p, q, e = (model.prints(pa.array(x, pa.string())) for x in (texts, nexts, edited))
        return pa.record_batch(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]),
                pa.array(_hex(p)),
                pa.array(_hex(e)),
                pa.array(likeness(p, e, model.weights)),
                pa.array(likeness(p, q, model.weights)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, size = None, [], 0
        for b in batches:
            cols = [b.column(k) for k in range(4)]
            for k in range(b.num_rows):
                block, doc, text, tail = (c[k].as_py() for c in cols)
                if last is not None and last[0] == block:
                    rows.append((last[1], last[2], text))
                    size += len(last[2])
                    if size > 1 << 20 or len(rows) >= 1000:
                        yield digest(rows)
                        rows, size = [], 0
                last = None if tail else (block, doc, text)
        if rows:
            yield digest(rows)

    return run


class Fingerprinter:
    """I-Match with terms in ``low``..``high`` share of the documents."""

    def __init__(
        self,
        low: float = 0.0005,
        high: float = 0.2,
        rates: tuple[int, ...] = (16, 64, 256, 1024),
        each: int = 12,
        seed: int = 5,
        most_terms: int = 4_000_000,
    ):
        self.low, self.high, self.rates, self.each, self.seed, self.most_terms = low, high, rates, each, seed, most_terms

    def fit(self, docs: DataFrame, text: str = "text") -> IMatch:
        n = docs.count()
        counts = docs.select(F.col(text).alias("text")).mapInArrow(_term_counts(), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        band = counts.where((F.col("n") >= max(2, self.low * n)) & (F.col("n") <= max(2, self.high * n)))
        held = Scratch(docs.sparkSession, "imatch").table(band.select("term"), "lexicon")
        if (size := held.count()) > self.most_terms:
            raise ValueError(f"the lexicon has {size} terms; raise low or most_terms ({self.most_terms})")
        terms = np.array([r[0] for r in held.toLocalIterator()], np.int64).view(tk.U)
        return IMatch(np.sort(terms), self.rates, self.each, self.seed)

    def edited(self, docs: DataFrame, model: IMatch, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """Fingerprints of each text and of the text whose second half gives way
        to the start of the next document, in descending id, in a circle.

        Documents are dealt into id ranges of about equal row counts; the first
        document of each range is also sent to the range above as its tail, so no
        task needs another's."""
        src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shares = [k / (2 * parts) for k in range(1, 2 * parts)]
        cuts = sorted(set(src.agg(F.percentile_approx("doc_id", shares, 10 * parts).alias("c")).first()["c"] or []))
        # a null id comes after all others: range -1, below the smallest id's
        above = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
        placed = src.withColumn("block", F.when(F.col("doc_id").isNull(), -1).otherwise(above).cast("long"))
        head = placed.groupBy("block").agg(F.max("doc_id").alias("top")).orderBy(F.desc("block")).collect()
        if not head:
            return docs.sparkSession.createDataFrame([], _EDITED)
        ring = {head[(k + 1) % len(head)]["block"]: r["block"] for k, r in enumerate(head)}
        tops = {r["block"]: r["top"] for r in head}
        spark = docs.sparkSession
        moves = spark.createDataFrame([(b, tops[b], to) for b, to in ring.items()], "block long, top long, to long")
        # of rows with the greatest id of a range, the one that sorts first by text
        tails = (
            placed.join(F.broadcast(moves), "block")
            .where(F.col("doc_id").eqNullSafe(F.col("top")))
            .groupBy("to", "doc_id")
            .agg(F.min("text").alias("text"))
            .select(F.col("to").alias("block"), "doc_id", "text", F.lit(True).alias("tail"))
        )
        rows = placed.select("block", "doc_id", "text", F.lit(False).alias("tail")).union(tails)
        sent = rows.repartitionByRange(parts, "block").sortWithinPartitions("block", "tail", F.desc_nulls_last("doc_id"), "text")
        return sent.mapInArrow(_edits(model), _EDITED)


_EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
