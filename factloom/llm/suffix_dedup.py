"""Long repeated passages by a sparse, distributed suffix array.

A passage of ``least`` words or more is repeated if all its windows of ``least``
words are, so suffixes are sorted and compared by their first ``least`` words
only, and two stand together if and only if these agree.  Most need no sort: the
least-hashed ``gram``-word gram of the first ``reach`` words of a window is its
minimiser, and from there at least ``least - (reach - gram)`` words lie in the
window: its *core*.  A count of cores over all documents, put into a filter of
fixed size, leaves the suffixes that can have a partner.

These are range-sorted by the hashes of core and of window, then by place
(document id, then position), so a group of copies of any size is spread over
tasks, and a task streams its run; the two rows at each border between runs are
compared at last.  Every window meets all its copies, whatever else shares its
core.  The core comes first in the order because windows that follow one another
often share it: their finds become one span where they are made.

A window goes if an equal one lies at an earlier place (document id, then
position), so whatever goes can be read at an earlier place.  Where windows
overlap, a word goes if any of its windows does.

Edge cases: null and empty texts, and texts shorter than ``least`` words, have no
spans; rows with equal ids are treated as one document's places; a null id is
later than all others; repeats inside one document count too; further columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from . import textkernel as tk
from .scratch import Scratch
from .substring_dedup import NO_ID, anchors


def _windows(w: tk.Words, reach: int, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``least`` words inside one document, and
    their minimiser positions."""
    start, _, at = anchors(w, reach, gram)
    ok = start + least <= len(w.hash)
    start, at = start[ok], at[ok]
    ok = w.doc[start] == w.doc[start + least - 1]
    return start[ok], at[ok]


def _range_hash(w: tk.Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    up, down = tk._powers(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, tk.U)
    np.cumsum(w.hash * up[: len(w.hash)], out=total[1:])
    return tk.mix((total[hi] - total[lo]) * down[lo] + tk.U(97))


def _core_rows(reach: int, gram: int, least: int):
    core = least - (reach - gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in tk.blocks(b.column(0)):
                at = np.unique(_windows(w, reach, gram, least)[1])
                if len(at):
                    h, n = np.unique(_range_hash(w, at, at + core), return_counts=True)
                    yield pa.record_batch([tk.signed(h), pa.array(n)], names=["core", "n"])

    return run


def _suffix_rows(reach: int, gram: int, least: int, seen: np.ndarray):
    """Suffixes cut at ``least`` words, as the hashes of their core and of all
    their words."""
    core = least - (reach - gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for w in tk.blocks(b.column(1)):
                start, at = _windows(w, reach, gram, least)
                h = _range_hash(w, at, at + core)
                on = bitfilter.test(seen, h)
                start, h = start[on], h[on]
                full = _range_hash(w, start, start + least)
                for k in range(0, len(start), 20000):
                    p = start[k : k + 20000]
                    doc = w.doc[p]
                    yield pa.record_batch(
                        [tk.signed(h[k : k + 20000]), tk.signed(full[k : k + 20000]), pa.array(ids[w.row0 + doc]), pa.array(p - w.first[doc])],
                        names=["core", "whole", "doc_id", "pos"],
                    )

    return run


SPANS = ["core", "doc_id", "lo", "hi", "mate", "later", "edge", "whole"]


def _spans(rows: np.ndarray, later: np.ndarray, mate: np.ndarray, least: int) -> pa.RecordBatch:
    """Spans of windows (core, whole, doc, pos): those that follow one another in a
    document, with one core, partner and flag, are one."""
    order = np.lexsort((rows[3], later, mate, rows[2], rows[0]))
    (core, _, doc, pos), later, mate = rows[:, order], later[order].astype(np.int64), mate[order]
    cut = np.ones(len(pos), bool)
    cut[1:] = (pos[1:] - pos[:-1] > 1) | (pos[1:] < pos[:-1])
    for x in (core, doc, mate, later):
        cut[1:] |= x[1:] != x[:-1]
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], len(pos)) - 1
    none = np.full(len(lo), -1)
    return pa.record_batch([pa.array(c) for c in (core[lo], doc[lo], pos[lo], pos[hi] + least, mate[lo], later[lo], none, none)], names=SPANS)


def _neighbours(least: int):
    """Spans of the windows that equal a neighbour in a sorted run; later tells
    that the run holds an earlier place of theirs.  The first and the last row of a
    run come besides, numbered by edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        top = None
        # the last row lacks its right neighbour: it waits, with its left one, for the next batch
        rows, begin, late = np.zeros((4, 0), np.int64), 0, False
        for b in itertools.chain(batches, (None,)):
            if b is not None:
                rows = np.concatenate([rows, [c.to_numpy(zero_copy_only=False) for c in b.columns]], axis=1)
            n = rows.shape[1]
            if not n:
                continue
            if top is None:
                top = rows[:, 0].copy()
            same = np.zeros(n + 1, bool)
            same[1:n] = (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)
            moved = np.zeros(n, np.int64)
            moved[1:] = same[1:n] & (rows[2:, 1:] != rows[2:, :-1]).any(axis=0)
            group, moves = np.cumsum(~same[:n]), np.cumsum(moved)
            later = (moves > moves[np.searchsorted(group, group)]) | (late & (group == 1))
            doc = rows[2]
            left, right = np.append(doc[:1], doc[:-1]), np.append(doc[1:], doc[-1:])
            left, right = np.where(same[:n], left, doc), np.where(same[1:], right, doc)
            mate = np.where(left != doc, left, right)
            stop = n if b is None else n - 1
            twin = np.flatnonzero((same[:n] | same[1:])[begin:stop]) + begin
            if len(twin):
                yield _spans(rows[:, twin], later[twin], mate[twin], least)
            keep = max(stop - 1, 0)
            late, begin = bool(later[keep]), int(stop > 0)
            rows = rows[:, keep:].copy()
        if top is not None:
            edge = 2 * TaskContext.get().partitionId()
            ends = [(x[0], x[2], x[3], x[3] + least, x[2], 0, edge + k, x[1]) for k, x in enumerate((top, rows[:, -1]))]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*ends, strict=True)], names=SPANS)

    return run


def across(ends: list[tuple]) -> list[tuple]:
    """Spans (core, doc, lo, hi, mate, later) of windows that equal one beyond the
    border of their run; ends are first and last rows, run after run."""
    out = []
    for a, b in zip(ends[1::2], ends[2::2], strict=False):
        if (a[0], a[7]) == (b[0], b[7]):
            out += [(*a[:4], b[1], 0), (*b[:4], a[1], 1)]
    return out


class SuffixDedup:
    """Repeated passages of ``least`` words or more across all documents."""

    def __init__(self, least: int = 50, reach: int = 20, gram: int = 6, filter_bits: int = 26):
        self.least, self.reach, self.gram, self.filter_bits = least, reach, gram, filter_bits

    def spans(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, lo, hi, mate, first): repeated word ranges, of windows that
        follow one another; first tells that their windows have no earlier place.
        A window at a border of the sort can have a row for each side of it."""
        spark = docs.sparkSession
        scratch = Scratch(spark, "suffixes")
        src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
        shape = (self.reach, self.gram, self.least)
        cores = src.select("text").mapInArrow(tk.tidy(_core_rows(*shape)), "core long, n long")
        many = cores.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1")
        seen = bitfilter.build(many, "core", self.filter_bits)
        scratch.release()
        order = ("core", "whole", "doc_id", "pos")
        spec = ", ".join(f"{c} long" for c in order)
        kept = scratch.table(src.mapInArrow(tk.tidy(_suffix_rows(*shape, seen)), spec), "suffixes")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        runs = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        spec = ", ".join(f"{c} long" for c in SPANS)
        found = scratch.table(runs.mapInArrow(tk.tidy(_neighbours(self.least)), spec), "neighbours")
        scratch.drop(kept)
        # the border rows: two for each task of the sort
        ends = [tuple(r) for r in found.where("edge >= 0").orderBy("edge").collect()]
        cross = across(ends)
        inner = found.where("edge < 0").select(*SPANS[:6])
        both = inner.union(spark.createDataFrame(cross, inner.schema)) if cross else inner
        return both.select("doc_id", "lo", "hi", "mate", (F.col("later") == 0).alias("first"))

    def report(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per document with repeats: words in repeated passages, words
        that go, the passages as merged word ranges, and a partner document."""
        rows = self.spans(docs, doc, text)
        per = rows.groupBy("doc_id").agg(
            F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("every"),
            F.sort_array(F.collect_set(F.when(~F.col("first"), F.struct("lo", "hi")))).alias("later"),
            F.min(F.when(F.col("mate") != F.col("doc_id"), F.col("mate"))).alias("mate"),
        )
        size = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
        out = per.select("doc_id", _merged(F.col("every")).alias("passages"), _merged(F.col("later")).alias("gone"), "mate")
        return out.select("doc_id", size("passages").alias("n_repeated"), size("gone").alias("n_removed"), "passages", "gone", "mate")


def _merged(spans):
    """Union of sorted ranges."""
    zero = F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        fresh = F.concat(acc, F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["hi"] >= s["lo"]), joined).otherwise(fresh)

    return F.aggregate(spans, zero, step)
