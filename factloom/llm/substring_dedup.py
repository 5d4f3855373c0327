"""Removal of word passages that a smaller document id also holds.

Method: suffix automata of reference shards.  The reference of a corpus is the
corpus itself, so it is cut into shards by content: every window of ``window``
words has an anchor, the least-hashed ``anchor``-word gram inside it, and equal
windows have equal anchors.  Windows whose anchor occurs in one document only
are settled by a filter of fixed size.  What is left is laid out as pieces, the
longest runs of windows with one anchor; equal pieces are merged, keeping their
smallest id.  The distinct pieces of an anchor go to one task, which builds a suffix
automaton over a bounded shard of pieces, notes for every state the smallest id
of any document that holds it, and streams the same pieces through it: wherever
the matching statistic reaches ``window`` words, the state's smallest id says
whether a smaller document has the passage.  A shard's automaton lives in one
task instead of being broadcast to all, because the reference grows with the
corpus and only its own anchor's pieces can match.

An anchor with a single piece needs no automaton: its piece is the first copy.  An
anchor with more than ``most_pieces`` distinct ones is refined: its windows become
anchors of their own.  What they hold is equal, so such a shard is one window, and
its smallest id, aggregated before the shuffle, decides.

Edge cases: null or empty text has no words; texts shorter than the window lose
nothing; rows with equal ids never remove from one another; a null id is larger
than all others; very long texts are cut into pieces like any other; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from . import textkernel as tk
from .scratch import Scratch

NO_ID = (1 << 63) - 1


def anchors(w: tk.Words, window: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window start of a block: the start, and hash and first word of
    its anchor (leftmost of equal least hashes)."""
    size = len(w.hash) - window + 1
    if size <= 0:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, tk.U), z
    g = w.hash[: len(w.hash) - n + 1].copy()
    for k in range(1, n):
        g = g * tk.U(0x9FB21C651E98DF25) + w.hash[k : len(w.hash) - n + 1 + k]
    g = tk.mix(g)
    best, at = g[:size].copy(), np.arange(size)
    for k in range(1, window - n + 1):
        less = g[k : k + size] < best
        best[less] = g[k : k + size][less]
        at[less] = np.flatnonzero(less) + k
    start = np.flatnonzero(w.doc[:size] == w.doc[window - 1 :])
    return start, best[start], at[start]


def _runs(w: tk.Words, window: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor hash, first and last window start."""
    start, h, at = anchors(w, window, n)
    if not len(start):
        return np.zeros(0, tk.U), start, start
    cut = np.ones(len(start), bool)
    cut[1:] = (at[1:] != at[:-1]) | (w.doc[start[1:]] != w.doc[start[:-1]])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(start)) - 1
    return h[first], start[first], start[last]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _anchor_rows(window: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _ids(b.column(0))
            for w in tk.blocks(b.column(1)):
                h, first, _ = _runs(w, window, n)
                if len(h):
                    doc = ids[w.row0 + w.doc[first]]
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    keep = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
                    yield pa.record_batch([tk.signed(h[keep]), pa.array(doc[keep])], names=["anchor", "doc_id"])

    return run


def first_key(piece: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A key of a piece in a document; FIRST_KEY is the same in SQL."""
    return piece ^ doc ^ (doc << np.int64(21))


FIRST_KEY = "piece ^ doc_id ^ shiftleft(doc_id, 21)"


def _piece_rows(window: int, n: int, seen: np.ndarray, firsts: np.ndarray | None = None):
    """Pieces and their places; with ``firsts`` only pieces at their first
    documents, and their words instead of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _ids(b.column(0))
            for w in tk.blocks(b.column(1)):
                h, first, last = _runs(w, window, n)
                on = bitfilter.test(seen, h) if len(h) else np.zeros(0, bool)
                if not on.any():
                    continue
                h, first, last = h[on], first[on], last[on]
                stop = last + window
                up, down = tk._powers(len(w.hash) + 1)
                total = np.zeros(len(w.hash) + 1, tk.U)
                np.cumsum(w.hash * up[: len(w.hash)], out=total[1:])
                piece = tk.mix((total[stop] - total[first]) * down[first] + (stop - first).astype(tk.U)).view(np.int64)
                doc = ids[w.row0 + w.doc[first]]
                if firsts is None:
                    cols = [tk.signed(h), pa.array(piece), pa.array(doc), pa.array(first - w.first[w.doc[first]]), pa.array(stop - first)]
                    yield pa.record_batch(cols, names=["anchor", "piece", "doc_id", "start", "words"])
                    continue
                on = bitfilter.test(firsts, first_key(piece, doc))  # bits all set: every piece
                raw, offs = tk.gather(w.hash.view(np.uint8), first[on] * 8, stop[on] * 8)
                cols = [tk.signed(h[on]), pa.array(piece[on]), pa.array(doc[on]), tk.binary_column(raw, offs)]
                yield pa.record_batch(cols, names=["anchor", "piece", "doc_id", "content"])

    return run


def _window_rows(window: int, n: int, hot: np.ndarray):
    """All windows of the pieces of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "piece", "doc_id", "hit", "refined"]
        for b in _piece_rows(window, n, hot, np.full(1, 255, np.uint8))(batches):
            first = np.frombuffer(b.column(3).buffers()[1], np.int32)[: b.num_rows + 1].astype(np.int64) // 8
            words = np.frombuffer(b.column(3).buffers()[2], np.int64)[: first[-1]].view(tk.U)
            count = np.diff(first) - window + 1
            row = np.repeat(np.arange(b.num_rows), count)
            hit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = first[row] + hit
            h = words[at].copy()
            for k in range(1, window):
                h = h * tk.U(0x9FB21C651E98DF25) + words[at + k]
            cols = [b.column(k).take(pa.array(row)) for k in range(3)]
            yield pa.record_batch([*cols, pa.array(hit), tk.signed(tk.mix(h))], names=names)

    return run


class SuffixAutomaton:
    """Automaton of all factors of several word sequences; each state knows the
    smallest id among the sequences that hold its factors."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NO_ID]

    def add(self, words: list[int], ident: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                if ident < least[q]:
                    least[q] = ident
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                least.append(ident)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = cur
            else:
                last = self._clone(last, c, q)
                if ident < least[last]:
                    least[last] = ident

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        self.least.append(self.least[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def close(self) -> None:
        """Carry smallest ids from longer factors to their suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.least[v] < self.least[p]:
                self.least[p] = self.least[v]

    def matches(self, words: list[int], window: int, ident: int) -> list[int]:
        """Starts of windows that a sequence with an id below ident holds."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        v = size = 0
        out = []
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            while length[link[v]] >= window:
                v = link[v]
                size = length[v]
            if size >= window and least[v] < ident:
                out.append(i - window + 1)
        return out


def _match(window: int, shard_words: int):
    """Rows sorted by anchor, piece and id: for each distinct piece its windows
    that smaller ids hold, if any."""

    def settle(groups: list[list[tuple]]) -> pa.RecordBatch:
        sam = SuffixAutomaton()
        pieces = [(p, ident, np.frombuffer(c, np.int64).tolist()) for g in groups for p, ident, c in g]
        for _, ident, words in pieces:
            sam.add(words, ident)
        sam.close()
        rows = [(p, hits) for p, ident, words in pieces if (hits := sam.matches(words, window, ident))]
        return _hits(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, shard, held = None, [], [], 0
        for b in batches:
            for anchor, piece, ident, content in zip(
                b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True
            ):
                if anchor != now:
                    if len(group) > 1:
                        shard.append(group)
                        held += sum(len(c) for *_, c in group) // 8
                        if held >= shard_words:
                            yield settle(shard)
                            shard, held = [], 0
                    now, group = anchor, []
                if not group or group[-1][0] != piece:
                    group.append((piece, ident, content))
        if len(group) > 1:
            shard.append(group)
        if shard:
            yield settle(shard)

    return run


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["piece", "hits"]
    )


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, lo, hi in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                gone = 0
                if lo:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.array(lo), 1)
                    np.add.at(edge, np.array(hi), -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    gone = int((~keep).sum())
                    kept = b" ".join([x for x, k in zip(words, keep.tolist(), strict=True) if k])
                else:
                    kept = b" ".join(words)
                out.append((doc, len(words), gone, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch(
                [pa.array([x.decode("utf-8", "replace") for x in c] if k == pa.string() else c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


class SubstringDedup:
    """Removes every word covered by a ``window``-word sequence that a document
    with a smaller id also holds.

    ``filter_bits`` sizes the filter of anchors that occur in several documents,
    ``shard_words`` the automata; ``most_pieces`` bounds those of one anchor.  They
    steer cost only."""

    def __init__(self, window: int = 13, anchor: int = 5, filter_bits: int = 27, shard_words: int = 100_000, most_pieces: int = 1000):
        self.window, self.anchor, self.filter_bits, self.shard_words = window, anchor, filter_bits, shard_words
        self.most_pieces = most_pieces

    def spans(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """(doc_id, lo, hi): word ranges to remove, arrays per document id."""
        w, n = self.window, self.anchor
        rows = docs.mapInArrow(_anchor_rows(w, n), "anchor long, doc_id long")
        both = rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
        seen = bitfilter.build(both, "anchor", self.filter_bits)
        scratch.release()
        spec = "anchor long, piece long, doc_id long, start long, words long"
        pieces = scratch.table(docs.mapInArrow(_piece_rows(w, n, seen), spec), "pieces")
        firsts = scratch.table(pieces.groupBy("anchor", "piece").agg(F.min("doc_id").alias("doc_id")), "firsts")
        several = scratch.table(firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
        wanted = firsts.join(several.where(F.col("n") <= self.most_pieces), "anchor", "left_semi").select(F.expr(FIRST_KEY).alias("key"))
        first = bitfilter.build(wanted, "key", self.filter_bits)
        scratch.release()
        spec = "anchor long, piece long, doc_id long, content binary"
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        sent = docs.mapInArrow(_piece_rows(w, n, seen, first), spec).repartition(parts, "anchor").sortWithinPartitions("anchor", "piece", "doc_id")
        hits = scratch.table(sent.mapInArrow(_match(w, self.shard_words), "piece long, hits array<long>"), "hits")
        hot = several.where(F.col("n") > self.most_pieces).select("anchor")
        if not hot.isEmpty():
            hits = hits.union(self._refined(docs, firsts, hot, scratch))
        scratch.release()
        # a piece's hash covers its words, so it names its anchor too
        marked = pieces.drop("anchor").join(firsts.select("piece", F.col("doc_id").alias("least")), "piece")
        later = marked.where("doc_id > least").select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("words")).alias("hi"))
        first = marked.where("doc_id = least").join(hits, "piece").select("doc_id", "start", F.explode("hits").alias("hit"))
        first = first.select("doc_id", (F.col("start") + F.col("hit")).alias("lo"))
        both = later.union(first.select("doc_id", "lo", (F.col("lo") + w).alias("hi")))
        return both.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select("doc_id", "r.lo", "r.hi")

    def _refined(self, docs: DataFrame, firsts: DataFrame, hot: DataFrame, scratch: Scratch) -> DataFrame:
        """hits of the pieces of hot anchors, window by window."""
        bits = bitfilter.build(hot, "anchor", bitfilter.bits_for(hot.count(), self.filter_bits))
        spec = "anchor long, piece long, doc_id long, hit long, refined long"
        rows = docs.mapInArrow(_window_rows(self.window, self.anchor, bits), spec).join(hot, "anchor", "left_semi")
        rows = scratch.table(rows.join(firsts, ["anchor", "piece", "doc_id"], "left_semi").select("piece", "doc_id", "hit", "refined"), "refined")
        least = rows.groupBy("refined").agg(F.min("doc_id").alias("least"))
        found = rows.join(least, "refined").where("doc_id > least")
        return scratch.table(found.groupBy("piece").agg(F.collect_set("hit").alias("hits")), "refined_hits")

    def clean(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_words, n_removed, kept_text) for every row of docs."""
        scratch = Scratch(docs.sparkSession, "substring")
        src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
        spans = scratch.table(self.spans(src, scratch), "spans")
        scratch.release()
        key = F.coalesce("doc_id", F.lit(NO_ID))
        joined = src.withColumn("k", key).join(spans.withColumnRenamed("doc_id", "k"), "k", "left")
        return joined.select("doc_id", "text", "lo", "hi").mapInArrow(
            _keep(self.window), "doc_id long, n_words long, n_removed long, kept_text string"
        )
