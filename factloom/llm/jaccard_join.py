"""Exact Jaccard self-join of documents on word shingles.

Method: token-combination prefixes.  Shingles are put in one global order,
(frequency class, hash), rare class first.  With ``o`` the smallest overlap a
partner must have, two linked sets share at least ``k`` shingles among the first
``n - o + k`` of each: their prefixes, extended by ``k - 1``.  A rare shingle of
the prefix is indexed on its own.  Frequent ones are dealt to ``k - 1`` classes by
hash; if a pair shares no rare one, some class holds two that it shares, so only
the two-shingle combinations inside a class are indexed.  ``k`` grows with the
set, which keeps the combinations in proportion to it.

Frequency classes come from a histogram over all shingles of all documents
(``sketch_bits``); only the set of heavy histogram cells is broadcast, a bitmap
of fixed size.  Documents with equal sets are one class from the start.

Verification never expands a large group.  Each key names a pivot, the set with the
fewest rare shingles that holds it; every set is compared with the pivots of its
keys, and the links found are contracted.  Two linked sets share a key and so a
pivot.  Those still apart are compared pair by pair where ``SMALL`` sets or fewer
have one pivot.  In a larger group their differences from it share a shingle, unless one
is the pivot: were the differences disjoint, the larger one alone would break
the limit on their sum.  So prefixes of the differences are indexed by (pivot,
shingle), where what a whole group has in common is gone.  What is to be verified
must have parity sketches within the allowed difference.

Edge cases: null or empty text gives an empty set that is linked with nothing;
texts shorter than the shingle are one shingle; repeated rows, equal ids and
null ids are separate rows that share a set; a class whose ids are all null has a
null id; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitfilter
from . import textkernel as tk
from .components import components
from .scratch import Scratch

NO_ID = (1 << 63) - 1  # stands for a null id, later than all others
SMALL = 64  # sets with one pivot that are compared pair by pair
PER_CLASS = 12  # a set of this many needed shingles gets one class of frequent ones


def levels(size: int, percent: int) -> list[int]:
    """Numbers of classes of frequent shingles for pairs whose larger set has
    ``size`` shingles up to as many as a partner can have.  0: no combinations."""
    out: list[int] = []
    at, most = size, size * 100 // percent
    while at <= most:
        need = (percent * at + 99) // 100
        top = need // PER_CLASS
        level = 1 << (top.bit_length() - 1) if top else int(need >= 2)
        out.append(level)
        # the smallest size of the next level
        step = 2 * level * PER_CLASS if level else 2
        if level == 1 and top == 0:
            step = PER_CLASS
        at = max(at + 1, ((step - 1) * 100) // percent + 1)
    return sorted(set(out))


def shingle_sets(w: tk.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a block, sorted in each document, and their offsets."""
    g, at = tk.grams(w, n)
    doc = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        g = np.concatenate([g, _short(w, short)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    if len(g):
        keep = np.empty(len(g), bool)
        keep[0] = True
        keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(w.rows + 1))


def _short(w: tk.Words, rows: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(rows), tk.U)
    count = w.first[rows + 1] - w.first[rows]
    for k in range(int(count.max())):
        on = count > k
        acc[on] = acc[on] * tk.U(0x8CB92BA72F3D8DD7) + w.hash[w.first[rows[on]] + k]
    return tk.mix(acc + count.astype(tk.U) * tk.U(0x632BE59BD9B4E019))


def _set_ids(g: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One 64-bit id per set, independent of order; 0 for the empty set."""
    total = np.zeros(len(g) + 1, tk.U)
    np.cumsum(tk.mix(g + tk.U(0x1F83D9ABFB41BD6B)), out=total[1:])
    size = np.diff(offs)
    out = tk.mix((total[offs[1:]] - total[offs[:-1]]) ^ (size.astype(tk.U) * tk.U(0x9E3779B97F4A7C15)))
    out[size == 0] = 0
    return out


def _histogram(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for w in tk.blocks(b.column(0), fold=True):
                g, _ = shingle_sets(w, n)
                total += np.bincount((g >> tk.U(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 50_000):
            yield pa.record_batch([pa.array(at[k : k + 50_000]), pa.array(total[at[k : k + 50_000]])], names=["cell", "n"])

    return run


def _heavy(docs: DataFrame, n: int, bits: int, sigmas: float, scratch: Scratch) -> np.ndarray:
    """Heavy cells of the shingle histogram, as a bitmap of 2**bits bits."""
    cells = docs.select("text").mapInArrow(tk.tidy(_histogram(n, bits)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = scratch.table(cells, "cells")
    size = 1 << bits
    s = rows.agg(F.sum("n").alias("s"), F.percentile_approx("n", 0.5).alias("m")).first()
    base = (s.m or 0) if (s.s or 0) >= size else (s.s or 0) / size
    limit = max(base + sigmas * math.sqrt(base + 1), 8.0)
    return bitfilter.build(rows.where(F.col("n") > limit), "cell", bits)


def _alone(size: int, percent: int) -> bool:
    """Whether only an equal set can be a partner of one of this size."""
    return (percent * size + 99) // 100 == size == size * 100 // percent and -(-2 * percent * size // (100 + percent)) >= size


SKETCH = 4  # words of 64 bits in a parity sketch
WORDS = [f"s{k}" for k in range(SKETCH)]


def _sketches(g: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Parity sketches of sets: bit b tells whether an odd number of shingles hash to
    b, so two sketches differ in no more bits than the sets in shingles."""
    bits, rows = 64 * SKETCH, len(offs) - 1
    spot = (tk.mix(g) & tk.U(bits - 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(rows), np.diff(offs)) * bits + spot, minlength=rows * bits) & 1
    return np.packbits(odd.reshape(rows, bits).astype(np.uint8), axis=1, bitorder="little").view("<u8")


def _postings(n: int, percent: int, bits: int, heavy: np.ndarray):
    """Rows of documents: their set's size, id and index keys; ``cut`` shingles are
    outside the prefix, ``often`` frequent and ``rare`` rare ones inside; a partner
    shares ``least`` of them at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in tk.blocks(b.column(1), fold=True):
                g, offs = shingle_sets(w, n)
                ids = _set_ids(g, offs)
                hot = bitfilter.test(heavy, (g >> tk.U(64 - bits)).astype(np.int64)) if len(g) else np.zeros(0, bool)
                keys, counts, told = [], np.zeros(w.rows, np.int64), np.zeros((4, w.rows), np.int64)
                for r in range(w.rows):
                    size = int(offs[r + 1] - offs[r])
                    if not size or _alone(size, percent):
                        continue
                    need = (percent * size + 99) // 100
                    steps = levels(size, percent)
                    prefix = min(size, size - need + steps[-1] + 1)
                    own, flag = g[offs[r] : offs[r + 1]], hot[offs[r] : offs[r + 1]]
                    rare, frequent = own[~flag][:prefix], own[flag]
                    k = _keys(rare, frequent, size - need, steps)
                    counts[r] = len(k)
                    told[:, r] = size - prefix, prefix - len(rare), len(rare), steps[0] + 1
                    keys.append(k)
                flat = np.concatenate(keys) if keys else np.zeros(0, tk.U)
                at = np.zeros(w.rows + 1, np.int32)
                np.cumsum(counts, out=at[1:])
                sketch = _sketches(g, offs)
                yield pa.record_batch(
                    [
                        b.column(0).slice(w.row0, w.rows).cast(pa.int64()),
                        pa.array(np.diff(offs).astype(np.int64)),
                        tk.signed(ids),
                        *(pa.array(x) for x in told),
                        *(tk.signed(sketch[:, k]) for k in range(SKETCH)),
                        pa.ListArray.from_arrays(pa.array(at), tk.signed(flat)),
                    ],
                    names=["doc_id", "size", "set_id", "cut", "often", "rare", "least", *WORDS, "keys"],
                )

    return run


def _keys(rare: np.ndarray, frequent: np.ndarray, spare: int, steps: list[int]) -> np.ndarray:
    """Index keys of a set: its rare prefix shingles, and for each level the pairs
    of frequent ones in one class.  The lowest bit tells combinations."""
    tag = ~tk.U(1)
    out = [rare & tag]
    for level in steps:
        f = frequent[: max(0, spare + level + 1 - len(rare))]
        if level == 0:
            out.append(f & tag)
        elif len(f) > level:  # fewer cannot hold level + 1 shared ones
            part = tk.mix(f ^ tk.U(0x5851F42D4C957F2D)) % tk.U(level)
            order = np.argsort(part, kind="stable")
            f, part = f[order], part[order]
            for d in range(1, len(f)):
                same = part[d:] == part[:-d]
                if not same.any():
                    break
                both = f[:-d][same] * tk.U(0x94D049BB133111EB) + f[d:][same] + tk.U(level * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
                out.append(tk.mix(both) | tk.U(1))
    return np.unique(np.concatenate(out))


def _sets(n: int, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            hit = bitfilter.test(wanted, ids)
            if not hit.any():
                continue
            part = b.column(1).filter(pa.array(hit))
            for w in tk.blocks(part, fold=True):
                g, offs = shingle_sets(w, n)
                raw = np.ascontiguousarray(g).view(np.uint8)
                yield pa.record_batch(
                    [tk.signed(_set_ids(g, offs)), pa.array(ids[hit][w.row0 : w.row0 + w.rows]), tk.binary_column(raw, offs * 8)],
                    names=["set_id", "doc_id", "shingles"],
                )

    return run


def _verify(percent: int):
    """Rows (u, v, x, y) whose sets x and y are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for r, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), tk.U), np.frombuffer(y.as_buffer(), tk.U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok[r] = 100 * both >= percent * (len(p) + len(q) - both)
            keep = pa.array(ok)
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    return run


def _prefix(apart: int, size: int, pivot: int, linked: bool, percent: int) -> int:
    """How many shingles of a set's difference from its pivot to index.

    Two linked sets x and y of different components share (|x'| + |y'| - d) / 2 of
    their differences x' and y', where d is at most ``allowed``; one of them is not
    linked with the pivot, so its difference exceeds what is allowed there."""
    if not apart:
        return 0
    if linked:
        shared = -(-apart * percent // (100 + percent))
    else:
        allowed = (size + size * 100 // percent) * (100 - percent) // (100 + percent)
        beyond = apart * (100 + percent) - (size + pivot) * (100 - percent)
        shared = max(1, -(-beyond // (2 * (100 + percent))), apart - allowed)
    return apart - shared + 1


DIFFERENCE = "u long, v long, ok boolean, apart long, tokens array<long>"


def _differences(percent: int):
    """Rows (u, v, large, x, y) with whether sets x and y are linked and, if large, the
    size and a prefix of their difference.  Shingles that the pivot y lacks come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            ok, apart, counts, tokens = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), []
            for r, (large, x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), tk.U), np.frombuffer(y.as_buffer(), tk.U)
                gained = np.setdiff1d(p, q, assume_unique=True)
                both = len(p) - len(gained)
                ok[r] = 100 * both >= percent * (len(p) + len(q) - both)
                if large:
                    lost = np.setdiff1d(q, p, assume_unique=True)
                    s = np.concatenate([gained, lost])
                    apart[r], counts[r] = len(s), _prefix(len(s), len(p), len(q), bool(ok[r]), percent)
                    tokens.append(s[: counts[r]])
            at = np.zeros(n + 1, np.int32)
            np.cumsum(counts, out=at[1:])
            flat = tk.signed(np.concatenate(tokens) if tokens else np.zeros(0, tk.U))
            lists = pa.ListArray.from_arrays(pa.array(at), flat)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ok), pa.array(apart), lists], names=["u", "v", "ok", "apart", "tokens"])

    return run


class JaccardJoin:
    """Links between documents whose shingle sets reach ``percent`` per cent
    Jaccard similarity, as connected components.

    ``sketch_bits`` sizes the frequency histogram and ``filter_bits`` bounds the
    filter of documents to reread; both only steer cost, never the result."""

    def __init__(self, shingle: int = 5, percent: int = 80, sketch_bits: int = 19, sigmas: float = 3.0, filter_bits: int = 27):
        if not 0 < percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.shingle, self.percent = shingle, percent
        self.sketch_bits, self.sigmas, self.filter_bits = sketch_bits, sigmas, filter_bits

    def classes(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row of docs."""
        scratch = Scratch(docs.sparkSession, "jaccard")
        docs = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
        heavy = _heavy(docs, self.shingle, self.sketch_bits, self.sigmas, scratch)
        shape = ", ".join(f"{c} long" for c in ("doc_id", "size", "set_id", "cut", "often", "rare", "least", *WORDS)) + ", keys array<long>"
        rows = scratch.table(docs.mapInArrow(tk.tidy(_postings(self.shingle, self.percent, self.sketch_bits, heavy)), shape), "rows")
        known = [F.first(c).alias(c) for c in ("size", "cut", "often", "rare", "least", *WORDS)]
        sets = scratch.table(rows.where("size > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), *known), "sets")
        whole = sets.select("set_id", "doc_id")
        first = rows.where("least > 0").select("set_id", "doc_id", "size", "keys").join(whole, ["set_id", "doc_id"])
        post = scratch.table(self._posted(first, sets), "postings")
        slim = scratch.table(rows.select("doc_id", "size", "set_id"), "slim")
        scratch.drop(rows)
        scratch.release()
        linked = self._components(docs, sets, post, scratch)
        out = slim.join(whole.select("set_id", F.col("doc_id").alias("least")), "set_id", "left")
        root = F.coalesce("least", "doc_id")
        if linked is not None:
            low = linked.join(whole.withColumnRenamed("set_id", "node"), "node").groupBy("root").agg(F.min("doc_id").alias("component"))
            low = scratch.table(linked.join(low, "root").select(F.col("node").alias("set_id"), "component"), "roots")
            out = out.join(low, "set_id", "left")
            root = F.coalesce("component", root)
        there = lambda c: F.when(c != NO_ID, c)
        return out.select(there(F.col("doc_id")).alias("doc_id"), F.col("size").alias("n_shingles"), there(root).alias("component_id"))

    def _posted(self, first: DataFrame, sets: DataFrame) -> DataFrame:
        """Keys that several sets of compatible sizes share, of sets that share enough
        of their prefix: frequent shingles, and rare ones that such a set has in its
        prefix.  Each set stands in two bands of sizes, so that two whose sizes fit
        meet in one; ``key`` is the key in a band."""
        width = max(-math.log(self.percent / 100) * (1 + 1e-6), 1e-3)
        flat = first.select("set_id", "size", F.explode("keys").alias("key"))
        met = flat.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")
        band = F.floor(F.log("size") / width)
        both = met.withColumn("band", F.explode(F.array(band, band + 1)))
        both = both.withColumn("m", F.count("*").over(Window.partitionBy("key", "band"))).where("m > 1").select("set_id", "key", "band")
        both = both.withColumn("one", F.row_number().over(Window.partitionBy("set_id", "key").orderBy("band")) == 1)
        kind = F.col("one") & (F.col("key").bitwiseAND(F.lit(1)) == 0)
        shared = both.withColumn("single", F.count(F.when(kind, 1)).over(Window.partitionBy("set_id")))
        shared = shared.join(sets.where("least > 0").select("set_id", "size", "cut", "often", "rare", "least"), "set_id")
        found = shared.withColumn("most", F.col("often") + F.least("rare", "single")).where("most >= least")
        return found.select("set_id", F.xxhash64("key", "band").alias("key"), "size", "cut", "rare", "most")

    def _needed(self, a: str, b: str) -> Column:
        """Prefix shingles that a linked pair of these rows shares at least."""
        p = self.percent
        overlap = F.expr(f"({p} * ({a}.size + {b}.size) + {99 + p}) div {100 + p}")
        return overlap - F.greatest(f"{a}.cut", f"{b}.cut")

    def _fit(self, a: str, b: str) -> Column:
        return F.expr(f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})")

    def _near(self, post: DataFrame) -> DataFrame:
        """(u, v, key, more, fit): each set u with the pivot v of each of its keys; more
        tells that the key has further sets, fit that u and v may be linked."""
        at = F.struct("rare", "set_id", "size", "cut", "most")
        top = post.groupBy("key").agg(F.min(at).alias("v"), F.count("*").alias("m")).where("m > 1")
        near = post.withColumn("u", at).join(top, "key").where("u.set_id <> v.set_id").withColumn("more", F.col("m") > 2)
        fit = self._fit("u.size", "v.size") & (F.least("u.most", "v.most") >= self._needed("u", "v"))
        out = near.select(F.col("u.set_id").alias("u"), F.col("v.set_id").alias("v"), "key", "more", fit.alias("fit"))
        return out.where("more or fit")

    def _close(self, x: str, y: str) -> Column:
        """What sizes and sketches of two linked sets satisfy."""
        most = f"(({x}.size + {y}.size) * {100 - self.percent}) div {100 + self.percent}"
        ways = " + ".join(f"bit_count({x}.{w} ^ {y}.{w})" for w in WORDS)
        return self._fit(f"{x}.size", f"{y}.size") & F.expr(f"{ways} <= {most}")

    def _tries(self, near: DataFrame, sets: DataFrame) -> DataFrame:
        """(u, v, large): sets and pivots to compare: those that may be linked, and all
        of a large group of sets with one pivot."""
        pairs = near.groupBy("u", "v").agg(F.max("fit").alias("fit"), F.max("more").alias("more"))
        groups = pairs.groupBy("v").agg((F.count(F.when(F.col("more"), 1)) > SMALL).alias("large"))
        told = lambda c: sets.select(F.col("set_id").alias(c), F.struct("size", *WORDS).alias(f"of_{c}"))
        both = pairs.join(groups, "v").join(told("u"), "u").join(told("v"), "v").withColumn("large", F.col("large") & F.col("more"))
        return both.where(F.col("large") | (F.col("fit") & self._close("of_u", "of_v"))).select("u", "v", "large")

    def _components(self, docs: DataFrame, sets: DataFrame, post: DataFrame, scratch: Scratch) -> DataFrame | None:
        """(node, root) of every set that is linked with another; None without links."""
        near = scratch.table(self._near(post), "near")
        scratch.drop(post)
        tries = scratch.table(self._tries(near, sets), "tries")
        scratch.release()
        both = self._pairs(tries, self._content(docs, sets, tries, scratch)).select("u", "v", "large", "x", "y")
        seen = scratch.table(both.mapInArrow(tk.tidy(_differences(self.percent)), DIFFERENCE), "differences")
        scratch.release()
        label = scratch.table(components(seen.where("ok").select("u", "v"), scratch), "label")
        cross = scratch.table(self._across(seen, near, label, tries, sets, scratch), "cross")
        scratch.drop(seen, near, tries)
        if cross.isEmpty():
            return None if label.isEmpty() else label
        both = self._pairs(cross, self._content(docs, sets, cross, scratch)).select("u", "v", "x", "y")
        found = scratch.table(both.mapInArrow(tk.tidy(_verify(self.percent)), "u long, v long"), "links")
        if found.isEmpty():
            return None if label.isEmpty() else label
        # contract: links between roots, then every node to the root of its root
        of = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        roots = found.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        upper = scratch.table(components(roots, scratch), "upper").select(F.col("node").alias("root"), F.col("root").alias("top"))
        lower = label.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        alone = upper.join(label.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
        return scratch.table(lower.union(alone), "linked")

    def _across(self, seen: DataFrame, near: DataFrame, label: DataFrame, tries: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
        """Pairs (u, v) of different components that share a key and fit: those of small
        groups one by one, those of large ones where their differences from the pivot
        meet."""
        named = label.withColumnRenamed("node", "u")
        keyed = near.where("more").join(named, "u", "left").select("u", "v", "key", F.coalesce("root", "u").alias("root"))
        spread = keyed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        wanted = keyed.join(spread, "key", "left_semi").select("u", "v", "root").distinct()
        open_ = wanted.join(sets.select(F.col("set_id").alias("u"), "size", *WORDS), "u")
        marked = open_.join(tries.where("large").select("u", "v", F.lit(True).alias("large")), ["u", "v"], "left")
        open_ = scratch.table(marked.withColumn("large", F.coalesce("large", F.lit(False))), "open")
        one = F.struct("u", "root", "size", *WORDS)
        apart = (F.col("x.u") > F.col("y.u")) & (F.col("x.root") != F.col("y.root")) & self._close("x", "y")
        pairs = lambda df: df.select(F.col("x.u").alias("u"), F.col("y.u").alias("v"))
        few = lambda c: open_.where("not large").select("v", one.alias(c))
        direct = pairs(few("x").join(few("y"), "v").where(apart))
        told = seen.where("size(tokens) > 0").join(open_.where("large").drop("large"), ["u", "v"])
        many = lambda c: told.select(F.explode("tokens").alias("token"), "v", F.struct("u", "root", "size", "apart", *WORDS).alias(c))
        most = f"((x.size + y.size) * {100 - self.percent}) div {100 + self.percent}"
        met = pairs(many("x").join(many("y"), ["v", "token"]).where(apart & F.expr(f"abs(x.apart - y.apart) <= {most}")))
        return direct.union(met).distinct()

    def _content(self, docs: DataFrame, sets: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """Shingle sets of the documents that stand for the sets of pairs."""
        ends = pairs.select(F.col("u").alias("set_id")).union(pairs.select(F.col("v").alias("set_id"))).distinct()
        need = scratch.table(sets.select("set_id", "doc_id").join(ends, "set_id", "left_semi"), "need")
        wanted = bitfilter.build(need, "doc_id", bitfilter.bits_for(need.count(), self.filter_bits))
        both = docs.mapInArrow(tk.tidy(_sets(self.shingle, wanted)), "set_id long, doc_id long, shingles binary")
        out = scratch.table(both.join(need, ["set_id", "doc_id"], "left_semi").drop("doc_id"), "content")
        scratch.release()
        return out

    def _pairs(self, pairs: DataFrame, content: DataFrame) -> DataFrame:
        a = content.select(F.col("set_id").alias("u"), F.col("shingles").alias("x"))
        b = content.select(F.col("set_id").alias("v"), F.col("shingles").alias("y"))
        return pairs.join(a, "u").join(b, "v")


def keep_one(docs: DataFrame, join: JaccardJoin | None = None) -> DataFrame:
    """docs without all but one document of each near-duplicate class: the one
    with the smallest id stays, and of rows that repeat its id and text one.
    Rows with empty sets stay."""
    found = (join or JaccardJoin()).classes(docs)
    classes = Scratch(docs.sparkSession, "keep").table(found.where("n_shingles > 0"), "classes")
    gone = classes.where("doc_id > component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    again = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").withColumn("__t", F.xxhash64("text")).dropDuplicates(["doc_id", "__t"]).drop("__t")
    return left.join(again, "doc_id", "left_anti").unionByName(once)
