"""Near-duplicate lines across documents, with DataFrame functions only.

Method: segment-partition edit join.  Equal lines are merged first, keeping the
earliest place (document id, then line number).  A distinct line of ``l`` code
points is cut into ``edits + 1`` segments; a line within ``edits`` of it and at
most that much longer must hold one of them at one of a few shifted places, so
the longer line probes an index keyed by (length, segment number, segment text).
Keys are 64-bit hashes: texts do not travel with them.  Only the texts of lines
that share a key with another one are fetched, through a filter of fixed size.
Their pairs are kept if the counts of some letters differ by no more than the
edits can explain, and verified by a banded bit-parallel edit distance: a fold over
code points that carries a few bits.

A line goes if it is not the earliest of its equals or if some earlier line is
within ``edits`` of it; within one edit if the shorter has fewer than
``short_chars`` code points, where two make another word.  Lines below
``near_chars`` code points are only compared for equality, those below
``exact_chars`` are never dropped.

Edge cases: null and empty texts stay as they are; rows that repeat id and text
keep and lose the same lines; null ids are later than all others; a text whose
lines all go becomes the empty text; further columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitfilter import bits_for
from .scratch import Scratch

LATEST = (1 << 63) - 1


def segments(length: str, parts: int) -> list[tuple[str, str]]:
    """(offset, size) SQL expressions of the segments of a line."""
    out = []
    for i in range(parts):
        # the last (length mod parts) segments are one longer
        longer = f"greatest(0, {i} - {parts} + pmod({length}, {parts}))"
        own = f"case when {i} >= {parts} - pmod({length}, {parts}) then 1 else 0 end"
        out.append((f"({i} * ({length} div {parts}) + {longer})", f"({length} div {parts} + {own})"))
    return out


def index_keys(line: str, length: str, edits: int) -> list[str]:
    return [
        f"xxhash64({length}, {i}, substring({line}, {at} + 1, {n}))" for i, (at, n) in enumerate(segments(length, edits + 1))
    ]


def _shifts(i: int, d: int, edits: int) -> range:
    """Shifts of segment i of a line that is d shorter: as many as errors can
    precede it, given the errors that must follow."""
    return range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)


def probe_keys(line: str, length: str, edits: int) -> list[str]:
    """Keys of the places where a segment of a line that is 0..edits shorter can
    lie in this one."""
    return [key for d in range(edits + 1) for key in _shifted(line, f"({length} - {d})", d, edits)]


def _shifted(line: str, target: str, d: int, edits: int) -> list[str]:
    """Keys of the segments of a line of ``target`` code points, d fewer, at all their
    shifts."""
    cut = segments(target, edits + 1)
    return [f"xxhash64({target}, {i}, substring({line}, {at} + {s} + 1, {n}))" for i, (at, n) in enumerate(cut) for s in _shifts(i, d, edits)]


def mixed_keys(line: str, length: str, edits: int, short: int) -> list[str]:
    """probe_keys of a line that is long enough for shorter lines of fewer than
    ``short`` code points, which allow one edit; null where a place has no key."""
    few, out = min(edits, 1), []
    for d in range(edits + 1):
        target = f"({length} - {d})"
        own, less = _shifted(line, target, d, edits), _shifted(line, target, d, few) if d <= few else []
        for k, key in enumerate(own):
            out.append(f"case when {target} >= {short} then {key} {f'else {less[k]}' if k < len(less) else ''} end")
    return out


LETTERS = "etnairohsd"


def letter_counts(line: str) -> str:
    """How often each of a few letters occurs, six bits a letter, in one long."""
    one = "least(octet_length({0}) - octet_length(replace({0}, '{1}', '')), 63)"
    return " + ".join(f"shiftleft(cast({one.format(line, x)} as bigint), {6 * k})" for k, x in enumerate(LETTERS))


def letters_apart(a: str, b: str) -> str:
    """Total difference of letter counts: an edit changes it by two at most."""
    part = "((shiftright({0}, {1})) & 63)"
    return " + ".join(f"abs({part.format(a, 6 * k)} - {part.format(b, 6 * k)})" for k in range(len(LETTERS)))


def within(a: str, b: str, edits: int, allowed: str) -> str:
    """Whether lines a and b are at most ``allowed`` (no more than ``edits``) edits
    apart, as a SQL expression: banded bit-parallel.

    Bit d + edits of the e-th group of bits tells that the first j + d code points of
    a become the first j of b with at most e edits.  A code point of b moves all
    groups at once, by the bits of its equal ones in the band of a; once no group has
    a bit the rest is skipped."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    group = lambda e: f"(shiftright(s, {width * e}) & {full})"
    step, new = [], ""
    for e in range(edits + 1):
        kept = f"({group(e)} & c)"
        below = f"({group(e - 1)} | shiftright({group(e - 1)}, 1) | (shiftleft({new}, 1) & {full}))" if e else ""
        new = f"({kept} | {below})" if e else kept
        step.append(f"shiftleft({new}, {width * e})" if e else new)
    equal = " + ".join(f"if(get(xs, j + {d}) <=> get(ys, j), {1 << (d + edits)}, 0)" for d in range(-edits, edits + 1))
    first, start = 1 << edits, 0
    for e in range(edits + 1):
        start |= (first & full) << (width * e)
        first |= first << 1
    walk = (
        f"aggregate(sequence(0, size(ys) - 1), {start}, (s, j) -> if(s = 0, 0, aggregate(array({equal}), s, (s, c) -> {' | '.join(step)})))"
    )
    text = lambda x: f"regexp_extract_all({x}, '(?s).', 0)"
    spot = f"size(xs) - size(ys) + {edits}"
    told = f"shiftright({walk}, {width} * ({allowed}) + {spot}) & 1 = 1"
    # xs and ys are bound once
    bound = f"transform(array(named_struct('xs', {text(a)}, 'ys', {text(b)})), z -> abs(size(z.xs) - size(z.ys)) <= {edits} and {told.replace('xs', 'z.xs').replace('ys', 'z.ys')})"
    return f"if({a} = {b}, true, if({a} = '' or {b} = '', length({a}) + length({b}) <= ({allowed}), get({bound}, 0)))"


def maybe_among(rows: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """rows whose key may be one of keys: a filter of 2**bits bits, held as 64-bit
    words in a broadcast table, which is bounded by that whatever the input."""
    spot = F.expr(f"{key} & {(1 << bits) - 1}")
    marks = keys.select(spot.alias("spot")).groupBy(F.expr("spot div 64").alias("__word"))
    words = marks.agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("__mask"))
    asked = rows.withColumn("__spot", spot).withColumn("__word", F.expr("__spot div 64"))
    found = asked.join(F.broadcast(words), "__word").where("shiftright(__mask, cast(__spot % 64 as int)) & 1 = 1")
    return found.drop("__word", "__spot", "__mask")


class LineDedup:
    """Drops lines that an earlier line equals or nearly equals."""

    def __init__(self, edits: int = 2, near_chars: int = 30, exact_chars: int = 12, filter_bits: int = 24, short_chars: int = 0):
        self.edits, self.near_chars, self.exact_chars, self.filter_bits = edits, near_chars, exact_chars, filter_bits
        self.short_chars = short_chars

    def _lines(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        src = docs.where(F.col(text).isNotNull()).select(
            F.coalesce(F.col(doc).cast("long"), F.lit(LATEST)).alias("doc"),
            F.xxhash64(F.col(text)).alias("body"),
            F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"),
        )
        lines = src.withColumn("size", F.length("line")).where(F.col("size") >= self.exact_chars)
        return lines.withColumn("k", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(1), "line"))

    def dropped(self, docs: DataFrame, scratch: Scratch, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, body, pos) of every line that goes."""
        lines = self._lines(docs, doc, text)
        places = scratch.table(lines.select("doc", "body", "pos", "k", "k2", "size"), "places")
        distinct = places.groupBy("k", "k2", "size").agg(F.min(F.struct("doc", "pos")).alias("first"))
        distinct = scratch.table(distinct, "distinct")
        later = self._near(lines, distinct, scratch)
        # equal lines: all but the earliest place
        marked = places.join(distinct.select("k", "k2", "first"), ["k", "k2"])
        again = marked.where(F.struct("doc", "pos") > F.col("first")).select("doc", "body", "pos")
        first = marked.where(F.struct("doc", "pos") == F.col("first")).join(later, ["k", "k2"], "left_semi")
        return again.union(first.select("doc", "body", "pos"))

    def _near(self, lines: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
        """(k, k2) of distinct lines to which an earlier one is near."""
        own = f"array({', '.join(index_keys('line', 'size', self.edits))})"
        asks = f"array({', '.join(probe_keys('line', 'size', self.edits))})"
        few = min(self.edits, 1)
        if self.short_chars:
            own = f"if(size < {self.short_chars}, array({', '.join(index_keys('line', 'size', few))}), {own})"
            mixed = ", ".join(mixed_keys("line", "size", self.edits, self.short_chars))
            asks = f"if(size < {self.short_chars + self.edits}, array({mixed}), {asks})"
        keyed = lines.where(F.col("size") >= self.near_chars).select(
            "k", "k2", "doc", "pos", F.expr(f"struct({own} as own, {asks} as asks)").alias("keys")
        )
        one = keyed.groupBy("k", "k2").agg(F.min_by("keys", F.struct("doc", "pos")).alias("keys"))
        one = scratch.table(one.select("k", "keys.*"), "keys")
        scratch.release()
        # n is the probe's number, -1 for an index entry
        index = one.select("k", F.lit(-1).alias("n"), F.explode("own").alias("key"))
        probe = one.select("k", F.posexplode("asks").alias("n", "key")).where("key is not null")
        by_key = Window.partitionBy("key")
        met = index.union(probe.select("k", "n", "key")).select(
            "k", "n", "key", F.min("k").over(by_key).alias("lo"), F.max("k").over(by_key).alias("hi"), F.min("n").over(by_key).alias("first_n")
        )
        met = scratch.table(met.where("lo <> hi and first_n = -1").select("k", "n", "key"), "met")
        scratch.drop(one)
        scratch.release()
        ends = scratch.table(met.select("k").distinct(), "ends")
        bits = bits_for(ends.count(), self.filter_bits)
        some = maybe_among(lines.where(F.col("size") >= self.near_chars).select("k", "k2", "line"), ends, "k", bits)
        # ends are distinct; a semi join would be moved below the filter, and so move all lines
        texts = some.join(ends, "k").groupBy("k", "k2").agg(F.min("line").alias("line"))
        texts = texts.join(distinct.select("k", "k2", "first"), ["k", "k2"])
        texts = scratch.table(texts.withColumn("letters", F.expr(letter_counts("line"))), "texts")
        marked = met.join(texts.select("k", "letters").distinct(), "k")
        left = marked.where("n = -1").select(F.col("k").alias("a"), F.col("letters").alias("la"), "key")
        right = marked.where("n >= 0").select(F.col("k").alias("b"), F.col("letters").alias("lb"), "n", "key")
        # keys of lines of one length find each pair from both sides: the smaller hash is enough
        level = sum(len(_shifts(i, 0, self.edits)) for i in range(self.edits + 1))
        once = F.when(F.col("n") < level, F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
        found = left.join(right, "key").where(once).where(f"{letters_apart('la', 'lb')} <= {2 * self.edits}")
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        whole = F.struct("k", "k2", "line", "first")
        both = pairs.join(texts.select(F.col("k").alias("a"), whole.alias("x")), "a").join(texts.select(F.col("k").alias("b"), whole.alias("y")), "b")
        allowed = F.when(F.least(F.length("x.line"), F.length("y.line")) < self.short_chars, few).otherwise(self.edits)
        both = both.withColumn("allowed", allowed)
        near = both.where(F.expr(within("x.line", "y.line", self.edits, "allowed")))
        late = F.when(F.col("x.first") > F.col("y.first"), F.struct("x.k", "x.k2")).otherwise(F.struct("y.k", "y.k2"))
        return near.select(late.alias("l")).select("l.k", "l.k2").distinct()

    def clean(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """docs with their remaining lines as text, and with ``lines_kept`` and
        ``lines_dropped``."""
        scratch = Scratch(docs.sparkSession, "lines")
        gone = self.dropped(docs, scratch, doc, text).groupBy("doc", "body").agg(F.collect_set("pos").alias("gone"))
        gone = scratch.table(gone.select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("gone").alias("__gone")), "gone")
        scratch.only(gone)
        keyed = docs.withColumn("__doc", F.coalesce(F.col(doc).cast("long"), F.lit(LATEST))).withColumn("__body", F.xxhash64(F.col(text)))
        joined = keyed.join(gone, ["__doc", "__body"], "left")
        parts = F.split(F.col(text), "\n")
        kept = F.filter(parts, lambda x, k: ~F.array_contains("__gone", k))
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts))
        lost = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
        new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
        rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "lines_kept", "lines_dropped")]
        return joined.select(*rest, new.alias(text), (n - lost).cast("long").alias("lines_kept"), lost.cast("long").alias("lines_dropped"))
