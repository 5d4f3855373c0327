"""Exact top-k inner-product search by distributed histogram selection.

Vectors are scaled and floored to integers, so scores are exact integers.  The
query rows and the candidate rows are packed into blocks; every pair of a query
block and a candidate block is one unit of work, a matrix product.  Round by
round each unit histograms its scores inside the current range of each query;
the summed histograms show in which cell the k-th best score lies, and that cell
is the next range.  Once the range holds few scores or one value, the units send
every score above the range and, of those inside it, their best ``k`` by
(score, id); a last window ranks those few rows.  A score's place among ties goes
to the smaller id.

Edge cases: vectors that are null, hold a null or a non-finite component, or
differ in dimension from the most frequent one take no part; a null id takes
none either; fewer than k candidates give fewer rows; equal vectors tie; an
empty table gives no rows; further columns are not read.  Rows that repeat a
query's id are its own rows and never its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, id, v) rows, sorted by block, to one row a block: ids and matrix."""
    held: list[pa.RecordBatch] = []
    now = None

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column(1).to_numpy().astype(np.int64)
        flat = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.record_batch([pa.array([now], pa.int64()), pa.array([ids.tobytes()]), pa.array([flat.tobytes()])], names=["block", "ids", "matrix"])

    for b in batches:
        block = b.column(0).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *edge], [*edge, len(block)], strict=True):
            if hi <= lo:
                continue
            if held and block[lo] != now:
                yield out()
                held = []
            now = int(block[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield out()


def _unpack(ids: pa.Scalar, matrix: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids.as_buffer(), np.int64)
    return i, np.frombuffer(matrix.as_buffer(), np.int64).reshape(len(i), -1)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every sum is below 2**53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


OWN = np.iinfo(np.int64).min


def _units(b: pa.RecordBatch) -> Iterator[tuple]:
    """Query ids, ranges, candidate ids and scores of each unit of a batch."""
    for r in range(b.num_rows):
        qi, q = _unpack(b.column(0)[r], b.column(1)[r])
        ci, c = _unpack(b.column(4)[r], b.column(5)[r])
        lo = np.frombuffer(b.column(2)[r].as_buffer(), np.int64)
        hi = np.frombuffer(b.column(3)[r].as_buffer(), np.int64)
        s = _scores(q, c)
        s[qi[:, None] == ci[None, :]] = OWN
        yield qi, lo, hi, ci, s


def _histogram(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, lo, hi, _, s in _units(b):
                width = _width(lo, hi, cells)
                spot = (s - lo[:, None]) // width[:, None]
                spot[s > hi[:, None]] = cells
                inside = (s >= lo[:, None]) & (s != OWN)
                row, _ = np.nonzero(inside)
                flat = np.bincount(row * (cells + 1) + spot[inside], minlength=len(qi) * (cells + 1)).reshape(len(qi), cells + 1)
                at, cell = np.nonzero(flat)
                yield pa.record_batch([pa.array(qi[at]), pa.array(cell), pa.array(flat[at, cell])], names=["query_id", "cell", "n"])

    return run


def _width(lo, hi, cells: int):
    return (hi - lo) // cells + 1


def _above(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, lo, hi, ci, s in _units(b):
                out = []
                for r in range(len(qi)):
                    at = np.flatnonzero((s[r] >= lo[r]) & (s[r] != OWN))
                    if len(at):
                        best = at[np.lexsort((ci[at], -s[r][at]))[:k]]
                        out.append((np.full(len(best), qi[r]), ci[best], s[r][best]))
                if out:
                    q, c, v = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.record_batch([pa.array(q), pa.array(c), pa.array(v)], names=["query_id", "vec_id", "score"])

    return run


class TopKSearch:
    """The k best candidates of every query row, over all other rows.

    ``cells`` is the size of a histogram, ``few`` the number of scores above a
    range's foot at which refining stops, ``block`` and ``query_block`` the rows
    of a unit's sides; none of them changes the result."""

    def __init__(self, k: int = 5, scale: int = 256, cells: int = 256, few: int = 64, block: int = 4096, query_block: int = 256):
        self.k, self.scale, self.cells, self.few = k, scale, cells, few
        self.block, self.query_block = block, query_block

    def _usable(self, rows: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
        x = F.transform(F.col(vector), lambda v: v.cast("double"))
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        ok = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0))
        whole = F.transform(x, lambda v: F.floor(v * self.scale))
        return ok.select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))

    def _blocks(self, rows: DataFrame, count: int, size: int, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
        """rows (id, v) as numbered blocks of about size rows."""
        n = max(1, -(-count // size))
        dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("block"), "id", "v")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        even = dealt.repartition(parts, "block").sortWithinPartitions("block")
        return scratch.table(even.mapInArrow(_pack, "block long, ids binary, matrix binary"), name), n

    def search(self, rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score); is_query tells the query rows."""
        spark = rows.sparkSession
        scratch = Scratch(spark, "topk")
        own = self._usable(rows, is_query, key, vector)
        dim = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        if dim is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        own = own.where(F.size("v") == dim["d"])
        asked = scratch.table(own.where("asked").groupBy("id").agg(F.min("v").alias("v")), "asked")
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        longest = float(np.sqrt(own.agg(F.max(square)).first()[0]))
        cand, blocks = self._blocks(own, dim["n"], self.block, scratch, "candidates")
        quer, _ = self._blocks(asked, asked.count(), self.query_block, scratch, "queries")
        bound = (F.ceil(F.sqrt(square) * longest) + 2).cast("long")
        at = scratch.table(asked.select(F.col("id").alias("query_id"), (-bound).alias("lo"), bound.alias("hi"), F.lit(False).alias("done")), "ranges")
        while not at.where("not done").isEmpty():
            at = scratch.table(self._narrow(self._units(quer, cand, blocks, at), at), "ranges")
        best = self._units(quer, cand, blocks, at).mapInArrow(_above(self.k), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    def _units(self, quer: DataFrame, cand: DataFrame, blocks: int, at: DataFrame) -> DataFrame:
        """Every query block, with its ranges, against every candidate block."""
        ids = quer.mapInArrow(_block_ids, "block long, spot int, query_id long").join(at, "query_id")
        ranges = ids.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("spot", "lo", "hi"))).alias("r"))
        ready = quer.join(ranges, "block").select(F.col("ids").alias("qi"), F.col("matrix").alias("q"), "r.lo", "r.hi")
        packed = ready.mapInArrow(_packed_ranges, "qi binary, q binary, lo binary, hi binary")
        spread = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return spread.join(cand, "block").select("qi", "q", "lo", "hi", "ids", "matrix")

    def _narrow(self, units: DataFrame, at: DataFrame) -> DataFrame:
        """The cell of each query's range that holds its k-th best score."""
        cells = units.mapInArrow(_histogram(self.cells), "query_id long, cell long, n long").groupBy("query_id", "cell").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
        upto = cells.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") >= self.k)
        spot = upto.groupBy("query_id").agg(F.max_by(F.struct("cell", "upto"), "cell").alias("c"))
        width = F.expr(f"(hi - lo) div {self.cells} + 1")
        low = F.col("lo") + F.col("c.cell") * width
        same = F.col("done") | F.col("c").isNull()  # no k-th score at all: everything is wanted
        return at.join(spot, "query_id", "left").select(
            "query_id",
            F.when(same, F.col("lo")).otherwise(low).alias("lo"),
            F.when(same, F.col("hi")).otherwise(low + width - 1).alias("hi"),
            (same | (F.col("c.upto") <= self.few) | (width == 1)).alias("done"),
        )


def _block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            ids = np.frombuffer(b.column(1)[r].as_buffer(), np.int64)
            n = len(ids)
            yield pa.record_batch(
                [pa.array([b.column(0)[r].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids)],
                names=["block", "spot", "query_id"],
            )


def _packed_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pack(c: pa.Array) -> pa.Array:
        return pa.array([np.array(x, np.int64).tobytes() for x in c.to_pylist()], pa.binary())

    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pack(b.column(2)), pack(b.column(3))], names=["qi", "q", "lo", "hi"])
