"""Packing by cutting-stock column generation.

Documents are tokenized and cut into full pieces and one rest each.  Pieces fall into length classes of GRAIN
tokens; the histogram of classes (at most size / GRAIN rows) is all that reaches the driver:

* the linear program "fewest sequences that hold every class's pieces" is solved by the revised simplex method over
  patterns (how many pieces of each class share a sequence); a knapsack dynamic program over the duals prices the
  next pattern, and it ends when a lower bound of the program's value is reached;
* pattern counts are rounded down and the few pieces left over are packed largest first;
* pieces are ranked within their class by one range shuffle, and a pattern's share of each class is a range of ranks,
  so every piece finds its sequence from its rank alone; offsets are a running sum within a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import batch, cut_lineage, id_and_text, map_arrow, pylist, slices, table
from newsloom.llm.tokens import encoder

SIZE = 2048
GRAIN = 8            # tokens in a length class
ENOUGH = 1e-4        # the column generation ends this close to the linear program's value
ROUNDS = 20_000


def best_pattern(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: best total value of items (of distinct weights) within ``room``,
    and their counts."""
    of = np.full(room + 1, -np.inf)
    of[weight] = value
    best = np.zeros(room + 1)
    taken = np.zeros(room + 1, np.int64)      # weight of the item that fills a space up, 0: a unit is left empty
    for space in range(1, room + 1):
        gain = of[1:space + 1] + best[space - 1::-1] if space > 1 else of[1:2] + best[:1]
        k = int(gain.argmax())
        best[space] = best[space - 1]
        if gain[k] > best[space] + 1e-12:
            best[space], taken[space] = gain[k], k + 1
    number = {int(w): k for k, w in enumerate(weight)}
    count, space = np.zeros(len(value), np.int64), room
    while space > 0:
        if taken[space]:
            count[number[int(taken[space])]] += 1
        space -= max(1, int(taken[space]))
    return float(best[room]), count


def first_basis(weight: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, by filling sequences with the largest pieces left: every pattern
    uses up a class that no later one holds, so the columns are independent and none is used less than 0 times."""
    n = len(weight)
    left, patterns, level = demand.astype(float), np.zeros((n, n)), np.zeros(n)
    open_ = np.ones(n, bool)
    while open_.any():
        count, space = np.zeros(n), room
        for k in np.flatnonzero(open_):
            count[k] = min(space // weight[k], max(1, int(left[k])))
            space -= int(count[k]) * int(weight[k])
        ratio = np.full(n, np.inf)
        ratio[count > 0] = left[count > 0] / count[count > 0]
        out = int(ratio.argmin())
        patterns[:, out], level[out], open_[out] = count, ratio[out], False
        left = np.maximum(left - count * ratio[out], 0)
    return patterns, level


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots.  Elementwise on purpose, like the products with it below: numpy's BLAS
    threads can hang in a process that has forked, as a Spark driver does to start its JVM."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0
        work -= others[:, None] * work[k]
    return work[:, n:]


def column_generation(weight: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Basic patterns (pieces per class) of the linear program and how often each is used; ``weight`` descends.

    The number of sequences is at least demand * weight / room, and at least the program's present value divided by the
    best pattern's price; it ends when the present value is within ENOUGH of the larger of these bounds.
    """
    n = len(weight)
    patterns, level = first_basis(weight, demand, room)
    inverse = inverted(patterns)
    least = float(demand @ weight) / room
    for _ in range(ROUNDS):
        dual = np.maximum(inverse.sum(axis=0), 0)
        value, count = best_pattern(dual, weight, room)
        least = max(least, float(dual @ demand) / value)
        if level.sum() <= (1 + ENOUGH) * least:
            break
        step = (inverse * count).sum(axis=1)
        up = step > 1e-9
        ratio = np.full(n, np.inf)
        ratio[up] = level[up] / step[up]
        out = int(ratio.argmin())
        level = level - ratio[out] * step
        level[out] = ratio[out]
        patterns[:, out] = count
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return [(patterns[:, k].astype(np.int64), max(0.0, level[k])) for k in range(n)]


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pieces per class, number of sequences) of a packing of exactly these pieces; class k needs k of ``room``."""
    classes = sorted((k for k, n in histogram.items() if n), reverse=True)
    if not classes:
        return []
    weight = np.array(classes)
    left = np.array([histogram[k] for k in classes])
    chosen = []

    def use(count: np.ndarray, times: int) -> None:
        nonlocal left
        if times > 0 and count.any():
            chosen.append(({int(k): int(c) for k, c in zip(weight, count) if c}, int(times)))
            left = left - count * times

    for count, times in sorted(column_generation(weight, left.astype(float), room), key=lambda p: -p[1]):
        held = count > 0
        use(count, min(int(times + 1e-9), int((left[held] // count[held]).min())) if held.any() else 0)
    while left.any():
        count, space = np.zeros(len(weight), np.int64), room
        for k in range(len(weight)):
            count[k] = min(left[k], space // weight[k])
            space -= count[k] * weight[k]
        held = count > 0
        use(count, int((left[held] // count[held]).min()))
    return chosen


def pieces_of(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces and one rest of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in slices(batches, 200):
            rows = []
            for i, x in zip(pylist(b, "doc_id"), own.encode([d.decode("utf-8", "replace") for d in pylist(b, "data")])):
                x += end
                n = len(x) // 4
                for k in range(0, n, size):
                    part = x[4 * k:4 * (k + size)]
                    rows.append((i, k, len(part) // 4, zlib.crc32(part), n))
            yield batch(schema, dict(zip(schema.names, map(list, zip(*rows)))) if rows else {c: [] for c in schema.names})

    return map_arrow(id_and_text(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id"), run,
                     "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = SIZE, grain: int = GRAIN, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty texts are the end id alone; repeated rows and null ids are packed like any other document; an
    empty table gives no pieces.  ``size`` must be a multiple of ``grain``.
    """
    spark = docs.sparkSession
    # written first: the range shuffle below samples its input, which would tokenize every text twice
    parts = cut_lineage(pieces_of(docs, path, end_id, id_col, text_col, size).withColumn("cls", F.ceil(F.col("length") / grain).cast("int")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["cls", "doc_id", "start", "ids_crc32"]
    ranked = cut_lineage(parts.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("at", F.monotonically_increasing_id()))
    share = F.shiftright("at", 33)
    # one row per class and partition: the ranks at which each class begins in each partition
    runs = ranked.groupBy(share.alias("p"), "cls").agg(F.count("*").alias("n"), F.min("at").alias("at")).collect()
    before: dict[int, int] = {}
    base = {}
    for r in sorted(runs, key=lambda r: (r["cls"], r["p"])):
        base[(r["p"], r["cls"])] = before.get(r["cls"], 0) - r["at"]
        before[r["cls"]] = before.get(r["cls"], 0) + r["n"]
    held: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequences = 0
    for counts, times in plan(before, size // grain):
        for cls, c in counts.items():
            first = used.get(cls, 0)
            held.setdefault(cls, []).append((first + c * times, first, c, sequences))
            used[cls] = first + c * times
        sequences += times
    places = spark.sparkContext.broadcast(({k: np.array(v, np.int64) for k, v in held.items()}, base))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("rank", pa.int64()), ("cls", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, base_ = places.value
        for b in batches:
            at = np.array(pylist(b, "at"), np.int64)
            cls = np.array(pylist(b, "cls"), np.int64)
            rank = at + np.array([base_[(a >> 33, c)] for a, c in zip(at.tolist(), cls.tolist())], np.int64)
            sequence = np.empty(len(at), np.int64)
            for c in np.unique(cls):
                own = cls == c
                t = table_[int(c)]
                t = t[np.searchsorted(t[:, 0], rank[own], side="right")]
                sequence[own] = t[:, 3] + (rank[own] - t[:, 1]) // t[:, 2]
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls")}
            yield batch(schema, col | {"sequence_id": sequence, "rank": rank})

    placed = map_arrow(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, rank long, cls int")
    before_it = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before_it), F.lit(0).cast("long"))).drop("rank", "cls")


def op1_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens by column generation (see module)."""
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
