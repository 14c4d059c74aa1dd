"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the test windows: every 10 consecutive words of a benchmark item, or the whole item when
it has fewer.  For each window length m the matcher keeps

* a shift table keyed by blocks of two words: the distance from the block's last place in any window
  to the window's end, so a text position whose block is unknown is skipped by m - 1 words at once;
* buckets keyed by the hash of the window's last block (shift 0), holding the candidate windows;
* a direct comparison of the words, which alone confirms an occurrence.

The window table is broadcast in blocks of at most ``block_words`` words, whatever the benchmark's size;
documents flow through the blocks one after the other in one narrow pass (no shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import alnum_words, batch, id_and_text, map_arrow, pylist, table

SPAN = 10
BLOCK_WORDS = 2_000_000


class Matcher:
    """Wu-Manber tables for one block of benchmark items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], span: int = SPAN):
        by_length: dict[int, dict[tuple, set[str]]] = {}
        for item, words in items:
            m = min(span, len(words))
            for k in range(len(words) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(words[k:k + m]), set()).add(item)
        self.groups = []
        for m, windows in sorted(by_length.items()):
            shift: dict = {}
            bucket: dict = {}
            width = min(2, m)
            for w in windows:
                for end in range(width, m + 1):
                    block = w[end - 1] if width == 1 else w[end - 2] + b" " + w[end - 1]
                    shift[block] = min(shift.get(block, m), m - end)
                bucket.setdefault(block, []).append(w)
            self.groups.append((m, width, shift, bucket, windows))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences (start, end) in ascending order per window length, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        n = len(words)
        for m, width, shift, bucket, windows in self.groups:
            default = m - width + 1
            end = m - 1
            while end < n:
                block = words[end] if width == 1 else words[end - 1] + b" " + words[end]
                step = shift.get(block, default)
                if step:
                    end += step
                    continue
                start = end - m + 1
                for w in bucket[block]:
                    if words[start] == w[0] and tuple(words[start:end + 1]) == w:
                        spans.append((start, end + 1))
                        items |= windows[w]
                        break
                end += 1
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of positions inside any span."""
    total, reach = 0, -1
    for a, b in sorted(spans):
        a = max(a, reach)
        if b > a:
            total += b - a
            reach = b
    return total


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Benchmark items streamed to the driver, at most ``block_words`` words at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                            F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        words = alnum_words(bytes(r["t"]))
        if not words:
            continue
        if held and size + len(words) > block_words:
            yield held
            held, size = [], 0
        held.append((r["i"], words))
        size += len(words)
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, hits (array of [start, end) word spans of the occurrences),
    n_hit (words inside any), items (ids of occurring items, sorted as strings).

    Null or empty texts have no words and no hits; repeated documents are each returned; items without
    words never occur; items with the same window all count; an empty benchmark hits nothing; a null
    item id counts as the empty string.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(x) for x in item_blocks(benchmark, item_col, item_text_col, block_words)]
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
    state = f"{id_col} long, data binary, starts array<int>, ends array<int>, items array<string>"
    through = pa.schema([(id_col, pa.int64()), ("data", pa.binary()), ("starts", ints), ("ends", ints), ("items", strings)])
    last = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("starts", ints), ("ends", ints),
                      ("n_hit", pa.int64()), ("items", strings)])
    out = id_and_text(docs, id_col, text_col)
    for i, held in enumerate(blocks):
        final = i == len(blocks) - 1

        def search(batches: Iterator[pa.RecordBatch], held=held, first=i == 0, final=final) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, span)
            for b in batches:
                n = b.num_rows
                starts, ends, items = [[[] for _ in range(n)]] * 3 if first else [pylist(b, c) for c in ("starts", "ends", "items")]
                starts, ends, items, n_words, n_hit = list(starts), list(ends), list(items), [], []
                for k, data in enumerate(pylist(b, "data")):
                    words = alnum_words(data)
                    found, which = matcher.find(words)
                    if found:
                        starts[k] = starts[k] + [s for s, _ in found]
                        ends[k] = ends[k] + [e for _, e in found]
                        items[k] = sorted({*items[k], *which})
                    if final:
                        n_words.append(len(words))
                        n_hit.append(covered(list(zip(starts[k], ends[k]))))
                yield (batch(last, {id_col: b.column(0), "n_words": n_words, "starts": starts, "ends": ends, "n_hit": n_hit, "items": items})
                       if final else batch(through, {id_col: b.column(0), "data": b.column(1), "starts": starts, "ends": ends, "items": items}))

        out = map_arrow(out, search, f"{id_col} long, n_words long, starts array<int>, ends array<int>, n_hit long, items array<string>" if final else state)
    return out.select(id_col, "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("hits"),
                      "n_hit", "items")


def op6_decontaminate(spark, sf_dir):
    """Benchmark decontamination of all documents by Wu-Manber search (see module)."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = """
WITH norm AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM wins),
dw AS (
  SELECT rid, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM norm, lens WHERE len(w) >= m)),
hit AS (SELECT dw.rid, dw.m, dw.k, wins.item_id FROM dw JOIN wins USING (m, win)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + m)) AS p FROM hit) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": OP6_SQL}
