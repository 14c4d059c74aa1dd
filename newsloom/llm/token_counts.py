"""Token counts: pieces are counted once per distinct pre-token and summed by document frequencies.

1. every task tallies its pre-tokens and sends (pre-token, occurrences) sums; one row per distinct pre-token
   remains, its pieces are counted by the tokenizer library and the table is written (no ids are kept);
2. the pre-tokens that make up at least 1 / HEAD of all occurrences (so there are at most HEAD of them) are broadcast
   with their counts: they settle most occurrences while a document is tallied.  The other (document, pre-token, frequency) rows join the table by a
   shuffle; no pre-token in them is frequent, so no key is hot;
3. both parts are summed per document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch, cut_lineage, id_and_text, map_arrow, pylist, slices, table
from newsloom.llm.tokens import Splitter, n_pieces

HEAD = 2_000_000       # pre-tokens with this share of all occurrences are broadcast
TALLY = 300_000        # pre-tokens a task tallies before it sends sums
LIMIT = 512


def pretoken_counts(data: DataFrame, path: str) -> DataFrame:
    """(piece, n, tokens): every distinct pre-token, its occurrences and its number of ids."""
    tallied = pa.schema([("piece", pa.string()), ("n", pa.int64())])
    counted = pa.schema([("piece", pa.string()), ("n", pa.int64()), ("tokens", pa.int32())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = Splitter(path), Counter()
        for b in batches:
            for x in pylist(b, "data"):
                held.update(split.keys(x.decode("utf-8", "replace"))[0])
                if len(held) > TALLY:
                    yield batch(tallied, {"piece": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield batch(tallied, {"piece": list(held), "n": list(held.values())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        for b in batches:
            yield batch(counted, {"piece": b.column(0), "n": b.column(1),
                                  "tokens": n_pieces(path, [split.text_of(k) for k in pylist(b, "piece")])})

    sums = map_arrow(data, tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return map_arrow(sums, count, "piece string, n long, tokens int")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document row: doc_id, n_bytes (UTF-8), n_tokens.

    Null or empty texts have no bytes and no tokens; repeated rows are each counted; ids may be null; strings of
    added tokens inside a text count as the library's default takes them (one id each).
    """
    spark = docs.sparkSession
    data = id_and_text(docs, id_col, text_col)
    pieces = cut_lineage(pretoken_counts(data, path))
    total = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    top = pieces.where(F.col("n") * head >= total).select("piece", "tokens")
    known = spark.sparkContext.broadcast(dict(map(tuple, top.collect())))
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("part", pa.int64()),
                      ("piece", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = Splitter(path), known.value
        for b in slices(batches, 1000):
            n_bytes, part, rest, times = [], [], [], []
            for x in pylist(b, "data"):
                keys, drop = split.keys(x.decode("utf-8", "replace"))
                tallied = Counter(keys)
                total, more = -drop, {}
                for k, n in tallied.items():
                    c = count.get(k)
                    if c is None:
                        more[k] = n
                    else:
                        total += n * c
                n_bytes.append(len(x))
                part.append(total)
                rest.append(list(more))
                times.append(list(more.values()))
            yield batch(kind, {"doc_id": b.column(0), "n_bytes": n_bytes, "part": part, "piece": rest, "n": times})

    settled = cut_lineage(map_arrow(data, settle, "doc_id long, n_bytes long, part long, piece array<string>, n array<int>")
                          .withColumn("row", F.monotonically_increasing_id()))
    rest = (settled.select("row", F.explode(F.arrays_zip("piece", "n")).alias("t"))
            .select("row", F.col("t.piece").alias("piece"), F.col("t.n").alias("times"))
            .join(pieces.select("piece", "tokens"), "piece")
            .groupBy("row").agg(F.sum(F.col("times").cast("long") * F.col("tokens")).alias("rest")))
    return (settled.select("row", "doc_id", "n_bytes", "part").join(rest, "row", "left")
            .select("doc_id", "n_bytes", (F.col("part") + F.coalesce("rest", F.lit(0))).alias("n_tokens")))


def op9_token_counts(spark, sf_dir):
    """Token counts of all documents under the byte-level tokenizer file (see module)."""
    import public_tokenizers
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
