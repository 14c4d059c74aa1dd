"""Alignment of two tokenizers over a corpus, with a fast path for tokens of the same bytes.

The token ends of both encodings of a text are offsets in the same bytes; offsets where both end cut the text into
groups.  ``identity`` maps each A id, once, to the B id of the same bytes.

1. every text is encoded by both libraries once and cut into groups.  A group of one A and one B token that the map
   holds is *regular*: it is kept as (A id, times).  All other groups are *irregular*: their link (last A, last B) is
   kept as (pair, times).  Both are distinct per document, in a written table;
2. regular links: every task adds its rows into one vector of A's vocabulary length; the sums are at most one row an id;
3. irregular links: (pair, times) rows are summed by a shuffle with map-side sums.  A link of a group with more than
   one token on a side joins tokens of unequal length, so no pair is counted on both paths;
4. the highest count of each B id is at most one row an id of B.  It, the vector and the irregular pairs of at least
   1 / HEAD of all links (so at most HEAD) are broadcast and settle nearly all links where the rows lie; what is left
   joins the pair table, where no key is hot.

Each step reads a written table, so a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.fixed import byte_table
from newsloom.llm.common import batch, cut_lineage, id_and_text, map_arrow, pylist, slices, table
from newsloom.llm.tokens import ranked, safe

HEAD = 1_000_000     # irregular pairs with this share of all links are broadcast
ROWS = 256           # texts that are encoded and cut together


@dataclass
class Vocabularies:
    """Bytes of every id of A and B, and the identity map: A id -> B id of the same bytes, or -1."""
    a: list[bytes]
    b: list[bytes]
    identity: np.ndarray


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """Read from a byte-level tokenizer file (A) and a sentencepiece model (B).

    Where several B ids have the same bytes (a character and its byte piece), the map takes the one that isn't a byte
    piece, then the smallest; groups with the other one are irregular."""
    import sentencepiece
    with open(path_a, encoding="utf-8") as f:
        spec = json.load(f)
    names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    back = {c: b for b, c in enumerate(byte_table())}
    a = [b""] * (max(names.values()) + 1)
    for name, k in names.items():
        a[k] = bytes(back[c] for c in name)
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(k) for k in range(size)]
    is_byte = [len(p) == 6 and p.startswith("<0x") and p.endswith(">") for p in pieces]
    b = [bytes([int(p[3:5], 16)]) if x else p.replace("▁", " ").encode() for p, x in zip(pieces, is_byte)]
    own: dict[bytes, int] = {}
    for k in sorted(range(size), key=lambda k: (is_byte[k], k)):
        own.setdefault(b[k], k)
    return Vocabularies(a, b, np.array([own.get(x, -1) if x else -1 for x in a], np.int64))


class Aligner:
    """``groups(texts)``: digest and distinct links of each text, by numpy over all texts of the call at once.

    If file A is the plain byte-level BPE (no normalizer, the library's own pattern, ids in merge order), texts of
    characters below U+3000 (and without endless white space) are encoded by tiktoken over the file's vocabulary, which gives the same ids (tested on every
    such character) in a fifth of the time; all other texts are encoded by tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer
        self.fast = ranked(path_a)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path_a)
        self.encoder.encode_special_tokens = True          # their strings inside a text are plain text
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.known = v = vocabularies(path_a, path_b)
        self.len_a = np.array([len(x) for x in v.a], np.int64)
        self.len_b = np.array([len(x) for x in v.b], np.int64)
        na, nb = len(v.a), len(v.b)
        # decimal ids with the sign that may follow: A "," A "|" B "," B ";" B ""
        self.text = [b"%d%s" % (k, s) for n, signs in ((na, (b",", b"|")), (nb, (b",", b";", b""))) for s in signs for k in range(n)]

    def encode(self, raw: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B; none for a text that is empty, not UTF-8, or not rebuilt by both."""
        texts = []
        for x in raw:
            try:
                texts.append(x.decode())
            except UnicodeDecodeError:
                texts.append("")
        slow = [k for k, t in enumerate(texts) if self.fast is None or not safe(t)]
        a = [[] if self.fast is None or not safe(t) else self.fast.encode_ordinary(" " + t) for t in texts]
        for k, e in zip(slow, self.encoder.encode_batch_fast([" " + texts[k] for k in slow], add_special_tokens=False)):
            a[k] = e.ids
        b = self.model.encode(texts, num_threads=1)
        of_a, of_b = self.known.a.__getitem__, self.known.b.__getitem__
        for k, x in enumerate(raw):
            if not texts[k] or b"".join(map(of_a, a[k])) != b" " + x or b"".join(map(of_b, b[k])) != b" " + x:
                a[k], b[k] = [], []
        return a, b

    def groups(self, raw: list[bytes]) -> dict:
        ids_a, ids_b = self.encode(raw)
        docs, na, nb = len(raw), len(self.known.a), len(self.known.b)
        n_a = np.fromiter(map(len, ids_a), np.int64, docs)
        n_b = np.fromiter(map(len, ids_b), np.int64, docs)
        a, b = (np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in ids)]) for ids in (ids_a, ids_b))
        # both sides have the same bytes in every text, so offsets may run through all texts
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[np.minimum(at, len(b) - 1)] == end_a) if len(b) else np.zeros(0, np.int64)
        last_b = at[last_a]
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        doc = np.repeat(np.arange(docs), n_a)[last_a]
        link_a, link_b = a[last_a], b[last_b]
        regular = (size_a == 1) & (size_b == 1) & (self.known.identity[link_a] == link_b)

        # ids in group order: A's of a group, then B's
        group_a, group_b = np.repeat(np.arange(len(last_a)), size_a), np.repeat(np.arange(len(last_b)), size_b)
        code = np.empty(len(a) + len(b), np.int64)
        is_last_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        is_last_a[last_a] = 1
        sign_b[last_b] = 1
        sign_b[np.cumsum(n_b)[n_b > 0] - 1] = 2
        code[np.arange(len(a)) + (last_b - size_b + 1)[group_a]] = a + na * is_last_a
        code[np.arange(len(b)) + (last_a + 1)[group_b]] = b + 2 * na + nb * sign_b
        stop = np.cumsum(n_a + n_b).tolist()
        text = self.text.__getitem__
        digest = [hashlib.sha256(b"".join(map(text, code[lo:hi].tolist()))).hexdigest() if hi > lo else ""
                  for lo, hi in zip([0, *stop], stop)]

        def distinct(which: np.ndarray, value: np.ndarray, span: int) -> tuple[pa.Array, pa.Array]:
            key, times = np.unique(doc[which] * span + value[which], return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(docs + 1) * span), pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(key % span)), pa.ListArray.from_arrays(offsets, pa.array(times))

        same, same_n = distinct(regular, link_a, na)
        pair, pair_n = distinct(~regular, link_a * nb + link_b, na * nb)
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc, minlength=docs), "groups_sha256": digest,
                "same": same, "same_n": same_n, "pair": pair, "pair_n": pair_n}


def _flat(b: pa.RecordBatch, ids: str, times: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and times of every element of two list columns."""
    lists = b.column(b.schema.get_field_index(ids))
    rows = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
    return rows, np.asarray(lists.flatten()), np.asarray(b.column(b.schema.get_field_index(times)).flatten())


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text (it adds the space).  Null, empty and invalid texts, and texts that either
    side doesn't give back byte for byte, have no tokens (zeros, empty digest) and add nothing to the counts.  Repeated
    rows are each counted; ids may be null; equal highest counts are all best; a very long text is one row of one task,
    whose memory it must fit with its ids.
    """
    spark = docs.sparkSession
    known = vocabularies(path_a, path_b)
    na, nb = len(known.a), len(known.b)
    longs = pa.list_(pa.int64())
    kind = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                      ("groups_sha256", pa.string()), ("same", longs), ("same_n", longs), ("pair", longs), ("pair_n", longs)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for b in slices(batches, ROWS):
            yield batch(kind, aligner.groups(pylist(b, "data")) | {"doc_id": b.column(0)})

    rows = cut_lineage(map_arrow(id_and_text(docs, id_col, text_col), cut,
                                 "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, same array<long>, "
                                 "same_n array<long>, pair array<long>, pair_n array<long>")
                       .withColumn("row", F.monotonically_increasing_id()))

    summed = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(na, np.int64)
        for b in batches:
            _, ids, times = _flat(b, "same", "same_n")
            np.add.at(held, ids, times)
        some = np.flatnonzero(held)
        yield batch(summed, {"id": some, "n": held[some]})

    # at most one row an id of the vocabulary comes to the driver
    same_count = np.zeros(na, np.int64)
    for k, n in map_arrow(rows.select("same", "same_n"), vector, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        same_count[k] = n
    pairs = cut_lineage(rows.select(F.explode(F.arrays_zip("pair", "pair_n")).alias("t"))
                        .groupBy(F.col("t.pair").alias("pair")).agg(F.sum("t.pair_n").alias("n")))
    best = np.zeros(nb, np.int64)
    np.maximum.at(best, known.identity[known.identity >= 0], same_count[known.identity >= 0])
    for k, n in pairs.groupBy(F.pmod("pair", F.lit(nb)).alias("b")).agg(F.max("n")).collect():
        best[k] = max(best[k], n)
    links = int(same_count.sum()) + int(pairs.agg(F.sum("n")).first()[0] or 0)
    top = sorted(map(tuple, pairs.where(F.col("n") * head >= links).select("pair", "n").collect()))
    shared = spark.sparkContext.broadcast((known.identity, same_count, best, np.array([p for p, _ in top], np.int64),
                                           np.array([n for _, n in top], np.int64)))
    part = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pair", longs), ("pair_n", longs)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, same_count, best, head_pair, head_n = shared.value
        for b in batches:
            n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)

            def add(row, count, b_id, times):
                np.add.at(count_sum, row, times * count)
                np.add.at(n_best, row, np.where(count == best[b_id], times, 0))

            row, ids, times = _flat(b, "same", "same_n")
            add(row, same_count[ids], identity[ids], times)
            row, ids, times = _flat(b, "pair", "pair_n")
            at = np.minimum(np.searchsorted(head_pair, ids), max(len(head_pair) - 1, 0))
            hit = head_pair[at] == ids if len(head_pair) else np.zeros(len(ids), bool)
            add(row[hit], head_n[at[hit]] if len(head_pair) else times[hit], ids[hit] % nb, times[hit])
            offsets = pa.array(np.searchsorted(row[~hit], np.arange(b.num_rows + 1)), pa.int32())
            yield batch(part, {"row": b.column(b.schema.get_field_index("row")), "n_best": n_best, "count_sum": count_sum,
                               "pair": pa.ListArray.from_arrays(offsets, pa.array(ids[~hit])),
                               "pair_n": pa.ListArray.from_arrays(offsets, pa.array(times[~hit]))})

    settled = cut_lineage(map_arrow(rows.select("row", "same", "same_n", "pair", "pair_n"), settle,
                                    "row long, n_best long, count_sum long, pair array<long>, pair_n array<long>"))
    highest = F.broadcast(spark.createDataFrame([(k, int(n)) for k, n in enumerate(best) if n], "b long, best long"))   # <= one row an id
    rest = (settled.select("row", F.explode(F.arrays_zip("pair", "pair_n")).alias("t"))
            .select("row", F.col("t.pair").alias("pair"), F.col("t.pair_n").alias("times")).join(pairs, "pair")
            .join(highest, F.pmod("pair", F.lit(nb)) == F.col("b")))
    rest = rest.select("row", F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
                       (F.col("times") * F.col("n")).alias("count_sum"))
    sums = settled.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    # one link ends each group
    return (rows.select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
            .join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def op11_align_tokenizers(spark, sf_dir):
    """Alignment of all documents between the byte-level and the piece tokenizer (see module)."""
    import public_tokenizers as P
    return align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


QUERIES = {"op11_align_tokenizers": op11_align_tokenizers}
ORACLES: dict[str, str] = {}
