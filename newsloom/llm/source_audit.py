"""How far the word use of a language's sources lies apart, in exact integers.

1. the words of every document are written once, between spaces, in one folder per language;
2. per language, ``CountVectorizer`` with ``minDF`` and the largest integer as ``vocabSize`` fits the vocabulary (every
   word of at least MIN_DOCS documents, none left out);
3. the vocabulary's words are counted by group, sparse, in the tasks that read them and then by a shuffle of blocks of
   the vocabulary: a source holding a third of the rows sends few rows a task.  The sums are written;
4. a probability depends on the group and the count alone.  With f00 the term of two words that neither source has,
   a pair of sources sums to

       V * f00 + sum over the words of s of (f(p_s, 0_t) - f00) + the same from t + sum over shared words of the rest,

   so only words that occur are looked at.  The first sums read the (count, words with it) histogram of each source; the
   last joins a language's words with themselves, which meets at most one row a source, and is summed where it is made.

The vocabulary of one language (words of at least MIN_DOCS documents) is held by the driver and by each task that counts,
as ``CountVectorizer`` does it; nothing else grows there.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import batch, checkpoint_dir, cut_lineage, map_arrow, pylist, slices, table

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
ROWS = 512           # texts that are split together, if they have fewer than MOST bytes
COUNTED = 4096       # texts whose words are counted together, likewise
MOST = 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# bytes table: A-Z lower-cased, ASCII characters other than letters become a space
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SURROGATE = re.compile(rb"\xed[\xa0-\xbf][\x80-\xbf]?")     # Java replaces it as a whole, Python byte by byte
HELD = 2_000_000     # distinct elements of group sums a task holds before it sends them
BLOCKS = 64          # parts of a vocabulary whose sums travel together


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Words ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of UTF-8 texts with A-Z lower-cased, cut out of the joined bytes by numpy."""
    data = b" ".join([*(x or b"" for x in texts.to_pylist()), b""]).translate(LETTERS)
    letters = np.frombuffer(data, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letters, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    kept = data.replace(b" ", b"")
    sizes = np.array([0, *(len(x or b"") + 1 for x in texts.to_pylist())], np.int64)
    bounds = np.searchsorted(starts, np.cumsum(sizes)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words)


def probability(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), by decimals, so no count is too large."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * size).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def word_sums(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
              min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, source) of every group, (lang, source, idx, n) of its words, and (lang, idx, word) of every vocabulary."""
    spark = docs.sparkSession
    base = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    # the folder is a hash of the language: any string may be one, the empty one too
    kind = pa.schema([("folder", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("words", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield batch(kind, {f.name: b.column(k) for k, f in enumerate(kind)} | {"words": list(map(spaced, b.column(3).to_pylist()))})

    read = docs.select(F.sha2(text(lang_col), 256).alias("folder"), text(lang_col).alias("lang"), text(source_col).alias("source"),
                       text(text_col).cast("binary").alias("words"))
    map_arrow(read, split, "folder string, lang string, source string, words string").write.partitionBy("folder").parquet(f"{base}/words")
    held = spark.read.schema("lang string, source string, words string, folder string").parquet(f"{base}/words")
    counter = CountVectorizer(inputCol="list", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1)
    words = F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))
    for row in held.select("folder", "lang").distinct().collect():          # one row a language
        own = held.where(F.col("folder") == row["folder"])
        vocabulary = list(counter.fit(own.select(words.alias("list"))).vocabulary)
        counts = group_sums(own.select("lang", "source", F.col("words").cast("binary").alias("words")), word_elements(spark, vocabulary))
        counts.write.mode("append").parquet(f"{base}/sums")
        terms = spark.createDataFrame([(row["lang"], vocabulary)], "lang string, words array<string>")
        terms.select("lang", F.posexplode("words").alias("idx", "word")).write.mode("append").parquet(f"{base}/terms")
    return (held.select("lang", "source").distinct(), spark.read.schema("lang string, source string, idx int, n long").parquet(f"{base}/sums"),
            spark.read.schema("lang string, idx int, word string").parquet(f"{base}/terms"))


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` texts, long texts alone."""
    return (c for b in slices(batches, rows) for c in slices(iter([b]), rows if b.nbytes < MOST else 1))


def spaced(data: bytes | None) -> str:
    """The words of a UTF-8 text, as in ``word_lists``, with one space between them; invalid bytes are replaced as Java does."""
    words = b" ".join((data or b"").translate(LETTERS).split())
    try:
        return words.decode()
    except UnicodeDecodeError:
        return SURROGATE.sub(b"\xff", words).decode("utf-8", "replace")


# rows -> the group (lang, source, block) of each row or part of rows, its number of elements, and the elements (idx, n)
Elements = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]]


def vector_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Elements of the sparse vectors in column ``vector``."""
    for b in batches:
        _, _, lists, values = b.column(b.schema.get_field_index("vector")).flatten()      # type, size, indices, values
        yield (list(zip(pylist(b, "lang"), pylist(b, "source"))), np.asarray(lists.value_lengths()), np.asarray(lists.flatten()),
               np.asarray(values.flatten()))


def word_elements(spark: SparkSession, vocabulary: list[str]) -> Elements:
    """Counts of the vocabulary's words in the texts of ``spaced`` (column ``words``, as bytes), those of a group at once."""
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        place = {w.encode(): k for k, w in enumerate(held.value)}
        for b in parts(batches, COUNTED):
            texts: dict[tuple, list[bytes]] = {}
            for *group, data in zip(pylist(b, "lang"), pylist(b, "source"), pylist(b, "words")):
                texts.setdefault(tuple(group), []).append(data)
            sizes, idx, n = [], [], []
            for own in texts.values():
                found = Counter(b" ".join(own).split(b" "))
                at = np.fromiter((place.get(w, -1) for w in found), np.int64, len(found))
                idx.append(at[at >= 0])
                n.append(np.fromiter(found.values(), np.int64, len(found))[at >= 0])
                sizes.append(len(idx[-1]))
            if texts:
                yield list(texts), np.array(sizes), np.concatenate(idx), np.concatenate(n)

    return run


def block_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Elements that ``group_sums`` has sent, in columns ``idx`` and ``n``."""
    for b in batches:
        idx, n = (b.column(b.schema.get_field_index(c)) for c in ("idx", "n"))
        yield (list(zip(pylist(b, "lang"), pylist(b, "source"), pylist(b, "block"))), np.asarray(idx.value_lengths()), np.asarray(idx.flatten()),
               np.asarray(n.flatten()))


def group_sums(rows: DataFrame, elements: Elements = vector_elements) -> DataFrame:
    """(lang, source, idx, n) from (lang, source, and what ``elements`` reads, sparse vectors by default): the sum of each
    group, one row for every element that isn't zero.

    A task adds its elements up, sparse, and sends sums whenever it holds HELD of them, a row for each group and block of
    the elements; a block's rows are added up where a shuffle has put them, sorted, so that done blocks can be let go."""
    sent = pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int32()), ("idx", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("idx", pa.int32()), ("n", pa.int64())])

    def added(batches, read: Elements, left: Callable) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        """(groups, place in them, idx, sum) by place; ``left``: the first place that must stay, if sums are sent before the end."""
        names: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
            return keys[first], np.add.reduceat(n[order], first) if len(keys) else n

        def sums(keys: np.ndarray, n: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
            return list(names), keys >> 32, keys & 0xFFFFFFFF, n

        for groups, lengths, idx, n in read(batches):
            group = np.array([names.setdefault(g, len(names)) for g in groups], np.int64)
            held.append((np.repeat(group, lengths) << 32 | idx.astype(np.int64), n.astype(np.int64)))
            if sum(len(k) for k, _ in held) > HELD:
                held = [merge()]
                keys, n = held[0]
                if len(keys) > HELD // 2:
                    end = np.searchsorted(keys, left(len(names)) << 32)
                    if end:
                        yield sums(keys[:end], n[:end])
                    held = [(keys[end:], n[end:])]
        if held:
            yield sums(*merge())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, group, idx, n in added(batches, elements, lambda groups: groups):
            ends = np.searchsorted(group, np.arange(len(groups) + 1))
            for (lang, source), lo, hi in zip(groups, ends, ends[1:]):
                order = lo + np.argsort(idx[lo:hi] % BLOCKS, kind="stable")
                cuts = np.searchsorted(idx[order] % BLOCKS, np.arange(BLOCKS + 1))
                some = np.flatnonzero(np.diff(cuts))
                edges = pa.array([*cuts[some], hi - lo], pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x[order], t)) for x, t in ((idx, pa.int32()), (n, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                                                  pa.array(some, pa.int32()), *lists], schema=sent)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, group, idx, n in added(batches, block_elements, lambda groups: groups - 1):
            lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            for k in range(0, len(idx), 10_000):
                own = slice(k, k + 10_000)
                at = pa.array(group[own])
                yield batch(kind, {"lang": lang.take(at), "source": source.take(at), "idx": idx[own], "n": n[own]})

    dealt = (map_arrow(rows, send, "lang string, source string, block int, idx array<int>, n array<long>")
             .repartition("lang", "source", "block").sortWithinPartitions("lang", "source", "block"))
    return map_arrow(dealt, receive, "lang string, source string, idx int, n long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language (part ``pair``) and the ``top`` words
    that a source uses more than its language (part ``term``).

    Null text, lang and source are read as empty; a (lang, source) group without kept words is still a group; repeated
    rows are each counted; equal values are ranked by the item's bytes; very long texts are one vector each; an empty
    table gives no rows; a language without kept words gives pairs of value 0.
    """
    spark = docs.sparkSession
    if not docs.select(F.lit(1)).take(1):
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    named, sums, terms = word_sums(docs, lang_col, source_col, text_col, min_docs)
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    # one row a group, also for groups without words
    groups = cut_lineage(named
                         .join(sums.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
                         .join(sizes, "lang", "left")
                         .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"))
                         .withColumn("p0", F.when(F.col("size") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.col("size")))))
    counted = cut_lineage(sums.join(groups, ["lang", "source"])
                          .select("lang", "source", "idx", "n", "p0", probability(F.col("n"), F.col("total"), F.col("size")).alias("p")))
    return _pairs(groups, counted).unionByName(_terms(counted, sizes, terms, top))


def _pairs(groups: DataFrame, counted: DataFrame) -> DataFrame:
    s = groups.select("lang", F.col("source").alias("s"), "size", F.col("p0").alias("s0"))
    t = groups.select("lang", F.col("source").alias("t"), F.col("p0").alias("t0"))
    # the answer itself has a row for each ordered pair of sources of a language; a value is computed for s < t
    none = (s.join(t, "lang").where("s < t")
            .select("lang", "s", "t", F.coalesce(F.col("size") * gap(F.col("s0"), F.col("t0")), F.lit(0)).alias("value")))
    histogram = counted.groupBy("lang", F.col("source").alias("s"), F.col("p0").alias("s0"), "p").agg(F.count(F.lit(1)).alias("words"))
    one = (histogram.join(t, "lang").where("s <> t")
           .select("lang", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"),
                   (F.col("words") * (gap(F.col("p"), F.col("t0")) - gap(F.col("s0"), F.col("t0")))).alias("value")))
    a = counted.select("lang", "idx", F.col("source").alias("s"), F.col("p").alias("ps"), F.col("p0").alias("s0"))
    b = counted.select("lang", "idx", F.col("source").alias("t"), F.col("p").alias("pt"), F.col("p0").alias("t0"))
    ps, pt, s0, t0 = map(F.col, ("ps", "pt", "s0", "t0"))
    shared = (a.join(b, ["lang", "idx"]).where("s < t")
              .groupBy("lang", "s", "t").agg(F.sum(gap(ps, pt) - gap(ps, t0) - gap(s0, pt) + gap(s0, t0)).alias("value")))
    half = none.unionByName(one).unionByName(shared).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("s", "t"), F.struct(F.col("t").alias("s"), F.col("s").alias("t")))
    total = half.select("lang", "value", F.explode(both).alias("pair")).select("lang", "pair.s", "pair.t", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "s").orderBy(F.col("value").desc(), "t"))
    return total.select("lang", F.col("s").alias("source"), F.lit("pair").alias("part"), F.col("t").alias("item"), "value",
                        rank.alias("rank"))


def _terms(counted: DataFrame, sizes: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    by_lang = counted.groupBy("lang", "idx").agg(F.sum("n").alias("n"))
    totals = by_lang.groupBy("lang").agg(F.sum("n").alias("total"))
    whole = (by_lang.join(totals.join(sizes, "lang"), "lang")
             .select("lang", "idx", probability(F.col("n"), F.col("total"), F.col("size")).alias("q")))
    more = (counted.join(whole, ["lang", "idx"]).where("p > q").join(terms, ["lang", "idx"])
            .select("lang", "source", F.col("word").alias("item"), gap(F.col("p"), F.col("q")).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return (more.withColumn("rank", rank).where(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op12_source_audit(spark, sf_dir):
    """Divergence of all sources of each language of the documents, and the words that mark each source (see module)."""
    return audit(table(spark, sf_dir, "documents"))


_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT row, lang, source, unnest(words) AS word FROM d),
vocabulary AS (SELECT lang, word FROM w GROUP BY lang, word HAVING count(DISTINCT row) >= {MIN_DOCS}),
size AS (SELECT lang, (SELECT count(*) FROM vocabulary v WHERE v.lang = g.lang) AS v FROM (SELECT DISTINCT lang FROM d) g),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, word, count(*) AS n FROM w JOIN vocabulary USING (lang, word) GROUP BY ALL),
full_group AS (SELECT g.lang, g.source, x.word, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
               FROM groups g JOIN vocabulary x USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.word = x.word),
p AS (SELECT lang, source, word, n, 1 + ({SCALE}::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM full_group JOIN size USING (lang)),
full_lang AS (SELECT lang, word, sum(n) AS n FROM full_group GROUP BY lang, word),
q AS (SELECT lang, word, 1 + ({SCALE}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM full_lang JOIN size USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)), 0) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.word = b.word AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, word AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, word) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM all_pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= {TOP}"""

QUERIES = {"op12_source_audit": op12_source_audit}
ORACLES = {"op12_source_audit": _SQL}
