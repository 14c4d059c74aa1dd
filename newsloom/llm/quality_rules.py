"""Quality rules, native: base text rules and cross-document line frequency.

Only DataFrame functions run here.  One pass over the texts writes, per document, the base counts and its
distinct normalised lines as (hash, words) pairs to the shared checkpoint folder; everything after it works
on that small table.

A line is frequent on its host when more than ``max(MIN_DOCS, MIN_SHARE of the host's documents)`` distinct
documents hold it.  Exact copies (equal texts on a host, by a 64-bit hash) are one document in both counts, so
copying a text doesn't make its lines boilerplate; texts that differ anywhere are different documents.  The counts
are over distinct (host, line, text) first, spread by all three, so a line in a third of all documents is counted
by many tasks.  Frequent lines are removed; a document with fewer than ``MIN_WORDS`` words left is depleted and
rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut_lineage, table
from newsloom.operators.common import with_computed

MIN_WORDS = 20          # base rule and depletion
REPEAT_SPAN = 8
REPEAT_SHARE = 30       # per cent of words in repeated windows
MIN_DOCS = 20
MIN_SHARE = 0.01
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Lower case, digits as 0, runs of blanks as one space; line breaks stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_hashes(text: Column) -> Column:
    """(hash, words) of every line with a word, in order, after normalisation."""
    lines = F.filter(F.transform(F.split(normalised(text), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).cast("long").alias("w")))


def base_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words of repeated 8-word windows)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw_lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    df = with_computed(docs, {"words": _words(text), "raw_lines": raw_lines})
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long"),
        "word_hashes": F.transform("words", lambda w: F.xxhash64(w)),
    }).drop("words", "raw_lines")
    windows = F.when(F.col("n_words") >= REPEAT_SPAN, F.transform(
        F.sequence(F.lit(1), (F.col("n_words") - (REPEAT_SPAN - 1)).cast("int")),
        lambda i: F.xxhash64(F.slice(F.col("word_hashes"), i, REPEAT_SPAN)))).otherwise(F.array().cast("array<bigint>"))
    df = with_computed(with_computed(df, {"word_hashes": F.col("word_hashes")}), {"windows": windows}).drop("word_hashes")
    # only texts that repeat a window at all sort their windows (by hash, then place)
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform(
        "windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<x:bigint,i:int>>"))
    df = with_computed(df, {"ordered": ordered}).drop("windows")
    again = F.filter("ordered", lambda s, j: F.coalesce(s["x"] == F.get("ordered", j - 1)["x"], F.lit(False))
                     | F.coalesce(s["x"] == F.get("ordered", j + 1)["x"], F.lit(False)))
    places = F.array_sort(F.transform(again, lambda s: s["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
                          lambda a, p: F.struct((a["n"] + (p + REPEAT_SPAN - F.greatest(p, a["reach"]))).cast("long").alias("n"),
                                                (p + REPEAT_SPAN).alias("reach")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered).drop("ordered")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str, row_col: str | None = None) -> DataFrame:
    """The written per-document table: row (``row_col`` or a new key), doc_id, host, base counts, lines (distinct
    normalised lines), text_hash."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                      F.col(text_col).alias("text"), row.alias("row"))
    lines = line_hashes(F.coalesce(F.col("text"), F.lit("")))
    df = base_counts(own, "text").withColumns(
        {"all_lines": lines, "text_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}).drop("text")
    return cut_lineage(df)


def frequent_lines(m: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, h) of the lines above the limits."""
    hosts = m.groupBy("host").agg(F.countDistinct("text_hash").alias("host_docs"))
    held = (m.select("host", "text_hash", F.explode(F.array_distinct(F.transform("all_lines", lambda s: s["h"]))).alias("h"))
            .groupBy("host", "h").agg(F.countDistinct("text_hash").alias("docs")))
    return (held.where(F.col("docs") > min_docs).join(hosts, "host")
            .where(F.col("docs") > min_share * F.col("host_docs")).select("host", "h"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document row: doc_id, the base counts, n_lines, n_removed_lines, n_left_words, base_failed, kept.

    Null or empty texts have no words, so they fail the base rules; a null host is the host ''; lines without a
    word are never counted; repeated rows of a text on a host count once, and each gets its own row; at exactly a limit a
    line is not frequent; hosts of at most MIN_DOCS different texts have no frequent lines; very long texts and lines are
    read whole.
    """
    m = measured(docs, id_col, text_col, host_col)
    return verdicts(m, frequent_lines(m))


def verdicts(m: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of ``quality_rules`` from the measured table and the frequent lines."""
    return row_verdicts(m, frequent).drop("row")


def row_verdicts(m: DataFrame, frequent: DataFrame) -> DataFrame:
    """``verdicts`` with the measured table's row."""
    gone = (m.select("row", "host", F.explode("all_lines").alias("l")).select("row", "host", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
            .join(frequent, ["host", "h"]).groupBy("row").agg(F.count("*").alias("n_removed_lines"), F.sum("w").alias("gone")))
    out = m.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   F.size("all_lines").cast("long").alias("n_lines")).join(gone, "row", "left")
    out = out.withColumns({"n_removed_lines": F.coalesce("n_removed_lines", F.lit(0).cast("long")),
                           "n_left_words": F.col("n_words") - F.coalesce("gone", F.lit(0)), "base_failed": base_failed()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_left_words") >= MIN_WORDS)).drop("gone")


def without_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents without their host's frequent lines.  ``frequent``: (host, h) as ``frequent_lines`` gives them;
    each host's lines travel as one array, whose size the limits bound: a host has at most
    (lines per document / MIN_SHARE) of them."""
    lists = frequent.groupBy("host").agg(F.collect_set("h").alias("_gone")).withColumnRenamed("host", "_host")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    keep = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col("_gone"), F.xxhash64(F.trim(normalised(x)))))
    return (docs.withColumn("_host_key", key).join(lists, F.col("_host_key") == F.col("_host"), "left")
            .withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n")))
            .withColumn("n_chars", F.length(text_col).cast("long")).select(*docs.columns))


def op4_quality_rules(spark, sf_dir):
    """Base rules and cross-document line frequency over all documents (see module)."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_removed_lines", "n_left_words")


_WS = "'[\\x20\\x09-\\x0D]+'"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, {_WS}), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
             list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(t), '[0-9]', '0', 'g'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10)),
                                        lambda x: trim(x)), lambda x: x <> '') AS nl FROM d),
win AS (SELECT rid, k, array_to_string(list_slice(w, k, k + 7), ' ') AS s
        FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS k FROM w WHERE len(w) >= 8)),
dup AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT win.rid, unnest(range(k, k + 8)) AS p FROM win JOIN dup USING (rid, s)) GROUP BY rid),
lines AS (SELECT rid, host, t, unnest(nl) AS line FROM w),
freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS docs FROM lines GROUP BY host, line)
         JOIN (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host) USING (host)
         WHERE docs > {MIN_DOCS} AND docs > {MIN_SHARE} * host_docs),
gone AS (SELECT rid, count(*) AS n, sum(len(string_split(line, ' '))) AS words FROM lines JOIN freq USING (host, line) GROUP BY rid),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(nl) AS BIGINT) AS n_lines, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_lines,
             CAST(len(w) - coalesce(gone.words, 0) AS BIGINT) AS n_left_words
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words) AND n_left_words >= {MIN_WORDS} AS kept FROM o
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": OP4_SQL}
