"""Merge stage: cleaned, deduplicated, split corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed, rand, text as T
from newsloom.operators import dedupe as D
from newsloom.operators.common import with_computed


def fix_authors(df: DataFrame, text: str = "text", authors: str = "authors", summary: str | None = "summary",
                byline_requires_newline: bool = True) -> DataFrame:
    """P9 + F15 + P10.

    P9 (intent, quirk X2): no authors, text starts with ``By `` and contains a newline, the first
    line after ``By `` has fewer than 6 words -> it becomes the author, the rest (stripped) the text.
    """
    t, a = F.col(text), F.col(authors)
    after = F.substring(t, 4, 1 << 30)
    first = F.substring_index(after, "\n", 1)
    rest = F.substring(after, F.length(first) + 2, 1 << 30)
    cond = (F.size(a) == 0) & F.startswith(t, F.lit(fixed.BYLINE_PREFIX))
    if byline_requires_newline:
        cond = cond & F.contains(after, F.lit("\n"))
    cond = cond & (F.size(F.split(first, " ", -1)) < fixed.BYLINE_MAX_WORDS)
    new_authors = F.filter(F.when(cond, F.array(T.strip(first))).otherwise(a), T.plausible_author)
    out = with_computed(df, {authors: new_authors, text: F.when(cond, T.strip(rest)).otherwise(t)})
    if summary and summary in df.columns:
        out = out.withColumn(summary, T.summary_or_null(summary))
    return out


def strip_boilerplate(df: DataFrame, text: str = "text", domain: str | None = "domain", rules=None,
                      names=None, on_domain=None) -> DataFrame:
    """P11 + P12 + P13."""
    c = T.strip_boilerplate_text(text, rules)
    if domain and domain in df.columns:
        c = T.undouble_names(c, domain, names, on_domain)
    return with_computed(df, {text: c})


def assign_split(df: DataFrame, key: str | list[str], train: float = fixed.TRAIN_PORTION, seed: int = 0,
                 name: str = "split") -> DataFrame:
    """Hash-Bernoulli train/val split (reproducible; ``key`` may be the domain, as the
    original's docstring suggests, or the article id)."""
    keys = [key] if isinstance(key, str) else list(key)
    u = rand.uniform(seed, "split", *keys)
    return df.withColumn(name, F.when(u < F.lit(train), "train").otherwise("val"))


def dump_order_table(spark: SparkSession, dumps: list[str] | None = None,
                     archive: str | None = fixed.ARCHIVE_SOURCE) -> DataFrame:
    """(dump, priority); archive first, then dumps newest -> oldest."""
    dumps = fixed.DUMP_ORDER if dumps is None else dumps
    rows = ([(archive, 0)] if archive else []) + [(d, i + 1) for i, d in enumerate(reversed(dumps))]
    return spark.createDataFrame(rows, "dump string, priority int")


def with_priority(df: DataFrame, order_table: DataFrame, dump: str = "dump") -> DataFrame:
    """Attach the dump priority.  No hint: the order table has one row per dump, so the planner
    (statically) or AQE (from its runtime size) broadcasts it, and falls back to a shuffle join if a
    caller ever passes a large one."""
    return df.join(order_table.withColumnRenamed("dump", dump), dump, "inner")


def merge_corpus(df: DataFrame, order_cols: list[str], url: str = "url", text: str = "text",
                 domain: str = "domain", split_key: str | list[str] | None = None, seed: int = 0,
                 end_key: bool = False, clean: bool = True, seen: dict | None = None) -> DataFrame:
    """The merge: clean -> ban -> greedy two-key dedupe (url, content key) in order -> split.

    ``order_cols`` give the precedence (e.g. ``['priority', 'file', 'line']``).  Returns the kept
    rows with ``split``; the content key is the first (or, with ``end_key``, last) 100 characters
    of the cleaned text.
    """
    if clean:
        df = fix_authors(df, text=text) if "authors" in df.columns else df
        df = strip_boilerplate(df, text=text, domain=domain if domain in df.columns else None)
    if "authors" in df.columns:
        df = D.ban_rows(df, text=text)
    else:
        df = df.filter(~(T.gallery_count(text) > fixed.MAX_GALLERY_MATCHES))
    df = df.withColumns({"_order": D.order_column(*order_cols), "_ckey": T.content_key(text, end=end_key)})
    kept = D.greedy_dedupe(df, [url, "_ckey"], "_order", seen=seen)
    kept = kept.drop("_order", "_ckey")
    return assign_split(kept, split_key if split_key is not None else url, seed=seed)


def domain_counts(kept: DataFrame, domain: str = "domain") -> DataFrame:
    """A1 (+ A10 for any grouping column): kept articles per domain."""
    return kept.groupBy(domain).agg(F.count(F.lit(1)).alias("n_articles"))


def hit_miss(all_rows: DataFrame, kept: DataFrame, order: str, source: str | None = None,
             archive: str = fixed.ARCHIVE_SOURCE) -> DataFrame:
    """A2: hits = kept rows, misses = rejected rows not from the archive scrape."""
    flagged = all_rows.join(kept.select(order).withColumn("_hit", F.lit(True)), order, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    not_archive = F.lit(True) if source is None else (F.col(source) != archive)
    return flagged.agg(F.count_if(hit).alias("hits"), F.count_if(~hit & not_archive).alias("misses"))


def sample_articles(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """W8 + A11: shuffle by a hash of (seed, key) and take ``n`` rows (sampling is the feature here).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps its top n, the
    driver merges n x partitions rows -- bounded by n, independent of the corpus size.
    """
    u = rand.uniform(seed, "sample", key)
    return df.withColumn("_u", u).orderBy("_u", key).limit(n).drop("_u")


def dump_and_key(path: str = "path", propaganda: bool = False) -> tuple[Column, Column]:
    """Dump id = second path segment; output key = ``{prefix}{dump}/{rest joined by _}.jsonl``."""
    parts = F.split(F.col(path), "/", -1)
    dump = parts.getItem(1)
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    prefix = "propaganda-" if propaganda else ""
    return dump, F.concat(F.lit(prefix), dump, F.lit("/"), rest, F.lit(".jsonl"))


def check_valid(df: DataFrame, date: str | None = "publish_date", label: str | None = None,
                labels: list[str] | None = None, fail: bool = False) -> DataFrame:
    """validity of dates (and labels).  ``fail=True`` stops the job on the first invalid row,
    as the original's assertions do; otherwise a ``valid`` column is added for a reject table."""
    ok = F.lit(True)
    if date:
        ok = ok & T.valid_date(date)
    if label:
        ok = ok & F.coalesce(F.col(label).isin(labels or fixed.CLASS_LABELS), F.lit(False))
    if fail:
        return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("invalid row")).cast("boolean")))
    return df.withColumn("valid", ok)


def keep_splits(df: DataFrame, drop: list[str] = ("train",), split: str = "split") -> DataFrame:
    """drop rows of the given splits (e.g. train for evaluation, ``ignore`` for the corpus)."""
    return df.where(~F.col(split).isin(list(drop)))


def fold_filter(df: DataFrame, line: str, num_folds: int, fold: int) -> DataFrame:
    """rows whose line number falls in one fold (line mod folds == fold)."""
    return df.where(F.pmod(F.col(line), F.lit(num_folds)) == fold)
