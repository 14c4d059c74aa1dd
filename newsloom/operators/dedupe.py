"""Order-aware exact deduplication.

D1, greedy first-seen over several keys: walking rows in ``order``, a row is kept iff *none* of
its keys was registered before, and only kept rows register their keys.  This is not a chain of
``dropDuplicates`` (a rejected row registers nothing).  It equals a parallel fixpoint (greedy
maximal independent set in rounds):

    u := undecided rows
    repeat until u is empty:
        kept_r := rows of u whose order is the minimum of u for *every* one of their keys
        kept_r += rows that a chain of single conflicts decides (below)
        u      := u minus kept_r minus every row sharing any key with kept_r

A row that conflicts with exactly one earlier undecided row is kept iff that row is not.  Such rows form chains, and a
chain is decided at once from the row at its head: its members of even distance are kept.  The distances come from
pointer doubling, so a chain of n conflicts takes log2(n) joins instead of n / 2 rounds.  Rounds remain only for rows with
two or more earlier conflicts that are themselves undecided (the problem is inherently sequential in the worst case).

Physical shape per round, chosen for skewed keys (one key may hold a third of the rows):
* only (order, keys) take part;
* the two earliest rows of each key are a ``row_number() <= 2`` window, which Spark limits within each map task before
  the shuffle, so a hot key costs two rows per map task, never one task holding the whole group.  They hold all that a
  round needs: no earlier row on any key (kept), or exactly one (a chain link);
* pointers are joined on ``order``, which is unique; rows whose pointer is final leave the join;
* the removal is a left-anti join on each key; the kept side has at most one row per key, and AQE's
  skew-join split handles a hot key on the large side.
Exact duplicates of the whole key tuple are collapsed first (again a partial aggregation), so a
hot group of identical copies shrinks to one row before any round.  Lineage is cut every round by a table in the
shared checkpoint folder (executor loss cannot lose decided state).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import fixed, text as T
from newsloom.session import cut_lineage


# Number of fixpoint rounds and pointer doublings of recent calls (diagnostics only; bounded list).
LAST_ROUNDS: list[int] = []


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """D3: keep the earliest row of each key (single key)."""
    firsts = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(firsts.select(order), order, "left_semi")


def _links(u: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(order, parent): rows with no earlier row on any key (parent null), or exactly one."""
    def near(k: str) -> DataFrame:
        w = Window.partitionBy(k).orderBy(order)
        two = u.select(k, order).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
        return two.select(order, F.lag(order).over(w).alias("_parent"))
    rows = reduce(DataFrame.unionByName, map(near, keys))       # at most one row per (order, key)
    seen = rows.groupBy(order).agg(F.count(F.lit(1)).alias("_keys"), F.collect_set("_parent").alias("_parents"))
    return (seen.where((F.col("_keys") == len(keys)) & (F.size("_parents") <= 1))
            .select(order, F.get("_parents", F.lit(0)).alias("parent")))


def _chain_kept(links: DataFrame, order: str) -> tuple[DataFrame, int]:
    """The rows that the written table ``links`` decides as kept, and the number of doublings."""
    heads = links.where("parent IS NULL").select(order)
    done: list[DataFrame] = []
    open_ = chain = links.where("parent IS NOT NULL").select(order, F.col("parent").alias("root"), F.lit(1).alias("far"))
    steps = 0
    while not open_.isEmpty():
        steps += 1
        above = chain.select(F.col(order).alias("root"), F.col("root").alias("_root"), F.col("far").alias("_far"))
        moved = cut_lineage(open_.join(above, "root", "left"))
        done.append(moved.where("_far IS NULL").select(order, "root", "far"))
        open_ = moved.where("_far IS NOT NULL").select(order, F.col("_root").alias("root"), F.pmod(F.col("far") + F.col("_far"), F.lit(2)).alias("far"))
        # a pointer that is final is the last word on its row; the others are twice as long
        chain = reduce(DataFrame.unionByName, [open_, *done])
    if not done:
        return heads, steps
    even = reduce(DataFrame.unionByName, done).where("far = 0")
    return heads.unionByName(even.join(heads.select(F.col(order).alias("root")), "root", "left_semi").select(order)), steps


def greedy_dedupe_orders(df: DataFrame, keys: list[str], order: str, checkpoint_every: int = 1,
                         max_rounds: int | None = None) -> DataFrame:
    """D1 core: returns the ``order`` values of kept rows (one column DataFrame).

    ``order`` must be unique and non-null, and so must the values that stand for null keys (``greedy_dedupe`` makes them).
    """
    # Collapse identical key tuples: only the earliest copy can ever be kept.
    u = df.groupBy(*keys).agg(F.min(order).alias(order))
    u = cut_lineage(u)
    kept_parts: list[DataFrame] = []
    rnd = steps = 0
    while True:
        rnd += 1
        orders, doublings = _chain_kept(cut_lineage(_links(u, keys, order)), order)
        steps += 1 + doublings
        kept = cut_lineage(u.join(orders, order, "left_semi"))
        kept_parts.append(kept.select(order))
        rest = u.join(kept.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(kept.select(k), k, "left_anti")
        u = cut_lineage(rest) if rnd % checkpoint_every == 0 else rest
        if u.isEmpty():
            break
        if max_rounds is not None and rnd >= max_rounds:
            raise RuntimeError(f"greedy_dedupe did not converge in {max_rounds} rounds")
    LAST_ROUNDS.append(steps)
    del LAST_ROUNDS[:-100]
    return reduce(lambda a, b: a.unionByName(b), kept_parts)


def greedy_dedupe(df: DataFrame, keys: list[str], order: str, seen: dict[str, DataFrame] | None = None,
                  checkpoint_every: int = 1, materialize: bool = True) -> DataFrame:
    """D1 (+ D5 when ``seen`` maps key column -> DataFrame of already registered values; the
    "not already seen" test is J4, one left-anti join per key).

    Rows whose key is already registered in ``seen`` are dropped first (they come after the
    existing corpus); the remaining rows are deduplicated greedily.  Returns the kept rows.
    With ``materialize`` the input is checkpointed once, so its upstream work (extraction,
    cleaning) runs once for both the key rounds and the final selection of kept rows.
    """
    base = cut_lineage(df) if materialize else df
    if seen:
        for k, s in seen.items():
            base = base.join(s.select(F.col(s.columns[0]).alias(k)).where(F.col(k).isNotNull()), k, "left_anti")
    # A null key registers nothing and collides with nothing: give it a value unique to the row.
    keyed = base.select(order, *[
        F.coalesce(F.col(k).cast("string"), F.concat(F.lit("\u0000"), F.col(order).cast("string"))).alias(k)
        for k in keys])
    kept = greedy_dedupe_orders(keyed, keys, order, checkpoint_every)
    return base.join(kept, order, "left_semi")


def order_column(*cols) -> Column:
    """A single sortable order value from (priority, file, line)-like parts."""
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])


def ban_reason(text: str = "text", authors: str = "authors") -> Column:
    """F13 + F14 (null = not banned)."""
    return (F.when(T.gallery_count(text) > fixed.MAX_GALLERY_MATCHES, "gallery")
            .when(F.array_join(F.col(authors), " ") == fixed.BANNED_AUTHOR_LINE, "author_line"))


def ban_rows(df: DataFrame, text: str = "text", authors: str = "authors", keep_rejects: bool = False) -> DataFrame:
    out = df.withColumn("ban_reason", ban_reason(text, authors))
    return out if keep_rejects else out.filter(F.col("ban_reason").isNull()).drop("ban_reason")


def seen_keys(kept: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Key tables registered by an existing kept corpus (input of the incremental form)."""
    return {k: kept.select(k).where(F.col(k).isNotNull()).distinct() for k in keys}


def mark_seen(df: DataFrame, key: str, registered: DataFrame, registered_key: str, name: str = "seen") -> DataFrame:
    """Adds ``name``, whether the row's key is among the registered ones; a null key never is.  The registered keys
    are made distinct first, so the join adds no rows and a key of many rows is split on the side of ``df`` alone."""
    keys = (registered.select(F.col(registered_key).alias("_seen_key")).where(F.col("_seen_key").isNotNull()).distinct()
            .withColumn("_hit", F.lit(True)))
    return (df.join(keys, df[key] == F.col("_seen_key"), "left")
            .withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_seen_key", "_hit"))
