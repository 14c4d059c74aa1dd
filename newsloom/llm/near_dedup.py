"""Near-duplicate detection with SetSketch registers.

A document is the set of its distinct five-word shingles (64-bit hashes).  Its SetSketch has M registers
``K_i = floor(1 - log_b(min_x h_i(x)))`` clipped to 16 bits, where ``h_i`` is exponentially distributed with
rate A: the sketch of a union is the register-wise maximum, and equal registers are likely for similar sets.

1. sketch: one narrow pass; documents with the same set collapse to a class (smallest doc_id represents it);
2. band: four 16-bit registers make one 64-bit band key, 32 bands; only keys of two classes or more go on.
   At similarity 0.75 a pair misses all bands with probability (1 - 0.75^4)^32 = 5e-6;
3. star: in each bucket the class that shares most buckets is the hub; every other member is linked to the hubs
   of its buckets only (no pairs within a bucket), the joint likelihood estimate of the similarity drops
   hopeless links, and the full sets confirm the rest;
4. rest: in buckets whose members but the hub are still in different components, the members outside the bucket's largest
   component are compared with all members, in tiles of at most 2 x TILE of them (so a bucket of any size is spread
   over many tasks), again by likelihood and then full sets; members of the largest component are linked already and
   need no comparison with each other; a tile returns a spanning forest of its confirmed links, never all pairs;
5. components: alternating large-star / small-star rounds on the confirmed links, each round written to the
   shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import (batch, cut_lineage, id_and_text, map_arrow, pylist,
                                 slices, space_words, table, window_hashes, word_hashes)

WORDS = 5
THRESHOLD = (75, 100)       # links: 100 * |A and B| >= 75 * |A or B|
REGISTERS = 128
BAND_ROWS = 4               # registers of 16 bits in one 64-bit band key
BASE, RATE = 1.001, 20.0    # register base b and rate a of the exponential hashes
TOP = 65535                 # largest register value (16 bits)
MARGIN = 0.2                # an estimate this far below the threshold (over 5 standard errors) drops a link
TILE = 256                  # members on each side of a tile in the complete comparison

_RNG = np.random.default_rng(20240601)
_MULTIPLY = (_RNG.integers(1, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]


def shingle_set(data: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (A-Z lower-cased, words of non-white space)."""
    return np.unique(window_hashes(word_hashes(space_words(data.lower())), k))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set.  ``h_i`` is monotone in a uniform 32-bit hash, so the minimum of the
    uniform hashes is taken first and transformed once per register."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 4096):
        low = np.minimum(low, (x[None, k:k + 4096] * _MULTIPLY + _ADD).min(axis=1))
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketch rows a, b with known set sizes: joint likelihood of the
    numbers of larger, smaller and equal registers, maximised by golden-section search (it is concave)."""
    larger = (a > b).sum(axis=1)
    smaller = (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fc, fd = likelihood(c), likelihood(d)
    for _ in range(24):
        left = fc >= fd
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        fc, fd = likelihood(c), likelihood(d)
    return (lo + hi) / 2


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on the full sets (sorted distinct arrays)."""
    num, den = THRESHOLD
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_hash binary or null, sketch binary or null, bands array<long>)."""
    import hashlib
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()),
                        ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            n, key, sketch, bands = [], [], [], []
            for data in pylist(b, "data"):
                s = shingle_set(data)
                n.append(len(s))
                if len(s):
                    r = registers(s)
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketch.append(r.tobytes())
                    bands.append(r.view(np.int64))
                else:
                    key.append(None)
                    sketch.append(None)
                    bands.append([])
            yield batch(schema, {"doc_id": b.column(0), "n_shingles": n, "set_hash": key, "sketch": sketch, "bands": bands})

    return map_arrow(id_and_text(docs, id_col, text_col), run,
                     "doc_id long, n_shingles long, set_hash binary, sketch binary, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, set binary) for the listed document ids; repeated rows of an id give one row."""
    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).join(
        ids.select(F.col("rep").alias(id_col)), id_col, "left_semi")
    schema = pa.schema([("rep", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            yield batch(schema, {"rep": b.column(0), "set": [shingle_set(x).tobytes() for x in pylist(b, "data")]})

    return map_arrow(id_and_text(chosen, id_col, text_col), run, "rep long, set binary")


def _matrix(col: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(len(col), REGISTERS)


def star_links(classes: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) among candidate pairs: likelihood estimate, then full sets."""
    num, den = THRESHOLD
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    drawn = (pairs.join(one, "a").join(two, "b")
             .where((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)))
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            j = estimate(_matrix(pylist(b, "s_a")), _matrix(pylist(b, "s_b")),
                         np.array(pylist(b, "n_a"), float), np.array(pylist(b, "n_b"), float))
            keep = pa.array(j >= num / den - MARGIN)
            yield batch(kind, {"a": b.column(b.schema.get_field_index("a")).filter(keep),
                               "b": b.column(b.schema.get_field_index("b")).filter(keep)})

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            x, y = pylist(b, "x"), pylist(b, "y")
            keep = pa.array([similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)], pa.bool_())
            yield batch(kind, {"a": b.column(b.schema.get_field_index("a")).filter(keep),
                               "b": b.column(b.schema.get_field_index("b")).filter(keep)})

    candidates = map_arrow(drawn.select("a", "b", "n_a", "n_b", "s_a", "s_b"), likely, "a long, b long")
    full = (candidates.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b"))
    return map_arrow(full.select("a", "b", "x", "y"), confirmed, "a long, b long")


def tile_links(left: list[int], right: list[int], comp: dict[int, int], size: dict[int, int], sketch: dict[int, np.ndarray],
               sets: dict[int, np.ndarray], inner: bool, band: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the confirmed links between two lists of members (one list, if inner).  With ``band``, a pair
    is compared only in the first band that it shares, so each pair is compared once over all buckets."""
    num, den = THRESHOLD
    least = num / den - MARGIN
    labels = {c: k for k, c in enumerate(sorted({comp[i] for i in (*left, *right)}))}
    own = np.array([labels[comp[i]] for i in left])
    theirs = own if inner else np.array([labels[comp[j]] for j in right])      # one array, if inner: merged together
    rows = np.array([sketch[j] for j in right])
    sizes = np.array([size[j] for j in right], float)
    found = []
    for k, i in enumerate(left):
        n = float(size[i])
        open_ = (theirs != own[k]) & (den * np.minimum(sizes, n) >= num * np.maximum(sizes, n))
        if inner:
            open_[:k + 1] = False
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        equal = rows[others] == sketch[i]
        likely = equal.sum(axis=1) >= least * REGISTERS
        if band is not None:
            likely &= equal.reshape(len(others), -1, BAND_ROWS).all(axis=2).argmax(axis=1) == band
        others = others[likely]
        if not len(others):
            continue
        j = estimate(np.broadcast_to(sketch[i], (len(others), REGISTERS)), rows[others], np.full(len(others), n), sizes[others])
        for o in others[np.argsort(-j, kind="stable")][:int((j >= least).sum())]:
            if theirs[o] != own[k] and similar(sets[i], sets[right[o]]):
                gone, stays = theirs[o], own[k]
                own[own == gone] = stays
                theirs[theirs == gone] = stays
                found.append((i, right[o]))
    return found


def rest_links(buckets: DataFrame, hubs: DataFrame, comp: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links between different components inside the buckets that hold several, by tiles.  A bucket's hub was
    compared with all its members before and takes no part here."""
    placed = (buckets.join(hubs, ["band", "key"]).where("rep <> hub").join(comp, F.col("rep") == F.col("node"), "left")
              .select("band", "key", "rep", F.coalesce("root", "rep").alias("root")))
    # per bucket its largest component (main) and how many members lie in it and outside of it
    parts = placed.groupBy("band", "key", "root").agg(F.count("*").alias("c"))
    open_ = (parts.groupBy("band", "key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("c"))
             .select("band", "key", F.col("main.root").alias("main"), F.col("main.c").alias("inside"), (F.col("c") - F.col("main.c")).alias("outside"))
             .where("outside > 0"))
    # blocks 0 .. mb - 1 hold the members outside, the next mg blocks those inside; an outside block meets every block
    members = (placed.join(open_, ["band", "key"]).withColumn("mb", F.ceil(F.col("outside") / TILE).cast("int"))
               .withColumn("mg", F.ceil(F.col("inside") / TILE).cast("int")))
    inside, mixed = F.col("root") == F.col("main"), F.xxhash64("rep")
    dealt = (members
             .withColumn("blk", F.when(inside, F.col("mb") + F.pmod(mixed, F.col("mg"))).otherwise(F.pmod(mixed, F.col("mb"))).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("mb") - 1 + F.when(inside, 0).otherwise(F.col("mg")))))
             .select("band", "key", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "rep", "root"))
    full = dealt.join(classes.select("rep", "n", "sketch"), "rep").join(sets, "rep")

    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tile(rows: pa.Table) -> list[tuple[int, int]]:
        ids, blk = rows["rep"].to_pylist(), rows["blk"].to_pylist()
        band, p, q = (rows[c][0].as_py() for c in ("band", "p", "q"))
        left, right = (sorted({i for i, at in zip(ids, blk) if at == side}) for side in (p, q))
        return tile_links(left, right, dict(zip(ids, rows["root"].to_pylist())), dict(zip(ids, rows["n"].to_pylist())),
                          {i: np.frombuffer(x, np.uint16) for i, x in zip(ids, rows["sketch"].to_pylist())},
                          {i: np.frombuffer(x.as_buffer(), np.uint64) for i, x in zip(ids, rows["set"])}, p == q, band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted rows, so a tile's rows follow each other; the last tile of a batch may go on in the next batch
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            if not rows.num_rows:
                continue
            keys = [rows[c].to_numpy() for c in ("band", "key", "p", "q")]
            starts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()]
            found = [x for lo, hi in zip(starts, starts[1:]) for x in tile(rows.slice(lo, hi - lo))]
            held = rows.slice(starts[-1])
            yield batch(kind, {"a": [x for x, _ in found], "b": [y for _, y in found]})
        if held is not None:
            found = tile(held)
            yield batch(kind, {"a": [x for x, _ in found], "b": [y for _, y in found]})

    keys = ["band", "key", "p", "q"]
    return map_arrow(full.select(*keys, "blk", "rep", "root", "n", "sketch", "set").repartition(*keys).sortWithinPartitions(*keys),
                     run, "a long, b long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a")
    return (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node and the smallest node of its component.  Each round is written to the
    shared checkpoint folder; rounds end when a round changes nothing (their number is logarithmic)."""
    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    while before[0]:
        e = cut_lineage(_small_star(_large_star(e)))
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    Defined cases: null or empty texts and texts without words have no shingles and are linked with nothing;
    fewer than five words are one shingle; documents with the same set are one class, however many; repeated rows
    of an id share its component (with different texts under one id, the texts' components join); a null doc_id
    is linked with nothing and kept, with a null component_id.  The id of a component is its smallest doc_id.
    """
    s = cut_lineage(sketches(docs, id_col, text_col))
    # sketch and bands are functions of the set, so any row of a class serves
    classes = cut_lineage(s.where("set_hash is not null and doc_id is not null").groupBy("set_hash")
                          .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
                               F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    bands = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    several = bands.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = cut_lineage(bands.join(several, ["band", "key"]))
    degree = buckets.groupBy("rep").agg(F.sum("c").alias("degree"))
    hubs = cut_lineage(buckets.join(degree, "rep").groupBy("band", "key")
                       .agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("h"))
                       .select("band", "key", (-F.col("h.r")).alias("hub")))
    pairs = (buckets.join(hubs, ["band", "key"]).where("rep <> hub")
             .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    sets = cut_lineage(shingle_sets(docs, degree.select("rep"), id_col, text_col).join(
        classes.select("rep", "set_hash"), "rep").groupBy("rep").agg(F.first("set").alias("set")))
    links = cut_lineage(star_links(classes, pairs, sets))
    rest = rest_links(buckets, hubs, components(links), classes, sets)
    roots = components(links.union(rest))
    # smallest id per set: a document whose id also names another class joins through its own class
    of_set = (classes.join(roots, F.col("rep") == F.col("node"), "left")
              .select("set_hash", F.coalesce("root", "rep").alias("component_id")))
    return (s.select("doc_id", "n_shingles", "set_hash").join(of_set, "set_hash", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def op10_near_dedup(spark, sf_dir):
    """Near-duplicate components of all documents by SetSketch (see module)."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM docs UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node),
comp AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES = {"op10_near_dedup": OP10_SQL}
