"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

* features of a text: hashed words, hashed word shapes (cases, digits and symbols by kind) and repeats, as
  square-root term frequencies weighted by inverse document frequency; DIM buckets in all;
* fit: a bounded sample of labelled training rows (FIT_ROWS, as many of either label as there are, chosen by a hash
  of the id) gives the frequencies and, by a randomised singular value decomposition, a projection to RANK latent
  dimensions.  The sample's unit vectors, labels and weights are the model: FIT_ROWS x RANK numbers, broadcast;
* score: every document's unit vector is multiplied with the labelled vectors block by block (exact cosines); its
  NEAREST neighbours vote with weight similarity^POWER, corrected for the sample's label balance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch, crc_mod, id_and_text, map_arrow, pylist, slices, space_words, table

FIT_ROWS = 4_000
DIM = 2_048
WORD_BUCKETS = 1_024      # buckets of words; the rest hold shapes and text statistics
RANK = 48
NEAREST = 25
POWER = 4.0
HELD_OUT = 5
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_KIND = np.full(256, 3, np.uint8)                       # other ASCII
_KIND[ord("a"):ord("z") + 1] = 0
_KIND[128:] = 0
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("0"):ord("9") + 1] = 2
_SHAPE = bytes(c if k == 3 else b"aA0"[k] for c, k in enumerate(_KIND.tolist()))


class _Buckets(dict):
    """word -> (word bucket, shape bucket), remembered; emptied when full."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import re
        import zlib
        if len(self) > self.LIMIT:
            self.clear()
        shape = re.sub(rb"(.)\1+", rb"\1", word.translate(_SHAPE))
        code = (zlib.crc32(word.lower()) % WORD_BUCKETS) * DIM + WORD_BUCKETS + zlib.crc32(shape) % (DIM - WORD_BUCKETS - 16)
        self[word] = code
        return code


def features(texts: list[bytes], buckets: _Buckets) -> np.ndarray:
    """Raw feature counts, one row a text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, data in enumerate(texts):
        words = space_words(data)
        if not words:
            continue
        codes = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
        n = len(words)
        out[i] = np.bincount(codes // DIM, minlength=DIM)[:DIM] + np.bincount(codes % DIM, minlength=DIM)[:DIM]
        # statistics of the whole text, each in its own bucket on the scale of word counts
        again = (codes[1:] == codes[:-1]).mean() if n > 1 else 0.0
        letters = max(1, sum(map(len, words)))
        symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!")))
        upper = len(data) - len(data.translate(None, _UPPER))
        stats = (again, 1 - len(np.unique(codes)) / n, symbols / letters * 4, upper / letters)
        out[i, DIM - 16:DIM - 16 + len(stats)] = np.array(stats) * n * 2
    return out


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(raw) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(texts: list[bytes], labels: np.ndarray, prior: float) -> dict:
    """Latent-semantic model of the labelled sample; ``prior`` is label 1's share of all training rows."""
    raw = features(texts, _Buckets())
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + 1
    idf[DIM - 16:] = 4
    x = weighted(raw, idf)
    rng = np.random.default_rng(7)
    rank = min(RANK, *x.shape)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], rank + 8)).astype(np.float32)))[0]
    for _ in range(2):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    project = (q @ v[:rank].T).astype(np.float32)
    share = float(labels.mean()) if len(labels) else prior
    # votes are weighted so that the balanced sample speaks with the training rows' label balance
    weight = np.where(labels == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9)).astype(np.float32)
    return {"idf": idf, "project": project, "vectors": unit(x @ project), "labels": labels.astype(np.float32), "weight": weight, "prior": prior}


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def vote(model: dict, raw: np.ndarray) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors; the prior where nothing is similar."""
    if not len(model["vectors"]):
        return np.full(len(raw), model["prior"])
    y = unit(weighted(raw, model["idf"]) @ model["project"])
    cosine = y @ model["vectors"].T
    k = min(NEAREST, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    power = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** POWER * model["weight"][near]
    total = power.sum(axis=1)
    share = (power * model["labels"][near]).sum(axis=1) / np.where(total > 0, total, 1)
    return np.where(total > 0, np.clip(share, 0, 1), model["prior"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> dict:
    """Fits the model on at most ``fit_rows`` labelled rows whose id isn't held out."""
    one = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
           .groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(label_col).alias("y")).where(crc_mod("k", HELD_OUT) != 0))
    known = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("binary").alias("data"))
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    rows = []
    for y in (0, 1):
        want = min(sizes.get(y, 0), max(fit_rows // 2, fit_rows - sizes.get(1 - y, 0)))
        if want:
            # the ids of the smallest hashes, so the sample doesn't depend on partitions or retries; the share below
            # which they lie (a few more than asked for) keeps the sort small.  One text of an id: the smallest
            cut = min(2**30, int(2**30 * 1.2 * want / sizes[y]) + 1)
            place = F.pmod(F.xxhash64("k"), F.lit(2**30))
            ids = one.where((F.col("y") == y) & (place < cut)).orderBy(place, "k").select("k").limit(want)
            texts = known.join(F.broadcast(ids), "k").groupBy("k").agg(F.min("data").alias("data")).collect()
            rows += [(y, bytes(r["data"])) for r in sorted(texts, key=lambda r: r["k"])]
    return fit([d for _, d in rows], np.array([y for y, _ in rows], np.float32), prior)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             fit_rows: int = FIT_ROWS, row_col: str | None = None) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1), predicted; with ``row_col`` that column as well.

    Null, empty and wordless texts and texts similar to nothing labelled get the prior (label 1's share); several
    labels of an id count as their largest; rows without id, label or text aren't learnt from; without any label every
    score is 0.5; repeated rows are each scored, and of several texts of a labelled id the smallest is learnt from; equal
    hashes in the sample go by id; a very long text is one vector like any other.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, fit_rows))
    more = [row_col] if row_col else []
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), *((c, pa.int64()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for b in slices(batches, 256):
            yield batch(schema, {"doc_id": b.column(0), "score": vote(model.value, features(pylist(b, "data"), buckets))}
                        | {c: b.column(b.schema.get_field_index(c)) for c in more})

    scored = map_arrow(id_and_text(docs, id_col, text_col, *more), run, ", ".join(["doc_id long", "score double", *(f"{c} long" for c in more)]))
    return scored.select("doc_id", (crc_mod("doc_id", HELD_OUT) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *more)


def op2_quality_classifier(spark, sf_dir):
    """Quality scores of all documents by nearest labelled latent-semantic vectors (see module)."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLES: dict[str, str] = {}
