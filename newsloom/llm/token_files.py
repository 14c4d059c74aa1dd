"""Token-id files: each document's ids compressed on their own with a shared zstandard dictionary.

A folder holds ``dictionary.zstd``, ``manifest.json`` and shards in ascending document order.  A shard is

    magic 8 bytes | dictionary sha256 32 bytes | frame | frame | ...            one zstd frame per document
    index: per document  id i64, offset u64, bytes u32, ids u32 (little-endian)
    footer: documents u64, ids u64, offset of the index u64, id width u64, magic 8 bytes

so one document is read with two short reads (``read_document``).  The dictionary is trained on a bounded
sample of serialized id arrays (SAMPLE_DOCS, SAMPLE_BYTES) and only shapes compression.  Frames are written once
as a table, ranged by document id and streamed into shards; a shard appears by a rename, and a repeated task replaces
it with the same bytes.  The driver handles one row per shard.  Folders without a scheme lie on Hadoop's default file
system (``qualified``); tasks get the full URI.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch, checkpoint_dir, cut_lineage, id_and_text, map_arrow, pylist, qualified, slices, table
from newsloom.llm.tokens import encoder

MAGIC = b"NLIDSEQ1"
INDEX = np.dtype([("id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
NULL_ID = -2**63              # index entry of a null document id
DICTIONARY_BYTES = 65_536
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 8 * DICTIONARY_BYTES * 10
SHARD_BYTES = 16 << 20
LEVEL = 3


def file_system(uri: str):
    """(pyarrow file system, path) of a folder's full URI; a bare path is local (see ``qualified``)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def publish(store, draft: str, target: str) -> None:
    """Renames a finished draft; where the store refuses an existing target (a repeated task), that one goes first."""
    from pyarrow import fs
    try:
        store.move(draft, target)
    except OSError:
        if store.get_file_info(target).type != fs.FileType.File:
            raise
        store.delete_file(target)
        store.move(draft, target)


def width_of(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 65_536 else "<u4"


def train_dictionary(data: DataFrame, path: str, end_id: int, kind: str) -> bytes:
    """Dictionary trained on the id arrays of a bounded sample of documents, chosen by a hash of the id."""
    import zstandard
    rows = data.count()
    share = 2**20 if rows <= SAMPLE_DOCS else max(1, int(2**20 * 1.5 * SAMPLE_DOCS / rows))
    chosen = data.where(F.pmod(F.xxhash64(F.col(data.columns[0])), F.lit(2**20)) < share).limit(SAMPLE_DOCS)
    picked = pa.schema([("ids", pa.binary())])

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, room = encoder(path), SAMPLE_BYTES
        for b in slices(batches, 200):
            out = []
            for x in own.encode([d.decode("utf-8", "replace") for d in pylist(b, "data")]):
                ids = np.append(np.frombuffer(x, "<u4"), end_id).astype(kind).tobytes()
                if ids and room > 0:
                    out.append(ids[:room])
                    room -= len(ids)
            yield batch(picked, {"ids": out})

    samples = [bytes(r["ids"]) for r in map_arrow(chosen, ids_of, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:       # too little to train on: the sample itself serves as raw content
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(content: bytes):
    import zstandard
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


def frames(data: DataFrame, path: str, end_id: int, kind: str, dictionary: bytes) -> DataFrame:
    """(doc_id, n, frame): the compressed ids of every document, with the end id."""
    import zstandard
    shared = data.sparkSession.sparkContext.broadcast(dictionary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_checksum=True)
        end = np.array([end_id], kind).tobytes()
        for b in slices(batches, 200):
            ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end
                   for x in own.encode([d.decode("utf-8", "replace") for d in pylist(b, "data")])]
            size = np.dtype(kind).itemsize
            yield batch(schema, {"doc_id": b.column(0), "n": [len(x) // size for x in ids], "frame": [pack.compress(x) for x in ids]})

    return map_arrow(data, run, "doc_id long, n long, frame binary")


def write_shards(encoded: DataFrame, folder: str, dictionary: bytes, kind: str) -> list[tuple[str, int, int]]:
    """Writes the shards; (file, documents, ids) of each, in document order."""
    digest = hashlib.sha256(dictionary).digest()
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        store, root = file_system(folder)
        name = f"shard-{shard:06d}.ids"
        draft = posixpath.join(root, f"_draft-{name}-{uuid.uuid4().hex}")
        index, at, out = [], len(MAGIC) + len(digest), None
        for b in batches:
            if out is None and b.num_rows:
                out = store.open_output_stream(draft)
                out.write(MAGIC + digest)
            for i, n, frame in zip(pylist(b, "doc_id"), pylist(b, "n"), pylist(b, "frame")):
                out.write(frame)
                index.append((NULL_ID if i is None else i, at, len(frame), n))
                at += len(frame)
        if out is None:
            return
        total = sum(x[3] for x in index)
        out.write(np.array(index, INDEX).tobytes() + np.array([len(index), total, at, width], "<u8").tobytes() + MAGIC)
        out.close()
        publish(store, draft, posixpath.join(root, name))
        yield batch(schema, {"shard": [shard], "file": [name], "docs": [len(index)], "ids": [total]})

    size = encoded.agg(F.sum(F.length("frame")).alias("b")).first()["b"] or 0
    order = ["doc_id", "n", "frame"]
    ranged = encoded.repartitionByRange(max(1, -(-size // SHARD_BYTES)), *order[:2], F.crc32("frame")).sortWithinPartitions(*order)
    done = map_arrow(ranged, run, "shard int, file string, docs long, ids long").collect()
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(done, key=lambda r: r["shard"])]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text") -> dict:
    """Encodes every document and writes dictionary, shards and manifest into a shared folder; the manifest.

    Null or empty texts are the end id alone; rows are in ascending (doc_id, length, content) order, null ids first;
    repeated rows are each written; an empty table gives a manifest without shards; a very long text is one frame.
    The index holds a null id as -2**63, so a document of that id is read back with a null one.
    """
    from tokenizers import Tokenizer
    folder = qualified(docs.sparkSession, folder)
    data = id_and_text(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    kind = width_of(max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1))
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    dictionary = train_dictionary(data, path, end_id, kind)
    with store.open_output_stream(posixpath.join(root, "dictionary.zstd")) as f:
        f.write(dictionary)
    encoded = cut_lineage(frames(data, path, end_id, kind, dictionary))
    shards, start, first = [], 0, 0
    for name, n_docs, n_ids in write_shards(encoded, folder, dictionary, kind):
        shards.append({"file": name, "documents": n_docs, "ids": n_ids, "start": start, "first_document": first})
        start, first = start + n_ids, first + n_docs
    manifest = {"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "end_id": end_id, "shards": shards}
    with store.open_output_stream(posixpath.join(root, "manifest.json")) as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _open(store, file: str, digest: str):
    """(file, index, dtype of ids) of a shard; refuses another dictionary."""
    f = store.open_input_file(file)
    head = f.read(len(MAGIC) + 32)
    f.seek(f.size() - 32 - len(MAGIC))
    foot = f.read()
    if head[:len(MAGIC)] != MAGIC or foot[32:] != MAGIC or head[len(MAGIC):].hex() != digest:
        raise ValueError(f"{file} is no shard of this dictionary")
    n, _, at, width = map(int, np.frombuffer(foot[:32], "<u8"))
    f.seek(at)
    return f, np.frombuffer(f.read(n * INDEX.itemsize), INDEX), f"<u{width}"


def read_dictionary(store, root: str, digest: str):
    with store.open_input_file(posixpath.join(root, "dictionary.zstd")) as f:
        content = f.read()
    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError("the dictionary isn't the manifest's")
    return _dictionary(content)


def read_document(folder: str, shard: str, position: int) -> tuple[int, np.ndarray]:
    """(doc_id, ids) of one document, by its shard and place there: reads the index and that frame only."""
    import zstandard
    store, root = file_system(folder)
    with store.open_input_file(posixpath.join(root, "manifest.json")) as f:
        manifest = json.loads(f.read())
    f, index, kind = _open(store, posixpath.join(root, shard), manifest["dictionary_sha256"])
    with f:
        e = index[position]
        f.seek(int(e["offset"]))
        unpack = zstandard.ZstdDecompressor(dict_data=read_dictionary(store, root, manifest["dictionary_sha256"]))
        return int(e["id"]), np.frombuffer(unpack.decompress(f.read(int(e["bytes"]))), kind).astype("<u4")


def read_digests(spark, folder: str, manifest: dict) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the shards, one task per shard."""
    import zstandard
    folder = qualified(spark, folder)
    digest = manifest["dictionary_sha256"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    listed = spark.createDataFrame([(s["file"], s["start"]) for s in manifest["shards"]], "file string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        unpack = None
        for b in batches:
            for name, start in zip(pylist(b, "file"), pylist(b, "start")):
                unpack = unpack or zstandard.ZstdDecompressor(dict_data=read_dictionary(store, root, digest))
                f, index, kind = _open(store, posixpath.join(root, name), digest)
                starts = start + np.concatenate([[0], np.cumsum(index["ids"].astype(np.int64))])
                with f:
                    for k in range(0, len(index), 2000):
                        part = index[k:k + 2000]
                        base = int(part["offset"][0])
                        f.seek(base)
                        blob = f.read(int(part["offset"][-1]) + int(part["bytes"][-1]) - base)
                        crc, n = [], []
                        for e in part:
                            at = int(e["offset"]) - base
                            ids = np.frombuffer(unpack.decompress(blob[at:at + int(e["bytes"])]), kind).astype("<u4")
                            crc.append(zlib.crc32(ids.tobytes()))
                            n.append(len(ids))
                        yield batch(schema, {"doc_id": [None if i == NULL_ID else int(i) for i in part["id"]],
                                             "start": starts[k:k + len(part)], "n_tokens": n, "ids_crc32": crc})

    return map_arrow(listed.repartition(max(1, len(manifest["shards"]))), run,
                     "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir):
    """Token-id files of all documents, written in document order and read back (see module)."""
    import public_tokenizers
    folder = f"{checkpoint_dir(spark)}/token_files/{uuid.uuid4().hex}"
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder, manifest)


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
