"""Tokenizer-based operators against the library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import packing, token_counts, token_files, tokens
from tests.conftest import SF_SMALL

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "\na b\n", "it's  we'll\t don't", "x\r\ny", "café éa ́b",
       "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>\n b", "a<|endoftext|>b", "  a  b", "\x1c a\x1db", "AİΣ ẞ",
       "1 23 4a5", "!!? ... ''s", "你好 世界", "​ a​ b", "a\x85b \x85 c", "  lead", "trail  ", "\t\ttab", "<|startoftext|> hi",
       "word " * 3000, "a᠎b ﻿ c", "\U0001f600 \U0001f600\n\U0001f600"]


def random_texts(n=400, seed=5):
    rng = np.random.default_rng(seed)
    parts = ["a", "the", "Hi", " ", "  ", "\n", "\t", "'s", "'ll", "1", "99", "!", "...", "é", "́", " ", "<|endoftext|>", "\r", "\x1f", " ", "#", "\U0001f600"]
    return ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_ids_of_the_whole_text(path):
    texts = [t or "" for t in ODD] + random_texts()
    library = Tokenizer.from_file(path)
    got = tokens.Encoder(path).encode(texts)
    for t, x in zip(texts, got):
        assert np.frombuffer(x, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def _docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "start": F.lit("x")})


def test_counts(spark):
    library = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, token_counts.token_counts(_docs(spark), BYTE, head=3).collect()), key=repr)
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids))
            for r in _docs(spark).select("doc_id", "text").collect()]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(_docs(spark).limit(0), BYTE).collect() == []


def test_files_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(BYTE)
    manifest = token_files.write_token_files(_docs(spark), str(tmp_path / "t"), BYTE)
    got = sorted(map(tuple, token_files.read_digests(spark, str(tmp_path / "t"), manifest).collect()), key=lambda r: r[1])
    rows = _docs(spark).select("doc_id", "text").collect()
    ids = [(r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")) for r in rows]
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids if i is not None)
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda i: -1 if i is None else i)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    shard = manifest["shards"][0]["file"]
    doc, first = token_files.read_document(str(tmp_path / "t"), shard, 1)
    assert doc == got[1][0] and zlib.crc32(first.tobytes()) == got[1][3]
    empty = token_files.write_token_files(_docs(spark).limit(0), str(tmp_path / "e"), BYTE)
    assert empty["shards"] == [] and token_files.read_digests(spark, str(tmp_path / "e"), empty).collect() == []


def _check_packing(rows, size):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= size
    return sum(n for p in seqs.values() for _, n in p) / (size * len(seqs))


def test_packing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(docs, WORD).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids = np.array(library.encode(d.text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert _check_packing(rows, 2048) > 0.97
    odd = packing.pack(_docs(spark), WORD, size=64).collect()
    _check_packing(odd, 64)
    assert len({(r.doc_id, r.doc_tokens) for r in odd}) == _docs(spark).count()
    assert packing.pack(_docs(spark).limit(0), WORD).collect() == []


def test_rounded_patterns_stay_near_the_linear_program():
    rng = np.random.default_rng(1)
    hist = {int(k): int(n) for k, n in zip(range(1, 65), rng.integers(50, 500, 64))}
    used = packing.plan(hist, 64)
    total = {}
    for counts, times in used:
        assert sum(k * c for k, c in counts.items()) <= 64
        for k, c in counts.items():
            total[k] = total.get(k, 0) + c * times
    assert total == hist
    weight = np.array(sorted(hist, reverse=True))
    bound = sum(x for _, x in packing.column_generation(weight, np.array([hist[k] for k in weight], float), 64))
    assert bound * 64 >= sum(k * n for k, n in hist.items()) - 1e-6
    assert sum(t for _, t in used) <= 1.005 * bound + 5


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_joined_pieces_have_the_ids_of_single_pieces(path):
    own = tokens.Encoder(path)
    pieces = [f"{own.border}x{k}" if k % 150 == 7 else f"Q{k}'s" if k % 3 else f" é{k}<|" for k in range(700)] + ["", own.border]
    assert own.border and own.pieces(pieces) == own.batch(pieces) and own.pieces([]) == []
