"""Merge tables run by tiktoken against the tokenizers library: every character they may meet, long runs, odd neighbours."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def check(path, texts):
    library = Tokenizer.from_file(path)
    got = tokens.Encoder(path).encode(texts)
    assert len(got) == len(texts)
    for t, x in zip(texts, got):
        assert np.frombuffer(x, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_both_files_take_the_fast_path():
    assert tokens.Encoder(BYTE).ranked is not None and tokens.Encoder(WORD).words is not None
    assert tokens.ranked_words(BYTE) is None and tokens.ranked(WORD) is None


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_character(path):
    own = [chr(c) for c in range(0x3000)]
    check(path, [form.format(c=c) for c in own for form in ("{c}", "a{c}b", "A {c} 1{c}{c}'S")])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_and_random(path):
    rng = np.random.default_rng(3)
    parts = ["a", "The", "zq", " ", "  ", "\n", "'s", "'LL", "7", "!", "..", "É", "́", "ß", "ª", "²", "İ", "\x01", "\x02",
             "<|endoftext|>", "<|start", "\x85", "\xa0", "你", "漢", "\U0001f600", "_", "-"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(2000)]
    letters = list("abcdefghijklmnopqrstuvwxyzäöüéèñ")
    texts += [" ".join("".join(rng.choice(letters, rng.integers(1, 25))) for _ in range(200)) for _ in range(50)]
    check(path, [*texts, "ab" * 50_000, "x" + " " * 200_000 + "y", "!" * 20_000, "word " * 60_000, ""])


def test_white_space_that_ends_the_fast_path():
    # the pattern engine overflows on such texts, so the library reads them
    text = "a" + " " * 3_000_000 + "b"
    assert not tokens.safe(text) and tokens.safe("a b " * 50_000)
    check(BYTE, [text])


def test_repeated_shard_replaces_the_first(tmp_path):
    from newsloom.llm import token_files
    store, root = token_files.file_system(tmp_path.as_uri())
    for text in (b"one", b"two"):
        (tmp_path / "draft").write_bytes(text)
        token_files.publish(store, f"{root}/draft", f"{root}/shard")
    assert (tmp_path / "shard").read_bytes() == b"two" and not (tmp_path / "draft").exists()


def test_bare_folders_lie_on_the_default_file_system(spark, tmp_path):
    from newsloom.llm.common import qualified
    assert qualified(spark, str(tmp_path)) == tmp_path.as_uri()
    assert qualified(spark, tmp_path.as_uri()) == tmp_path.as_uri()
