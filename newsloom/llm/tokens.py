"""Ids of whole texts by the tokenizers library, remembering the ids of each distinct piece.

A text is cut at white space into pieces whose ids don't depend on their neighbours, and each distinct piece is
encoded by the library once per worker and cache filling.  Which cuts are safe follows from the tokenizer file:

* ``byte``: byte-level pre-tokenizer with its own pattern and no normalizer.  A single space belongs to the word
  after it; a line break between two words stands alone.  Texts with any other white space are cut by SPLIT, which
  splits white space exactly as the pattern does; added tokens are cut out first there, as the library does;
* ``word``: white space is dropped by the pre-tokenizer, so every run between spaces is a piece;
* ``whole``: anything else is encoded as a whole.

Where the file is a plain merge table with ids in merge order (``ranked``, ``ranked_words``), tiktoken runs the same
merges over the file's own vocabulary in a fraction of the time.  Texts outside ``safe`` (``byte``) or ``_PLAIN``
(``word``), and those with an added token's string, are cut into pieces; of these the new ones in ``_PLAIN`` are encoded
likewise and all others by the library.
"""

from __future__ import annotations

import array
import json
import re
import unicodedata

import numpy as np

from newsloom.functions.fixed import PRETOKEN_PATTERN, byte_table

# white space of the library's patterns (Unicode White_Space)
_SPACE = "\t-\r \x85\xa0  -     　"
SPLIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_RARE = re.compile(f"[{_SPACE.replace(' ', '', 1).replace(chr(9) + '-' + chr(13), chr(9) + chr(11) + '-' + chr(13))}]")
JOINED = 64          # pieces encoded in one call, an added token between them
_HIGH = re.compile("[^\x00-\u2fff]")
_RUN = re.compile(r"\s{1000}")
# unchanged by NFC, lower case below LIMIT, and without the marks END and NEXT
LIMIT = 0x300
_PLAIN = re.compile("[\t\n\r\x20-\u012f\u0131-\u0239]*\\Z")
END, NEXT = "\x01", "\x02"                      # the end of a word; a word of its own between two pieces
CACHE = 600_000      # pieces in a generation of a worker's cache; two generations are kept


def mode_of(path: str) -> tuple[str, list[str]]:
    """How texts may be cut for a tokenizer file, and the strings of its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens") or []]
    pre = spec.get("pre_tokenizer") or {}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or []):
        return "whole", added
    if not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte", added
    steps = pre.get("pretokenizers") or [pre]
    norms = (spec.get("normalizer") or {}).get("normalizers") or []
    if (steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
            and any(n.get("type") == "Replace" and n.get("content") == " " for n in norms)):
        return "word", added
    return "whole", added


def border(path: str) -> str | None:
    """A special token to stand between pieces: the library cuts it out before anything else, so the ids of what lies
    between two of them are those of the piece alone.  None if every token overlaps itself or another."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec.get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in tokens):
        return None
    strings = [t["content"] for t in tokens]
    for t in tokens:
        own = t["content"]
        if t.get("special") and (not t.get("normalized") or not spec.get("normalizer")) and not any(
                x != own and (x in own or own in x) or any(x.endswith(own[:k]) or own.endswith(x[:k]) for k in range(1, min(len(x), len(own))))
                for x in strings):
            return own
    return None


def ranked(path: str):
    """The file's vocabulary as a tiktoken encoding, or None if its ids aren't those of its merge order."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = {t["content"] for t in spec.get("added_tokens") or []}
    names = sorted((k, n) for n, k in model["vocab"].items() if n not in added)
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if (model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex")
            or pre.get("add_prefix_space") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
            or model.get("end_of_word_suffix") or [n for _, n in names][256:] != merged or any(len(n) > 1 for _, n in names[:256])):
        return None
    back = {c: b for b, c in enumerate(byte_table())}
    return tiktoken.Encoding("file", pat_str=PRETOKEN_PATTERN, mergeable_ranks={bytes(back[c] for c in n): k for k, n in names},
                             special_tokens={})


def safe(text: str) -> bool:
    """Whether tiktoken may encode a text: characters below U+3000, which the tests compare with the library, and no
    white space so long that its pattern engine runs out of stack."""
    return not _HIGH.search(text) and (len(text) <= 100_000 or not _RUN.search(text))


def ranked_words(path: str):
    """(pattern of words, tiktoken encoding of words that end with END), or None if the file isn't a merge table over
    words with a suffix on the last byte and ids in merge order, NFC and lower-casing before it."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    suffix = model.get("end_of_word_suffix")
    added = {t["content"] for t in spec.get("added_tokens") or []}
    names = [n for _, n in sorted((k, n) for n, k in model["vocab"].items() if n not in added)]
    single = byte_table()
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges") or []]
    if (mode_of(path)[0] != "word" or kinds != ["NFC", "Replace", "Lowercase"] or not suffix or model["type"] != "BPE"
            or model.get("ignore_merges") or sorted(names[:256]) != sorted(single)
            or names[256:512] != [n + suffix for n in names[:256]] or names[512:] != merged):
        return None
    back = {c: b for b, c in enumerate(single)}
    ranks = {}
    for k, n in ((model["vocab"][n], n) for n in names):
        stem = n[:-len(suffix)] if n.endswith(suffix) and n != suffix else n
        ranks[bytes(back[c] for c in stem) + (END.encode() if stem != n else b"")] = k
    if len(ranks) != len(names):
        return None
    # the classes of letters and numbers, as far as _PLAIN goes
    words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    for kind in "LN":
        own = "".join(re.escape(chr(c)) for c in range(LIMIT) if unicodedata.category(chr(c))[0] == kind)
        words = words.replace(rf"\p{{{kind}}}", own)
    if r"\p" in words:
        return None
    return (re.compile(words),
            tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={}))


class Splitter:
    """``keys(text)``: the text's pieces as cache keys, and how many leading ids to drop."""

    def __init__(self, path: str):
        self.mode, added = mode_of(path)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def keys(self, text: str) -> tuple[list[str], int]:
        if self.mode == "word":
            return text.replace("\n", " ").split(" "), 0
        if self.mode == "whole":
            return [text], 0
        if not text:
            return [], 0
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        if "" not in pieces and "\n" not in pieces and not _RARE.search(text):
            return pieces, 1          # the first piece carries a line break of its own: one id
        parts = self.added.split(text) if self.added else [text]
        return [" " + chunk for k, part in enumerate(parts) if part for chunk in ([part] if k % 2 else SPLIT.findall(part))], 0

    def text_of(self, key: str) -> str:
        """The text whose ids a key stands for."""
        if self.mode != "byte":
            return key
        return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key


class Encoder:
    """``encode(texts)``: little-endian unsigned 32-bit ids of each text, without added begin or end tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = Splitter(path)
        self.border = border(path)
        self.ranked = ranked(path) if self.splitter.mode == "byte" else None
        self.words = ranked_words(path) if self.splitter.mode == "word" else None
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}      # the generation before: pieces used again move on

    def batch(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in got]

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of every piece, JOINED pieces at a time; blocks holding the border itself are encoded piece by piece."""
        if self.border is None:
            return self.batch(texts)
        blocks = [texts[k:k + JOINED] for k in range(0, len(texts), JOINED)]
        joined = self.batch([self.border.join(b) for b in blocks])
        mark = self.tokenizer.token_to_id(self.border)
        out: list[bytes] = []
        for block, data in zip(blocks, joined):
            at = (4 * np.flatnonzero(np.frombuffer(data, np.uint32) == mark)).tolist()
            if len(at) != len(block) - 1 or any(self.border in x for x in block):
                out += self.batch(block)
            else:
                out += [data[lo:hi] for lo, hi in zip([0, *(k + 4 for k in at)], [*at, len(data)])]
        return out

    def new(self, texts: list[str]) -> list[bytes]:
        """Ids of pieces that aren't remembered yet."""
        if self.words is None:
            return self.pieces(texts)
        plain = [bool(_PLAIN.match(x)) and not (self.splitter.added and self.splitter.added.search(x)) for x in texts]
        other = iter(self.pieces([x for x, p in zip(texts, plain) if not p]))
        pattern, encoding = self.words
        # every word gets its end mark, and NEXT stands after each piece
        joined = pattern.findall(f" {NEXT} ".join([x for x, p in zip(texts, plain) if p] + [""]).lower())
        ids = np.array(encoding.encode_ordinary(END.join([*joined, ""])), np.uint32)
        at = (4 * np.flatnonzero(ids == encoding.encode_ordinary(NEXT + END)[0])).tolist()
        data = ids.tobytes()
        own = (data[lo:hi] for lo, hi in zip([0, *(k + 4 for k in at)], at))
        return [next(own) if p else next(other) for p in plain]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is not None:
            added = self.splitter.added
            fast = [safe(t) and not (added and added.search(t)) for t in texts]
            other = iter(self.remembered([t for t, f in zip(texts, fast) if not f]))
            return [array.array("I", self.ranked.encode_ordinary(t)).tobytes() if f else next(other) for t, f in zip(texts, fast)]
        if self.words is not None:
            added, (pattern, encoding) = self.splitter.added, self.words
            fast = [bool(_PLAIN.match(t)) and not (added and added.search(t)) for t in texts]
            other = iter(self.remembered([t for t, f in zip(texts, fast) if not f]))
            return [array.array("I", encoding.encode_ordinary(END.join([*pattern.findall(t.lower()), ""]))).tobytes()
                    if f else next(other) for t, f in zip(texts, fast)]
        return self.remembered(texts)

    def remembered(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        keys = [self.splitter.keys(t) for t in texts]
        wanted = set().union(*(k for k, _ in keys))
        if len(self.cache) > CACHE:
            self.before, self.cache = self.cache, {}
        wanted.difference_update(self.cache)
        again = wanted.intersection(self.before)
        self.cache.update(zip(again, map(self.before.__getitem__, again)))
        new = list(wanted.difference(again))
        for k in range(0, len(new), 20_000):
            part = new[k:k + 20_000]
            self.cache.update(zip(part, self.new([self.splitter.text_of(x) for x in part])))
        return [b"".join(map(self.cache.__getitem__, k))[4 * drop:] for k, drop in keys]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file (kept while the worker lives)."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def n_pieces(path: str, texts: list[str]) -> list[int]:
    """Numbers of ids of texts, by the library."""
    return [len(e) for e in encoder(path).tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
