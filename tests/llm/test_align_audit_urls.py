"""Operators 11 to 13 against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import align_tokenizers, source_audit, url_filter
from tests.conftest import SF_SMALL

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "\n", "a", " a", "a ", "a  b", "it's  we'll\t don't", "café éa ́b", "<|endoftext|>", "a <|endoftext|> b",
       "<s> </s> <unk>", "x▁y", "▁", "<0x41> <0x0A>", "你好 世界", "\U0001f600 \U0001f600", "a\r\nb\x00c", "word " * 2000, "a\x85b",
       "x" * 3000, "   lead", "trail   ", "the the the"]


def plain_alignment(texts):
    """Tokens end by end, one text at a time."""
    enc, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    enc.encode_special_tokens = True
    known = align_tokenizers.vocabularies(A, B)
    groups = []
    for t in texts:
        own = []
        if t:
            a, b = enc.encode(" " + t, add_special_tokens=False).ids, model.encode(t)
            if b"".join(known.a[i] for i in a) == (" " + t).encode() == b"".join(known.b[i] for i in b):
                ends = [list(itertools.accumulate(len(v[i]) for i in ids)) for ids, v in ((a, known.a), (b, known.b))]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                for lo, hi in zip([0, *cuts], cuts):
                    own.append(([i for i, e in zip(a, ends[0]) if lo < e <= hi], [i for i, e in zip(b, ends[1]) if lo < e <= hi]))
        groups.append(own)
    count = Counter((x[-1], y[-1]) for own in groups for x, y in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for own in groups:
        links = [(x[-1], y[-1]) for x, y in own]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        out.append((sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(links),
                    sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if own else ""))
    return out


@pytest.mark.parametrize("head", [1, 50, 1_000_000])
def test_alignment_equals_the_plain_version(spark, head):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").select("text").limit(30).collect()]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "the the the"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_a": F.lit("x"), "row": F.lit(1), "pair": F.lit(2)})
    got = [tuple(r) for r in align_tokenizers.align(docs, A, B, head=head).collect()]
    want = [(k, *x) for (k, _), x in zip(rows, plain_alignment([t for _, t in rows]))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fast_ids_are_those_of_the_library():
    library, fast = Tokenizer.from_file(A), align_tokenizers.ranked(A)
    library.encode_special_tokens = True
    assert fast is not None and align_tokenizers.ranked(P.path("word_bpe_49k.json")) is None
    texts = [f"a{c}b {c}1{c}  {c}!{c} \n{c}" for c in map(chr, range(0x3000))]
    for t in [*texts, "x" * 30_000, " " * 30_000, "\n" * 999, "  a" * 5_000, "<|endoftext|>"]:
        assert fast.encode_ordinary(t) == library.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_word_lists():
    texts = ["Ab c1d É", "", "  x", " " * 5, "zz", "é-è", "A" * 10 + " b", "\x00Z\x7f"]
    want = [re.findall(r"[^\x00-\x60\x7B-\x7F]+", t.translate(str.maketrans(source_audit.UPPER, source_audit.LOWER))) for t in texts]
    assert source_audit.word_lists(pa.array([t.encode() for t in texts])).to_pylist() == want
    assert source_audit.word_lists(pa.array([], pa.binary())).to_pylist() == []


def test_group_sums_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 3)
    rows = [("a", f"s{k % 3}", {0: 1.0, k % 5 + 1: 2.0}) for k in range(50)] + [("b", "s0", {})]
    vectors = spark.createDataFrame([(la, s, Vectors.sparse(9, v)) for la, s, v in rows], ["lang", "source", "vector"]).repartition(3)
    want = Counter()
    for la, s, v in rows:
        want.update({(la, s, i): int(n) for i, n in v.items()})
    assert {tuple(r)[:3]: r["n"] for r in source_audit.group_sums(vectors).collect()} == want


def test_invalid_bytes_are_replaced_as_by_java(spark):
    lead, rnd = [0x61, 0xC3, 0xE9, 0xED, 0xA0, 0x80, 0xF0, 0x9F, 0xF5, 0xFF, 0xC0, 0xBF, 0xE0], random.Random(1)
    texts = [bytes(rnd.choice(lead) for _ in range(rnd.randint(1, 7))) for _ in range(2000)]
    rows = spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate(texts)], "k int, b binary").selectExpr("k", "split(cast(b AS string), ' ')[0] AS w")
    assert [source_audit.spaced(t) for t in texts] == [r["w"] for r in rows.orderBy("k").collect()]


def test_words_of_a_group_are_counted_and_sent_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 3)
    monkeypatch.setattr(source_audit, "BLOCKS", 2)
    texts = ["A b,c  b", "", "zz a", "É a\x00b", "c" * 300, None]
    rows = [("l" if k % 3 else "", f"s{k % 4}", source_audit.spaced(texts[k % 6] and texts[k % 6].encode())) for k in range(60)]
    assert source_audit.spaced("A b,c  b\x00É".encode()) == "a b c b É"
    vocabulary = ["b", "a", "É", "never", "c" * 300]
    docs = spark.createDataFrame(rows, "lang string, source string, words string").selectExpr("lang", "source", "cast(words AS binary) AS words")
    want = Counter((la, s, vocabulary.index(w)) for la, s, t in rows for w in t.split() if w in vocabulary)
    got = source_audit.group_sums(docs.repartition(5), source_audit.word_elements(spark, vocabulary))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and {r[:3]: r[3] for r in found} == want
    # the shuffle has a row a task, group and block: no row for each element
    assert "hashpartitioning(lang#" in (plan := got._jdf.queryExecution().toString()) and "block#" in plan and "HashAggregate" not in plan


def test_alignment_of_invalid_bytes_and_no_rows(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert [tuple(r)[1:] for r in align_tokenizers.align(docs, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]
    assert align_tokenizers.align(docs.limit(0), A, B).collect() == []


def plain_audit(rows, min_docs, top):
    """Every probability of every group, word by word."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans(source_audit.UPPER, source_audit.LOWER)
    out = []
    for lang in {r[0] for r in rows}:
        docs = [(s, re.findall(r"[^\x00-\x60\x7B-\x7F]+", t.translate(lower))) for la, s, t in rows if la == lang]
        df = Counter(w for _, ws in docs for w in set(ws))
        kept = [w for w, n in df.items() if n >= min_docs]
        counts = {s: Counter() for s, _ in docs}
        for s, ws in docs:
            counts[s].update(w for w in ws if w in set(kept))

        def p(c):
            total = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        own, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(t, sum((own[s][w] - own[t][w]) ** 2 // (own[s][w] + own[t][w]) for w in kept)) for t in counts if t != s]
            words = [(w, (own[s][w] - q[w]) ** 2 // (own[s][w] + q[w])) for w in kept if counts[s][w] and own[s][w] > q[w]]
            for part, items, limit in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)]
    return out


def test_audit_equals_the_plain_version(spark):
    read = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang", "source", "text").collect()
    rows = [tuple(r) for r in read] + [("", None, "a b c " * 3), (None, "", "a c É"), (None, "x", None), ("xx", "only", "word"),
                                       ("xx", "other", ""), ("en", "empty", None), ("en", "dup", "The the THE"), ("en", "dup", "The the THE"),
                                       ("a/b=%", "s", "q"), ("long", "s", "zebra " * 50_000), ("long", "t", "zebra yak")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns(
        {c: F.lit(7) for c in ("idx", "n", "p", "words", "folder", "vector", "value")})
    for least, top in ((3, 4), (10, 10), (1, 2)):
        got = [tuple(r) for r in source_audit.audit(docs, min_docs=least, top=top).collect()]
        assert sorted(got) == sorted(plain_audit(rows, least, top))
    assert source_audit.audit(docs.limit(0)).collect() == []


def test_probability_of_huge_counts(spark):
    got = spark.range(1).select(source_audit.probability(F.lit(4 * 10**12), F.lit(9 * 10**12), F.lit(10**6))).first()[0]
    assert got == 1 + 10**9 * (4 * 10**12 + 2) // (9 * 10**12 + 2 * 10**6)


URLS = ["http://Blog.Example.NET/en/a?x=1", "https://example.net", "https://example.net/", "http://a.example.com/de/1#t", "http://b.org/fr/",
        "http://org/fr/2", "http://notexample.net/en/1", "http://x.example.com/den", "no scheme", "", None, "http://", "://net/x", "a://b://c/d?e",
        "http://Casino-Win.example.com/en/77", "http://cheappills.example.com/fr/", "http://" + "ab" * 3000 + ".com/" + "z9" * 3000,
        "http://ünï.org/fr/ß", "http://net:80/", "http://user@net/x", "http://..net/x", "http://x.com/a\nb"]
TEXTS = ["the cheap pills win the day and the casino is a farm by the sea", "the sea the day win win", None, ""]


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [(r.split("/")[0], "/" + r.split("/", 1)[1])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def plain_split(letters, counts, total):
    """The cheapest of all ways to cut."""
    def cost(w):
        return math.log10(total / counts[w]) if w in counts else math.log10(total) - 1 + len(w)
    ways = []
    for cuts in itertools.product((0, 1), repeat=len(letters) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(letters)]
        words = [letters[a:b] for a, b in zip(at, at[1:])]
        ways.append((sum(map(cost, words)), words))
    return min(ways)[0]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3]), (None, URLS[0])], "page_id long, url string").withColumns(
        {c: F.lit("x") for c in ("host", "path", "rule", "feature")})
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, texts).collect()}
    assert len(got) == len(URLS) + 1
    for k, u in enumerate(URLS):
        host, path, rule, verdict = plain_rule(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == verdict if rule else got[k]["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0), texts).collect() == []
    assert url_filter.judge(pages, texts.limit(0)).count() == len(URLS) + 2


def test_segmentation_is_the_cheapest_cut():
    counts, total = {"cheap": 50, "pills": 40, "pill": 30, "s": 5, "a": 400, "the": 900, "heap": 9, "sea": 20, "win": 11}, 2000
    segmenter = url_filter.Segmenter(counts, total)
    assert segmenter.split("cheappills") == ("cheap", "pills")
    assert segmenter.words("Cheappills-24.thesea") == ["cheap", "pills", "0", "the", "sea"]
    for letters in ("cheappills", "theseawin", "qcheapq", "zzzz", "aaaa", "thea", "pillsea"):
        words = segmenter.split(letters)
        assert "".join(words) == letters
        cost = sum(segmenter.cost.get(w, segmenter.unknown(len(w))) for w in words)
        assert abs(cost - plain_split(letters, counts, total)) < 1e-9


def test_model_learns_words_beside_seeds(spark):
    urls = ([f"http://casino-win.example.com/en/{k}" for k in range(40)] + [f"http://news{k % 7}.example.com/en/{k}" for k in range(400)]
            + ["http://winwin.example.com/en/1", "http://thenews.example.com/en/2"])
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    texts = spark.createDataFrame([("the news of the win " * 30,)], "text string")
    rows = url_filter.judge(pages, texts, rules=()).orderBy("page_id").collect()
    assert {r["verdict"] for r in rows[:40]} == {"block"} and {r["verdict"] for r in rows[40:440]} == {"allow"}
    assert rows[440]["verdict"] == "block" and rows[440]["words"] == ["win", "win", "example", "com"] and rows[441]["verdict"] == "allow"
    # the scores of a plain multinomial model over the same features
    counts, total = url_filter.lexicon(texts, "text", url_filter.SEEDS)
    segmenter = url_filter.Segmenter(counts, total)
    features = [segmenter.features(*plain_rule(u)[:2]) for u in urls]
    label = [any(f[2:] in url_filter.SEEDS for f in x) for x in features]
    tally = {c: Counter(f for x, y in zip(features, label) if y == c for f in x) for c in (True, False)}
    names = set(tally[True]) | set(tally[False])
    for row, x in zip(rows, features):
        odds = math.log((sum(label) + .1) / (len(label) - sum(label) + .1))
        for f in x:
            odds += math.log((tally[True][f] + .1) / (sum(tally[True].values()) + .1 * (len(names) + 1)))
            odds -= math.log((tally[False][f] + .1) / (sum(tally[False].values()) + .1 * (len(names) + 1)))
        assert abs(odds - row["score"]) < 1e-9


def test_result_does_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = sorted(map(tuple, url_filter.judge(pages.repartition(1), texts).select("page_id", "verdict", "score").collect()))
    many = sorted(map(tuple, url_filter.judge(pages.repartition(7), texts.repartition(5)).select("page_id", "verdict", "score").collect()))
    assert [r[:2] for r in one] == [r[:2] for r in many]
