"""URL filter: rules first, else a naive Bayes model over the words of host and path.

1. words of running text are counted over the whole corpus; those with at least 1 / HEAD of all occurrences (so at most
   HEAD) and the seed words are the lexicon, which is broadcast;
2. the letters of a host or path part are split into words by Viterbi under the unigram model of the lexicon; a stretch
   outside it costs more with each letter.  What is split depends on the part alone, so tasks remember it;
3. a url with a seed word among its words is an example of ``block``, every other url one of ``allow``.  Tasks tally the
   features by class and send sums.  Features are bounded: lexicon words, digit runs as one, and BUCKETS hash buckets for
   words outside the lexicon, host and path apart; so the sums fit the driver and a broadcast at any input size;
4. multinomial naive Bayes with add-ALPHA smoothing gives the log odds of ``block``; above 0 the verdict is ``block``.
   So words that stand beside seed words are learned, and a seed word among many clean ones may be outvoted.

A rule that fits decides before the model: a rule ``host/path`` fits its host and all subdomains of it if the url's path
starts with its path; the longest rule wins.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch, cut_lineage, map_arrow, pylist, table

HEAD = 200_000       # words of running text with this share of all occurrences are in the lexicon
LONGEST = 24         # letters of a lexicon word at most
BUCKETS = 1 << 16    # hash buckets of words outside the lexicon
ALPHA = 0.1
SENT = 200_000       # features a task tallies before it sends sums
REMEMBERED = 200_000
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# words that mark advert, gambling, adult, pharmacy and link-farm hosts: a parameter, examples for the model
SEEDS = ("adserver", "adult", "ads", "banner", "bet", "bets", "betting", "casino", "clickbait", "escort", "gambling", "jackpot",
         "lottery", "malware", "payday", "pharmacy", "phishing", "pills", "poker", "popup", "porn", "replica", "roulette", "sex",
         "slots", "spam", "torrent", "tracker", "viagra", "warez", "xxx")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end.  Both empty for null and urls without ``://``."""
    found = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(found > 0, F.substr(url, found + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


class Rules:
    """``find(host, path)``: the longest rule that fits, as (verdict, rule), or None; one look-up a label of the host."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, verdict, rule))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        at = 0
        while True:
            for start, verdict, rule in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[1])):
                    best = (verdict, rule)
            at = host.find(".", at) + 1
            if not at:
                return best


class Segmenter:
    """``split(letters)``: words by Viterbi under unigram costs (negative log10 probability)."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(total, 1)
        self.cost = {w: math.log10(self.total / max(n, 1)) for w, n in counts.items()}
        self.split = lru_cache(REMEMBERED)(self._split)

    def unknown(self, length: int) -> float:
        """A stretch outside the lexicon: as likely as ten occurrences, and a tenth of that with each letter."""
        return math.log10(self.total) - 1 + length

    def _split(self, letters: str) -> tuple[str, ...]:
        n = len(letters)
        best, start = [0.0] + [math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - LONGEST), end):
                word = letters[begin:end]
                cost = best[begin] + self.cost.get(word, self.unknown(end - begin))
                if cost < best[end]:
                    best[end], start[end] = cost, begin
        out, end = [], n
        while end:
            out.append(letters[start[end]:end])
            end = start[end]
        return tuple(reversed(out))

    def words(self, text: str) -> list[str]:
        """Words of a host or path: letters are split, digit runs become ``0``, other characters separate."""
        out: list[str] = []
        for part in _PARTS.findall(text.lower()):
            out.extend(self.split(part) if "a" <= part[0] <= "z" else ("0",) if part[0].isdigit() and part[0] < "\x80" else (part,))
        return out

    def features(self, host: str, path: str) -> list[str]:
        """``h:`` and ``p:`` features: lexicon words as such, others by hash bucket."""
        return [f"{side}:{w}" if w in self.cost or w == "0" else f"{side}#{zlib.crc32(w.encode('utf-8', 'replace')) % BUCKETS}"
                for side, text in (("h", host), ("p", path)) for w in self.words(text)]


def lexicon(texts: DataFrame, text_col: str, seeds: Iterable[str], head: int = HEAD) -> tuple[dict[str, int], int]:
    """Words a-z of running text (A-Z lower-cased) of at least 1 / ``head`` of all occurrences, at most ``head`` words;
    seeds below that count as one such occurrence.  And the number of all occurrences."""
    counted = (texts.select(F.explode(F.split(F.translate(F.coalesce(text_col, F.lit("")), _UPPER, _LOWER), "[^a-z]+")).alias("w"))
               .where(F.length("w").between(1, LONGEST)).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    counted = cut_lineage(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    counts = dict(map(tuple, counted.where(F.col("n") * head >= total).collect()))
    for w in seeds:
        counts.setdefault(w, max(1, -(-total // head)))
    return counts, max(total, 1)


class Bayes:
    """Log odds of ``block`` from (feature, n_block, n_allow) sums and the numbers of urls of each class."""

    def __init__(self, rows: Iterable[tuple[str, int, int]], n_block: int, n_allow: int, alpha: float = ALPHA):
        rows = list(rows)
        size = len(rows) + 1          # the features that occur, and one for all others
        block, allow = sum(r[1] for r in rows) + alpha * size, sum(r[2] for r in rows) + alpha * size
        self.unseen = math.log(allow / block)
        self.weight = {f: math.log((b + alpha) / (a + alpha)) + self.unseen for f, b, a in rows}
        self.prior = math.log((n_block + alpha) / (n_allow + alpha))

    def odds(self, features: list[str]) -> float:
        return self.prior + math.fsum(self.weight.get(f, self.unseen) for f in features)


def fit(parts: DataFrame, counts: dict[str, int], total: int, seeds: Iterable[str]) -> Bayes:
    """The model from all (host, path) rows; see module, 3."""
    seeds = frozenset(seeds)
    spark = parts.sparkSession
    shared = spark.sparkContext.broadcast((counts, total))
    kind = pa.schema([("feature", pa.string()), ("block", pa.int64()), ("allow", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*shared.value)
        held = Counter(), Counter()

        def sums() -> pa.RecordBatch:
            names = list(held[0] | held[1])
            out = batch(kind, {"feature": names, "block": [held[1][f] for f in names], "allow": [held[0][f] for f in names]})
            held[0].clear(), held[1].clear()
            return out

        for b in batches:
            for host, path in zip(pylist(b, "host"), pylist(b, "path")):
                features = segmenter.features(host, path)
                blocked = any(f[2:] in seeds for f in features)
                held[blocked].update(features)
                held[blocked]["url"] += 1          # no feature: those start with h or p
            if len(held[0]) + len(held[1]) > SENT:
                yield sums()
        yield sums()

    rows = [tuple(r) for r in map_arrow(parts.select("host", "path"), tally, "feature string, block long, allow long")
            .groupBy("feature").agg(F.sum("block"), F.sum("allow")).collect()]      # at most 2 * (lexicon + BUCKETS + 1) rows
    urls = next((r for r in rows if r[0] == "url"), ("url", 0, 0))
    return Bayes((r for r in rows if r[0] != "url"), urls[1], urls[2])


def judge(pages: DataFrame, texts: DataFrame, rules: Iterable[tuple[str, str]] = RULES, seeds: Iterable[str] = SEEDS,
          id_col: str = "page_id", url_col: str = "url", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per page row: page_id, host, path, rule (else null), verdict, score (log odds of ``block``), words.

    ``texts``: running text for the lexicon.  Null urls and urls without ``://`` have empty host and path, and the verdict
    of the class prior alone; repeated rows each count and get the same verdict; equal log odds (0) allow; of equally long
    rules that fit (the same rule twice) the first wins; a very long part is split in linear time; empty tables give an
    empty result, an empty ``texts`` a lexicon of the seeds; ids may be null.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    counts, total = lexicon(texts, text_col, seeds, head)
    shared = spark.sparkContext.broadcast((counts, total, fit(parts, counts, total, seeds), Rules(rules)))
    kind = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
                      ("verdict", pa.string()), ("score", pa.float64()), ("words", pa.list_(pa.string()))])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, bayes, rules = shared.value
        segmenter = Segmenter(counts, total)
        for b in batches:
            rule, verdict, score, words = [], [], [], []
            for host, path in zip(pylist(b, "host"), pylist(b, "path")):
                found = rules.find(host, path)
                odds = bayes.odds(segmenter.features(host, path))
                rule.append(found[1] if found else None)
                verdict.append(found[0] if found else "block" if odds > 0 else "allow")
                score.append(odds)
                words.append(segmenter.words(host))
            yield batch(kind, {"page_id": b.column(0), "host": b.column(1), "path": b.column(2), "rule": rule,
                               "verdict": verdict, "score": score, "words": words})

    return map_arrow(parts, decide, "page_id long, host string, path string, rule string, verdict string, score double, words array<string>")


def op13_url_filter(spark, sf_dir):
    """Verdicts on all page urls; the lexicon is counted over all documents (see module)."""
    got = judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return got.select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op13_url_filter": op13_url_filter}
ORACLES: dict[str, str] = {}
