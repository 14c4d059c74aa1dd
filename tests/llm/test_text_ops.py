"""Near-duplicates, decontamination, rules, extraction, licences, scores and classifier on small fixtures."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, html_extract, license_scan, lm_score, near_dedup, quality_classifier, quality_rules


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"kept": F.lit(1), "n_words": F.lit("x"), "source": F.lit(None).cast("string"), "component_id": F.lit(0)})


def words(rng, n, vocabulary=3000):
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


def near_fixture():
    rng = np.random.default_rng(3)
    rows, k = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  two"), (5, "one two three four five"), (None, "no id here at all")], 10
    for _ in range(6):
        base = words(rng, int(rng.integers(30, 160)))
        for _ in range(9):
            edited = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 8))):
                edited[at] = f"x{rng.integers(0, 10**9)}"
            rows.append((k, " ".join(edited)))
            k += 1
    hub = words(rng, 120)
    for n in range(60):          # a hub whose variants resemble it more than each other
        edited = list(hub)
        edited[2 * n] = edited[2 * n + 1 if n else 0] = f"v{n}"
        edited[(2 * n + 60) % 120] = f"u{n}"
        rows.append((k + n, " ".join(edited)))
    chain = words(rng, 300)
    rows += [(600 + n, " ".join(chain[5 * n:5 * n + 60])) for n in range(48)]      # each resembles its neighbours only
    rows += [(500, " ".join(hub)), (501, " ".join(hub)), (501, " ".join(hub)), (502, " ".join(words(rng, 9000, 10**6)))]
    return rows


@pytest.mark.parametrize("tile", [near_dedup.TILE, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = near_fixture()
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_dedup.near_duplicates(docs(spark, rows).limit(0)).collect() == []


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(2)
    for j in (0.5, 0.75, 0.9):
        x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        same = int(3000 * j)
        half = (3000 - same) // 2
        a, b = x[:same + half], np.concatenate([x[:same], x[same + half:]])
        e = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([float(len(a))]), np.array([float(len(b))]))
        assert abs(e[0] - j) < 0.17
        merged = np.maximum(near_dedup.registers(a), near_dedup.registers(b))
        assert (merged == near_dedup.registers(np.union1d(a, b))).all()


def test_tiles_find_links_between_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    own = {k: np.unique(np.concatenate([base[:190], rng.integers(0, 2**63, 10, dtype=np.uint64)])) for k in range(40)}
    sketch = {k: near_dedup.registers(v) for k, v in own.items()}
    size = {k: len(v) for k, v in own.items()}
    links = near_dedup.tile_links(list(range(40)), list(range(40)), {k: k for k in range(40)}, size, sketch, own, True)
    assert len(links) == 39      # a spanning forest, not all pairs


@pytest.mark.parametrize("block_words", [10, 10**6])
def test_decontamination_equals_brute_force(spark, block_words):
    rng = np.random.default_rng(1)
    items = [(k, " ".join(words(rng, n, 30))) for k, n in enumerate([25, 12, 10, 9, 3, 1, 40])] + [(7, None), (8, " .. "), (2, "Same id, other text")]
    rows = [(0, None), (1, "")] + [(k, " ".join(words(rng, 60, 30))) for k in range(2, 12)]
    rows += [(20, "lead " + items[0][1].upper() + "!! tail"), (21, items[3][1]), (21, items[3][1]), (22, " ".join(words(rng, 9, 30)) + " " + items[1][1])]
    split = lambda t: (t or "").encode().translate(decontaminate.alnum_words.__globals__["ALNUM"]).split()
    wins = {(tuple(w[k:k + min(10, len(w))]), str(i)) for i, t in items for w in [split(t)] if w for k in range(len(w) - min(10, len(w)) + 1)}
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.decontaminate(docs(spark, rows), bench, block_words=block_words).collect()
    want = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for win, item in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        want.append((i, len(w), len(hit), sorted(found)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    none = decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and all(r.n_hit == 0 for r in none)


def test_rules_remove_frequent_lines_and_spare_copies(spark):
    rng = np.random.default_rng(6)
    line = "this line stands everywhere 12"
    rows = [(k, line.replace("12", f"{k:02d}") + "\n" + " ".join(words(rng, 30 + k))) for k in range(40)]
    rows += [(100 + k, (line + "\n") * 5) for k in range(3)]                      # only the frequent line
    copy = "\n".join(" ".join(words(rng, 12)) for _ in range(5))
    rows += [(200 + k, copy) for k in range(60)] + [(300, None), (301, ""), (302, "short one")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert all(got[k].kept and got[k].n_removed_lines == 1 for k in range(40))
    assert all(not got[100 + k].kept for k in range(3))
    assert all(got[200 + k].kept and got[200 + k].n_removed_lines == 0 for k in range(60))
    assert not got[300].kept and got[300].n_words == 0 and got[302].base_failed
    m = quality_rules.measured(docs(spark, rows), "doc_id", "text", "source")
    left = quality_rules.without_lines(docs(spark, rows), quality_rules.frequent_lines(m))
    texts = {r.doc_id: r.text for r in left.collect()}
    assert "stands everywhere" not in texts[5] and texts[200] == copy and left.columns == docs(spark, rows).columns
    assert quality_rules.quality_rules(docs(spark, rows).limit(0)).collect() == []


def test_rules_reject_stubs_of_equal_length(spark):
    rng = np.random.default_rng(16)
    notices = "\n".join(" ".join(words(rng, 9)) for _ in range(3))
    rows = [(k, f"{notices}\npage {k:04d}") for k in range(3000)]                       # the same notices, one number each
    copy = "\n".join(" ".join(words(rng, 12)) for _ in range(5))
    long = "\n".join(" ".join(words(rng, 50, 10**6)) for _ in range(400))              # a very long text
    rows += [(4000 + k, copy) for k in range(60)] + [(5000, long + "\n" + notices), (5001, notices.replace(" ", "  ") + "\n" + copy)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(not got[k].base_failed and not got[k].kept and got[k].n_left_words == 0 for k in range(3000))
    assert all(got[4000 + k].kept and got[4000 + k].n_removed_lines == 0 for k in range(60))
    assert got[5000].kept and got[5000].n_removed_lines == 3 and got[5001].kept and got[5001].n_left_words == 60


def test_rules_count_exactly_above_the_limits(spark):
    """Brute force of the line rule on random lines, hosts and copies, with lines at and beside the limit."""
    rng = np.random.default_rng(17)
    common = [" ".join(words(rng, 8)) for _ in range(40)]
    rows = []
    for k in range(900):
        own = [common[j] for j in np.unique(rng.integers(0, 40, 3))] + [" ".join(words(rng, 25))]
        rows.append((k, "\n".join(own), "a" if k % 3 else None))
    rows += [(1000 + k, *rows[k][1:]) for k in range(0, 900, 2)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for host in ("a", None):
        texts = {t for _, t, h in rows if h == host}
        lines = lambda t: [re.sub("[0-9]", "0", x) for x in t.split("\n")]
        held = Counter(x for t in texts for x in set(lines(t)))
        frequent = {x for x, n in held.items() if n > max(quality_rules.MIN_DOCS, quality_rules.MIN_SHARE * len(texts))}
        assert frequent
        for i, t, h in rows:
            if h == host:
                assert got[i].n_removed_lines == sum(x in frequent for x in lines(t))


def _page(k, body, extra=""):
    return (f"<html><head><title>t{k}</title><style>p{{x}}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home {k}</a></ul></nav>"
            f"<div class='cookie-notice'>Cookies {k}</div><!-- c --><div class=ad>Buy {k}</div><article><h1>Title {k}</h1>{body}"
            f"<p>Share this story</p><section class='comments'><p>first! {k}</p></section></article>{extra}<aside>See also {k}</aside><form>Mail<input></form>"
            f"<script>var t=\"</p>\"; x({k})</script><footer>&copy; {k}</footer></body></html>")


def test_extraction(spark):
    rows = [(k, "http://a.example/x", _page(k, f"<p>One&amp;two  <b>bold</b>\n {k} &lt;x&gt; 3 < 4<br>next<p>Unclosed {k}")) for k in range(20)]
    rows += [(100, "http://b.example/", "<p>Only  text<p>more &#x41;"), (101, None, None), (102, "", ""), (103, "bad url", "<div>plain</div>tail"), (5, "http://a.example/x", rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "host": F.lit(1), "data": F.lit(2)})
    got = html_extract.extract(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    for k in range(20):          # the fixed line 'Share this story' is template text
        assert texts[k] == f"Title {k}\n\nOne&two bold {k} <x> 3 < 4 next\n\nUnclosed {k}"
    assert texts[100] == "Only text\n\nmore A" and texts[101] == texts[102] == "" and texts[103] == "plain\n\ntail"
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_licences(spark):
    rows = [(0, None), (1, ""), (2, "Released under the MIT License. " * 2), (3, "x " * 50 + "Licensed under the Apache License, Version 2.0."),
            (4, "GENERAL public License"), (5, "mit licenses"), (6, "Licensed under CC BY-NC 4.0."), (7, "license mit " * 9), (2, "All rights reserved")]
    got = sorted((r.doc_id, len(r.starts), r.base_labels, sorted(r.found)) for r in license_scan.scan_licenses(docs(spark, rows)).collect())
    assert got == [(0, 0, [], []), (1, 0, [], []), (2, 0, [], ["all-rights-reserved"]), (2, 2, ["mit"], ["mit-notice"]), (3, 1, ["apache"], ["apache-2.0"]),
                   (4, 1, ["gpl"], []), (5, 0, [], []), (6, 0, [], ["cc-by-nc-4.0"]), (7, 8, ["mit"], [])]


def test_scores(spark):
    rng = np.random.default_rng(9)
    rows = [(0, None), (1, ""), (2, "A a\x1cb b")] + [(k, " ".join(words(rng, int(rng.integers(1, 80)), 200))) for k in range(3, 150)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    split = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    for head in (5, 10**6):
        got = {r.doc_id: r for r in lm_score.lm_scores(docs(spark, rows), own=20, prefixes=5, head=head).collect()}
        for i, t in rows:
            w, r = split(t), got[i]
            base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in counts for x in w), n, held(i))
            assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert lm_score.lm_scores(docs(spark, rows).limit(0)).collect() == []


def test_log_probabilities_are_normalised():
    voc = {"size": 30, "noise": np.full(30, 1 / 30)}
    params = lm_score.initial(voc)
    w = np.arange(30)
    assert abs(np.exp(lm_score.log_probabilities(params, w, np.full(30, 4), np.full(30, 30), 30)).sum() - 1) < 1e-5


def test_classifier(spark):
    rng = np.random.default_rng(8)
    good = [(k, " ".join(words(rng, 60))) for k in range(200)]
    bad = [(k, " ".join(w.upper() + "###" for w in words(rng, 60))) for k in range(200, 400)]
    rows = good + bad + [(500, None), (501, ""), (501, ""), (None, "no id")]
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(400)] + [(7, 1), (None, 1), (9999, 0)], "doc_id long, quality int")
    got = quality_classifier.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(test) > 40 and all(r.predicted == int(r.doc_id < 200) for r in test)
    assert {r.score for r in quality_classifier.classify(docs(spark, rows), labels.limit(0)).collect()} == {0.5}
