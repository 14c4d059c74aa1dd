"""Column expressions against plain-Python statements of the same rules."""

import re

from pyspark.sql import functions as F

from newsloom.functions import fixed, text as T, url as U
from newsloom.operators import crawl as C, merge as M


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_strip_matches_python(spark):
    for s in ["  a b \n", "  x　", "\n\n", "x"]:
        assert one(spark, T.strip("x"), s) == s.strip()


def test_collapse_newlines(spark):
    s = "a\n   b\n\t\n c \nd"
    assert one(spark, T.collapse_newlines("x"), s) == re.sub(r"\n\s+", "\n", s)


def test_boilerplate_rules_each_fire(spark):
    cases = {
        "Intro.\nADVERTISEMENT ADVERTISEMENT": "Intro.\n\n",
        "Intro.\nAdvertisement \t Advertisement\nrest": "Intro.\nrest\n",
        "Fact (Photo: J. Roe/Agency) more": "Fact  more\n",
        "a\nImage: courtesy archive\nb": "a\nb\n",
        "a\nPhoto Published on 01-02-2019\nb": "a\nb\n",
        "End. Photo: Staff\nb": "End.\nb\n",
        "a\nPicture Courtesy: Wire\nb": "a\nb\n",
        "a\nREAD MORE: stories\nb": "a\nb\n",
        "a\nShare this: Facebook\nTwitter\nGoogle\nWhatsApp\nEmail\nCopy\nb": "a\nb\n",
    }
    for src, want in cases.items():
        got = one(spark, T.strip_boilerplate_text("x"), src)
        assert got == re.sub(r"\n+", "\n", want), (src, got)


def test_boilerplate_keeps_long_credit(spark):
    src = "a\nImage: " + "x" * 61 + "\nb"
    assert one(spark, T.strip_boilerplate_text("x"), src) == src + "\n"


def test_undouble_names_only_on_domain(spark):
    df = spark.createDataFrame([("Apple Apple and Visa Visa", "forbes.com"), ("Apple Apple", "other.com")],
                               "text string, domain string")
    got = [r[0] for r in df.select(T.undouble_names("text", "domain")).collect()]
    assert got == ["Apple and Visa", "Apple Apple"]


def test_fix_authors_byline_and_filters(spark):
    rows = [("By Jane Roe\nBody text", [], "A summary..."),
            ("By one two three four five six\nBody", [], "ok"),
            ("No byline", ["https://x", "Sports", "John Smith", "www.site", "me.com"], None)]
    df = spark.createDataFrame(rows, "text string, authors array<string>, summary string")
    out = M.fix_authors(df).collect()
    assert out[0]["authors"] == ["Jane Roe"] and out[0]["text"] == "Body text" and out[0]["summary"] is None
    assert out[1]["authors"] == [] and out[1]["text"].startswith("By one")
    assert out[2]["authors"] == ["John Smith"]


def test_pick_summary_and_short_author(spark):
    df = spark.createDataFrame([(" short ", "  " + "t" * 31 + " ", "d" * 40)], "a string, b string, c string")
    assert df.select(T.pick_summary("a", "b", "c")).first()[0] == "t" * 31
    df2 = spark.createDataFrame([(["a b", " ".join(["w"] * 10), " ".join(["w"] * 9)],)], "x array<string>")
    assert df2.select(F.filter("x", lambda v: T.short_author(v))).first()[0] == ["a b", " ".join(["w"] * 9)]


def test_url_parts(spark):
    urls = [("https://m.news.example.com/a/b.HTML?x=1#f",), ("http://www.site.co.uk/path/",),
            ("http://a.b.c.org/.hidden",), ("https://host.com/file.tar.gz",)]
    df = spark.createDataFrame(urls, "url string")
    out = C.url_columns(df, suffixes=["com", "co.uk", "org", "example.com"]).collect()
    assert (out[0]["domain"], out[0]["subdomain"], out[0]["extension"], out[0]["clean_url"]) == \
        ("news.example.com", "m", "html", "https://m.news.example.com/a/b.HTML")
    assert (out[1]["domain"], out[1]["subdomain"]) == ("site.co.uk", "www")
    assert (out[2]["domain"], out[2]["subdomain"], out[2]["extension"]) == ("c.org", "a.b", "")
    assert out[3]["extension"] == "gz"


def test_url_reject_reasons(spark):
    allow = spark.createDataFrame([("good.com", None), ("part.com", ["", "www"])], "domain string, subdomains array<string>")
    urls = ["http://good.com/" + "x" * 200, "http://bad.com/a", "http://blog.part.com/a", "http://www.part.com/a",
            "http://good.com/a.jpg", "http://good.com/a.net/x", "http://good.com/video/1", "http://good.com/story"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = C.url_filter(df, allow, keep_rejects=True, suffixes=["com"]).select("url", "url_reject").collect()
    got = {r["url"]: r["url_reject"] for r in out}
    assert [got[u] for u in urls] == ["url_length", "domain", "domain", None, "extension", "endings",
                                      "banned_string", None]


def test_banned_pattern_is_escaped_alternation():
    pat = re.compile(U.banned_pattern())
    for s in fixed.BANNED_STRINGS:
        assert pat.search("http://x.org" + s)
    assert not pat.search("http://good.example.org/story")


def test_spelled_date(spark):
    assert one(spark, T.spelled_date("x"), "03-07-2019") == "March 07, 2019"
    assert one(spark, T.mm_dd_yyyy("x"), "2019-03-07 10:00:00") == "03-07-2019"
    assert one(spark, T.mm_dd_yyyy("x"), "not a date") is None


def test_piece_text_rules(spark):
    df = spark.createDataFrame([(["Al", "Bo"], "s" * 51), (["Al"], "s" * 50), (["Jane Roe"], None)],
                               "a array<string>, s string")
    out = df.select(T.authors_text("a").alias("a"), T.summary_text("s").alias("s")).collect()
    assert [(r["a"], r["s"]) for r in out] == [("Al, Bo", "s" * 51), (None, None), ("Jane Roe", None)]


def test_split_and_fold_filters(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["train", "val", "test", "train", "ignore"])],
                               "line long, split string")
    assert sorted(r[0] for r in M.keep_splits(df, ["train", "ignore"]).select("line").collect()) == [1, 2]
    assert sorted(r[0] for r in M.fold_filter(df, "line", 2, 1).select("line").collect()) == [1, 3]
