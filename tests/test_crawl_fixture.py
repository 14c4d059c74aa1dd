"""Crawl stage on hand-made pages: every reject reason and the meta-based fields."""

from newsloom.operators import crawl as C

BODY = "<p>" + ("Lorem ipsum dolor sit amet. " * 45) + "</p>"


def page(title="A sufficiently long headline for the test page", lang="en", date="2019-03-07T10:00:00Z",
         authors=("Jane Roe",), desc="  " + "d" * 40 + "  ", og=None, body=BODY, lead_title=False):
    metas = "".join(f'<meta name="author" content="{a}">' for a in authors)
    if date:
        metas += f'<meta property="article:published_time" content="{date}">'
    if desc:
        metas += f'<meta name="description" content="{desc}">'
    if og:
        metas += f'<meta property="og:description" content="{og}">'
    lead = f"<p>{title}</p>" if lead_title else ""
    return (f'<html lang="{lang}"><head><title>{title}</title>{metas}</head><body>'
            f'<article><h1>{title}</h1>{lead}{body}</article></body></html>')


def run(spark, rows, require_date=True):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rec_type string, content_type string")
    allow = spark.createDataFrame([("good.com", None)], "domain string, subdomains array<string>")
    return {r["page_id"]: r for r in C.crawl(df, allow, suffixes=["com"], require_date=require_date,
                                               keep_rejects=True).collect()}


def test_reject_reasons_and_fields(spark):
    ok = ("response", "application/http; msgtype=response")
    rows = [
        (1, "http://www.good.com/a", page(lead_title=True), *ok),
        (2, "http://good.com/b", page(date=None), *ok),
        (3, "http://good.com/c", page(body="<p>short</p>"), *ok),
        (4, "http://good.com/d", page(title="Too short"), *ok),
        (5, "http://good.com/e", page(lang="de"), *ok),
        (6, "http://bad.com/f", page(), *ok),
        (7, "http://good.com/g", "", *ok),
        (8, "http://good.com/h", page(authors=("One", " ".join(["w"] * 12)), og="o" * 31), *ok),
    ]
    out = run(spark, rows)
    assert out[1]["reject_reason"] is None
    assert out[1]["publish_date"] == "03-07-2019" and out[1]["authors"] == ["Jane Roe"]
    assert out[1]["summary"] == "d" * 40                       # stripped, > 30 characters
    assert not out[1]["text"].startswith("A sufficiently")     # leading title removed (P4)
    assert out[1]["status"] == "success" and out[1]["url"] == "http://www.good.com/a"
    assert [out[i]["reject_reason"] for i in range(2, 8)] == ["date", "len", "title", "lang", "domain", "parse"]
    assert out[8]["authors"] == ["One"] and out[8]["summary"] == "o" * 31   # F16; og before description
    relaxed = run(spark, rows[1:2], require_date=False)
    assert relaxed[2]["reject_reason"] is None


def test_record_filter_drops_non_responses(spark):
    rows = [(1, "http://good.com/a", page(), "request", "application/http; msgtype=request"),
            (2, "http://good.com/b", page(), "response", "application/http; msgtype=response")]
    assert set(run(spark, rows)) == {2}
