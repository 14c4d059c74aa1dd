"""Article text survives names that look like furniture, near copies and repeated rows; real furniture goes."""

import pytest

from newsloom.llm import html_extract as H

ARTICLE = "<h1>Head</h1><p>First words of the article.</p><p>Second words of it.</p>"
WANT = "Head\n\nFirst words of the article.\n\nSecond words of it."
KEPT = {
    "body class": f'<body class="home has-sidebar"><article>{ARTICLE}</article></body>',
    "wrapper class": f'<body><div class="wrap navbar-fixed"><article>{ARTICLE}</article></div></body>',
    "other attribute value": f'<body><div style="overflow:hidden"><article>{ARTICLE}</article></div></body>',
    "data attribute": f'<body><article data-widget-id="social share" data-class="ad">{ARTICLE}</article></body>',
    "article class part": f'<body><article class="post comments-open">{ARTICLE}</article></body>',
    "body without article": f'<body class="with-menu"><div>{ARTICLE}</div></body>',
    "furniture around": f'<body class="nav-open"><nav>Menu</nav><div class="cookie-bar">Cookies</div><main>{ARTICLE}</main><div class="related-posts"><article>Teaser</article></div></body>',
    "related names": f'<body><article>{ARTICLE}<section class="comments"><article class="comment">Me first</article></section></article></body>',
    "sidebar article": f'<body><aside><article>Teaser</article></aside><article>{ARTICLE}</article></body>',
    "hidden": f'<body><article>{ARTICLE}<div hidden>no</div><div aria-hidden=true>no</div></article></body>',
    "inline advert": f'<body><article>{ARTICLE.replace("Second", "<span class=ad>Buy <span>now</span></span>Second")}<a class="share" href=x>Share</a></article></body>',
}


@pytest.mark.parametrize("name", KEPT)
def test_article_text(name):
    assert H.main_text(KEPT[name], set(), set(), set()) == WANT


def test_headings_and_captions_inside_the_article_stay():
    page = '<article><h2 id="search">Search</h2><p id="menu">a</p><figure><img><figcaption>View</figcaption></figure><span class="comment">code</span></article>'
    assert H.main_text(page, set(), set(), set()) == "Search\n\na\n\nView\n\ncode"


def page(k, text):
    return f"<html><body><nav>Menu</nav><article><h1>Headline {k}</h1>{text}<p>Share this</p></article><footer>End</footer></body></html>"


def run(spark, rows):
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return sorted((r.page_id, r.text) for r in got)


def test_near_copies_keep_their_paragraphs_and_others_lose_fixed_text(spark):
    rows = [(k, "http://copy.example/x", page(k, "<p>The shared paragraph of all the copies.</p><p>And another one.</p>")) for k in range(60)]
    rows += [(100 + k, "http://own.example/x", page(k, f"<p>Paragraph {k} of this page, which no other page has.</p>")) for k in range(30)]
    want = [(k, f"Headline {k}\n\nThe shared paragraph of all the copies.\n\nAnd another one.\n\nShare this") for k in range(60)]
    want += [(100 + k, f"Headline {k}\n\nParagraph {k} of this page, which no other page has.") for k in range(30)]
    assert run(spark, rows) == want
    assert run(spark, rows * 2) == sorted(want * 2)          # each row twice: the same template


def test_classes_equal_brute_force(spark):
    pages = [(k, f"<div><p>a</p>{'<section><b>x</b></section>' * (k % 3)}<ul class=l{k}><li>{k}</li></ul></div>" + "<table><tr><td>t</td></tr></table>" * (k < 28))
             for k in range(30)]
    rows = [(k, "http://h.example/", t) for k, t in pages]
    data = spark.createDataFrame(rows, "row long, url string, html string").selectExpr("'h' AS host", "cast(html AS binary) AS data", "row")
    got = H.templates(data.union(data)).collect()[0]
    vectors = {}
    for k, t in pages:
        for token, n in H.occurrences(H.parse(t))[0].items():
            vectors.setdefault(token, {})[k] = n
    same = {t: sum(v == u for u in vectors.values()) for t, v in vectors.items()}
    want = {t for t, v in vectors.items() if len(v) >= H.SUPPORT * len(pages) and (same[t] > 1 or all(n == 1 for n in v.values()))}
    assert set(got.elements) == want and len(want) >= 4
