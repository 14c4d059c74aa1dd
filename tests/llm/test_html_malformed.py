"""Malformed pages are read in time linear in their length, and keep their text."""

import time

import pytest

from newsloom.llm import html_extract


def texts(source):
    return [r[4] for r in html_extract.parse(source) if r[4].strip()]


CUT = "<html><body><p>text</p><div " + " ".join(f'a{k}="v{k}"' for k in range(100_000))
PAGES = {"cut inside a tag": CUT, "cut inside a value": CUT + ' b="', "unclosed quotes": '<p a="' * 50_000, "closed far away": '<p a="' * 50_001 + '">x',
         "many attributes": CUT + ">end", "mixed quotes": "<p a='\"" * 30_000 + ">t", "brackets": "<" * 100_000, "open comment": "<!-- <p>" * 20_000}


@pytest.mark.parametrize("name", PAGES)
def test_malformed_pages_take_no_time(name):
    start = time.time()
    html_extract.parse(PAGES[name])
    assert time.time() - start < 5


def test_malformed_pages_keep_their_text():
    assert texts(CUT)[0] == "text" and texts(PAGES["many attributes"]) == ["text", "end"]
    assert texts("<p>a < b</p>c < d") == ["a ", "<", " b", "c < d"]
    assert texts("<p>a</p><!-- <b>x</b> tail") == ["a"] and texts("<p>a</p>b <!-- tail") == ["a", "b "]
    assert texts("<p>a</p><script>var x = '<p>'; tail") == ["a"] and texts("<script>x</script>b") == ["b"]
    assert texts('<p a="1>2" b=\'>\'>x</p>') == ["x"] and texts('<p a="1>x</p>') == ["x"] and texts("") == [] and texts("plain") == ["plain"]
