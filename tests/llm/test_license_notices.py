"""Published notices and whole licence texts, as files carry them, get their labels."""

from newsloom.llm import license_scan as L

GPL = """ * Copyright (C) 2019 A. Person
 * This program is free software{0} you can redistribute it and/or modify
 * it under the terms of the GNU {2}General Public License as published by
 * the Free Software Foundation, either version {1} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the
 * GNU {2}General Public License for more details.
"""
OTHER = "Local council met on Monday to discuss the new version of its budget and the terms of the program. " * 5


def _found(text):
    index = L.Index(L.TEMPLATES, {}, 0)
    return index.scan(L._words(OTHER + text + OTHER))[2]


def test_published_notices():
    assert set(_found(GPL.format(";", 2, ""))) == {"gpl-2.0"}
    assert set(_found(GPL.format(":", 3, ""))) == {"gpl-3.0"}
    assert set(_found(GPL.format(":", 3, "Affero "))) == {"agpl-3.0"}
    assert set(_found(GPL.format(":", 3, "Lesser "))) == {"lgpl"}
    assert "cc-by-sa-4.0" in _found("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.\n"
                                    "To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/ or send a letter")
    assert set(_found("")) == set()


def test_whole_text_with_words_added_and_missing():
    words = L._text("Apache-2.0").split()
    own = " ".join(w if k % 40 else f"{w} page{k}" for k, w in enumerate(words) if k % 55)
    found = _found(own)
    assert found["apache-2.0"] > 0.9
    assert _found("Released under the MIT License.") == {"mit-notice": 1.0}
