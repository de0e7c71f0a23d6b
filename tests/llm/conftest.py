import pytest

ODD = [None, "", " ", "\n\n", "one", "one two", "Straße élan naïve", "!!! ??? 123", "a\tb\r\nc", "x" * 5000, "word " * 3000, "same text here for all", "same text here for all", "▁ <s> \u0000 ﻿", "  two  spaces  ", "日本語 テキスト です", "🏳️‍🌈 flag"]


@pytest.fixture
def odd(spark):
    """Null, empty, long, repeated texts; null and repeated ids; columns whose names clash with the operators' own."""
    rows = [(i if i % 7 else None, t, None if i % 3 else "en", "s", i) for i, t in enumerate(ODD)] + [(3, "other text under a known id", "en", "s", 0), (4, "one", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int").selectExpr("*", "1 as size", "2 as `group`", "'x' as words", "0 as n", "'y' as block", "'z' as h", "1 as at", "'l' as line", "0.5 as score", "1 as unit", "'g' as gone", "1 as gone_id", "'h' as hits", "2 as hit_id", "3 as bad_id", "4 as _gone")


@pytest.fixture
def none(odd):
    return odd.where("false")
