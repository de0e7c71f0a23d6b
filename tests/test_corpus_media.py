import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions.text import sha256
from lodestrata.operators import corpus as c
from lodestrata.operators import media as m
from lodestrata.sources.tables import pages_from_text

PARAGRAPHS = [
    "Safety Rules",
    "All visitors sign in at the desk. Badges must be worn at all times inside. Staff escort every guest through the building.",
    "Evacuation Plan",
    "When the alarm sounds, leave by the nearest exit and meet at the east lawn.",
]


def test_a_page_is_packed_within_bounds():
    got = c.pack_page(PARAGRAPHS, 24, 6, 4)
    assert len(got) >= 2 and all(6 <= n <= 24 and n == c.tokens_in(t) for t, n in got)
    assert got[0][0].startswith("Safety Rules") and any("Evacuation Plan\n\nWhen" in t for t, _ in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_packing_keeps_all_words_in_order(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma.", "delta", "it's", "x-1", "End!", "ß"])
    paragraphs = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
    most, least = rng.choice([(24, 6), (40, 10), (12, 3)])
    plain = c.pack_page(paragraphs, most, least, 0)
    tokens = [t for x, _ in plain for t in c.PY_TOKEN.findall(x)]
    assert tokens == [t for p in paragraphs for t in c.PY_TOKEN.findall(p)]
    assert all(n <= most and n == c.tokens_in(t) for t, n in plain)
    lapped = c.pack_page(paragraphs, most, least, 4)
    assert len(lapped) == len(plain) and all(t.endswith(p) and n <= most for (t, n), (p, _) in zip(lapped, plain, strict=True))


def test_headings():
    assert c.heading("TRAVEL POLICY", 2) and c.heading("Travel Policy", 2) and c.heading("1.2. scope of use", 6) and c.heading("what to do:", 4)
    assert not c.heading("Travel Policy.", 3) and not c.heading("123 456", 2) and not c.heading("this is a sentence", 4)


def pages(spark, rows):
    return spark.createDataFrame(rows, "document_id string, filename string, page_number int, paragraphs array<string>")


def test_chunks_carry_provenance(spark):
    rows = [("d", "f.pdf", i, ["Acme Fixture", f"Title {i}", f"Paragraph number {i} says something of note about the policy.", f"Page {i}"]) for i in (1, 2, 3)] + [("blank", "b.pdf", 1, [])]
    cleaned = c.remove_boilerplate(pages(spark, rows))
    assert {r.page_number: r.paragraphs for r in cleaned.where("document_id = 'd'").collect()}[2] == ["Title 2", "Paragraph number 2 says something of note about the policy.", "Page 2"]
    got = c.build_chunks(cleaned, max_tokens=40, min_tokens=4, overlap=0).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_number) for r in got] == [(0, 1), (1, 2), (2, 3)] and all(r.chunk_id.startswith("chunk_") and len(r.checksum) == 64 for r in got)
    roll = {r.document_id: r for r in c.document_rollup(cleaned, c.build_chunks(cleaned, max_tokens=40, min_tokens=4)).collect()}
    assert roll["blank"].ocr_required and roll["blank"].chunk_count == 0 and not roll["d"].ocr_required and roll["d"].chunk_count == 3


def test_chunks_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "\n".join(PARAGRAPHS * (i + 1))) for i in range(6)], "doc_id long, text string")
    one, many = (sorted(map(tuple, c.build_chunks(pages_from_text(df.repartition(n), lines_per_page=3), max_tokens=24, min_tokens=6, overlap=4).collect())) for n in (1, 5))
    assert one == many and one


def test_duplicates_by_checksum(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "text string").select(sha256("text").alias("checksum"))
    assert [r.copies for r in c.duplicate_checksums(df).collect()] == [2]


def media(spark):
    film = spark.createDataFrame([("v", "v.mp4", 6.0)], "video_id string, filename string, duration_seconds double")
    spans = spark.createDataFrame([("v", 0.0, 3.0, "the roadmap."), ("v", 3.0, 6.0, "the marker ORION-VIDEO.")], "video_id string, start_seconds double, end_seconds double, text string")
    seen = spark.createDataFrame([("v", 0, "A chart."), ("v", 1, "Visual enrichment unavailable."), ("v", 2, "Visual enrichment disabled.")], "video_id string, idx int, description string")
    return film, spans, seen


def test_segments_and_overlap(spark):
    for slot in (1.0, 60.0):
        film, spans, _ = media(spark)
        bounds = m.segment_bounds(m.representative_timestamps(film, 2, 3), film)
        got = [(r.start_seconds, r.end_seconds, r.transcript) for r in m.overlap_spans(bounds, spans, slot).orderBy("start_seconds").collect()]
        assert got == [(0.0, 2.0, "the roadmap."), (2.0, 4.0, "the roadmap. the marker ORION-VIDEO."), (4.0, 6.0, "the marker ORION-VIDEO.")]


def test_segment_texts_and_search(spark):
    film, spans, seen = media(spark)
    got = m.build_segments(film, spans, seen, 2, 3)
    rows = got.orderBy("start_seconds").collect()
    assert rows[0].combined_text == "the roadmap. A chart." and rows[2].combined_text == "the marker ORION-VIDEO."
    none = m.build_segments(film, spans.where("false"), seen, 2, 3).orderBy("start_seconds").collect()
    assert none[1].combined_text == "Video segment from 2.000 to 4.000 seconds; Visual enrichment unavailable."
    assert m.media_rollup(got).head().processing_status == "partial"
    q = spark.createDataFrame([("q", "  the   marker ")], "query_id string, text string")
    assert m.search_segments(q, got, 1).head().start_seconds in (2.0, 4.0)


def test_timestamps_of_short_media(spark):
    film = spark.createDataFrame([("a", 0.0), ("b", 30.0), ("c", 30.5), ("d", 9999.0)], "video_id string, duration_seconds double")
    got = {}
    for r in m.representative_timestamps(film).collect():
        got.setdefault(r.video_id, []).append(r.start_seconds)
    assert got["a"] == [0.0] and got["b"] == [0.0] and got["c"] == [0.0, 30.0] and len(got["d"]) == 6


def test_headings_by_column(spark):
    texts = ["TRAVEL POLICY", "Travel Policy", "1.2. scope of use", "what to do:", "Travel Policy.", "123 456", "this is a sentence", "", "A - b", "Élan Vital", "ÉLAN", "It's", "It'S", "X" * 121, "a: b", "Word " * 17, "B. next", "Ab1Cd", "ab Cd"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", c.is_heading(F.col("text")).alias("h")).collect()
    assert {r.text: r.h for r in rows} == {t: c.heading(t, c.tokens_in(t)) for t in texts}


# ---- chunks against a packing that counts everything anew at each step ----

COUNT = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")


def size(*texts):
    return sum(len(COUNT.findall(t)) for t in texts)


def parts_of(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text) if s.strip()]


def units_of(text, most):
    if size(text) <= most:
        return [(text, c.heading(text, size(text)))]
    out = []
    for sentence in parts_of(text):
        tokens = COUNT.findall(sentence)
        runs = [sentence] if len(tokens) <= most else [" ".join(tokens[i : i + most]) for i in range(0, len(tokens), most)]
        out += [(r, False) for r in runs]
    return out


def naive_chunks(paragraphs, most, least, overlap):
    groups = []
    for unit, opens in [u for p in paragraphs for u in units_of(p, most)]:
        if not groups or opens or size(*groups[-1], unit) > most:
            groups.append([])
        groups[-1].append(unit)
    if len(groups) > 1 and size(*groups[-1]) < least:
        both = groups[-2] + groups[-1]
        if size(*both) <= most:
            groups[-2:] = [both]
        else:
            for at in range(1, len(both)):
                if all(least <= size(*side) <= most for side in (both[:at], both[at:])):
                    groups[-2:] = [both[:at], both[at:]]
                    break
    i = 0
    while i + 1 < len(groups):
        own, after = groups[i], groups[i + 1]
        if size(*own) < least:
            if size(*own, *after) <= most:
                groups[i : i + 2] = [own + after]
                continue
            while size(*own) < least and len(after) > 1 and size(*own, after[0]) <= most and size(*after[1:]) >= least:
                own.append(after.pop(0))
            words, missing = after[0].split(), least - size(*own)
            for n in range(1, len(words)):
                if missing > 0 and size(" ".join(words[:n])) >= missing:
                    left, right = " ".join(words[:n]), " ".join(words[n:])
                    if size(*own, left) <= most and size(right, *after[1:]) >= least:
                        own.append(left)
                        after[0] = right
                    break
        i += 1
    texts = ["\n\n".join(g) for g in groups]
    out = texts[:1]
    for before, text in zip(texts, texts[1:]):
        lead = []
        for sentence in reversed(parts_of(before)):
            if size(sentence, *lead) > overlap:
                break
            lead.insert(0, sentence)
        first = " ".join(lead) if lead else " ".join(COUNT.findall(before)[-overlap:] if overlap else [])
        out.append(f"{first}\n\n{text}" if first and size(first, text) <= most else text)
    return out


@pytest.mark.parametrize("most,least,overlap", [(400, 80, 40), (60, 20, 8), (25, 10, 0)])
def test_chunks_of_every_document_against_a_naive_packing(spark, most, least, overlap):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = pages_from_text(docs, lines_per_page=10)
    found = {}
    for r in c.chunk_pages(pages, most, least, overlap).collect():
        found.setdefault((r.document_id, r.page_number), []).append((r.position, r.text, r.token_estimate))
    rows = pages.collect()
    for r in rows:
        want = naive_chunks(list(r.paragraphs), most, least, overlap)
        got = sorted(found.pop((r.document_id, r.page_number), []))
        assert [t for _, t, _ in got] == want and [n for _, _, n in got] == [size(t) for t in want]
    assert not found and len({r.document_id for r in rows}) == 200


def test_small_chunks_against_a_naive_packing():
    rng = random.Random(12)
    for _ in range(300):
        words = lambda n: " ".join(rng.choice(["alpha", "beta-2", "it's", "Gamma", "d.", "e!", "5"]) for _ in range(n))
        page = [rng.choice(["INTRODUCTION", "Results:", words(rng.randint(1, 30)), words(rng.randint(1, 90))]) for _ in range(rng.randint(1, 9))]
        most = rng.randint(8, 40)
        least, overlap = rng.randint(1, most // 2), rng.randint(0, 6)
        assert [t for t, _ in c.pack_page(page, most, least, overlap)] == naive_chunks(page, most, least, overlap)
