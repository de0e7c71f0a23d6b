import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import decontaminate, line_dedup, ngram_join, piece_codec, token_files, word_ids

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TRICKY = st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcéßǅ▁<>s/0x1日🏳́ \u0000"), st.characters(exclude_categories=["Cs"])), max_size=40)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


# ---- 1: pieces ----


@settings(max_examples=400, deadline=None)
@given(TRICKY)
def test_agenda_equals_the_library(text):
    own = piece_codec.vocabulary(PIECES)
    (ids,) = own.encode_all([text])
    assert ids == own.library.encode(text) and own.decode(ids) == own.library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decoding_of_any_ids(ids):
    own = piece_codec.vocabulary(PIECES)
    assert own.decode(ids) == own.library.decode(ids)


def test_many_stray_bytes_decode():
    assert piece_codec.lenient(b"\xff" * 5000 + "é".encode() + b"\xc3") == "\ufffd" * 5000 + "é\ufffd"


def test_full_memory_changes_nothing(library):
    own = piece_codec.Vocabulary(PIECES, held=3)
    texts = ["the cat sat on the mat", "a cat", "the mat", None, ""] * 3
    assert list(own.encode_all(texts)) == [library.encode(t or "") for t in texts]


def test_a_wrong_encoder_is_noticed():
    own = piece_codec.Vocabulary(PIECES)
    own.pair_ranks = own.pair_ranks[::-1].copy()
    with pytest.raises(piece_codec.Disagreement):
        list(own.encode_all(["thermodynamics"]))
    own.scores = {p: -x for p, x in own.scores.items()}
    with pytest.raises(piece_codec.Disagreement):
        list(own.encode_all(["thermodynamics" * 4]))


def test_agendas_in_step_equal_the_heap(library):
    own = piece_codec.Vocabulary(PIECES)
    words = [w for w in piece_codec.RUNS.findall("▁" + open(__file__, encoding="utf-8").read().replace(" ", "▁"))] + ["▁", "\n", "é", "▁日本", "▁naïve", "▁🏳️\u200d🌈", "▁" * 33, "ab" * 40]
    assert own.merge_all(words) == [list(own.merge(w)) for w in words]


def test_a_name_that_is_there_already_is_refused(odd):
    with pytest.raises(ValueError, match="n_tokens"):
        piece_codec.encode_decode(odd, PIECES)


def test_pieces_of_odd_rows(odd, none, library):
    got = piece_codec.encode_decode(odd.withColumnRenamed("n_tokens", "_n"), PIECES, digests=True).collect()
    assert len(got) == odd.count() and all(r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids) and r.n_tokens == len(r.ids) for r in got)
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)
    assert piece_codec.encode_decode(none, PIECES, prefix="own_").count() == 0


# ---- 9: token files ----


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 9000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), np.minimum(rng.zipf(1.3, n), 49_407), np.full(n, 7), np.tile(np.arange(5), n // 5 + 1)[:n]):
        sizes, sums, payload = token_files.encode_ids(ids.astype("<u4"))
        assert (token_files.decode_ids(n, np.array(sizes, int), np.array(sums), payload) == ids).all()
    if n == 9000:
        assert len(payload) < n  # five ids in turn are predicted


def test_a_range_of_two_to_the_48_is_not_shifted_away():
    lanes = token_files.Lanes(2)
    # low 32 bits 0 and the next 16 ones, over the edge of the top word: cut short, the range is 2**32 and 2**48 after a shift
    lanes.low[:], lanes.range[:] = np.uint64(0x1234FFFF00000000), np.uint64((1 << 48) - 1)
    lanes.low[1], lanes.range[1] = np.uint64(7 << 48), np.uint64(1 << 48)
    lanes.settle(2)
    assert lanes.range.tolist() == [1 << 48, 1 << 48] and lanes.length.tolist() == [1, 0]


def test_ids_without_shares_and_near_the_limit():
    rng = np.random.default_rng(4)
    ids = np.concatenate([np.minimum(rng.zipf(1.2, 60_000), 1 << 40) % 49_000, rng.integers(0, token_files.MOST, 40_000), [token_files.MOST - 1, 0]])
    assert token_files.MOST >= 1 << 20
    sizes, sums, payload = token_files.encode_ids(ids.astype("<u4"))
    assert (token_files.decode_ids(len(ids), np.array(sizes), np.array(sums), payload) == ids).all()
    shares, skip = token_files.Shares.read(payload)
    assert 0 < len(shares.ids) < len(np.unique(ids)) and shares.sizes.min() >= 1 and 0 < shares.rest < 1 << 16
    bad = bytearray(payload)
    for at in (0, 4, skip // 2, skip + 11, len(payload) - 60):
        bad[at] ^= 255
        with pytest.raises(token_files.Damaged):
            token_files.decode_ids(len(ids), np.array(sizes), np.array(sums), bytes(bad))
        bad[at] ^= 255


def test_as_many_ids_as_slots():
    for n in (40_000, 87_000, 200_000):  # all of one count: with a share for each there would be too few slots
        ids = np.arange(n)
        sizes, sums, payload = token_files.encode_ids(ids.astype("<u4"))
        assert (token_files.decode_ids(n, np.array(sizes), np.array(sums), payload) == ids).all()


def test_blocks_of_a_group_learn_from_each_other():
    ids = np.tile(np.random.default_rng(6).permutation(3000), 60)  # no block of 2048 has an id twice
    sizes, sums, payload = token_files.encode_ids(ids.astype("<u4"))
    assert (token_files.decode_ids(len(ids), np.array(sizes), np.array(sums), payload) == ids).all()
    assert len(payload) < len(ids)  # each id alone takes 1.4 bytes


def test_models_learn_from_every_id(monkeypatch):
    learn, seen = token_files.Models.learn, []
    monkeypatch.setattr(token_files.Models, "learn", lambda self, *run: (seen.append(run[-1].copy()), learn(self, *run))[1])
    for n in (1, 511, 512, 513, 40_000):
        ids = np.arange(n)
        sizes, sums, payload = token_files.encode_ids(ids.astype("<u4"))
        assert np.array_equal(np.sort(np.concatenate([x.ravel() for x in seen])), ids)
        seen.clear()
        token_files.decode_ids(n, np.array(sizes), np.array(sums), payload)
        assert np.array_equal(np.sort(np.concatenate([x.ravel() for x in seen])), ids)
        seen.clear()


def test_another_count_of_blocks_is_damage():
    sizes, sums, payload = token_files.encode_ids(np.arange(5000).astype("<u4"))
    for count in (5000 - token_files.BLOCK, 5000 + token_files.BLOCK):
        with pytest.raises(token_files.Damaged):
            token_files.decode_ids(count, np.array(sizes), np.array(sums), payload)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aSsTtRrEeVvLlMmDd'1.,ÉéßÞ<", max_size=9), max_size=6))
def test_plain_words_are_split_as_the_file_splits_them(some):
    parts, before = word_ids.parts_of(pa.array(some, pa.large_string()))
    split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    want = [split.findall(word.lower()) for word in some]
    assert parts.to_pylist() == sum(want, []) and before.tolist() == np.cumsum([0, *map(len, want)]).tolist()


def test_words_of_a_run_stay_apart():
    own = token_files.word_ids(WORDS)
    texts = ["a,\n,b  ", "", None, " ", "É-é,", "don't \n\n'S'll it's", "x\ty\r\nz", "ok<|x|> <|endoftext|> ok", "日本 İI ½ a\u0301", "12,3", "\n", "...", "a, ,b"] * 3
    for some in (texts, texts[:1], texts[3:4], texts[8:9], []):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(some)] == [own.library.encode(t or "", add_special_tokens=False).ids for t in some]
    assert "don't" not in own.words.known  # parts are remembered, not the words made of them


def test_plain_words_of_files_go_through_the_merge_model():
    own = token_files.word_ids(WORDS)
    list(own.encode_all(["Once again, once again"]))
    assert own.model and {"once", "again"} <= set(own.parts.known)


def test_damage_is_noticed():
    ids = np.arange(3000)
    sizes, sums, payload = token_files.encode_ids(ids.astype("<u4"))
    bad = bytearray(payload)
    bad[10] ^= 255
    with pytest.raises(token_files.Damaged):
        token_files.decode_ids(3000, np.array(sizes), np.array(sums), bytes(bad))


@settings(max_examples=200, deadline=None)
@given(TRICKY)
def test_words_one_by_one_equal_whole_texts(text):
    own = token_files.word_ids(WORDS)
    (ids,) = own.encode_all([text])
    assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_files_of_odd_rows(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    token_files.write_token_files(odd, WORDS, str(tmp_path / "f"), parts=3)
    got = token_files.read_token_files(spark, str(tmp_path / "f"), ids=True).orderBy("start").collect()
    t = Tokenizer.from_file(WORDS)
    rows = odd.collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    want = sorted(t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows)
    assert sorted(r.ids for r in got) == want
    token_files.write_token_files(none, WORDS, str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


# ---- 2: decontamination ----


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, n):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(n, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(str(name))
    return len(w), sorted(hit), sorted(names)


def test_hits_against_brute_force(spark, odd, none):
    rng = random.Random(5)
    vocabulary = ["Red", "blue", "É", "é", "x1", "the"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 7)))) for i in range(12)] + [(None, "red the blue x1"), (50, None), (51, "...")]
    docs = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-"]) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):  # broadcast, and by shuffle
        got = {r.doc_id: (r.n_words, list(r.hits), [x for x in r["items"]]) for r in decontaminate.find_hits(d, b, 4, limit).collect()}
        for i, text in docs:
            n, hits, names = brute_hits(text, [x for x in items], 4)
            assert got[i][:2] == (n, hits) and got[i][2] == [x for x in names if x != "None"]
    assert decontaminate.find_hits(odd, b, 4).count() == odd.count() and decontaminate.find_hits(none, b, 4).count() == 0
    assert {r.n_hit for r in decontaminate.find_hits(odd, b.where("false"), 4).collect()} == {0}
    kept = decontaminate.drop_contaminated(d, b, 4)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in docs if not brute_hits(x, items, 4)[1]} and decontaminate.drop_contaminated(odd, b, 4).columns == odd.columns


def test_removed_spans(spark, odd):
    d = spark.createDataFrame([(1, "Keep this. one two three four! Then, keep that."), (2, "clean text"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "ONE two three four")], "item_id long, text string")
    assert decontaminate.remove_spans(odd, b, 4).columns == odd.columns and decontaminate.remove_spans(odd, b, 4).count() == odd.count()
    assert [r.text for r in decontaminate.remove_spans(d, b, 4).orderBy("doc_id").collect()] == ["Keep this. Then, keep that.", "clean text", None]


# ---- 8: line dedup ----

PASSAGE = ["A passage of words that go on for a while and then on,", "and a second line of it that has a dozen words or so,", "with a third one that brings it all to more than forty words,", "and some more words at the end to come over fifty in all."]


def test_repeated_passages_go_and_the_rest_stays(spark):
    own = lambda i: [f"own line {i} {k} with a few words of its own" for k in range(4)]
    rows = [(1, own(1) + PASSAGE + own(11)), (2, PASSAGE + own(2)), (3, own(3) + PASSAGE), (4, ["short line."] + own(4)), (5, ["short line."] + own(5)), (6, own(6) + PASSAGE + own(66) + PASSAGE), (7, ["Anble anes."] * 60)]
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(d).collect()}
    assert got == {1: own(1) + PASSAGE + own(11), 2: own(2), 3: own(3), 4: ["short line."] + own(4), 5: ["short line."] + own(5), 6: own(6) + own(66), 7: ["Anble anes."]}


def test_one_long_line_is_a_passage(spark):
    line = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, f"a\n{line}"), (2, f"b\n{line}\nc")], "doc_id long, text string")
    assert [r.text for r in line_dedup.dedup_lines(d).orderBy("doc_id").collect()] == [f"a\n{line}", "b\nc"]


def test_every_run_of_the_guaranteed_size_is_found(spark):
    rng = random.Random(8)
    lines = [" ".join(f"{k}x{i}" for i in range(rng.randint(1, 30))) for k in range(400)]
    base = lines[:60]
    docs = [(0, base)] + [(i, lines[60 + 8 * i : 63 + 8 * i] + base[a : a + rng.randint(1, 12)] + lines[64 + 8 * i : 67 + 8 * i]) for i, a in ((i, rng.randint(0, 48)) for i in range(1, 30))]
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(d).collect()}
    for i, x in docs[1:]:
        run = [y for y in x if y in base]
        left = [y for y in got[i] if y in base]
        size = sum(len(y.split()) for y in run)
        assert [y for y in got[i] if y not in base] == [y for y in x if y not in base]
        assert left == [] if size >= line_dedup.GUARANTEE else left in ([], run)
    assert got[0] == base


def test_a_run_meets_its_earlier_copy_behind_a_shorter_one(spark):
    # an earlier document holds only lines 2 to 4; in some of the trials their gram is the passage's only fingerprint
    own = lambda *k: [" ".join(f"{k}x{i}y{j}".replace(" ", "") for j in range(12)) for i in range(3)]
    rows, passages = [], []
    for s in range(24):
        passage = [" ".join(f"s{s}p{k}w{i}" for i in range(10)) for k in range(6)]
        passages.append(passage)
        rows += [(4 * s, own(s, 0) + passage[1:4] + own(s, 1)), (4 * s + 1, own(s, 2) + passage + own(s, 3)), (4 * s + 2, own(s, 4) + passage + own(s, 5)), (4 * s + 3, own(s, 6) + passage[1:4] + own(s, 7) + passage + own(s, 8))]
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(d).collect()}
    for s, passage in enumerate(passages):
        left = [[y for y in got[4 * s + k] if y in passage] for k in range(4)]
        assert left[2] == [] and left[3] in ([], passage[1:4]) and set(left[0] + left[1]) == set(passage)
    assert all([y for y in got[i] if "p" not in y] == [y for y in x if "p" not in y] for i, x in rows)


def test_a_run_goes_to_its_last_line_and_across_blank_ones(spark):
    long, tail, more = " ".join(f"l{i}" for i in range(50)), "five words of a tail", " ".join(f"m{i}" for i in range(30))
    rows = [(1, [long, "other words"]), (2, ["b b", long, tail]), (3, ["c c", long, tail]), (4, [more, "", more + " x"]), (5, ["e e", more, more + " x"]), (6, ["f f", more, more + " x"])]
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(d).collect()}
    assert got[1] == [long, "other words"] and got[3] == ["c c"] and got[4] == [more, "", more + " x"] and got[6] == ["f f"]


def test_long_runs_of_blank_lines_count_by_their_contents(spark):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(35))
    a, b, many = words("a"), words("b"), [""] * 20_000
    rows = [(1, [a, *many, b]), (2, ["x x", a, *many, b]), (3, [a, *many, "", b]), (4, [a, *many[1:], " ", b]), (5, ["y y", *many, a, *many, b, *many])]
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    left = {r.doc_id: [w for w in r.text.split("\n") if w.strip()] for r in line_dedup.dedup_lines(d, noise=50).collect()}
    # the run goes where the blank lines between its lines are the same, whatever stands around it
    assert left == {1: [a, b], 2: ["x x"], 3: [a, b], 4: [a, b], 5: ["y y"]}


def test_line_dedup_of_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count() and line_dedup.dedup_lines(none).count() == 0
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in odd.collect())


# ---- 4: n-gram join ----


def brute_components(rows, width, t):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [shingles(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and Fraction(both, len(sets[i] | sets[j])) >= t:
                root[find(i)] = find(j)
    name = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            name[find(i)] = min(name.get(find(i), k), k)
    return sorted(((k, len(sets[i]), name.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def near_copies(width, odd):
    """Odd rows, families of near copies of all sizes, and short texts that share most of few words."""
    rng = random.Random(width)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for k in range(8):
        text = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 20, 60, 200, 1500]))]
        for j in range(6):
            mine = list(text)
            for _ in range(rng.randint(0, max(3, len(mine) // 90))):
                mine[rng.randrange(len(mine))] = f"e{rng.randint(0, 9)}"
            rows.append((100 + 10 * k + j, " ".join(mine) + (" tail" if j == 4 else "")))
    rows += [(500, rows[-1][1].upper()), (501, rows[-1][1])]
    rows += [(600 + i, " ".join(rng.choices(["one", "two", "three"], k=rng.randint(1, 14)))) for i in range(60)]
    return rows


#: CAP, HOT and SAMPLE: as they are; blocks in tiles; every shared digest a frequent one; both. Nothing fits a broadcast where blocks are in tiles.
@pytest.mark.parametrize("width,t", [(3, Fraction(9, 10)), (5, Fraction(8, 10))])
@pytest.mark.parametrize("cap,hot,sample", [(4096, 2048, 64), (8, 2048, 64), (4096, 2, 1), (8, 2, 1)])
def test_components_against_brute_force(spark, odd, none, monkeypatch, width, t, cap, hot, sample):
    for name, value in (("CAP", cap), ("HOT", hot), ("SAMPLE", sample), ("BROADCAST_ROWS", 0 if cap == 8 else ngram_join.BROADCAST_ROWS)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(width, odd)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, t)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows, width, t)
    if sample > 1 or cap < 4096:
        return
    assert ngram_join.near_duplicates(none, width, t).count() == 0 and ngram_join.near_duplicates(odd, width, t).count() == odd.count()


@pytest.mark.parametrize("cap", [4096, 8])
def test_all_links_between_different_sets(spark, odd, monkeypatch, cap):
    monkeypatch.setattr(ngram_join, "CAP", cap)
    rows = near_copies(3, odd)
    pairs, members = ngram_join.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(9, 10))
    named = {(r.doc_id, r.text_hash): r["class"] for r in members.collect()}
    assert members.count() == len(rows)
    keyed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    sets = {}
    for r in keyed:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        if w:
            sets[named[r.doc_id, r.h]] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        else:
            assert named[r.doc_id, r.h] is None
    expected = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 3


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for _ in range(150):
        own = base.copy() if rng.random() < 0.6 else rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)
        own[: rng.integers(0, min(60, len(own)))] = rng.integers(0, 2**63)
        sets.append(np.unique(own))
    points = ngram_join.unpacked([ngram_join.packed_points(s, np.array([0, len(s)]))[0] for s in sets], np.array([len(s) for s in sets]))
    sizes = np.array([len(s) for s in sets])
    t = Fraction(9, 10)
    tree = ngram_join.Tree(points, sizes)
    for i, s in enumerate(sets):
        found = set(tree.ask(points[i], int(sizes[i]), t)[0].tolist())
        assert {j for j, x in enumerate(sets) if ngram_join.similar(s, x, t)} <= found


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (2000, 2000)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and got[2000] == 2000


def test_hashes_agree_across_chunks():
    texts = pa.array(["a b c d e", "b c d", None, "B C D"], pa.large_string())
    from lodestrata.llm._shared import byte_chunks

    whole = [(tuple(v), tuple(s)) for _, _, d, o in byte_chunks(texts) for v, s in [ngram_join.shingle_sets(d, o, 3)]]
    single = [v for _, _, d, o in byte_chunks(texts, 1) for v, _ in [ngram_join.shingle_sets(d, o, 3)]]
    assert sum(map(len, single)) == len(whole[0][0]) and set(single[1]) <= set(single[0]) and list(single[1]) == list(single[3])
