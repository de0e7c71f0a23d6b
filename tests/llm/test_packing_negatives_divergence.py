import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import hard_negatives, sequence_packing, source_divergence
from lodestrata.llm.queries import QUERIES
from lodestrata.llm.word_ids import WordIds

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---- 11: packing ----


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("held,seed", [(250_000, 1), (40, 2)])
def test_words_by_their_parts_equal_the_library(library, held, seed):
    rng, letters = random.Random(seed), [chr(c) for c in range(1, 0x250)] + list("’'sStTreνvmldLDΣσçİıſﬁ½²ªا́̈　 ") + ["'s", "'ll", "<|startoftext|>", "<|endoftext|>", "\n", " the "]
    texts = [None, ""] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    own = WordIds(WORDS, held)
    got = []
    for ids, counts in own.encode(pa.array(texts, pa.string()), 5000):
        ends = np.cumsum(counts)
        got += [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert len(own.words.known) <= max(held, 3000) and own.model is not None


def test_other_files_go_through_their_library():
    own = WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.model is None


def documents_of(rows, length):
    """(doc_id, checksums of pieces, size) of each document, in order, from its pieces; checks that they lie without gaps."""
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at, out = 0, []
    for r in rows:
        assert r.sequence_id * length + r.offset == at and 0 < r.length and r.offset + r.length <= length
        at += r.length
        if r.start == 0:
            out.append((r.doc_id, r.doc_tokens, []))
        assert out[-1][0] == r.doc_id and out[-1][1] == r.doc_tokens and sum(n for n, _ in out[-1][2]) == r.start
        out[-1][2].append((r.length, r.ids_crc32))
    assert all(sum(n for n, _ in pieces) == size for _, size, pieces in out)
    return out, at


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("length,segment", [(16, 40), (64, 1 << 20), (7, 3)])
def test_pieces_and_sequences_of_odd_rows(spark, odd, none, library, tmp_path, length, segment):
    folder = str(tmp_path / "packed")
    sequence_packing.write_segments(odd.repartition(3), WORDS, folder, 2, segment=segment)
    found, total = documents_of(sequence_packing.pieces(spark, folder, length).collect(), length)
    wanted = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in odd.collect())
    sizes = Counter((i, len(ids)) for i, ids in wanted.elements())
    assert Counter((i, n) for i, n, _ in found) == sizes
    # whole ids come from the sequences; the checksums of pieces are theirs
    rows = sorted(sequence_packing.sequences(spark, folder, length).collect(), key=lambda r: r.sequence_id)
    ids = [x for r in rows for x in r.ids]
    assert [r.sequence_id for r in rows] == list(range(len(rows))) and all(r.n_tokens == length for r in rows[:-1]) and len(ids) == total
    at, got = 0, Counter()
    for i, n, pieces in found:
        got[i, tuple(ids[at : at + n])] += 1
        for size, checksum in pieces:
            assert crc(ids[at : at + size]) == checksum
            at += size
    assert got == wanted
    padded = {r.sequence_id: r.ids for r in sequence_packing.sequences(spark, folder, length, pad_id=9).collect()}
    last = rows[-1]
    power = last.n_tokens & (last.n_tokens - 1) == 0
    assert padded[last.sequence_id] == last.ids + [9] * (0 if power else length - last.n_tokens)
    nothing = str(tmp_path / "none")
    sequence_packing.write_segments(none, WORDS, nothing, 2)
    assert sequence_packing.pieces(spark, nothing, length).count() == sequence_packing.sequences(spark, nothing, length).count() == 0


@pytest.mark.parametrize("limit,summed", [(0, 2), (1_000_000, 1)])
def test_offsets_without_a_broadcast_and_in_many_groups(spark, tmp_path, monkeypatch, limit, summed):
    monkeypatch.setattr(sequence_packing, "BROADCAST_PARTS", limit)
    monkeypatch.setattr(sequence_packing, "SUMMED", summed)
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('word ', cast(id % 9 as int)) as text").repartition(7)
    folder = str(tmp_path / "packed")
    sequence_packing.write_segments(docs, WORDS, folder, 2)
    found, _ = documents_of(sequence_packing.pieces(spark, folder, 32).collect(), 32)
    assert sorted((i, n) for i, n, _ in found) == [(i, i % 9 + 1) for i in range(300)]


def test_the_packing_query(spark, library):
    found, total = documents_of(QUERIES["op11_sequence_packing"](spark, SMALL).collect(), 4096)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    encoded = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    assert sorted(i for i, _, _ in found) == sorted(texts) and total == sum(map(len, encoded.values()))
    for i, _, pieces in found:
        at = 0
        for n, checksum in pieces:
            assert crc(encoded[i][at : at + n]) == checksum
            at += n


# ---- 12: hard negatives ----


def test_spanning_trees_are_least_and_parents_first():
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(40, 5)), np.zeros((3, 5))])
    tree, seen = hard_negatives.spanning_tree(points), set()
    for node, parent, edge in tree:
        assert (parent == -1) == (not seen) and (parent == -1 or parent in seen)
        assert parent == -1 or np.isclose(edge, np.linalg.norm(points[node] - points[parent]))
        seen.add(node)
    assert seen == set(range(43))
    edges = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(43) for j in range(i))
    group, weight = list(range(43)), 0.0
    for d, i, j in edges:
        if group[i] != group[j]:
            weight += d
            group = [group[i] if x == group[j] else x for x in group]
    assert np.isclose(weight, sum(e for *_, e in tree))


def test_walks_leave_out_what_bounds_exclude():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16)) * 300
    draw = lambda n: np.round(np.repeat(centres, n, axis=0) + rng.normal(size=(6 * n, 16)) * 4)
    anchors, rows = draw(20), draw(200)
    exact = anchors @ rows.T
    # of each anchor, the scores between its 8th and its 2nd best
    lows, highs = np.sort(exact, axis=1)[:, -8], np.sort(exact, axis=1)[:, -2]
    found = {}
    scored = hard_negatives.walk(anchors, hard_negatives.spanning_tree(anchors), rows, lambda i: (lows[i], highs[i]), lambda i: np.ones(len(rows), bool), lambda i, at, s: found.update({i: (at, s)}))
    for i in range(len(anchors)):
        at = np.flatnonzero((exact[i] >= lows[i]) & (exact[i] <= highs[i]))
        assert found[i][0].tolist() == at.tolist() and (found[i][1] == exact[i][at]).all()
    assert scored < 0.5 * exact.size


def brute_negatives(rows, is_anchor, grid, k, n, share=(80, 100)):
    ok = [(i, label, [int(np.floor(grid * x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a in {i for i, _, _ in ok if is_anchor(i)}:
        v, label = min((v, x) for i, x, v in ok if i == a)
        others = [(-dot(v, w), i, x == label) for i, x, w in ok if i != a and len(w) == len(v)]
        for s, p, _ in sorted(o for o in others if o[2])[:k]:
            some = sorted((t, i) for t, i, same in others if not same and share[0] * -s <= share[1] * -t <= share[1] * -s)[:n]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("block,chunk,rounds", [(3, 7, 64 << 20), (512, 2048, 64 << 20), (9, 50, 1)])
def test_negatives_against_brute_force(spark, monkeypatch, block, chunk, rounds):
    monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", rounds)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.4, 6)).round(1).tolist(), int(rng.integers(0, 3))) for i in range(160)]
    rows += [(200, [float("nan")] * 6, 1), (210, None, 1), (220, [1.0, None] * 3, 0), (230, [], 0), (240, [0.5] * 5, 0), (241, [0.5] * 5, 0), (242, [0.4] * 5, 1), (None, [0.1] * 6, 0)]
    rows += [(250, [0.3] * 6, None), (260, rows[0][1], 1), (10, rows[1][1], 2), (260, rows[0][1], 1), (270, [0.0] * 6, 0), (280, [float("inf")] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "'x' as block", "2 as round", "'w' as windows").repartition(3)
    out = hard_negatives.mine(df, df.where("vec_id % 10 = 0"), 3, 4, to_grid=lambda x: F.floor(16 * x), block=block, chunk=chunk)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, out.collect()))
    want = brute_negatives(rows, lambda i: i % 10 == 0, 16, 3, 4)
    assert got == want and len(want) > 50
    assert hard_negatives.mine(df.where("false"), df.where("false")).count() == hard_negatives.mine(df, df.where("false")).count() == 0


def test_scores_beyond_doubles(spark):
    big = 3e8
    rows = [(0, [big, 1.0], 0), (1, [big, 2.0], 0), (2, [big, 1.0], 1), (3, [big - 1, 5.0], 1), (4, [1e200, 1.0], 1), (5, [-big, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, hard_negatives.mine(df, df.where("vec_id = 0")).collect()))
    assert got == brute_negatives(rows, lambda i: i == 0, 1, 5, 5)


# ---- 13: divergence of sources ----


def brute_divergence(rows, least_docs, top):
    words = lambda t: "".join(c if ord(c) > 127 or "a" <= c <= "z" else c.lower() if "A" <= c <= "Z" else " " for c in t).split(" ")
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, own = lang or "", source or "", [w for w in words(text or "") if w]
        groups[lang].add(source)
        counts[lang, source].update(own)
        in_docs[lang].update(set(own))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        total = lambda c: sum(c[t] for t in kept)
        value = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (total(c) + 2 * len(kept)) for t in kept}
        p = {s: value(counts[lang, s]) for s in sources}
        q = value(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, own in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, n + 1) for n, (v, item) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("groups,terms,held", [(2, 3, 5), (16, 4096, 200_000)])
def test_divergence_against_brute_force(spark, odd, monkeypatch, groups, terms, held):
    for name, x in (("GROUPS", groups), ("TERMS", terms), ("HELD", held)):
        monkeypatch.setattr(source_divergence, name, x)
    rng = random.Random(groups)
    texts = [" ".join(rng.choice(["Zebra", "été", "the", "x1y", "Ünï", "日本", "of", "a b", "stop."]) for _ in range(rng.randint(0, 30))) for _ in range(90)]
    rows = [(t, rng.choice([None, "en", "de", ""]), rng.choice([None, "", "s1", "s2", "Émile", "z", "s3"])) for t in texts]
    rows += [("rare words only here", "xx", "s1"), ("", "xx", "s2"), (None, "yy", "lone"), ("the the", "en", "s1"), ("the the", "en", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as n", "'t' as term", "2 as g", "'p' as p0", "3 as doc_id").repartition(3)
    got = sorted(map(tuple, source_divergence.divergence(df, 3, 4).collect()))
    assert got == brute_divergence(rows, 3, 4) and ("xx", "s1", "pair", "s2", 0, 1) in got
    own = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert sorted(map(tuple, source_divergence.divergence(odd, 2, 3).collect())) == brute_divergence(own, 2, 3)


def test_divergence_of_nothing(none):
    out = source_divergence.divergence(none)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_quotients_are_exact(spark):
    rng = random.Random(4)
    pairs = [(a, m) for m in (1, 3, 10**9 + 7, 9 * 10**15) for a in {1, m, max(1, m // 3), rng.randint(1, m)}]
    df = spark.createDataFrame(pairs, "a long, m long").select("a", "m", source_divergence.share("a", "m").alias("p"))
    assert all(r.p == 1 + 10**9 * r.a // r.m for r in df.collect())
