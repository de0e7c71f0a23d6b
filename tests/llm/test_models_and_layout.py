import base64
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from lodestrata.llm import language_id, quality_rules, shard_packing, token_counts, topk_search
from lodestrata.llm._shared import byte_chunks
from lodestrata.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"

# ---- 6: top-k ----


@pytest.mark.parametrize("block,k,most", [(7, 3, 1), (1000, 20, 64 << 20)])
def test_best_scores_against_brute_force(spark, monkeypatch, block, k, most):
    monkeypatch.setattr(topk_search, "BROADCAST_BYTES", most)  # 1: each block of queries in a round of its own
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(0, 0.3, 8).round(2).tolist()) for i in range(90)]
    rows += [(90, [float("nan")] * 8), (91, None), (92, [1.0, None] * 4), (93, []), (94, [0.5] * 5), (None, [0.1] * 8), (95, rows[0][1]), (0, rows[1][1]), (96, [float("inf")] * 8), (100, [1e18] * 8), (101, [-1e18] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'d' as dim", "1 as block", "2 as id", "'v' as vector", "0 as round").repartition(3)
    grid = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            grid.setdefault(i, []).append([int(np.floor(64 * x)) for x in v])
    got = {}
    for r in topk_search.top_k(df, df.where("vec_id % 10 = 0"), k, lambda x: F.floor(64 * x), block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in [i for i in grid if i % 10 == 0]:
        v = min(grid[q])
        cut = lambda x: max(min(x, 2**63 - 1), -(2**63) + 2)
        scores = [(-cut(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, own in grid.items() if i != q for w in own if len(w) == len(v)]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]


def test_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert topk_search.top_k(df, df.where("false")).count() == 0 and topk_search.top_k(df, df).count() == 0


# ---- 5: sharding ----


def test_tree_against_a_sorted_list():
    rng, tree, held = random.Random(1), shard_packing.Tree(), set()
    for i in range(800):
        if held and rng.random() < 0.4:
            key = rng.choice(sorted(held))
            held.remove(key)
            tree.remove(key)
        else:
            key = (rng.randrange(50), i)
            held.add(key)
            tree.insert(key)
        bound = (rng.randrange(55), -1)
        assert tree.ceiling(bound) == min((k for k in held if k >= bound), default=None)


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 40))]
        bins, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(left, b) for b, left in enumerate(bins) if left >= sizes[i]]
            if not fits:
                bins.append(100)
                fits = [(100, len(bins) - 1)]
            b = min(fits)[1]
            bins[b] -= sizes[i]
            want.append((i, b))
        runs = shard_packing.pack(Counter(sizes), 100)
        got = Counter((size, at) for size, own in runs.items() for at, n in own for _ in range(n))
        assert got == Counter((sizes[i], at) for i, at in want)
        assert shard_packing.pack(Counter(sizes), 100, len(bins) - 1) is None


def spread_evenly(sizes: list[int], shards: int) -> list[int]:
    """What each bin holds if each item, largest first, goes to the least filled one."""
    heap = [0] * shards
    for size in sorted(sizes, reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    return heap


def test_even_packing_with_giants():
    rng = random.Random(3)
    for sizes in ([1000] + [rng.randint(1, 9) for _ in range(300)], [5], [], [7] * 8, [rng.randint(1, 500) for _ in range(400)], [1000, 1000, 1000] + [3] * 900):
        runs = shard_packing.pack_evenly(Counter(sizes), 8)
        fill = Counter()
        for size, own in runs.items():
            assert sum(n for _, n in own) == sizes.count(size)
            for at, n in own:
                fill[at] += n * size
        assert set(fill) <= set(range(8)) and max(fill.values(), default=0) <= 1.02 * max(spread_evenly(sizes, 8)) + 1
    assert {at for own in shard_packing.pack_evenly(Counter([1000] + [5] * 70), 8).values() for at, _ in own} == set(range(8))


def test_shards_of_a_given_capacity(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([0, 3, 9, 30, 30, 60, 99, 150]) + str(i % 90)) for i in range(300)]
    got = shard_packing.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), None, capacity=140).collect()
    groups, fill = Counter(), Counter()
    for r in got:
        groups[r.group] += r["size"]
        fill[r.shard] += r["size"]
    large = [x for x in groups.values() if x > 140]
    assert len(got) == 300 and sorted(fill) == list(range(len(fill))) and sorted(x for x in fill.values() if x > 140) == sorted(large) and large
    least = len(large) + -(-sum(x for x in groups.values() if x <= 140) // 140)
    assert least <= len(fill) <= 1.4 * least + 1


def test_the_query_packs_whole_groups(spark):
    got = QUERIES["op5_shard_packing"](spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    place, slots, fill, groups = {}, {}, Counter(), Counter()
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert place.setdefault(docs[r.doc_id], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        fill[r.shard] += r["size"]
        groups[docs[r.doc_id]] += r["size"]
    assert set(fill) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(fill.values()) <= max(1.01 * sum(fill.values()) / 8, max(groups.values()))


def test_shards_of_odd_rows(spark, odd, none):
    rows = [(i, f"text {i % 30} " * (i % 30 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).withColumn("slot", F.lit("x")).withColumn("shard", F.lit("y"))
    got = shard_packing.shard_documents(df, 8).collect()
    assert len(got) == df.count() and shard_packing.shard_documents(none, 8).count() == 0
    shards, fill = {}, {}
    for r in got:
        shards.setdefault(r.group, set()).add(r.shard)
        fill.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in shards.values()) and all(sorted(x) == list(range(len(x))) for x in fill.values())
    texts = {r.doc_id: r.text for r in spark.createDataFrame(rows, "doc_id long, text string").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id]) + 1 for r in got if r.doc_id is not None and r.doc_id > 20)


# ---- 3: token counts ----


def brute_totals(batches):
    held, seen = {}, set()
    for name, rows in batches:
        if name in seen:
            continue
        seen.add(name)
        last = {}
        for r in rows:
            last[(r[0], r[3])] = r
        for k, (d, s, g, t, op, n) in last.items():
            if op == "insert" or (op == "revise" and k in held):
                held[k] = (s, g, t, n or 0)
            elif op == "delete":
                held.pop(k, None)
    out = {}
    for s, g, t, n in held.values():
        c = out.setdefault((s, g, t), [0, 0])
        c[0] += 1
        c[1] += n
    return sorted(((*k, *v) for k, v in out.items()), key=str)


CHANGE = "doc_id long, source string, lang string, tokenizer string, op string, n_tokens long"


def test_totals_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rollup, batches = token_counts.Rollup(spark, f"file://{tmp_path}/r"), []
    assert rollup.totals().count() == 0
    for b in range(4):
        rows, used = [], set()
        for _ in range(25):
            key = (rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["v1", "v2", None]))
            if key not in used:
                used.add(key)
                rows.append((key[0], rng.choice(["a", None]), rng.choice(["en", None]), key[1], rng.choice(["insert", "insert", "revise", "delete"]), rng.choice([None, 0, 5, 9])))
        batches.append((f"b{b}", rows))
        assert rollup.commit(f"b{b}", spark.createDataFrame(rows, CHANGE))
        assert not rollup.commit(f"b{b}", spark.createDataFrame(rows, CHANGE))
        assert sorted((tuple(r) for r in rollup.totals().collect()), key=str) == brute_totals(batches)
    assert rollup.commit("empty", spark.createDataFrame([], CHANGE))
    assert sorted((tuple(r) for r in rollup.totals().collect()), key=str) == brute_totals(batches)


def test_broken_commits_do_not_count(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([(1, "a", "en", "v", "insert", 5)], CHANGE)
    rollup.commit("b", rows)
    (tmp_path / "r/sums/b/_SUCCESS").unlink()  # as if the writer had died before its marker
    assert rollup.totals().count() == 0 and rollup.commit("b", rows) and rollup.totals().head().n_tokens == 5


def test_counts_by_real_tokenizers(odd):
    got = token_counts.counted(odd.select("doc_id", "text"), {n: public_tokenizers.path(f) for n, f in token_counts.TOKENIZERS.items()}).collect()
    pieces, marks = real_counters()
    assert all((r["piece_bpe_32k"], r["byte_bpe_50k"]) == (pieces(r.text), marks(r.text)) for r in got) and len(got) == odd.count()


def real_counters():
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (lambda t: len(library.encode(t or ""))), (lambda t: len(other.encode_ordinary(t or "")))


def test_the_query_counts_with_real_tokenizers(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    first, want = {}, {}
    for r in rows:
        if r.text is not None:
            first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    license_line = re.compile(token_counts.LICENSE.replace("(?m)", ""), re.M)
    for name, count in zip(("piece_bpe_32k", "byte_bpe_50k"), real_counters(), strict=True):
        for r in rows:
            if r.text is None or first[r.text] == r.doc_id:
                n_docs, n_tokens = want.get((r.source, r.lang, name), (0, 0))
                want[r.source, r.lang, name] = (n_docs + 1, n_tokens + count(license_line.sub("", r.text or "")))
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in QUERIES["op3_token_counts"](spark, SMALL).collect()}
    assert got == want


def test_the_same_key_twice_in_a_batch(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    rows = [(1, "a", "en", "v", "insert", 5, 1), (1, "a", "en", "v", "revise", 7, 3), (1, "a", "en", "v", "delete", 0, 2), (2, "a", "en", "v", "insert", 4, 1), (2, "a", "en", "v", "insert", 4, 1)]
    rollup.commit("b", spark.createDataFrame(rows, CHANGE + ", at int"), "at")
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 4)]  # the revision is the last of document 1, which is not held


# ---- 10: languages ----

TONGUES = {"en": "the and of this with thing nder ation", "de": "der und mit nicht heit keit über schön", "fr": "le et dans être très près pour queue"}


def sentences(rng, lang, n):
    return "\n".join(" ".join(rng.choice(TONGUES[lang].split()) + rng.choice(["", "er", "s"]) for _ in range(12)) for _ in range(n))


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(i, sentences(rng, lang, 4), lang) for i, lang in enumerate(list(TONGUES) * 60)], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(speech):
    return language_id.train(speech.where(~language_id.held_out("doc_id")), per_lang=40)


def test_held_out_accuracy(speech, model):
    got = language_id.identify(speech.where(language_id.held_out("doc_id")), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) > 0 and all(0 <= r.score <= 1 for r in got)


def test_switches_inside_a_line(model):
    text = "the and of this with the thing and of this der und mit nicht heit der schön und mit nicht"
    ((_, _, data, offsets),) = byte_chunks(pa.array([text], pa.large_string()))
    words = language_id.read_words(data, offsets)
    prob, _ = model.marginals(model.scores(words, model.entries(words)), words.chain)
    best = [model.langs[k] for k in prob.argmax(1)]
    assert best[:9] == ["en"] * 9 and best[-9:] == ["de"] * 9


def test_marginals_against_all_paths(model):
    import itertools

    rng = np.random.default_rng(0)
    scores, n = rng.normal(size=(4, 3)).astype(np.float32), 3
    total = np.zeros((4, 3))
    for path in itertools.product(range(n), repeat=4):
        w = np.exp(sum(scores[t, k] for t, k in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, k in enumerate(path):
            total[t, k] += w
    want = total / total.sum(1, keepdims=True)
    chain = np.concatenate([np.zeros(4, int), np.ones(1, int), np.full(4, 2)])
    got, _ = model.marginals(np.concatenate([scores, scores[:1], scores]), chain)
    assert np.allclose(got[:4], want, atol=1e-4) and np.allclose(got[5:], want, atol=1e-4)


def test_languages_of_odd_rows(odd, none, model):
    got = language_id.identify(odd, model, score="sure")
    with pytest.raises(ValueError, match="score"):
        language_id.identify(odd, model)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(got.columns) and language_id.identify(none.drop("score"), model).count() == 0
    assert all((r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text))) for r in rows)
    assert language_id.train(none) is None and {r.lang_pred for r in language_id.identify(odd.drop("score"), None).collect()} == {"und"}


# ---- 7: quality ----


def test_rules_tell_junk_apart(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice("the and of this with thing alpha beta gamma delta".split()) for _ in range(60)) + "."
    junk = [lambda: "BUY!! NOW!! " * 30, lambda: "spam spam spam " * 25, lambda: " | ".join(rng.choice(["aa", "bb"]) for _ in range(60))]
    rows = [(i, good() if i % 2 else rng.choice(junk)(), i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.score_quality(docs, labels).collect()}
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held) > 0


def test_statistics_against_plain_python():
    texts = ["Ab ab! ab\nab ab! ab\n", "É 12 ***", "", None, "x.y, z"]
    ((_, _, data, offsets),) = byte_chunks(pa.array(texts, pa.large_string()))
    got = quality_rules.measure(data, offsets)
    names = quality_rules.STATISTICS
    row = dict(zip(names, got[0], strict=True))
    assert row["log_words"] == np.log1p(6) and row["distinct_of_words"] == 3 / 6 and row["distinct_of_lines"] == 1.0 and row["upper_of_letters"] == 1 / 12 and row["tailed_of_words"] == 2 / 6 and row["stuttered_of_words"] == 1 / 6
    assert not got[2].any() and not got[3].any() and dict(zip(names, got[1], strict=True))["bare_of_words"] == 2 / 3
    assert all(np.allclose(quality_rules.measure(d, o), got[a:b]) for a, b, d, o in byte_chunks(pa.array(texts, pa.large_string()), 1))


@pytest.mark.parametrize("values,score", [([], 0.5), ([1, 1], 0.99)])
def test_labels_of_one_value(spark, odd, values, score):
    labels = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "doc_id long, quality int")
    got = quality_rules.score_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(abs(r.score - score) < 1e-9 for r in got)
