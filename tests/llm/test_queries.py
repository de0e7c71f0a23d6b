import random
from collections import Counter
from fractions import Fraction

import public_tokenizers
import sentencepiece
from test_text_ops import brute_components, brute_hits

import corpus_pipeline
from lodestrata.llm import language_id
from lodestrata.llm._shared import table
from lodestrata.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        left = docs.count()
        assert 0.4 * count <= left <= count, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == left and all(r.decoded == r.text for r in last.collect())


def test_stages_against_brute_force_with_null_and_shared_ids(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and"]) + f" w{rng.randint(0, 10**6)}" for _ in range(n // 2))
    a, b, c = prose(60), prose(60), prose(60)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leak = next(t for _, t in items if t and len(t.split()) >= 12)
    # copies of an id's text under null and under a shared id; clean ones under the same
    texts = [(1, a), (None, a + " tail"), (None, prose(60)), (None, None), (2, b), (3, b + " tail"), (3, prose(60)), (3, c), (4, c + " tail"), (None, leak + " " + prose(60)), (None, prose(70)), (5, leak + " " + prose(60)), (5, prose(70)), (6, ""), (6, "123 456")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name, d=docs: Counter((r.doc_id, r.text) for r in stages[name](spark, d, SMALL).collect())

    components = Counter()
    for i, _, name in brute_components(texts, 5, Fraction(8, 10)):
        components[i, name] += 1
    got = left("ngram_join")
    assert sum(got.values()) == sum(n for (i, name), n in components.items() if name is None or i == name)
    assert got == Counter(x for x in texts if x not in {texts[1], texts[5], texts[8]})
    assert left("decontaminate") == Counter((i, t) for i, t in texts if not brute_hits(t, items, 10)[1])
    model = language_id.train(table(spark, SMALL, "documents"))
    apart = spark.createDataFrame(list(enumerate(t for _, t in texts)), "doc_id long, text string")
    known = {r.doc_id for r in language_id.identify(apart, model, lang_pred="p", score="q").where(f"p != 'und' and q >= {corpus_pipeline.MIN_SCORE}").collect()}
    assert left("language_id") == Counter(x for i, x in enumerate(texts) if i in known)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in stages["piece_codec"](spark, docs, SMALL).collect()) == sorted((str(i), tuple(library.encode(t or ""))) for i, t in texts)

    # line dedup: a passage goes from all rows but the first in order of (id, text), whatever they share
    passage = "\n".join(prose(20) for _ in range(4))
    rows = [(i, f"{prose(12)}\n{passage}\n{prose(12)}") for i in (None, None, 7, 7, 8)] + [(None, prose(12)), (7, prose(12)), (7, None)]
    out = left("line_dedup", spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema))
    whole = [x for x in rows if x in out and passage in (x[1] or "")]
    assert len(whole) == 1 and whole[0][0] is None
    assert out == Counter(x if x == whole[0] else (x[0], x[1].replace(passage + "\n", "")) for x in rows if x[1])
