import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from lodestrata.functions import text as tx


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_queries_lose_request_and_source_phrases(spark):
    got = column(spark, ["  Please find the ORION-30 policy in my documents. ", "Find the refund policy in my documents.", "show me", "?!", "Straße in PDFs"], tx.normalize_query)
    assert got == ["the orion-30 policy", "the refund policy", "show me", "?!", "strasse"]


def test_tokens_keep_order_and_repeats(spark):
    got = column(spark, ["Refund ORION-30 the a.b_c", "Straße ﬁne refund refund", ""], tx.tokenize)
    assert got == [["refund", "orion-30", "a.b_c"], ["strasse", "fine", "refund", "refund"], []]
    assert column(spark, ["What is the Policy-7?"], tx.normalized_phrase) == ["what is the policy-7"]


def test_estimates_agree_with_a_unicode_pattern(spark):
    texts = ["Él no’s here-and-now, 3.5% …", "naïve—Ça va?", "", "a_b c'd"]
    assert column(spark, texts, tx.estimate_tokens) == [len(re.findall(r"\w+(?:['’-]\w+)*|[^\w\s]", t)) for t in texts]


def test_blocks_are_put_on_one_line(spark):
    assert column(spark, ["some­thing hyphen-\nated\r\nline  end "], tx.normalize_block) == ["something hyphenated line end"]


def test_filenames(spark):
    got = column(spark, ["C:\\docs\\a.pdf", "x/y/ b.pdf ", "", "bad\u0007.pdf", "n" * 256], tx.safe_filename)
    assert got == ["a.pdf", "b.pdf", None, None, None]


def test_routes_by_priority(spark):
    got = column(spark, ["What does the policy say?", "Which clip shows it?", "average revenue", "hello there", "Compare the sales in the report", "database"], tx.route)
    assert got == ["document_search", "video_search", "data_analytics", "direct_answer", "data_analytics", "direct_answer"]


def test_ids_and_fingerprints(spark):
    row = spark.range(1).select(tx.chunk_id(F.lit("d"), F.lit(2), F.lit(3), F.lit("täxt")).alias("c"), tx.segment_id(F.lit("v"), F.lit(0.0), F.lit(2.5)).alias("s"), tx.fingerprint(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b"))).alias("f")).head()
    assert row.c == "chunk_" + hashlib.sha256("d:2:3:täxt".encode()).hexdigest()[:24]
    assert row.s == "segment_" + hashlib.sha256(b"v:0.000:2.500").hexdigest()[:24]
    assert row.f == hashlib.sha256(b'{"a":1,"b":"x"}').hexdigest()


def test_relevance_is_the_share_of_terms_met(spark):
    df = spark.createDataFrame([("refunds take 30 days", ["30 days", "refunds", "cash"])], "a string, t array<string>")
    assert abs(df.select(tx.relevance_proxy(F.col("a"), F.col("t"))).head()[0] - 2 / 3) < 1e-9


def test_folding_is_nfkc_and_casefold(spark):
    values = ["ＡＢＣ", "ǅ", None, "İ"]
    assert column(spark, values, tx.fold_text) == [None if v is None else unicodedata.normalize("NFKC", v).casefold() for v in values]
