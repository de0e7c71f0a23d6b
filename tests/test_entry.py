import duckdb
import pytest

import __spark_entry__ as e
from lodestrata.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
#: A query of each family, compared with its SQL at the smallest scale; the driver compares all.
SAMPLE = ["group_three_keys", "describe_orders", "bm25_topk", "rerank", "rrf_fused", "boilerplate_lines", "overlap_spans", "claim_coverage", "screen_inputs", "rate_limit_users", "validate_events", "fold_requests", "retrieval_debug", "search_segments", "verdicts", "judged_grounding", "csv_dataset", "event_frames", "ingested_documents", "headings", "dataset_checksums", "checked_operations", "fold_requests_stream"]


def test_entry_gives_ranked_contexts(spark):
    out = e.entry(spark)
    assert out.columns[:3] == ["query_id", "rank", "chunk_id"] and out.where("rank = 1").count() > 0


def test_registry():
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, name, tmp_path):
    QUERIES[name](spark, SMALL).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    c.sql(f"CREATE TABLE a AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    c.sql(f"CREATE TABLE b AS {ORACLES[name]}")
    columns = ", ".join(sorted(f'"{r[0]}"' for r in c.sql("DESCRIBE a").fetchall()))
    assert c.sql(f"(SELECT {columns} FROM a EXCEPT ALL SELECT {columns} FROM b) UNION ALL (SELECT {columns} FROM b EXCEPT ALL SELECT {columns} FROM a)").fetchall() == []
