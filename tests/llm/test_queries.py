"""The queries themselves: columns, rows and what their contracts say of every row."""

import zlib

import pytest

from verdigris.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op3_near_dup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
}
HOLDS = {
    "op2_sharding": lambda r: r["law"] == "bytes" and 0 <= r["shard"] < 24 and r["slot"] >= 0 and r["grown_shard"] is None,
    "op3_near_dup": lambda r: r["kept"] == (r["doc_id"] == r["component_id"]) and r["component_id"] <= r["doc_id"],
    "op4_mixing": lambda r: 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6,
    "op6_quality": lambda r: not (r["kept"] and r["base_failed"]) and r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]),
    "op7_language": lambda r: 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2),
    "op8_toxicity": lambda r: 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    rows = queries.queries()[name](spark, FOLDER).collect()
    assert COLUMNS[name] <= set(rows[0].asDict()) and all(HOLDS[name](r) for r in rows)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
