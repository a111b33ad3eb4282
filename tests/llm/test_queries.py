import glob
import os

import pytest

from tablewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

COLUMNS = {
    "op1_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_": "doc_id held_out score predicted",
    "op3_": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_": "doc_id n_shingles component_id",
    "op7_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_": "page_id payload_bytes payload_digest record_type refers_to",
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_columns(spark, prefix):
    (name,) = [q for q in QUERIES if q.startswith(prefix)]
    want = COLUMNS[prefix].split()
    assert QUERIES[name](spark, SF).columns[: len(want)] == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
