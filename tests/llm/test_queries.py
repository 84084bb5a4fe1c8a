"""The registered queries on the small tables: contract columns, and SQL where there is some."""
import duckdb
import pytest

from hostgraph.llm.queries import LLM

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"],
    "op2": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_one_query_per_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in LLM) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(q for q in LLM if q.split("_")[0] in COLUMNS and not q.startswith("op5_")))
def test_contract_columns(spark, name):
    df = LLM[name][0](spark, SF)
    assert df.columns[:len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]]


@pytest.mark.parametrize("name", sorted(q for q in LLM if LLM[q][1]))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(LLM[name][1])
    names = [c[0] for c in rel.description]
    df = LLM[name][0](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted([tuple(r[c] for c in names) for r in df.collect()], key=repr)
    assert got == sorted(rel.fetchall(), key=repr) and got
