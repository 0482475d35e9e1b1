"""Each query of the operators on whole tables: columns of its contract, a row for each row, SQL where there is one."""

import zlib
from pathlib import Path

import duckdb
import pytest

from logloom.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_sstable": "doc_id start n_tokens ids_crc32",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_templates": "page_id url text n_chars",
    "op5_ogg": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_langid": "doc_id held_out lang_pred score",
    "op7_knn": "query_id rank vec_id score",
    "op8_quality": "doc_id held_out score predicted",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_simhash": "doc_id fingerprint component_id",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, db, name):
    found = queries.queries()[name](spark, DATA)
    rows = found.collect()
    assert set(COLUMNS[name].split()) <= set(found.columns)
    if name != "op7_knn":
        key, table = ("page_id", "pages") if name == "op4_templates" else ("doc_id", "documents")
        assert sorted(r[key] for r in rows) == sorted(i for (i,) in db.execute(f"SELECT {key} FROM {table}").fetchall())
    part = {"op6_langid": (4, 2), "op8_quality": (3, 1)}.get(name)
    if part:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % part[0] == part[1]) for r in rows)
    if name in queries.oracle_sql():
        wanted = db.execute(queries.oracle_sql()[name])
        names = [d[0] for d in wanted.description]
        assert sorted(names) == sorted(found.columns)
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(map(plain, w)) for w in wanted.fetchall())


def test_languages_and_quality_hold_on_documents_that_were_not_learned_from(spark, db):
    truth = dict(db.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    held = [r for r in queries.op6_langid(spark, DATA).collect() if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
