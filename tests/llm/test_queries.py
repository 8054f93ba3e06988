import pytest

from covenant.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.test_oracle_parity import _rows

CONTRACT = {
    1: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    2: "doc_id n_bytes n_removed n_spans kept_sha256",
    3: "query_id rank vec_id score",
    4: "doc_id n_words n_base first_word last_word base_labels labels score",
    5: "doc_id size source_size target taken",
    6: "page_id payload_bytes payload_digest record_type refers_to",
    7: "doc_id keep_id group_size kept text_sha256",
    8: "doc_id fingerprint component_id",
    9: "doc_id held_out lang_pred score",
    10: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    11: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    12: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    13: "query_id rank vec_id score",
}
LONG = set("doc_id n_email n_ip n_card n_phone n_bytes n_removed n_spans query_id vec_id n_words n_base first_word last_word size source_size taken "
           "page_id payload_bytes refers_to keep_id group_size component_id start length ids_crc32 doc_tokens sequence_id offset "
           "conv_id gaps blank duplicate truncated illegal cost depth parent_conv_id n_convs n_children n_leaves saved_tokens".split())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_columns_and_rows(spark, name):
    df = Q.QUERIES[name](spark, SF_SMALL)
    types = dict(df.dtypes)
    for c in CONTRACT[int(name[2:].split("_")[0])].split():
        if c in LONG:
            assert types[c] == "bigint", c
        else:
            assert types[c] in ("string", "double", "boolean", "int", "bigint"), c
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    rows = df.count()
    number = int(name[2:].split("_")[0])
    if number < 10 and number not in (3, 6):
        assert rows == docs
    elif number == 11:
        assert rows == spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id").distinct().count()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF_SMALL)
    res = duck.execute(Q.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, res.fetchall())
