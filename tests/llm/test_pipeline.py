import sys

import corpus_pipeline as C
import __spark_entry__ as E
from covenant.llm import lang_id

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents):
    from tests.llm.test_simhash import brute as near

    docs = documents
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(C.STAGES)

    one = stage["language ID"](spark, docs, SF)
    assert one.columns == docs.columns
    rejected = {r["doc_id"] for r in lang_id.predict(docs, lang_id.fit(docs), ("doc_id",)).filter("rejected").collect()}
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == set(rows) - rejected

    two = stage["exact dedup"](spark, one, SF)
    last = {}
    for d in sorted(kept):
        last[rows[d]["text"] or ""] = d
    got = {r["doc_id"]: r for r in two.collect()}
    assert set(got) == set(last.values()) and all(got[d] == rows[d] for d in got)

    three = stage["SimHash near-dedup"](spark, two, SF)
    exp = {c for _, _, c in near([(d, rows[d]["text"]) for d in sorted(got)])}
    assert {r["doc_id"] for r in three.collect()} == exp and three.count() == len(exp)

    four = stage["source mix"](spark, three, SF)
    words = lambda x: sum(len((r["text"] or "").split()) for r in x)
    assert four.columns == docs.columns
    assert abs(words(four.collect()) - words(three.collect())) <= 10

    five = stage["packing"](spark, four, SF)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}


def test_run(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_entry_works_without_this_subpackage(monkeypatch):
    real = E.find_spec
    monkeypatch.setattr(E, "find_spec", lambda name: None if "llm" in name or "corpus" in name else real(name))
    assert not any(n.startswith("op") and n[2].isdigit() for n in E.queries()) and "pipeline" not in E.queries()
    assert "pipeline" not in E.oracle_sql()


def test_nothing_else_imports_it():
    import pathlib
    import re

    top = pathlib.Path(C.__file__).parent / "covenant"
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert not re.search(r"covenant\.llm|from \.+llm", path.read_text()), path
    assert sys.modules["corpus_pipeline"]
