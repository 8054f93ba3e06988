import zlib

import pytest

from covenant.llm import lang_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", L.held_out().alias("h"))
    out = L.predict(rows, L.fit(docs), ("doc_id", "lang", "h")).collect()
    assert len(out) == docs.count()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["h"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.96
    assert all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["rejected"] for r in out) <= 0.03 * len(out)


def test_accuracy_by_length(spark):
    """One level for every length; held-out documents of sf0.1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = L.predict(docs.select("lang", "text", L.held_out().alias("h"), docs.text.alias("t")).filter("h"), L.fit(docs), ("lang", "t")).collect()
    right = {True: [], False: []}
    for r in out:
        n = len(L.letters(r["t"] or ""))
        if n:
            right[n < 60].append(r["lang"] == r["lang_pred"])
    assert sum(right[False]) / len(right[False]) >= 0.98 and sum(right[True]) / len(right[True]) >= 0.75


def test_every_prediction_equals_a_plain_encoder(documents):
    """The same dictionaries, each text's blocks encoded one by one."""
    import zstandard

    model = L.fit(documents)
    out = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"], r["rejected"]) for r in L.predict(documents.withColumn("copy", documents.text), model, ("doc_id", "copy")).withColumnRenamed("copy", "text").collect()}
    how = {k: zstandard.ZstdCompressionParameters.from_level(L.LEVEL, dict_size=len(v), source_size=L.BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False) for k, v in model.items()}
    for r in documents.collect():
        raw = L.letters(r["text"] or "")
        if not any(c.isalpha() for c in r["text"] or ""):
            assert out[r["doc_id"], r["text"]] == ("und", 0.0, True)
            continue
        sizes = []
        for k, v in model.items():
            encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how[k])
            sizes.append((sum(len(encoder.compress(raw[i:i + L.BLOCK])) for i in range(0, len(raw), L.BLOCK)), k))
        (best, lang), (second, _) = sorted(sizes)[:2]
        assert out[r["doc_id"], r["text"]] == (lang, 1 - best / second, 1 - best / second < L.MARGIN)


def test_a_sample_is_taken_from_anywhere_in_a_text(spark):
    """The language stands behind a long head of something else."""
    head = "zz " * 4000
    rows = [(10_000_000 + i, head + f"ovo je poruka broj {i} o vremenu i moru " * 200, "hr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert b"vremenu" in L.fit(df)["hr"]


def test_too_many_labels_are_an_error(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "'words' as text", "concat('l', id % 10000) as lang")
    with pytest.raises(ValueError, match="more than 256"):
        L.fit(df)


def test_nothing_held_out_is_learned(spark, documents):
    """What differs between the documents comes from those that are not held out."""
    marked = documents.selectExpr("doc_id", "concat('word', doc_id, 'x ', text) as text", "lang").filter("length(text) < 1500")
    marked = marked.selectExpr("doc_id", "translate(text, '0123456789', 'abcdefghij') as text", "lang")
    held = {r["doc_id"] for r in marked.filter(L.held_out()).collect()}
    digits = str.maketrans("0123456789", "abcdefghij")
    learned = b" ".join(L.fit(marked).values()).split()
    words = {r["doc_id"]: f"word{r['doc_id']}x".translate(digits).encode() for r in marked.collect()}
    assert not any(words[d] in learned for d in held) and any(words[d] in learned for d in words if d not in held)


def test_odd_rows(odd, documents):
    out = L.predict(odd, L.fit(documents), ("doc_id", "key"))
    assert out.columns == ["doc_id", "key", "lang_pred", "score", "rejected"]
    found = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd.count()
    for doc in (2, 3, 4, 6):
        assert (found[doc]["lang_pred"], found[doc]["score"], found[doc]["rejected"]) == ("und", 0.0, True)
    kept = L.identified(odd)
    assert kept.columns == odd.columns


def test_without_training_rows(empty, odd):
    assert L.fit(empty) == {}
    assert {r["lang_pred"] for r in L.predict(odd, {}).collect()} == {"und"}
    assert L.predict(empty, {}, ("doc_id",)).count() == 0


def test_every_block_counts(documents):
    compressors = L._compressors(tuple(L.fit(documents).items()), L.LEVEL)
    rows = {r["lang"]: r["text"] for r in documents.filter("length(text) > 3000").collect()}
    short, long = L.letters(rows["en"])[:3000].decode(), L.letters(rows["de"])[:3000].decode(errors="ignore")
    assert L.classify(short + " " + (long + " ") * 20, compressors)[0] == "de"


def test_languages_with_short_texts_only_are_learned(spark, documents):
    """Latin titles, unsegmented lines, and one text that starts with figures."""
    latin = ["arma virumque cano troiae qui primus ab oris", "italiam fato profugus laviniaque venit litora",
             "multum ille et terris iactatus et alto", "vi superum saevae memorem iunonis ob iram"]
    chinese = ["学而时习之不亦说乎", "有朋自远方来不亦乐乎", "人不知而不愠不亦君子乎"]
    late = "7 " * 1000 + "ovo je kratka poruka o vremenu i moru"
    rows = [(10_000_000 + i, t, k) for k, own in (("la", latin), ("zh", chinese), ("hr", [late])) for i, t in enumerate(own * 30)]
    short = spark.createDataFrame([*rows, (1, "", "xx"), (2, "123 --", "xx")], "doc_id long, text string, lang string")
    assert {len(t) >= 200 for _, t, k in rows if k != "hr"} == {False}
    for docs in (short, short.unionByName(documents.select("doc_id", "text", "lang"))):
        model = L.fit(docs)
        assert {"la", "zh", "hr"} <= set(model) and "xx" not in model
        compressors = L._compressors(tuple(model.items()), L.LEVEL)
        for lang, text in (("la", latin[1]), ("zh", chinese[1]), ("hr", late)):
            assert L.classify(text, compressors)[0::2] == (lang, False)
    kept = L.identified(short)
    assert kept.count() == len(rows)
