from covenant.functions.text import initcap_trim, is_identifier, lower_trim, minutes_between


def test_initcap_follows_word_runs(spark):
    df = spark.createDataFrame([(" o'brien-smith ",), ("mcDONALD jr",), (None,), ("ÉCOLE du-nord",)], "s string")
    got = [r[0] for r in df.select(initcap_trim("s")).collect()]
    assert got == ["O'Brien-Smith", "Mcdonald Jr", None, "École Du-Nord"]


def test_lower_trim_keeps_tabs(spark):
    df = spark.createDataFrame([("  A\t ",)], "s string")
    assert df.select(lower_trim("s")).first()[0] == "a\t"


def test_identifier_rule(spark):
    df = spark.createDataFrame([("order_id",), ("_x",), ("__",), ("a-b",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(is_identifier("s")).collect()] == [True, True, False, False, False, False]


def test_minutes_between_in_any_session_zone(spark):
    sql = "SELECT TIMESTAMP_NTZ '2024-03-31 04:00:00.25' AS a, TIMESTAMP_NTZ '2024-03-31 00:30:00' AS b"
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin", "America/New_York"):  # Berlin skips an hour in between
            spark.conf.set("spark.sql.session.timeZone", z)
            assert spark.sql(sql).select(minutes_between("a", "b")).first()[0] == 210 + 0.25 / 60
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_identifier_rule_is_the_same_on_the_driver(spark):
    from covenant.operators.checks import _valid_ident
    names = ["order_id", "größe_am", "_x", "__", "a-b", "a b", "", "9lives", "x\n", "日付"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(is_identifier("s")).collect()] == [_valid_ident(n) for n in names]


def test_to_utc_timestamp_ntz(spark):
    from datetime import datetime

    from covenant.functions.text import to_utc_timestamp_ntz
    df = spark.createDataFrame([("2024-01-01T10:00:00",), ("2024-01-01T10:00:00+02:00",), ("2024-01-01 10:00:00Z",), ("2024-01-01",), ("soon",), (None,)], "s string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = [r[0] for r in df.select(to_utc_timestamp_ntz("s")).collect()]
            assert got == [datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 10), datetime(2024, 1, 1), None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_initcap_matches_word_rule_on_random_text(spark):
    import re

    from hypothesis import given, settings
    from hypothesis import strategies as st

    def pg_initcap(s):
        out, prev_alnum = [], False
        for ch in s.lower():
            out.append(ch.upper() if ch.isalnum() and not prev_alnum else ch)
            prev_alnum = ch.isalnum()
        return "".join(out)

    samples = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="abcXYZ019 '-_.\t", max_size=20))
    def collect(s):
        samples.append(s)

    collect()
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    from covenant.functions.text import initcap_words
    got = [r[0] for r in df.select(initcap_words("s")).collect()]
    assert got == [pg_initcap(s) for s in samples]
    assert all(re.fullmatch(r"[^a-z]?.*", g or "") for g in got)
