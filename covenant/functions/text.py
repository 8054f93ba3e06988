"""Scalar column functions (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of letters/digits; everything else separates words
# (PostgreSQL INITCAP rule: a letter after any non-alphanumeric is upper).
_WORD_OR_GAP = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"
# Identifier rule of the contract models: underscores allowed, the rest
# alphanumeric, at least one non-underscore character.
IDENTIFIER_PATTERN = r"^_*[\p{L}\p{N}][\p{L}\p{N}_]*\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower_trim(x) -> Column:
    """FN1: LOWER(TRIM(x)); trims blanks only, like SQL TRIM."""
    return F.lower(F.trim(_c(x)))


def upper_trim(x) -> Column:
    """FN3: UPPER(TRIM(x))."""
    return F.upper(F.trim(_c(x)))


def initcap_words(x) -> Column:
    """FN2: PostgreSQL-style INITCAP: lower everything, then upper-case the
    first character of every alphanumeric run (``o'brien-smith`` ->
    ``O'Brien-Smith``). ``F.initcap`` splits on blanks only."""
    parts = F.regexp_extract_all(F.lower(_c(x)), F.lit(_WORD_OR_GAP), 1)
    return F.when(_c(x).isNull(), F.lit(None)).otherwise(
        F.array_join(
            F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                 F.substring(w, 2, 1 << 30))),
            "",
        ))


def initcap_trim(x) -> Column:
    """FN2 applied after TRIM, as the customer staging model does."""
    return initcap_words(F.trim(_c(x)))


def _micros(x: Column) -> Column:
    """Microseconds of a time without zone, whatever the session's zone."""
    t = x.cast("timestamp_ntz")
    seconds = F.unix_date(F.to_date(t)).cast("bigint") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def minutes_between(later, earlier) -> Column:
    """FN6: EXTRACT(EPOCH FROM later - earlier) / 60.0 as double.

    Works on TIMESTAMP (as the session's zone shows it) and TIMESTAMP_NTZ; a
    change of summer time in that zone adds nothing."""
    return (_micros(_c(later)) - _micros(_c(earlier))) / F.lit(60_000_000.0)


def is_identifier(x) -> Column:
    """FN11: identifier check used for table, column and timestamp names."""
    return F.coalesce(_c(x).rlike(IDENTIFIER_PATTERN), F.lit(False))


def stable_id(*cols) -> Column:
    """FN15: a deterministic id from key columns (tests and replays need
    stable ids; ``uuid()`` is used where a fresh id is wanted)."""
    return F.sha2(F.concat_ws("\u0001", *[_c(c).cast("string") for c in cols]), 256)


def to_utc_timestamp_ntz(x) -> Column:
    """FN7: ISO text or timestamp -> timestamp without zone, read as UTC
    (naive values are UTC; zoned text is converted to UTC)."""
    text = F.trim(_c(x).cast("string"))
    zoned = text.rlike(r"([Zz]|[+-][0-9]{2}:?[0-9]{2}|[A-Za-z]{3,})$") & text.rlike(r"[0-9][T ][0-9]")
    shifted = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return F.when(zoned, shifted).otherwise(text.try_cast("timestamp_ntz"))


def slug(name: Column | str) -> Column:
    """FN13: blanks become ``_``, in lower case."""
    return F.lower(F.replace(F.col(name) if isinstance(name, str) else name, F.lit(" "), F.lit("_")))
