"""Parsing the timestamp spellings found in play exports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from playtrail.functions.binning import derive

# Fixed value: larger numbers are milliseconds, this one and smaller are seconds.
MILLISECONDS_ABOVE = 10_000_000_000

# First and last second of years 1 to 9999.
_FIRST_SECOND, _LAST_SECOND = -62_135_596_800, 253_402_300_799

_NUMBER_KIND = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
_DATE_LIKE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_ZONED = "[T ].*(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"


def add_parsed_timestamp(df: DataFrame, value: str, instant: str, status: str) -> DataFrame:
    """Turn a VARIANT holding a number or text into an instant and how it was read.

    Numbers (also as text) are epoch seconds or milliseconds; other text is ISO, in UTC
    unless it names an offset.  Status is ``ok``, ``missing`` (absent, null, false, 0,
    empty) or ``invalid``; the instant is null unless ok.  Staged projections, so that
    each step is computed once per row.
    """
    kind, text, number, blank = (f"__{instant}_{part}" for part in ("kind", "text", "n", "blank"))
    raw = derive(
        df,
        {
            kind: f"coalesce(schema_of_variant({value}), 'VOID')",
            text: f"trim(try_variant_get({value}, '$', 'string'))",
        },
    )
    # What begins as a date is no number; to try it would cost an exception for each text.
    readable = f"({kind} = 'STRING' AND NOT {text} RLIKE '{_DATE_LIKE}' OR {kind} RLIKE '{_NUMBER_KIND}')"
    typed = derive(raw, {number: f"CASE WHEN {readable} THEN try_cast({text} AS DOUBLE) END"})
    classified = derive(
        typed,
        {
            blank: f"""
                {kind} IN ('VOID', 'OBJECT<>', 'ARRAY<VOID>')
                OR {kind} = 'STRING' AND {text} = ''
                OR {kind} = 'BOOLEAN' AND {text} = 'false'
                OR {kind} NOT IN ('STRING', 'BOOLEAN') AND coalesce({number} = 0, false)
            """,
            number: f"IF({number} > {MILLISECONDS_ABOVE}, {number} / 1000, {number})",
        },
    )
    parsed = derive(
        classified,
        {
            instant: f"""
                CASE WHEN {blank} THEN NULL
                     WHEN {number} BETWEEN {_FIRST_SECOND} AND {_LAST_SECOND}
                       THEN timestamp_micros(CAST(round({number} * 1000000) AS BIGINT))
                     WHEN {number} IS NULL AND {kind} = 'STRING' AND {text} RLIKE '{_DATE_LIKE}'
                       THEN try_to_timestamp(IF({text} RLIKE '{_ZONED}', {text}, {text} || 'Z'))
                END
            """
        },
    )
    label = f"CASE WHEN {blank} THEN 'missing' WHEN {instant} IS NULL THEN 'invalid' ELSE 'ok' END"
    return derive(parsed, {status: label}).drop(kind, text, number, blank)
