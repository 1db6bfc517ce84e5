"""Lenient date parsing of extracted text."""

from __future__ import annotations

# Texts that stand for no date, and the shape of an ISO date or date-time.
NULL_WORDS = ("null", "none", "n/a", "")
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
ZONE = r"(?<=[T ].{2,20})(Z|[+-]\d{2}:?\d{2})$"


def parse_date(x: str) -> str:
    """UTC time of an ISO date or date-time; no zone means UTC, anything else is NULL."""
    null_words = ", ".join(f"'{w}'" for w in NULL_WORDS)
    body = f"replace(regexp_replace({x}, r'{ZONE}', ''), ',', '.')"
    local = f"try_cast(if({body} RLIKE r'[T ]\\d{{2}}$', concat({body}, ':00'), {body}) AS TIMESTAMP_NTZ)"
    zone = f"nullif(replace(regexp_extract({x}, r'{ZONE}', 1), 'Z', ''), '')"
    minutes = (
        f"coalesce(if(startswith({zone}, '-'), -1, 1) * (try_cast(substring({zone}, 2, 2) AS INT) * 60"
        f" + try_cast(right({zone}, 2) AS INT)), 0)"
    )
    usable = f"lower({x}) NOT IN ({null_words}) AND {x} RLIKE r'{ISO}'"
    return f"if({usable}, {local} - make_dt_interval(0, 0, {minutes}), null)"
