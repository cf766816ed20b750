from tieout.functions.columns import (
    amount_of,
    category,
    contains_text,
    flag,
    gap_status,
    confidence_label,
    is_headline,
    money,
    percent,
    period_key,
    quarter_label,
    time_of,
    token_sorted,
)

__all__ = [
    "amount_of",
    "category",
    "contains_text",
    "flag",
    "gap_status",
    "confidence_label",
    "is_headline",
    "money",
    "percent",
    "period_key",
    "quarter_label",
    "time_of",
    "token_sorted",
]
