"""Accounting numbers and row labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as nil, currency signs, dashes, codes beside a figure, and the words that mark rows.
NIL = ["-", "--", "—", "–", "−", "nil", "n/a", "na"]
CURRENCY = "₹$€£¥"
DASHES = "–—−‒"
CODES = r"(?i)\b(?:inr|usd|eur|gbp|aed|jpy|cny|sgd|rs|rmb)\.?"
TOTAL = r"(?i)\b(?:sub-?\s*total|totals?|aggregate|sum\s+of|grand\s+total)\b"
DERIVED = r"(?i)\b(?:gross profit|gross margin|operating profit|operating margin|profit before (?:tax|income tax)|profit after tax|profit for the (?:year|period|quarter)|net profit|net income|ebitda)\b"
HEADER = r"(?i)(year ended|months ended|quarter ended|period ended|as at|as of|particulars|in ₹|in rs|in million|^note$|for the (year|period|quarter)|balance sheet|statement of|^index$|page no)"

_BLANK = r"[\s  -  　]"


def _strip(c: Column, inner: str = _BLANK) -> Column:
    return F.regexp_replace(c, rf"^{inner}+|{inner}+$", "")


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once; Spark repeats what stands in branches otherwise."""
    return F.transform(F.array(value), use)[0]


def parse_number(raw: Column) -> Column:
    """Value of a financial token as double; null if it is none or a percentage, 0 for nil."""

    def amount(s: Column) -> Column:
        wrapped = s.startswith("(") & s.endswith(")") & (F.length(s) >= 2)
        body = F.when(wrapped, _strip(F.regexp_replace(s, r"^\(|\)$", ""))).otherwise(s)
        return _let(body, lambda b: F.when(wrapped | b.rlike(rf"^[^0-9]*[-{DASHES}][^0-9]*[0-9]"), -magnitude(b)).otherwise(magnitude(b)))

    def magnitude(body: Column) -> Column:
        bare = _strip(_strip(F.regexp_replace(body, CODES, ""), rf"[{CURRENCY}{DASHES} \t]"))
        bare = F.regexp_replace(bare, rf"^[-+{DASHES} ]+", "")
        compact = F.regexp_replace(F.regexp_replace(bare, ",", ""), r"(?<=[0-9])[  ](?=[0-9])", "")
        return _let(compact, lambda c: F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.try_cast("double")))

    # most tokens have no digit and need no more than one look
    figure = _let(_strip(raw), lambda s: F.when(~s.contains("%"), amount(s)))
    return F.when(raw.rlike("[0-9]"), figure).when(F.lower(_strip(raw)).isin(NIL), 0.0)


def is_numberish(token: Column) -> Column:
    """Whether a token may be part of a figure: digits with signs, separators and currency only, one digit at least."""
    t = _strip(token)
    return F.coalesce(t.rlike("[0-9]") & t.rlike(rf"^[()+,.0-9{CURRENCY}{DASHES}-]+$"), F.lit(False))


def format_number(value: Column) -> Column:
    """1,234 for whole values, else two decimals."""
    return F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))


def is_year(token: Column) -> Column:
    t = F.regexp_replace(_strip(token), "[,.]+$", "")
    return F.coalesce(t.rlike("^(19|20)[0-9]{2}$"), F.lit(False))


def is_total(label: Column) -> Column:
    return F.coalesce(label.rlike(TOTAL), F.lit(False))


def is_derived(label: Column) -> Column:
    return F.coalesce(label.rlike(DERIVED), F.lit(False))


def is_header(label: Column, figures: Column) -> Column:
    """A period or column header: by its words, or because all of its figures (array of text) are years."""
    return F.coalesce(label.rlike(HEADER), F.lit(False)) | ((F.size(figures) > 0) & F.forall(figures, is_year))


def safe_name(symbol: Column) -> Column:
    """A symbol as part of a path."""
    return F.regexp_replace(symbol, "[^A-Za-z0-9._+-]", "_")
