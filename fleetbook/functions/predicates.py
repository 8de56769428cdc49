"""Column predicates with the stored-query semantics (ILIKE, warranty windows, flags)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings accepted as "true" by the boolean query flags.
TRUE_SPELLINGS = ("true", "TRUE", "True")


def normalise_like_term(term: str) -> str:
    """Make a search term safe for Spark's ``ilike`` with Postgres' escape meaning.

    Postgres treats ``\\x`` as a literal ``x`` for any ``x``; Spark rejects a backslash before
    an ordinary character.  ``\\%``, ``\\_`` and ``\\\\`` keep their escape meaning.
    """
    return re.sub(r"\\(.)", lambda m: m.group(0) if m.group(1) in "%_\\" else m.group(1),
                  term, flags=re.S)


def contains_ci(col: Column | str, term: str) -> Column:
    """``col ILIKE '%' || term || '%'``: ``%`` and ``_`` inside the term stay wildcards."""
    c = F.col(col) if isinstance(col, str) else col
    return c.ilike("%" + normalise_like_term(term) + "%")


def within_months(col: Column | str, months: int, as_of: dt.datetime) -> Column:
    """``date BETWEEN now() AND now() + N months`` with the date promoted to midnight.

    An expiry date equal to ``as_of``'s day is therefore outside once ``as_of`` is past
    midnight.  Month addition clamps at month end.
    """
    c = F.col(col) if isinstance(col, str) else col
    ts = c.cast("timestamp")
    now = F.lit(as_of).cast("timestamp")
    upper = now + F.make_interval(F.lit(0), F.lit(int(months)))
    return (ts >= now) & (ts <= upper)


def is_expired(col: Column | str, as_of: dt.datetime) -> Column:
    """``date < now()`` with the parameter taken as a DATE: today is not expired."""
    c = F.col(col) if isinstance(col, str) else col
    return c < F.lit(as_of.date() if isinstance(as_of, dt.datetime) else as_of)


def to_flag(col: Column | str) -> Column:
    """A query-string flag: only 'true', 'TRUE' and 'True' are true; anything else false."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(*TRUE_SPELLINGS), F.lit(False))


def warranty_predicate(col: str, warranty: int, expired: bool, as_of: dt.datetime) -> Column | None:
    """Warranty filter of the list endpoints: N>0 -> within N months; 0 given -> expired."""
    if warranty > 0:
        return within_months(col, warranty, as_of)
    if warranty == 0 and expired:
        return is_expired(col, as_of)
    return None


def all_of(preds) -> Column:
    preds = [p for p in preds if p is not None]
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out
