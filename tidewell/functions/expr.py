"""Column expressions whose rules differ from Spark's defaults. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_fold(c: str | Column) -> Column:
    return F.translate(col(c), _UPPER, _LOWER)


def ascii_like(c: str | Column, pattern: str) -> Column:
    """LIKE that folds A-Z only: other letters must match as they are. A pattern without A-Z letters on either side of
    case stays a plain LIKE, which reaches the scan."""
    folded = pattern.translate(str.maketrans(_UPPER, _LOWER))
    return col(c).like(pattern) if folded == pattern.translate(str.maketrans(_LOWER, _UPPER)) else ascii_fold(c).like(folded)


def has_text(c: str | Column, part: str) -> Column:
    """Whether a text contains the part as it stands, without wildcards; false for null."""
    return F.coalesce(F.contains(col(c), F.lit(part)), F.lit(False))


def ratio(a: str | Column, b: str | Column, scale: float = 1.0) -> Column:
    """a / b * scale as a double; null where b is 0 or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double")) * F.lit(float(scale))


def guarded_ratio(a: str | Column, b: str | Column, scale: float = 1.0) -> Column:
    """As ratio, and null unless b is positive."""
    return F.when(col(b) > 0, ratio(a, b, scale))


def half_even(c: str | Column, digits: int = 2) -> Column:
    return F.bround(col(c), digits)


def first_truthy(*cs: str | Column, last: str | Column | None = None) -> Column:
    """The first value that is neither null nor 0 nor empty; failing all, ``last`` as it is, or the last one given."""
    *head, tail = (*cs, last) if last is not None else cs
    return F.coalesce(*(F.nullif(col(c), F.lit(0)) for c in head), col(tail))


def month_start(year: str | Column, month: str | Column) -> Column:
    return F.make_date(col(year), col(month), F.lit(1))


def month_of(ts: str | Column) -> Column:
    """First day of the month as a DATE, also of timestamps without a zone."""
    return F.trunc(col(ts).cast("date"), "month")


def friday_of(ts: str | Column) -> Column:
    """The Friday of the Monday-based week."""
    return F.date_add(F.trunc(col(ts).cast("date"), "week"), 4)


def last_saturday(d: str | Column) -> Column:
    """The same day if it is a Saturday, else the Saturday before."""
    return F.date_sub(col(d), (F.weekday(col(d)) + 2) % 7)


def in_range(v: str | Column, limit: float = 1e10) -> Column:
    """Null, or an absolute value below the limit."""
    return col(v).isNull() | (F.abs(col(v)) < F.lit(limit))


def ratio_category(name: str | Column) -> Column:
    """The kind of a published ratio by parts of its lower-cased name; the first rule that fits decides."""
    n = F.lower(col(name))
    # Kinds and the parts of names that tell them, in order.
    rules = (("asset_quality", ("takip", "npl")), ("profitability", ("karlılık", "roa", "roe")), ("liquidity", ("likidite", "liquid")), ("capital", ("sermaye", "capital", "car")))
    out = F.when(F.lit(False), F.lit(""))
    for kind, parts in rules:
        hit = F.lit(False)
        for p in parts:
            hit = hit | n.contains(p)
        out = out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("other"))


def fixed_text(v: str | Column, digits: int, grouped: bool = False) -> Column:
    out = F.format_number(col(v), digits)
    return out if grouped else F.replace(out, F.lit(","), F.lit(""))


def amount_text(million: str | Column) -> Column:
    """An amount in millions as text: T from a million, B from a thousand, else M; a dash for null."""
    v = col(million)
    text = F.when(F.abs(v) >= 1e6, F.concat(fixed_text(v / 1e6, 2), F.lit("T TL"))).when(F.abs(v) >= 1e3, F.concat(fixed_text(v / 1e3, 1), F.lit("B TL"))).otherwise(F.concat(fixed_text(v, 0, True), F.lit("M TL")))
    return F.coalesce(text, F.lit("—"))


def percent_text(v: str | Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(fixed_text(v, digits), F.lit("%")), F.lit("—"))


def delta_text(v: str | Column, digits: int = 1) -> Column:
    """A signed percentage; nothing for null."""
    return F.coalesce(F.concat(F.when(col(v) > 0, F.lit("+")).otherwise(F.lit("")), fixed_text(v, digits), F.lit("%")), F.lit(""))


def basis_points_text(delta: str | Column) -> Column:
    """A difference in percentage points as signed whole basis points, half to even."""
    bp = F.bround(col(delta) * 100, 0).cast("long")
    return F.coalesce(F.concat(F.when(bp > 0, F.lit("+")).otherwise(F.lit("")), bp.cast("string"), F.lit("bps")), F.lit("—"))


def pace(growth: str | Column, before: str | Column, band: float = 0.1) -> Column:
    """Accelerated, eased or held, by how far the growth moved."""
    d = col(growth) - col(before)
    return F.when(d > band, "accelerated").when(d < -band, "eased").when(d.isNotNull(), "held")
