"""Exact money arithmetic, rounding and null-safe aggregates.

Sums of doubles depend on the order in which tasks deliver their rows.  Amounts
are therefore summed as whole units of 1/10,000 and turned back after the sum,
which gives the same digits for every partitioning of the input.  A unit is made
by long arithmetic, which is several times cheaper than a decimal with places,
and held as a decimal, so that a sum over any number of rows cannot overflow.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

PLACES = 4


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def units(c: ColumnOrName, places: int = PLACES) -> Column:
    """A number as a whole count of ``10 ** -places``."""
    return F.rint(_col(c) * 10**places).cast("long").cast("decimal(18,0)")


def amount(c: ColumnOrName, places: int = PLACES) -> Column:
    """Turn a sum of units back into an exact decimal."""
    return _col(c).cast(f"decimal({37 - places},0)") * F.lit(Decimal(1).scaleb(-places))


def money(c: ColumnOrName) -> Column:
    """A two-place amount in units."""
    return (F.rint(_col(c) * 100).cast("long") * 100).cast("decimal(18,0)")


def revenue(
    price: ColumnOrName = "l_extendedprice",
    discount: ColumnOrName | None = "l_discount",
    quantity: ColumnOrName | None = None,
) -> Column:
    """price [* quantity] [* (1 - discount)] in units; all three have two places.

    Units have four places: only with a broken quantity is a product rounded.
    """
    cents = F.rint(_col(price) * 100).cast("long")
    if quantity is not None:
        cents = cents * F.rint(_col(quantity) * 100).cast("long")
    kept = F.lit(100) if discount is None else 100 - F.rint(_col(discount) * 100).cast("long")
    units = (cents * kept).cast("decimal(18,0)")
    return units if quantity is None else F.round(units / F.lit(Decimal(100)), 0).cast("decimal(18,0)")


def sum_or_zero(c: ColumnOrName) -> Column:
    """Sum that is 0 for an empty or all-null group."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def sum_dp(c: ColumnOrName, places: int = 2) -> Column:
    """Exact sum of units, rounded, as a double; 0 for an empty group."""
    return F.round(amount(sum_or_zero(c)), places).cast("double")


def ratio(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """True division in doubles; null for a zero divisor."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def round_dp(c: ColumnOrName, places: int) -> Column:
    """Round half up what a double stands for, so that 1.005 becomes 1.01.

    Nine places first: that removes the last-digit noise of a division such as
    1584344.23 / 14, which is a tie in decimals but not in doubles.
    """
    return F.round(_col(c).try_cast("decimal(38,9)"), places).cast("double")


def mean_dp(c: ColumnOrName, places: int) -> Column:
    """Mean of units from their exact sum and their count, rounded."""
    return round_dp(ratio(amount(F.sum(_col(c))), F.count(_col(c))), places)


def n_unique(c: ColumnOrName) -> Column:
    """Distinct count in which null counts as one value."""
    has_null = F.max(F.when(_col(c).isNull(), 1).otherwise(0))
    return F.count_distinct(_col(c)) + F.coalesce(has_null, F.lit(0))


def clamp(c: ColumnOrName, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))


def power_floor(c: ColumnOrName, floor: float, exponent: float) -> Column:
    """``max(c, floor) ** exponent``."""
    return F.pow(F.greatest(_col(c), F.lit(floor)), F.lit(exponent))
