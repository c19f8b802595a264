"""Numbers as text."""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def _from(n: int) -> float:
    """The least double that rounds to over n hundredths: the exact middle between n and n + 1 goes to the even one."""
    middle = (2 * n + 1) / 200
    over = Fraction(middle) - Fraction(2 * n + 1, 200)
    return middle if over > 0 or (over == 0 and n % 2 == 1) else math.nextafter(middle, 1)


#: For each number of whole hundredths, where the next one begins; a fraction next to 1 has 100.
NEXT = [*map(_from, range(100)), math.inf]


def two_decimals(c: Column) -> Column:
    """A double as printf('%.2f') of SQL, Python and C gives it: its exact value, rounded half to even; null is null.

    Spark's format_string rounds the shortest text of the double half up, which
    differs where that text ends on half a hundredth. Numbers from 2^63 on,
    which have no fraction, are as format_string gives them.
    """
    x = c.cast("double")
    size = F.when(F.abs(x) < 2.0**63, F.abs(x))
    fraction = size - F.floor(size)
    hundredths = F.floor(fraction * 100)
    cents = hundredths + (fraction >= F.get(F.lit(NEXT), hundredths.cast("int"))).cast("int")
    text = (F.floor(size).cast("decimal(19,0)") + cents.cast("decimal(3,0)") * F.lit(Decimal("0.01"))).cast("string")
    large = F.when(F.isnan(x), "nan").when(F.abs(x) == math.inf, "inf").when(x.isNotNull(), F.format_string("%.2f", F.abs(x)))
    return F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), F.coalesce(text, large))
