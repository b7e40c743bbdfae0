"""Column expressions of the calibration vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def decile(price: Column) -> Column:
    """Fixed-width tenths, 1 to 10."""
    return (F.least(F.floor(price * 10), F.lit(9)) + 1).cast("int")


def price_bin(price: Column, n: int = 20) -> Column:
    """Fixed-width bin from 0; a price of 1 has bin n."""
    return F.floor(price * n).cast("int")


def ladder(value: Column, cuts: list[tuple[float, str]], last: str) -> Column:
    """The label of the first cut that value is below."""
    return reduce(lambda rest, cut: F.when(value < cut[0], cut[1]).otherwise(rest), reversed(cuts), F.lit(last))


def equal_frequency(number: Column, n: Column, q: int) -> Column:
    """Bin 1 to q of a row's number among n, as quantile cuts of first ranks do."""
    return F.when(n == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil((number - 1) * q / (n - 1)))).cast("int")


def mirrored(side: Column, price: Column) -> Column:
    """The price of the bought side: a SELL at p buys the complement at 1 - p."""
    return F.when(side == "BUY", price).otherwise(1 - price)


def stars(t: Column) -> Column:
    """Significance marks at 10, 5 and 1 in a thousand (two-sided normal: 2.58, 3.29) and 5 in a hundred (1.96)."""
    a = F.abs(t)
    return F.when(a >= 3.29, "***").when(a >= 2.58, "**").when(a >= 1.96, "*").otherwise("")


def lifecycle(*token: str, ts: str = "ts") -> Column:
    """Place of a trade in its token's life, 0 to 1; a life counts one second at least."""
    w = Window.partitionBy(*(token or ("token_id",)))
    first, last = F.min(ts).over(w), F.max(ts).over(w)
    return (F.col(ts) - first) / F.greatest(last - first, F.lit(1))


def r6(c: Column) -> Column:
    return F.round(c, 6)
