"""Column functions on quotes, fills, contexts and labels. None of them leaves the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def mid(bid: str = "bid_px", ask: str = "ask_px") -> Column:
    return (F.col(bid) + F.col(ask)) / 2


def spread_bps(bid: str = "bid_px", ask: str = "ask_px") -> Column:
    return (F.col(ask) - F.col(bid)) / mid(bid, ask) * 10_000


def microprice() -> Column:
    """Each side's price weighted by the other side's size."""
    return (F.col("bid_px") * F.col("ask_sz") + F.col("ask_px") * F.col("bid_sz")) / (F.col("bid_sz") + F.col("ask_sz"))


def top_imbalance() -> Column:
    return (F.col("bid_sz") - F.col("ask_sz")) / (F.col("bid_sz") + F.col("ask_sz"))


def side_sign(side: str = "side") -> Column:
    return F.when(F.col(side) == "B", 1).when(F.col(side) == "A", -1)


def maker_side() -> Column:
    """A fill that crossed was made by the other side; unknown counts as not crossed."""
    return F.when(F.col("crossed"), -side_sign()).otherwise(side_sign())


def fee_bps() -> Column:
    notional = F.col("px") * F.col("sz")
    return F.when(notional > 0, F.col("fee") / notional * 10_000)


def basis_bps() -> Column:
    return F.when(F.col("oracle_px") > 0, (F.col("mark_px") - F.col("oracle_px")) / F.col("oracle_px") * 10_000)


def markout_bps(side: Column, future_mid: Column, px: Column) -> Column:
    return side * (future_mid - px) / px * 10_000


def is_toxic(markout: Column, fee: float | Column = 1.0) -> Column:
    return markout < -(fee if isinstance(fee, Column) else F.lit(float(fee)))


def normalised_side(side: str = "side") -> Column:
    """B or A from the words in use; anything else is an error where the value is used."""
    word = F.upper(F.trim(side))
    return F.when(word.isin("B", "BUY", "BID", "LONG"), "B").when(word.isin("A", "ASK", "SELL", "SHORT"), "A").otherwise(F.raise_error(F.concat(F.lit("unknown side "), word)))


def normalised_coin(coin: str = "coin") -> Column:
    """Upper case without blanks around it and without -PERP; an empty name is an error where the value is used."""
    name = F.upper(F.trim(coin))
    return F.when(name == "", F.raise_error(F.lit("coin must be non-empty"))).otherwise(F.regexp_replace(name, "-PERP$", ""))


#: Knots that are written into a column's expression.
_KNOTS_INLINE = 64


def interpolated(p: Column, x: list[float], y: list[float]) -> Column:
    """A calibrator's piecewise-linear value: flat outside its knots, clamped to [0, 1]; null for null."""
    if len(x) > _KNOTS_INLINE:

        @F.pandas_udf("double")
        def looked_up(values: pd.Series) -> pd.Series:
            return pd.Series(np.interp(values, x, y, left=y[0], right=y[-1])).where(values.notna().to_numpy())

        return F.when(p.isNotNull(), F.least(F.greatest(looked_up(p.cast("double")), F.lit(0.0)), F.lit(1.0)))
    out = F.lit(float(y[-1]))
    for x0, x1, y0, y1 in reversed(list(zip(x, x[1:], y, y[1:], strict=False))):
        out = F.when(p <= x1, F.lit(float(y0)) + (p - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(float(y1))).otherwise(out)
    clamped = F.least(F.greatest(F.when(p <= x[0], F.lit(float(y[0]))).otherwise(out), F.lit(0.0)), F.lit(1.0))
    return F.when(p.isNotNull(), clamped)
