"""One cycle of a paper account: exits, what was learned, which signals trade, and how much.

``orders`` has (id, time, symbol, side 'Buy'/'Sell', qty, price, status, filled_qty, broker_id,
stop_loss, take_profit), ``quotes`` (symbol, last), ``signals`` (ticker, signal).  A cycle reads
them and returns new orders; nothing is kept between cycles but the order table itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.orders import exits, learned_bias, positions

VOID = ("Cancelled", "Rejected")
OPEN = ("Accepted", "Submitted", "PartiallyFilled")


@dataclass(frozen=True)
class Limits:
    cash: float = 100_000.0
    risk: float = 0.01
    stop: float = 0.02
    take: float = 0.03
    order_notional: float = 0.0  # none
    position_notional: float = 500.0
    position_qty: float = 100.0
    open_positions: int = 20
    trades: int = 20
    interval: int = 30
    threshold: float = 0.05
    allow_short: bool = True

    @property
    def seconds(self) -> int:
        """Seconds between cycles, never under 30."""
        return max(30, self.interval)


def sign_of(side: Column) -> Column:
    return F.when(side == "Buy", 1.0).otherwise(-1.0)


def triggered(orders: DataFrame, quotes: DataFrame) -> DataFrame:
    """id, symbol, side, qty, price, reason: closing orders of filled orders whose stop or target the last price has reached."""
    held = orders.where("status = 'Filled'").select("id", "symbol", "qty", (F.col("qty") * sign_of(F.col("side"))).alias("quantity"), "stop_loss", "take_profit")
    hit = exits(held, quotes)
    return hit.select("id", "symbol", F.when(F.col("quantity") > 0, "Sell").otherwise("Buy").alias("side"), "qty", F.col("last").alias("price"), "reason")


def marked(orders: DataFrame, quotes: DataFrame, digits: int = 2) -> DataFrame:
    """orders with ``last`` (their own price without a quote) and the signed mark-to-market ``pnl``."""
    last = F.coalesce("last", "price")
    o = orders.join(quotes, "symbol", "left").withColumn("last", last)
    return o.withColumn("pnl", F.round((F.col("last") - F.col("price")) * F.col("qty") * sign_of(F.col("side")), digits))


def learned(orders: DataFrame, quotes: DataFrame, digits: int = 4) -> DataFrame:
    """symbol, trades, wins, losses, pnl, bias of the filled orders with a quote."""
    o = orders.where("status = 'Filled'").join(quotes, "symbol").withColumn("pnl", (F.col("last") - F.col("price")) * F.col("qty") * sign_of(F.col("side")))
    g = o.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), F.round(F.sum("pnl"), digits).alias("pnl"))
    return g.withColumn("bias", learned_bias(F.col("wins"), F.col("losses")))


def ranked(signals: DataFrame) -> DataFrame:
    """symbol, signal: the mean of each ticker's readable signals."""
    s = signals.select(F.upper(F.trim("ticker")).alias("symbol"), F.col("signal").cast("string").try_cast("double").alias("signal"))
    return s.where("signal is not null and not isnan(signal)").groupBy("symbol").agg(F.avg("signal").alias("signal"))


def equity(orders: DataFrame, limits: Limits) -> DataFrame:
    """One row: cash less what orders that weren't cancelled or rejected have bound."""
    spent = F.sum(F.when(~F.col("status").isin(*VOID), F.col("qty") * F.col("price") * sign_of(F.col("side"))).otherwise(0.0))
    return orders.agg((F.lit(limits.cash) - F.coalesce(spent, F.lit(0.0))).alias("equity"))


def cycle(orders: DataFrame, quotes: DataFrame, signals: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """symbol, side, qty, price, signal, risk_amount, stop_loss, take_profit of the orders that one cycle places.

    At most ``trades`` signals, the strongest first (ties by name), of symbols that haven't traded
    within the interval.  A pending order, a position in the signal's direction, a full book and,
    unless allowed, a short sale each rule a symbol out.  Openings count towards the book in order.
    """
    recent = orders.where(F.unix_micros(F.col("time").cast("timestamp")) >= F.unix_micros(now) - limits.seconds * 1_000_000).select("symbol").distinct()
    strong = ranked(signals).where(F.abs("signal") >= limits.threshold).join(recent, "symbol", "left_anti")
    best = strong.orderBy(F.abs("signal").desc(), "symbol").limit(limits.trades)
    held = positions(orders)
    waiting = orders.where(F.col("broker_id").isNotNull() & F.col("status").isin(*OPEN)).select("symbol").distinct().withColumn("waiting", F.lit(True))
    c = F.broadcast(best).join(quotes, "symbol").join(held, "symbol", "left").join(learned(orders, quotes).select("symbol", "bias"), "symbol", "left").join(waiting, "symbol", "left")
    c = c.withColumn("quantity", F.coalesce("quantity", F.lit(0.0))).withColumn("strength", F.abs("signal"))
    c = c.withColumn("signal", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("signal") + F.coalesce("bias", F.lit(0.0)))))
    c = c.withColumn("side", F.when(F.col("signal") > 0, "Buy").otherwise("Sell"))
    flat = F.col("quantity") == 0
    same = ~flat & ((F.col("quantity") > 0) == (F.col("side") == "Buy"))
    short = (F.col("side") == "Sell") & (F.col("quantity") <= 0) & F.lit(not limits.allow_short)
    c = c.where(F.col("waiting").isNull() & ~same & ~short)
    account = equity(orders, limits).join(held.agg(F.count_if(F.col("quantity") != 0).alias("book")))
    c = c.join(F.broadcast(account)).withColumn("nth", F.count_if(flat).over(Window.partitionBy("book").orderBy(F.desc("strength"), "symbol")))
    c = c.where(~flat | (F.col("book") + F.col("nth") <= limits.open_positions))
    price = F.col("last")
    wanted = F.col("equity") * limits.risk / (price * limits.stop)
    if limits.order_notional > 0:
        wanted = F.least(wanted, limits.order_notional / price)
    qty = F.when(flat, F.least(wanted, limits.position_notional / price, F.lit(limits.position_qty))).otherwise(F.least(wanted, F.abs("quantity")))
    c = c.withColumn("qty", F.round(qty, 4)).where("qty > 0 and last > 0")
    up = sign_of(F.col("side"))
    return c.select(
        "symbol", "side", "qty", F.round(price, 4).alias("price"), F.round("signal", 6).alias("signal"), F.round(F.col("qty") * price * limits.stop, 2).alias("risk_amount"),
        F.round(price * (1 - up * limits.stop), 4).alias("stop_loss"), F.round(price * (1 + up * limits.take), 4).alias("take_profit"),
    )


def start_cycles(quotes: DataFrame, on_cycle, checkpoint: str, limits: Limits = Limits(), **trigger):
    """Runs ``on_cycle(quotes, epoch)`` on each micro-batch of a quote stream, one every ``interval`` seconds.

    An error in a cycle ends the query, which is how the account halts.
    """
    return quotes.writeStream.foreachBatch(on_cycle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{limits.seconds} seconds"})).start()
