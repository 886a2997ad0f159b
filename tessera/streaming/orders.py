"""Order lifecycle as a stateful stream, and position, stop and sizing rules as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("Filled", "Cancelled", "Rejected")
STATUSES = ("Accepted", "Submitted", "PartiallyFilled", *TERMINAL)
OUTPUT = "id string, status string, filled_qty double, seq long"


def next_status(now: str | None, event: str) -> str | None:
    """Terminal states are final; unknown events change nothing."""
    if now in TERMINAL or event not in STATUSES:
        return now
    return event


class OrderStates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order = handle.getValueState("order", "status string, filled_qty double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        status, filled = self.order.get() if self.order.exists() else (None, 0.0)
        seq = 0
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            after = next_status(status, e.status)
            if status not in TERMINAL and e.filled_qty == e.filled_qty and e.filled_qty is not None:
                filled = max(filled, float(e.filled_qty))
            status, seq = after, int(e.seq)
        self.order.update((status, filled))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "filled_qty": [filled], "seq": [seq]})

    def close(self) -> None:
        pass


def order_states(events: DataFrame) -> DataFrame:
    """Latest state of each order from a stream of (id, status, filled_qty, seq)."""
    return events.groupBy("id").transformWithStateInPandas(OrderStates(), OUTPUT, "Update", "None")


def positions(fills: DataFrame) -> DataFrame:
    """symbol, quantity: signed filled quantities."""
    q = F.when(F.col("status").isin("Filled", "PartiallyFilled"), F.coalesce("filled_qty", F.when(F.col("status") == "Filled", F.col("qty")), F.lit(0.0))).otherwise(0.0)
    return fills.groupBy("symbol").agg(F.sum(F.when(F.lower("side") == "buy", q).otherwise(-q)).alias("quantity"))


def exits(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Holdings whose last price is through the stop or the target."""
    h = holdings.join(quotes, "symbol")
    long = F.col("quantity") > 0
    stop = F.when(long, F.col("last") <= F.col("stop_loss")).otherwise(F.col("last") >= F.col("stop_loss"))
    goal = F.when(long, F.col("last") >= F.col("take_profit")).otherwise(F.col("last") <= F.col("take_profit"))
    return h.withColumn("reason", F.when(stop, "risk-stop").when(goal, "take-profit")).where("reason is not null")


def learned_bias(wins: Column, losses: Column) -> Column:
    return F.greatest(F.lit(-0.05), F.least(F.lit(0.05), 0.01 * (wins - losses)))


def order_quantity(equity: Column, price: Column, stop: Column, max_notional: float = 500.0, risk: float = 0.01) -> Column:
    """Largest quantity within 1% risk to the stop and the notional limit."""
    distance = F.nullif(F.abs(price - stop), F.lit(0.0))
    return F.floor(F.least(F.try_divide(equity * risk, distance), F.try_divide(F.lit(max_notional), price)) * 1000) / 1000
