"""Positions of a stream of bars: a moving factor and the position rules, kept in state by symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import ModelSettings
from ..operators.composite import rule_step

STATE = "held double, bars double, wait double, last timestamp, late long, closes array<double>"
OUTPUT = "symbol string, ts timestamp, value double, target_position double, ruled_position double, late long"


class Positions(StatefulProcessor):
    """Of each symbol: the last closes, the rules' state, the newest bar's time, and how many bars came after later ones.

    value is the close over the mean of the last `window` closes, less 1; beyond the threshold it is a target of 1 or -1.
    Bars that come late change nothing and are counted: positions that were taken cannot be taken back.
    """

    def __init__(self, s: ModelSettings, window: int, threshold: float):
        self.s, self.window, self.threshold = s, window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)
        self.step = rule_step(self.s)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        held, bars, wait, last, late, closes = self.state.get() if self.state.exists() else (0.0, 0.0, 0.0, None, 0, [])
        state, closes, out = [held, bars, wait], list(closes), []
        for ts, close in zip(new["ts"], new["close"], strict=True):
            if last is not None and ts <= pd.Timestamp(last):
                late += 1
                continue
            last = ts
            closes = [*closes, float(close)][-self.window :]
            value = close / (sum(closes) / self.window) - 1 if len(closes) == self.window else None
            target = 0.0 if value is None else 1.0 if value > self.threshold else -1.0 if value < -self.threshold else 0.0
            out.append((key[0], ts, value, target, self.step(state, (target,)), late))
        self.state.update((*map(float, state), pd.Timestamp(last).to_pydatetime() if last is not None else None, late, closes))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def streamed_positions(bars: DataFrame, s: ModelSettings = ModelSettings(), window: int = 20, threshold: float = 0.01) -> DataFrame:
    """(symbol, ts, value, target_position, ruled_position, late) of a stream of bars: symbol, ts, close."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = bars.where("close IS NOT NULL").selectExpr("symbol", "CAST(ts AS timestamp) ts", "close")
    return rows.groupBy("symbol").transformWithStateInPandas(Positions(s, window, threshold), OUTPUT, "append", "None")
