"""The factor catalogue: names, order and formulas of all factors, as data.

A formula is an expression over columns of the bars, named series of its family, and moving functions; w is the factor's
window, h half of it, d twice (240 at most), x the family's input. The order of tables and windows fixes a factor's
number. Nothing here touches data: plans.factors turns the formulas that are asked for into columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

# Windows of the families.
WINDOWS = (2, 3, 4, 5, 6, 8, 10, 13, 16, 21, 26, 34, 42, 55, 68, 89, 110, 144, 178, 233)
CROSS_WINDOWS = (2, 3, 5, 8, 13, 21, 34, 55)
MACRO_WINDOWS = (3, 5, 10, 20, 40, 60)
#: Most factors of a family that count (None: all).
CAPS = {"additional": 1500, "crossmega": 10000, "crossultra": 10000, "crosshyper": 10000, "calendar_ext": 20000}

# Formulas of single-window families, in order.
BASIC = {
    "momentum": "pct(close, 12)",
    "reversal": "-(close / mean(close, 6) - 1)",
    "breakout": "((close - trough(low, 20)) / (peak(high, 20) - trough(low, 20)) - 0.5) * 2",
    "volume_confirm": "sign(cc) * (volume / mean(volume, 20) - 1)",
}

PARAMETRIC_SERIES = {
    "o": "nz(open)", "v": "nz(volume)", "ret": "cc", "intra": "oc", "spread": "nz(high - low)", "body": "close - open",
    "upper": "high - greatest(open, close)", "lower": "least(open, close) - low", "location": "((close - low) - (high - close)) / spread",
    "volume_change": "pct(v)", "signed_volume": "sign0(ret) * fill0(v)", "gap": "open / lag(close) - 1", "illiq": "abs(ret) / v",
    "typical": "(high + low + close) / 3", "mid": "(high + low) / 2", "dollar": "close * v", "dollar_change": "pct(dollar)",
    "flow": "typical * signed_volume", "obv": "cumsum(signed_volume)", "prev": "lag(close)",
    "true_range": "greatest(high - low, abs(high - prev), abs(low - prev))",
    "open_ret": "pct(open)", "high_ret": "pct(high)", "low_ret": "pct(low)", "typical_ret": "pct(typical)",
    "gain": "positive(ret)", "loss": "negative(ret)", "wick": "(lower - upper) / spread", "body_direction": "nz(sign(body))",
    "body_pct": "body / o", "upper_pct": "upper / o", "lower_pct": "lower / o", "range_pct": "spread / o",
    "close_open": "close / o - 1", "price_volume": "ret * volume_change",
    "abs_ret": "abs(ret)", "abs_intra": "abs(intra)", "signed_range": "sign0(ret) * spread",
    "to_high": "close / nz(high) - 1", "to_low": "close / nz(low) - 1", "open_to_high": "open / nz(high) - 1", "open_to_low": "open / nz(low) - 1",
    "close_ma": "mean(close, w)", "volume_ma": "mean(v, w)", "illiq_ma": "mean(illiq, w)", "range_ma": "nz(mean(spread, w))", "body_ma": "nz(mean(abs(body), w))",
    "typical_ma": "mean(typical, w)", "mid_ma": "mean(mid, w)", "abs_ret_ma": "nz(mean(abs_ret, w))",
    "close_rank": "rank(close, w)", "volume_rank": "rank(v, w)", "range_rank": "rank(spread, w)", "ret_rank": "rank(ret, w)", "abs_ret_rank": "rank(abs_ret, w)",
    "gap_rank": "rank(gap, w)", "illiq_rank": "rank(illiq, w)", "dollar_rank": "rank(dollar, w)", "tr_rank": "rank(true_range, w)",
}

PARAMETRIC = {
    "ret": "pct(close, w)",
    "ma_gap": "close / close_ma - 1",
    "volatility": "std(ret, w)",
    "range_mean": "mean(spread / o, w)",
    "volume_ratio": "v / volume_ma - 1",
    "vwap_gap": "close / typical_ma - 1",
    "drawdown": "close / peak(close, w) - 1",
    "runup": "close / trough(close, w) - 1",
    "signed_volume": "total(signed_volume, w)",
    "intrabar_strength": "mean(intra, w)",
    "return_mean": "mean(ret, w)",
    "return_efficiency": "pct(close, w) / total(abs_ret, w)",
    "downside_vol": "std(loss, w)",
    "upside_vol": "std(gain, w)",
    "close_location": "mean(location, w)",
    "body_range": "mean(abs(body) / spread, w)",
    "upper_shadow": "mean(upper / spread, w)",
    "lower_shadow": "mean(lower / spread, w)",
    "price_volume_corr": "corr(ret, volume_change, w)",
    "volume_volatility": "std(volume_change, w)",
    "return_skew": "skew(ret, w)",
    "return_kurt": "kurt(ret, w)",
    "range_position": "(close - trough(low, w)) / (peak(high, w) - trough(low, w)) - 0.5",
    "gap_mean": "mean(gap, w)",
    "gap_volatility": "std(gap, w)",
    "illiquidity": "illiq_ma",
    "volume_pressure": "total(signed_volume, w) / total(v, w)",
    "return_acceleration": "mean(diff(ret), w)",
    "volatility_ratio": "std(ret, h) / std(ret, w) - 1",
    "max_min_return_gap": "peak(ret, w) + trough(ret, w)",
    "true_range_mean": "mean(true_range, w)",
    "true_range_ratio": "true_range / mean(true_range, w) - 1",
    "atr_close_ratio": "mean(true_range, w) / close",
    "gap_abs_mean": "mean(abs(gap), w)",
    "close_mid_gap": "mean(close / mid - 1, w)",
    "mid_momentum": "pct(mid, w)",
    "typical_ret": "pct(typical, w)",
    "typical_ma_gap": "typical / typical_ma - 1",
    "dollar_volume_ratio": "dollar / mean(dollar, w) - 1",
    "dollar_volume_vol": "std(dollar_change, w)",
    "money_flow_sum": "total(flow, w)",
    "obv_change": "diff(obv, w)",
    "obv_ma_gap": "obv / mean(obv, w) - 1",
    "price_dollar_corr": "corr(ret, dollar_change, w)",
    "return_dollar_cov": "cov(ret, dollar_change, w)",
    "high_break_dist": "close / peak(high, w) - 1",
    "low_break_dist": "close / trough(low, w) - 1",
    "range_expansion": "spread / range_ma - 1",
    "body_direction_sum": "total(body_direction, w)",
    "wick_imbalance": "mean(wick, w)",
    "open_close_corr": "corr(open_ret, ret, w)",
    "high_low_corr": "corr(high_ret, low_ret, w)",
    "return_volume_beta": "cov(ret, volume_change, w) / var(volume_change, w)",
    "return_autocorr": "corr(ret, lag(ret), w)",
    "volume_autocorr": "corr(volume_change, lag(volume_change), w)",
    "gain_loss_ratio": "mean(gain, w) / mean(abs(loss), w)",
    "positive_rate": "mean(num(ret > 0), w)",
    "negative_rate": "mean(num(ret < 0), w)",
    "max_return": "peak(ret, w)",
    "min_return": "trough(ret, w)",
    "return_quantile_spread": "quantile(ret, w, 0.75) - quantile(ret, w, 0.25)",
    "volume_quantile_spread": "quantile(volume_change, w, 0.75) - quantile(volume_change, w, 0.25)",
    "price_zdist": "(close - close_ma) / std(close, w)",
    "volume_zdist": "(v - volume_ma) / std(v, w)",
    "liquidity_shock": "illiq / illiq_ma - 1",
    "return_median": "median(ret, w)",
    "range_std": "std(spread / o, w)",
    "volume_trend_gap": "mean(v, h) / volume_ma - 1",
    "body_mean": "mean(body / o, w)",
    "typical_trend_gap": "mean(typical, h) / typical_ma - 1",
    "trend_quality": "total(ret, w) / total(abs_ret, w)",
    "trend_persistence": "total(sign(ret), w) / w",
    "up_down_return_sum_ratio": "nz(total(gain, w)) / total(abs(loss), w)",
    "close_rank": "close_rank - 0.5",
    "volume_rank": "volume_rank - 0.5",
    "range_rank": "range_rank - 0.5",
    "price_volume_divergence": "close_rank - volume_rank",
    "price_range_divergence": "close_rank - range_rank",
    "range_body_ratio": "mean(spread, w) / body_ma",
    "body_expansion": "abs(body) / body_ma - 1",
    "shadow_balance_std": "std(wick, w)",
    "upper_lower_shadow_ratio": "mean(upper, w) / mean(lower, w)",
    "money_flow_zdist": "(flow - mean(flow, w)) / std(flow, w)",
    "money_flow_acceleration": "mean(diff(flow), w)",
    "obv_slope": "mean(diff(obv), w)",
    "fast_slow_return_sum_ratio": "total(ret, h) / total(ret, w)",
    "fast_slow_volume_sum_ratio": "total(v, h) / total(v, w) - 1",
    "volatility_of_volatility": "std(std(ret, h), w)",
    "range_volatility_ratio": "std(spread, h) / std(spread, w) - 1",
    "gap_direction_consistency": "total(sign(gap), w) / w",
    "gap_return_corr": "corr(gap, ret, w)",
    "open_to_mid_gap": "mean(open / mid_ma - 1, w)",
    "close_to_mid_zdist": "(close - mid_ma) / std(mid, w)",
    "liquidity_trend_gap": "mean(illiq, h) / illiq_ma - 1",
    "volume_return_asymmetry": "mean(signed_volume, w) / volume_ma",
}

ADDITIONAL = {
    "close_ma_slope": "diff(close_ma)",
    "volume_ma_slope": "diff(volume_ma) / volume_ma",
    "range_ma_slope": "diff(range_ma) / range_ma",
    "return_abs_zdist": "(abs_ret - abs_ret_ma) / std(abs_ret, w)",
    "intrabar_abs_mean": "mean(abs_intra, w)",
    "intrabar_abs_ratio": "abs_intra / mean(abs_intra, w) - 1",
    "signed_range_sum": "total(signed_range, w)",
    "signed_range_pressure": "total(signed_range, w) / total(spread, w)",
    "close_typical_zdist": "(close - typical_ma) / std(typical, w)",
    "typical_price_slope": "diff(typical_ma) / typical_ma",
    "body_zdist": "(body - mean(body, w)) / std(body, w)",
    "body_sign_consistency": "total(sign(body), w) / w",
    "upper_shadow_zdist": "(upper - mean(upper, w)) / std(upper, w)",
    "lower_shadow_zdist": "(lower - mean(lower, w)) / std(lower, w)",
    "shadow_reversal_pressure": "(total(lower, w) - total(upper, w)) / total(spread, w)",
    "price_volume_rank_product": "(close_rank - 0.5) * (volume_rank - 0.5)",
    "price_range_rank_product": "(close_rank - 0.5) * (range_rank - 0.5)",
    "volume_range_rank_product": "(volume_rank - 0.5) * (range_rank - 0.5)",
    "volume_adjusted_momentum": "pct(close, w) / volume_rank",
    "range_adjusted_momentum": "pct(close, w) / range_rank",
    "illiquidity_zdist": "(illiq - illiq_ma) / std(illiq, w)",
    "turnover_price_impact": "total(abs_ret, w) / total(dollar, w)",
    "money_flow_rank": "rank(flow, w) - 0.5",
    "obv_rank": "rank(obv, w) - 0.5",
    "return_gap_interaction": "mean(ret, w) * mean(gap, w)",
    "return_rank": "ret_rank - 0.5",
    "abs_return_rank": "abs_ret_rank - 0.5",
    "gap_rank": "gap_rank - 0.5",
    "illiquidity_rank": "illiq_rank - 0.5",
    "dollar_volume_rank": "dollar_rank - 0.5",
    "true_range_rank": "tr_rank - 0.5",
    "return_volume_rank_gap": "ret_rank - volume_rank",
    "return_range_rank_gap": "ret_rank - range_rank",
    "abs_return_volume_rank_gap": "abs_ret_rank - volume_rank",
    "gap_volume_rank_gap": "gap_rank - volume_rank",
    "illiquidity_volume_rank_gap": "illiq_rank - volume_rank",
    "dollar_volume_price_rank_gap": "dollar_rank - close_rank",
    "true_range_price_rank_gap": "tr_rank - close_rank",
    "close_to_high_mean": "mean(to_high, w)",
    "close_to_low_mean": "mean(to_low, w)",
    "open_to_high_mean": "mean(open_to_high, w)",
    "open_to_low_mean": "mean(open_to_low, w)",
    "high_low_mid_gap": "mean(close / mid - 1, w)",
    "mid_price_zdist": "(mid - mid_ma) / std(mid, w)",
    "true_range_zdist": "(true_range - mean(true_range, w)) / std(true_range, w)",
    "spread_zdist": "(spread - range_ma) / std(spread, w)",
    "volume_change_zdist": "(volume_change - mean(volume_change, w)) / std(volume_change, w)",
    "dollar_volume_zdist": "(dollar - mean(dollar, w)) / std(dollar, w)",
    "gap_zdist": "(gap - mean(gap, w)) / std(gap, w)",
    "return_rank_volume_product": "(ret_rank - 0.5) * (volume_rank - 0.5)",
    "return_rank_range_product": "(ret_rank - 0.5) * (range_rank - 0.5)",
    "gap_rank_return_product": "(gap_rank - 0.5) * (ret_rank - 0.5)",
    "illiquidity_rank_return_product": "(illiq_rank - 0.5) * (ret_rank - 0.5)",
    "dollar_volume_rank_return_product": "(dollar_rank - 0.5) * (ret_rank - 0.5)",
    "true_range_rank_return_product": "(tr_rank - 0.5) * (ret_rank - 0.5)",
    "positive_volume_pressure": "total(pick(ret > 0, v, 0), w) / total(v, w)",
    "negative_volume_pressure": "total(pick(ret < 0, v, 0), w) / total(v, w)",
    "volume_pressure_balance": "(total(pick(ret > 0, v, 0), w) - total(pick(ret < 0, v, 0), w)) / total(v, w)",
    "positive_money_flow_pressure": "total(pick(ret > 0, flow, 0), w) / total(abs(flow), w)",
    "negative_money_flow_pressure": "total(pick(ret < 0, flow, 0), w) / total(abs(flow), w)",
    "money_flow_pressure_balance": "total(flow, w) / total(abs(flow), w)",
    "return_downside_share": "total(abs(loss), w) / total(abs_ret, w)",
    "return_upside_share": "total(gain, w) / total(abs_ret, w)",
    "range_downside_share": "total(pick(ret < 0, spread, 0), w) / total(spread, w)",
    "range_upside_share": "total(pick(ret > 0, spread, 0), w) / total(spread, w)",
    "gap_abs_zdist": "(abs(gap) - mean(abs(gap), w)) / std(abs(gap), w)",
    "open_return_zdist": "(open_ret - mean(open_ret, w)) / std(open_ret, w)",
    "high_return_zdist": "(high_ret - mean(high_ret, w)) / std(high_ret, w)",
    "low_return_zdist": "(low_ret - mean(low_ret, w)) / std(low_ret, w)",
    "typical_return_zdist": "(typical_ret - mean(typical_ret, w)) / std(typical_ret, w)",
    "return_open_corr": "corr(ret, open_ret, w)",
    "return_high_corr": "corr(ret, high_ret, w)",
    "return_low_corr": "corr(ret, low_ret, w)",
    "typical_volume_corr": "corr(typical_ret, volume_change, w)",
    "illiquidity_return_corr": "corr(illiq, abs_ret, w)",
    "range_volume_corr": "corr(spread, volume_change, w)",
    "body_volume_corr": "corr(abs(body), volume_change, w)",
}

# Families of inputs x transforms x windows. SHARED are series of the input that transforms use.
SHARED = {"m": "mean(x, w)", "s": "nz(std(x, w))", "hm": "mean(x, h)", "hs": "std(x, h)", "ax": "abs(x)", "asum": "nz(total(ax, w))", "dm": "mean(x, d)", "ds": "nz(std(x, d))"}

STRUCT_INPUTS = {
    "body_pct": "body_pct", "upper_shadow_pct": "upper_pct", "lower_shadow_pct": "lower_pct", "range_pct": "range_pct", "close_open_gap": "close_open",
    "high_open_gap": "high / o - 1", "low_open_gap": "low / o - 1", "typical_open_gap": "typical / o - 1", "mid_open_gap": "mid / o - 1",
    "close_prev_gap": "close / prev - 1", "volume_signed_return": "sign0(intra) * volume_change", "price_volume_product": "price_volume",
    "range_volume_product": "range_pct * volume_change", "body_volume_product": "body_pct * volume_change", "wick_balance_pct": "(lower - upper) / o",
}
STRUCT = {
    "mean": "m", "std": "s", "median": "median(x, w)", "rank": "rank(x, w) - 0.5", "zdist": "(x - m) / s", "half_full_gap": "hm / m - 1",
    "last_mean_gap": "x / m - 1", "sum_abs_share": "total(x, w) / asum", "accel": "mean(diff(x), w)", "vol_ratio": "hs / s - 1",
}

MEGA_INPUTS = {
    "bar_return": "ret", "intrabar_return": "intra", "gap_return": "gap", "volume_change": "volume_change", "dollar_volume_change": "dollar_change",
    "money_flow": "flow / dollar", "close_location": "location", "wick_imbalance": "wick", "body_pct": "body_pct", "range_pct": "range_pct",
    "close_open_gap": "close_open", "typical_return": "typical_ret", "open_return": "open_ret", "high_return": "high_ret", "low_return": "low_ret",
    "abs_return": "abs_ret", "true_range_pct": "true_range / o", "signed_volume_ratio": "signed_volume / v", "illiquidity": "illiq",
    "obv_change": "diff(obv) / v", "dollar_volume": "pct(dollar)", "close_rank_centered": "close_rank - 0.5", "volume_rank_centered": "volume_rank - 0.5",
    "range_rank_centered": "range_rank - 0.5", "price_volume_product": "price_volume",
}
MEGA = {
    "mean": "m", "std": "s", "median": "median(x, w)", "rank": "rank(x, w) - 0.5", "zdist": "(x - m) / s", "abs_mean": "nz(mean(ax, w))",
    "abs_zdist": "(ax - nz(mean(ax, w))) / std(ax, w)", "half_full_gap": "hm / m - 1", "half_std_ratio": "hs / s - 1", "ewm_gap": "x - ewm(x, w, h)",
    "diff_mean": "mean(diff(x), w)", "diff_std": "std(diff(x), w)", "accel_mean": "mean(diff(diff(x)), w)", "positive_share": "total(positive(x), w) / asum",
    "negative_share": "total(abs(negative(x)), w) / asum", "sum_abs_share": "total(x, w) / asum", "max": "peak(x, w)", "min": "trough(x, w)",
    "quantile_spread": "quantile(x, w, 0.75) - quantile(x, w, 0.25)", "return_corr": "corr(x, ret, w)",
}

#: Series of the ultra, hyper and omega families.
COMPLEX_SERIES = {
    "c": "nz(close)", "hi": "nz(high)", "lo": "nz(low)", "o": "nz(open)", "v": "nz(volume)", "amount": "nz(amt)", "ret": "cc", "intra": "oc",
    "spread_pct": "(hi - lo) / o", "body_pct": "(c - o) / o", "upper_pct": "(hi - greatest(o, c)) / o", "lower_pct": "(least(o, c) - lo) / o",
    "location": "((c - lo) - (hi - c)) / (hi - lo)", "typical": "(hi + lo + c) / 3", "mid": "(hi + lo) / 2", "gap": "o / lag(c) - 1",
    "volume_change": "pct(v)", "amount_change": "pct(amount)", "true_range": "greatest(hi - lo, abs(hi - lag(c)), abs(lo - lag(c)))",
    "true_range_pct": "true_range / o", "vwap_gap": "c / (amount / v) - 1", "pressure": "location * spread_pct", "liquidity": "abs(ret) / amount",
    "shadow_balance": "lower_pct - upper_pct", "signed_volume": "sign0(ret) * fill0(v)", "signed_amount": "sign0(ret) * fill0(amount)",
}
ULTRA_INPUTS = {
    "bar_return": "ret", "intrabar_return": "intra", "gap_return": "gap", "volume_change": "volume_change", "amount_change": "amount_change",
    "spread_pct": "spread_pct", "body_pct": "body_pct", "upper_shadow_pct": "upper_pct", "lower_shadow_pct": "lower_pct", "close_location": "location",
    "true_range_pct": "true_range_pct", "vwap_gap": "vwap_gap", "price_pressure": "pressure", "liquidity_pressure": "liquidity",
    "signed_volume_ratio": "sign0(ret) * v / mean(v, 20)", "body_shadow_balance": "body_pct - (upper_pct - lower_pct)",
    "range_volume_product": "spread_pct * volume_change", "return_volume_product": "ret * volume_change", "trend_path_efficiency": "ret / mean(abs(ret), 20)",
    "close_to_typical": "c / typical - 1", "close_to_mid": "c / mid - 1", "high_return": "pct(hi)", "low_return": "pct(lo)", "typical_return": "pct(typical)",
    "mid_return": "pct(mid)",
}
ULTRA = {
    "mean": "m", "std": "s", "skew": "skew(x, w)", "kurt": "kurt(x, w)", "rank": "rank(x, w) - 0.5", "zdist": "(x - m) / s", "abs_rank": "rank(ax, w) - 0.5",
    "half_mean_gap": "hm / m - 1", "half_std_ratio": "hs / s - 1", "ewm_gap": "x - ewm(x, w, h)", "diff_mean": "mean(diff(x), w)", "diff_std": "std(diff(x), w)",
    "accel_mean": "mean(diff(diff(x)), w)", "positive_share": "total(positive(x), w) / asum", "negative_share": "total(abs(negative(x)), w) / asum",
    "sum_abs_share": "total(x, w) / asum", "quantile_spread": "quantile(x, w, 0.75) - quantile(x, w, 0.25)", "return_corr": "corr(x, ret, w)",
    "volume_corr": "corr(x, volume_change, w)", "range_corr": "corr(x, spread_pct, w)",
}
HYPER_INPUTS = {
    "ret_x_vol": "ret * volume_change", "ret_x_amt": "ret * amount_change", "ret_x_range": "ret * spread_pct", "intrabar_x_range": "intra * spread_pct",
    "gap_x_intrabar": "gap * intra", "body_x_location": "body_pct * location", "shadow_x_location": "shadow_balance * location",
    "range_body_gap": "spread_pct - abs(body_pct)", "range_x_volume": "spread_pct * volume_change", "range_x_amount": "spread_pct * amount_change",
    "pressure": "pressure", "liquidity": "liquidity", "liquidity_x_range": "liquidity * spread_pct", "signed_volume": "signed_volume / mean(v, 20)",
    "signed_amount": "signed_amount / mean(amount, 20)", "vwap_gap": "vwap_gap", "close_typical_gap": "c / typical - 1", "close_mid_gap": "c / mid - 1",
    "true_range_pct": "true_range_pct", "trend_efficiency": "total(ret, 5) / total(abs(ret), 5)", "volatility_pressure": "spread_pct * volume_change",
    "money_pressure": "signed_amount / mean(amount, 20)", "high_low_return_gap": "pct(hi) - pct(lo)", "typical_mid_return_gap": "pct(typical) - pct(mid)",
    "return_reversal_mix": "ret - mean(ret, 5)",
}
HYPER = {
    "mean": "m", "std": "s", "zdist": "(x - m) / s", "rank": "rank(x, w) - 0.5", "slow_zdist": "(m - dm) / ds", "fast_slow_gap": "hm / dm - 1",
    "ewm_cross": "ewm(x, h, h) - ewm(x, w, h)", "abs_share": "total(x, w) / asum", "pos_count": "mean(num(x > 0), w)", "neg_count": "mean(num(x < 0), w)",
    "tail_spread": "quantile(x, w, 0.9) - quantile(x, w, 0.1)", "iqr": "quantile(x, w, 0.75) - quantile(x, w, 0.25)", "skew": "skew(x, w)", "kurt": "kurt(x, w)",
    "ret_corr": "corr(x, ret, w)", "intrabar_corr": "corr(x, intra, w)", "vol_corr": "corr(x, volume_change, w)", "amount_corr": "corr(x, amount_change, w)",
    "range_corr": "corr(x, spread_pct, w)", "location_corr": "corr(x, location, w)",
}
OMEGA_INPUTS = {
    "ret_pressure": "ret * pressure", "intrabar_pressure": "intra * pressure", "gap_pressure": "gap * pressure", "body_pressure": "body_pct * pressure",
    "shadow_pressure": "shadow_balance * pressure", "range_pressure": "spread_pct * pressure", "ret_volume_accel": "ret * diff(volume_change)",
    "ret_amount_accel": "ret * diff(amount_change)", "range_volume_accel": "spread_pct * diff(volume_change)", "range_amount_accel": "spread_pct * diff(amount_change)",
    "signed_volume_shock": "signed_volume / mean(v, 20)", "signed_amount_shock": "signed_amount / mean(amount, 20)", "turnover_impact": "liquidity",
    "range_liquidity_mix": "spread_pct * liquidity", "wick_body_mix": "shadow_balance * body_pct", "vwap_gap": "vwap_gap", "typical_gap": "c / typical - 1",
    "mid_gap": "c / mid - 1", "true_range_pct": "true_range_pct", "trend_quality": "total(ret, 8) / total(abs(ret), 8)",
    "return_path_noise": "abs(ret) - abs(mean(ret, 8))", "range_path_noise": "spread_pct - mean(spread_pct, 8)", "high_low_momentum_gap": "pct(hi, 3) - pct(lo, 3)",
    "open_close_momentum_gap": "pct(o, 3) - pct(c, 3)", "volume_amount_gap": "volume_change - amount_change",
}
OMEGA = {
    "mean": "m", "std": "s", "zdist": "(x - m) / s", "rank": "rank(x, w) - 0.5", "slow_zdist": "(m - dm) / ds", "fast_slow_gap": "hm / dm - 1",
    "ewm_cross": "ewm(x, h, h) - ewm(x, w, h)", "abs_share": "total(x, w) / asum", "pos_rate": "mean(num(x > 0), w)", "neg_rate": "mean(num(x < 0), w)",
    "tail_spread": "quantile(x, w, 0.9) - quantile(x, w, 0.1)", "iqr": "quantile(x, w, 0.75) - quantile(x, w, 0.25)", "skew": "skew(x, w)", "kurt": "kurt(x, w)",
    "diff_mean": "mean(diff(x), w)", "diff_std": "std(diff(x), w)", "ret_corr": "corr(x, ret, w)", "intrabar_corr": "corr(x, intra, w)",
    "volume_corr": "corr(x, volume_change, w)", "range_corr": "corr(x, spread_pct, w)", "location_corr": "corr(x, location, w)",
    "amount_corr": "corr(x, amount_change, w)", "body_corr": "corr(x, body_pct, w)", "shadow_corr": "corr(x, shadow_balance, w)",
    "range_beta": "cov(x, spread_pct, w) / var(spread_pct, w)", "volume_beta": "cov(x, volume_change, w) / var(volume_change, w)",
    "amount_beta": "cov(x, amount_change, w) / var(amount_change, w)", "ret_beta": "cov(x, ret, w) / var(ret, w)", "max": "peak(x, w)", "min": "trough(x, w)",
    "last_mean_gap": "x / m - 1", "mean_abs_ratio": "m / mean(ax, w)", "accel_mean": "mean(diff(diff(x)), w)", "accel_std": "std(diff(diff(x)), w)",
    "zero_cross": "mean(num(abs(diff(sign(x))) > 0), w)", "persistence": "total(sign(x), w) / w", "half_rank": "rank(x, h) - 0.5",
    "slow_rank_gap": "rank(x, w) - rank(x, d)", "vol_of_vol": "std(std(x, h), w)", "mean_slope": "diff(m)",
}

#: Series of pairs of a main and a related symbol, whose columns begin with r_.
PAIR_SERIES = {
    "mc": "nz(close)", "mo": "nz(open)", "mh": "nz(high)", "ml": "nz(low)", "mv": "nz(volume)", "ma": "nz(amt)", "mret": "pct(mc)", "mintra": "mc / mo - 1",
    "mrange": "(mh - ml) / mo", "mvc": "pct(mv)", "mac": "pct(ma)", "mloc": "((mc - ml) - (mh - mc)) / (mh - ml)",
    "rc": "nz(r_close)", "ro": "nz(r_open)", "rh": "nz(r_high)", "rl": "nz(r_low)", "rv": "nz(r_volume)", "ra": "nz(r_amt)", "rret": "pct(rc)", "rintra": "rc / ro - 1",
    "rrange": "(rh - rl) / ro", "rvc": "pct(rv)", "rac": "pct(ra)", "rloc": "((rc - rl) - (rh - rc)) / (rh - rl)",
    "price_ratio": "mc / rc", "volume_ratio": "mv / rv", "amount_ratio": "ma / ra",
    "beta": "cov(mret, rret, w) / var(rret, w)", "pair_corr": "corr(mret, rret, w)", "residual": "mret - beta * rret", "strength": "pct(mc, w) - pct(rc, w)",
}
#: The base and crossmega families keep zero highs and lows.
CROSS_SERIES = PAIR_SERIES | {
    "mrange": "(high - low) / mo", "rrange": "(r_high - r_low) / ro", "rel": "mret - rret", "signed_rv": "sign0(rret) * fill0(rv)",
    "price_ratio_ma": "nz(mean(price_ratio, w))", "volume_ratio_ma": "nz(mean(volume_ratio, w))", "rv_ma": "nz(mean(rv, w))",
    "mvol": "std(mret, w)", "rvol": "std(rret, w)",
}
CROSS = {
    "relret": "mean(rel, w)", "relstrength": "strength", "ratio_mom": "pct(price_ratio, w)", "ratio_zdist": "(price_ratio - price_ratio_ma) / std(price_ratio, w)",
    "corr": "pair_corr", "beta": "beta", "beta_resid": "mean(residual, w)", "lead_return": "mean(lag(rret), w)", "lead_intrabar": "mean(lag(rintra), w)",
    "volume_ratio": "volume_ratio / volume_ratio_ma - 1", "volume_pressure": "total(signed_rv, w) / total(rv, w)", "vol_spread": "nz(mvol) / rvol - 1",
    "range_spread": "mean(mrange, w) - mean(rrange, w)", "related_volume_shock": "rv / rv_ma - 1", "fast_slow_relret": "mean(rel, h) - mean(rel, w)",
}
CROSSMEGA_INPUTS = {
    "relative_return": "rel", "related_return": "rret", "related_intrabar": "rintra", "related_return_lag1": "lag(rret)", "related_intrabar_lag1": "lag(rintra)",
    "price_ratio_return": "pct(price_ratio)", "price_ratio_level": "price_ratio / price_ratio_ma - 1", "volume_ratio_level": "volume_ratio / volume_ratio_ma - 1",
    "volume_ratio_change": "pct(volume_ratio)", "related_range": "rrange", "range_spread": "mrange - rrange", "vol_spread": "nz(mvol) / rvol - 1",
    "rolling_corr": "pair_corr", "rolling_beta": "beta", "beta_residual": "residual", "relative_strength": "strength",
    "signed_related_volume_ratio": "signed_rv / rv", "related_volume_change": "rvc", "related_volume_shock": "rv / rv_ma - 1",
    "main_minus_related_abs_return": "abs(mret) - abs(rret)", "main_related_return_product": "mret * rret", "main_related_range_product": "mrange * rrange",
    "related_return_rank": "rank(rret, w) - 0.5", "relative_return_rank": "rank(rel, w) - 0.5", "lead_lag_return_gap": "lag(rret) - mret",
}
CROSSMEGA = {
    "mean": "m", "std": "s", "median": "median(x, w)", "rank": "rank(x, w) - 0.5", "zdist": "(x - m) / s", "half_full_gap": "hm / m - 1",
    "half_std_ratio": "hs / s - 1", "ewm_gap": "x - ewm(x, w, h)", "diff_mean": "mean(diff(x), w)", "sum_abs_share": "total(x, w) / asum",
    "positive_share": "total(positive(x), w) / asum", "quantile_spread": "quantile(x, w, 0.75) - quantile(x, w, 0.25)", "main_return_corr": "corr(x, mret, w)",
}
CROSSULTRA_INPUTS = {
    "relative_return": "mret - rret", "relative_intrabar": "mintra - rintra", "lead_related_return": "lag(rret)", "lead_related_intrabar": "lag(rintra)",
    "price_ratio_return": "pct(price_ratio)", "price_ratio_gap": "price_ratio / mean(price_ratio, w) - 1", "volume_ratio_gap": "volume_ratio / mean(volume_ratio, w) - 1",
    "amount_ratio_gap": "amount_ratio / mean(amount_ratio, w) - 1", "range_spread": "mrange - rrange", "volume_change_spread": "mvc - rvc",
    "amount_change_spread": "mac - rac", "location_spread": "mloc - rloc", "beta_residual": "residual", "corr_level": "pair_corr", "beta_level": "beta",
    "return_product": "mret * rret", "range_product": "mrange * rrange", "main_abs_minus_related_abs": "abs(mret) - abs(rret)", "lead_lag_gap": "lag(rret) - mret",
    "relative_strength": "strength", "related_volume_shock": "rv / mean(rv, w) - 1", "related_amount_shock": "ra / mean(ra, w) - 1",
    "related_range_rank": "rank(rrange, w) - 0.5", "relative_return_rank": "rank(mret - rret, w) - 0.5", "related_pressure": "rloc * rrange",
}
CROSSULTRA = {
    "mean": "m", "std": "s", "rank": "rank(x, w) - 0.5", "zdist": "(x - m) / s", "half_mean_gap": "hm / m - 1", "half_std_ratio": "hs / s - 1",
    "ewm_gap": "x - ewm(x, w, h)", "diff_mean": "mean(diff(x), w)", "sum_abs_share": "total(x, w) / asum",
    "quantile_spread": "quantile(x, w, 0.75) - quantile(x, w, 0.25)", "main_return_corr": "corr(x, mret, w)", "related_return_corr": "corr(x, rret, w)",
    "volume_corr": "corr(x, mvc, w)",
}
CROSSHYPER_INPUTS = {
    "rel_ret_x_corr": "(mret - rret) * pair_corr", "rel_ret_x_beta": "(mret - rret) * beta", "lead_ret_x_main": "lag(rret) * mret",
    "lead_intrabar_x_main": "lag(rintra) * mintra", "price_ratio_mom": "pct(price_ratio)", "price_ratio_reversal": "price_ratio / mean(price_ratio, w) - 1",
    "volume_ratio_mom": "pct(volume_ratio)", "amount_ratio_mom": "pct(amount_ratio)", "range_spread_x_corr": "(mrange - rrange) * pair_corr",
    "location_spread_x_range": "(mloc - rloc) * (mrange - rrange)", "volume_spread_x_ret": "(mvc - rvc) * (mret - rret)", "amount_spread_x_ret": "(mac - rac) * (mret - rret)",
    "beta_residual": "residual", "corr_change": "diff(pair_corr)", "beta_change": "diff(beta)", "relative_abs_gap": "abs(mret) - abs(rret)",
    "relative_range_gap": "mrange - rrange", "related_pressure": "rloc * rrange", "main_related_pressure_gap": "mloc * mrange - rloc * rrange",
    "lead_lag_pressure": "lag(rret) - mret", "price_volume_ratio_mix": "pct(price_ratio) * pct(volume_ratio)", "price_amount_ratio_mix": "pct(price_ratio) * pct(amount_ratio)",
    "related_volume_shock": "rv / mean(rv, w) - 1", "related_amount_shock": "ra / mean(ra, w) - 1", "relative_strength": "strength",
}
CROSSHYPER = {
    "mean": "m", "std": "s", "zdist": "(x - m) / s", "rank": "rank(x, w) - 0.5", "slow_zdist": "(m - dm) / ds", "fast_slow_gap": "hm / dm - 1",
    "ewm_cross": "ewm(x, h, h) - ewm(x, w, h)", "abs_share": "total(x, w) / asum", "tail_spread": "quantile(x, w, 0.9) - quantile(x, w, 0.1)",
    "iqr": "quantile(x, w, 0.75) - quantile(x, w, 0.25)", "main_corr": "corr(x, mret, w)", "related_corr": "corr(x, rret, w)", "volume_corr": "corr(x, mvc, w)",
}
CROSSOMEGA_INPUTS = {
    "rel_ret": "mret - rret", "rel_intrabar": "mintra - rintra", "lead_ret": "lag(rret)", "lead_intrabar": "lag(rintra)", "price_ratio_ret": "pct(price_ratio)",
    "price_ratio_gap": "price_ratio / mean(price_ratio, w) - 1", "volume_ratio_ret": "pct(volume_ratio)", "volume_ratio_gap": "volume_ratio / mean(volume_ratio, w) - 1",
    "amount_ratio_ret": "pct(amount_ratio)", "amount_ratio_gap": "amount_ratio / mean(amount_ratio, w) - 1", "range_spread": "mrange - rrange",
    "location_spread": "mloc - rloc", "volume_change_spread": "mvc - rvc", "amount_change_spread": "mac - rac", "beta_residual": "residual", "corr_level": "pair_corr",
    "beta_level": "beta", "corr_change": "diff(pair_corr)", "beta_change": "diff(beta)", "ret_product": "mret * rret", "range_product": "mrange * rrange",
    "pressure_gap": "mloc * mrange - rloc * rrange", "lead_lag_gap": "lag(rret) - mret", "relative_strength": "strength", "related_pressure": "rloc * rrange",
}
CROSSOMEGA = {
    "mean": "m", "std": "s", "zdist": "(x - m) / s", "rank": "rank(x, w) - 0.5", "slow_zdist": "(m - dm) / ds", "fast_slow_gap": "hm / dm - 1",
    "ewm_cross": "ewm(x, h, h) - ewm(x, w, h)", "abs_share": "total(x, w) / asum", "pos_rate": "mean(num(x > 0), w)", "neg_rate": "mean(num(x < 0), w)",
    "tail_spread": "quantile(x, w, 0.9) - quantile(x, w, 0.1)", "iqr": "quantile(x, w, 0.75) - quantile(x, w, 0.25)", "main_corr": "corr(x, mret, w)",
    "related_corr": "corr(x, rret, w)", "volume_corr": "corr(x, mvc, w)", "amount_corr": "corr(x, mac, w)", "range_corr": "corr(x, mrange, w)",
    "location_corr": "corr(x, mloc, w)", "main_beta": "cov(x, mret, w) / var(mret, w)", "related_beta": "cov(x, rret, w) / var(rret, w)",
    "diff_mean": "mean(diff(x), w)", "diff_std": "std(diff(x), w)", "accel_mean": "mean(diff(diff(x)), w)", "persistence": "total(sign(x), w) / w",
    "zero_cross": "mean(num(abs(diff(sign(x))) > 0), w)",
}

# Calendar. SQL of the bar's time; from 21:00 on a bar belongs to the next day.
CALENDAR_TIME = {
    "hour": "hour(ts)", "minute": "minute(ts)", "minute_of_day": "(hour(ts) * 60 + minute(ts))", "day_": "date_add(to_date(ts), CASE WHEN hour(ts) >= 21 THEN 1 ELSE 0 END)",
}
CALENDAR_DATE = {
    "weekday": "weekday({0})", "month": "month({0})", "dom": "day({0})", "doy": "dayofyear({0})", "quarter": "quarter({0})", "dim": "day(last_day({0}))",
}
CALENDAR_SERIES = {
    "left": "dim - dom", "c": "nz(close)", "hi": "nz(high)", "lo": "nz(low)", "o": "nz(open)", "v": "nz(volume)", "amount": "nz(amt)", "ret": "cc", "intra": "oc",
    "range_pct": "(hi - lo) / o", "ret_mean20": "mean(ret, 20, 5)", "ret_vol20": "std(ret, 20, 5)", "intrabar_mean20": "mean(intra, 20, 5)",
    "range_mean20": "mean(range_pct, 20, 5)", "volume_ratio20": "v / mean(v, 20, 5) - 1",
}
CALENDAR = {
    "time_sin": "sin(2 * pi * minute_of_day / 1440)", "time_cos": "cos(2 * pi * minute_of_day / 1440)", "week_sin": "sin(2 * pi * weekday / 5)", "week_cos": "cos(2 * pi * weekday / 5)",
    "month_sin": "sin(2 * pi * (month - 1) / 12)", "month_cos": "cos(2 * pi * (month - 1) / 12)", "year_sin": "sin(2 * pi * doy / 366)", "year_cos": "cos(2 * pi * doy / 366)",
    "quarter_sin": "sin(2 * pi * (quarter - 1) / 4)", "quarter_cos": "cos(2 * pi * (quarter - 1) / 4)", "day_of_month_centered": "(dom - 1) / (dim - 1) - 0.5",
    "days_to_month_end_norm": "left / dim - 0.5", "night_session": "num((hour >= 21) | (hour < 9))", "morning_session": "num((hour >= 9) & (hour < 11))",
    "midday_session": "num((hour >= 11) & (hour < 14))", "afternoon_session": "num((hour >= 14) & (hour < 16))", "night_open": "num(hour.is_(21) & (minute <= 30))",
    "day_open": "num(hour.is_(9) & (minute <= 30))", "day_close": "num(hour.is_(14) & (minute >= 30))", "monday_or_postweekend": "num(weekday <= 0)",
    "friday_or_preweekend": "num(weekday >= 4)", "month_start": "num(dom <= 3)", "month_end": "num(left <= 3)", "quarter_start": "num(mod(month, 3).is_(1) & (dom <= 5))",
    "quarter_end": "num(mod(month, 3).is_(0) & (left <= 5))", "year_start": "num(month.is_(1) & (dom <= 10))", "year_end": "num(month.is_(12) & (left <= 10))",
}
SEASONS = ("time_sin", "time_cos", "week_sin", "week_cos", "month_sin", "month_cos", "year_sin", "year_cos", "night_session", "month_end", "quarter_end")
CALENDAR_STATES = {"ret_mean20": "ret_mean20", "ret_vol20": "ret_vol20", "intrabar_mean20": "intrabar_mean20", "range_mean20": "range_mean20", "volume_ratio20": "volume_ratio20", "abs_ret": "abs(ret)"}
MULTIPLIERS = {
    "night": CALENDAR["night_session"], "morning": CALENDAR["morning_session"], "midday": CALENDAR["midday_session"], "afternoon": CALENDAR["afternoon_session"],
    "day_open": CALENDAR["day_open"], "day_close": CALENDAR["day_close"], "month_start": CALENDAR["month_start"], "month_end": CALENDAR["month_end"],
    "quarter_start": CALENDAR["quarter_start"], "quarter_end": CALENDAR["quarter_end"], "year_start": CALENDAR["year_start"], "year_end": CALENDAR["year_end"],
    "preweekend": CALENDAR["friday_or_preweekend"], "postweekend": CALENDAR["monday_or_postweekend"], "month_progress": "(dom - 1) / dim - 0.5",
    "month_remaining": "left / dim - 0.5", "year_progress": "doy / 366 - 0.5", "week_progress": "weekday / 5 - 0.5", "day_progress": "minute_of_day / 1440 - 0.5",
}
MARKET_STATES = {
    "ret": "ret", "intrabar": "intra", "abs_ret": "abs(ret)", "range": "range_pct", "body": "(c - o) / o", "gap": "o / lag(c) - 1", "volume_chg": "pct(v)",
    "amount_chg": "pct(amount)", "volume_ratio": "volume_ratio20", "amount_ratio": "amount / mean(amount, 20, 5) - 1", "location": "((c - lo) - (hi - c)) / (hi - lo)",
    "ret_mean20": "ret_mean20", "ret_vol20": "ret_vol20", "intrabar_mean20": "intrabar_mean20", "range_mean20": "range_mean20",
}
STATE_FORMS = {
    "mean": "mean(x, w, p)", "std": "nz(std(x, w, p))", "zdist": "(x - mean(x, w, p)) / std(x, w, p)", "diff_mean": "mean(diff(x), w, p)",
    "last_mean_gap": "x / mean(x, w, p) - 1", "mean_abs_ratio": "mean(x, w, p) / mean(abs(x), w, p)",
}

# Macro state; m_close is the daily series on the bars' times.
MACRO_SERIES = {
    "mret": "pct(nz(close))", "mrange": "(high - low) / nz(open)", "macro_ret": "pct(m_close)", "level": "log(m_close)",
    "beta": "cov(mret, macro_ret, w, p) / var(macro_ret, w, p)",
}
MACRO_STATIC = {
    "macro_ret_1": "macro_ret", "macro_level_change": "diff(m_close)", "macro_log_level": "level", "macro_main_ret_spread_1": "mret - macro_ret",
    "macro_main_ret_product_1": "mret * macro_ret", "macro_range_product_1": "mrange * abs(macro_ret)",
}
MACRO = {
    "macro_ret_mean": "mean(macro_ret, w, p)", "macro_ret_vol": "nz(std(macro_ret, w, p))", "macro_ret_zdist": "(macro_ret - mean(macro_ret, w, p)) / std(macro_ret, w, p)",
    "macro_level_zdist": "(level - mean(level, w, p)) / std(level, w, p)", "macro_momentum": "pct(m_close, w)", "macro_vol_spread": "nz(std(mret, w, p)) / std(macro_ret, w, p) - 1",
    "macro_corr_main": "corr(mret, macro_ret, w, p)", "macro_beta_main": "beta", "macro_beta_resid": "mean(mret - beta * macro_ret, w, p)",
    "macro_main_ret_spread": "mean(mret, w, p) - mean(macro_ret, w, p)", "macro_risk_on_product": "mean(macro_ret, w, p) * mean(mrange, w, p)",
    "macro_abs_shock": "abs(macro_ret) / mean(abs(macro_ret), w, p) - 1",
}


@dataclass(frozen=True)
class Factor:
    """name holds {s} where the related or macro symbol's key goes."""

    name: str
    source: str
    template: str
    input: str | None = None
    window: int | None = None
    kind: str = "own"  # own, pair, macro: what the bars are joined to

    def named(self, key: str = "") -> str:
        return self.name.replace("{s}", key)


#: Families of inputs x transforms: inputs, transforms, series.
GRIDS = {
    "struct": (STRUCT_INPUTS, STRUCT, PARAMETRIC_SERIES),
    "mega": (MEGA_INPUTS, MEGA, PARAMETRIC_SERIES),
    "ultra": (ULTRA_INPUTS, ULTRA, COMPLEX_SERIES),
    "hyper": (HYPER_INPUTS, HYPER, COMPLEX_SERIES),
    "omega": (OMEGA_INPUTS, OMEGA, COMPLEX_SERIES),
    "crossmega": (CROSSMEGA_INPUTS, CROSSMEGA, CROSS_SERIES),
    "crossultra": (CROSSULTRA_INPUTS, CROSSULTRA, PAIR_SERIES),
    "crosshyper": (CROSSHYPER_INPUTS, CROSSHYPER, PAIR_SERIES),
    "crossomega": (CROSSOMEGA_INPUTS, CROSSOMEGA, PAIR_SERIES),
}


def _grid(source: str) -> Iterator[Factor]:
    inputs, forms, _ = GRIDS[source]
    pair = source.startswith("cross")
    for w in CROSS_WINDOWS if pair else WINDOWS:
        for x in inputs:
            for form in forms:
                yield Factor(f"{source}_{form}_{{s}}_{x}_{w}" if pair else f"{source}_{form}_{x}_{w}", source, form, x, w, "pair" if pair else "own")


def _table(source: str, table: dict[str, str]) -> Iterator[Factor]:
    for w in WINDOWS:
        for t in table:
            yield Factor(f"{t}_{w}", source, t, None, w)


def _cross() -> Iterator[Factor]:
    for w in CROSS_WINDOWS:
        for t in CROSS:
            yield Factor(f"cross_{t}_{{s}}_{w}", "cross", t, None, w, "pair")


def _calendar() -> Iterator[Factor]:
    for t in CALENDAR:
        yield Factor(f"calendar_{t}", "calendar", t)
    for season in SEASONS:
        for state in CALENDAR_STATES:
            yield Factor(f"calendar_x_{season}_{state}", "calendar_x", season, state)


def _calendar_ext() -> Iterator[Factor]:
    for m in MULTIPLIERS:
        for state in MARKET_STATES:
            yield Factor(f"calendar_ext_{m}_level_{state}", "calendar_ext", f"{m} level", state)
            for w in WINDOWS:
                for form in STATE_FORMS:
                    yield Factor(f"calendar_ext_{m}_{form}_{state}_{w}", "calendar_ext", f"{m} {form}", state, w)


def _macro() -> Iterator[Factor]:
    for t in MACRO_STATIC:
        yield Factor(f"{t}_{{s}}", "macro", t, None, None, "macro")
    for w in MACRO_WINDOWS:
        for t in MACRO:
            yield Factor(f"{t}_{{s}}_{w}", "macro", t, None, w, "macro")


def _capped(factors: Iterator[Factor], cap: int | None, keys: tuple[str, ...] = ("",)) -> Iterator[tuple[Factor, str]]:
    factors = list(factors)
    every = ((f, k) for k in keys for f in factors)
    for n, pair in enumerate(every):
        if cap is not None and n >= cap:
            return
        yield pair


def symbol_key(symbol: str) -> str:
    return symbol.lower().translate(str.maketrans("./-", "___"))


@lru_cache(maxsize=4)
def catalog(related: tuple[str, ...] = (), macro: tuple[str, ...] = ()) -> tuple[tuple[int, str, Factor, str], ...]:
    """(number, name, factor, related or macro symbol) of all factors in order, from 1."""
    plan: list[Iterator[tuple[Factor, str]]] = [
        _capped((Factor(t, "basic", t) for t in BASIC), None),
        _capped(_table("parametric", PARAMETRIC), None),
        _capped(_table("additional", ADDITIONAL), CAPS["additional"]),
        _capped(_grid("struct"), None),
        _capped(_grid("mega"), None),
        _capped(_cross(), None, related),
        _capped(_grid("crossmega"), CAPS["crossmega"], related),
        _capped(_grid("ultra"), None),
        _capped(_grid("crossultra"), CAPS["crossultra"], related),
        _capped(_grid("hyper"), None),
        _capped(_grid("crosshyper"), CAPS["crosshyper"], related),
        _capped(_grid("omega"), None),
        _capped(_grid("crossomega"), None, related),
        _capped(_calendar(), None),
        _capped(_calendar_ext(), CAPS["calendar_ext"]),
        _capped(_macro(), None, macro),
    ]
    every = (x for part in plan for x in part)
    return tuple((n, f.named(symbol_key(s)), f, s) for n, (f, s) in enumerate(every, 1))
