"""Window sizes and column lists of a feature build.

``DAILY`` holds the fixed values of a daily equity panel. ``WEEKLY`` is the same build scaled to
weekly bars (about 350 rows per entity). All windows count rows, never calendar days.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    returns: tuple[int, ...]
    skip_pairs: tuple[tuple[int, int], ...]          # (skip, lookback)
    accel_pairs: tuple[tuple[int, int], ...]
    vols: tuple[int, ...]
    vol_ratio_pairs: tuple[tuple[int, int], ...]
    drawdowns: tuple[int, ...]
    averages: tuple[int, ...]
    macd: tuple[int, int, int]
    rsi: tuple[int, ...]
    bollinger: tuple[int, ...]
    channels: tuple[int, ...]
    cci: tuple[int, ...]
    volumes: tuple[int, ...]
    group_returns: tuple[int, ...]
    group_states: tuple[int, ...]
    dollar_z: int
    location_return: int
    excess: tuple[int, ...]
    momentum_ranks: tuple[int, ...]
    betas: tuple[int, ...]
    targets: tuple[int, ...]
    style_inputs: tuple[str, str, str]               # momentum, volatility, liquidity
    peer_inputs: tuple[str, ...]
    style_peer_inputs: tuple[str, ...]
    cross_inputs: tuple[str, ...]
    node_features: tuple[str, ...]
    core_features: tuple[str, ...]
    baseline: str


# Windows and column lists of the daily panel.
DAILY = Profile(
    returns=(1, 2, 3, 5, 10, 20, 40, 60, 120, 252),
    skip_pairs=((5, 20), (20, 60), (20, 120), (21, 252)),
    accel_pairs=((5, 20), (10, 40), (20, 60), (60, 120), (120, 252)),
    vols=(5, 10, 20, 40, 60, 120),
    vol_ratio_pairs=((5, 20), (10, 40), (20, 60), (60, 120)),
    drawdowns=(20, 60, 120, 252),
    averages=(5, 10, 20, 50, 100, 200),
    macd=(12, 26, 9),
    rsi=(6, 14, 28),
    bollinger=(20, 60),
    channels=(20, 60, 120),
    cci=(20, 60),
    volumes=(5, 10, 20, 60, 120),
    group_returns=(5, 20, 60),
    group_states=(20, 60),
    dollar_z=20,
    location_return=20,
    excess=(1, 5, 20, 60),
    momentum_ranks=(20, 60),
    betas=(60, 120),
    targets=(1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90),
    style_inputs=("ret_60d", "vol_60d", "log_dollar_volume"),
    peer_inputs=("ret_1d", "ret_5d", "ret_20d", "vol_20d", "rsi_14d", "volume_z_20d",
                 "sma_gap_20d", "beta_60d"),
    style_peer_inputs=("ret_1d", "ret_5d", "ret_20d", "vol_20d", "rsi_14d"),
    cross_inputs=(
        "ret_1d", "ret_5d", "ret_20d", "ret_60d", "ret_120d", "mom_252d_skip_21d", "vol_20d",
        "vol_60d", "downside_vol_20d", "parkinson_vol_20d", "gk_vol_20d", "volume_z_20d",
        "dollar_volume_z_20d", "log_dollar_volume", "amihud_20d", "rsi_14d", "sma_gap_20d",
        "sma_gap_50d", "sma_gap_200d", "boll_z_20d", "channel_pos_20d", "channel_pos_60d",
        "beta_60d", "idio_vol_60d", "excess_sector_ret_20d", "excess_subind_ret_20d",
        "firm_age_years", "sp500_membership_age_years"),
    node_features=(
        "ret_20d", "ret_60d", "ret_120d", "mom_252d_skip_21d", "vol_20d", "vol_60d",
        "downside_vol_20d", "volume_z_20d", "dollar_volume_z_20d", "amihud_20d", "rsi_14d",
        "sma_gap_20d", "sma_gap_50d", "boll_z_20d", "channel_pos_20d", "log_dollar_volume"),
    core_features=(
        "ret_1d", "ret_5d", "ret_20d", "ret_60d", "ret_120d", "mom_20d_skip_5d",
        "mom_60d_skip_20d", "mom_120d_skip_20d", "mom_252d_skip_21d", "mom_accel_5_20",
        "mom_accel_20_60", "vol_20d", "vol_60d", "downside_vol_20d", "parkinson_vol_20d",
        "gk_vol_20d", "vol_ratio_20_60", "drawdown_from_60d_high", "drawdown_from_252d_high",
        "rsi_14d", "sma_gap_20d", "sma_gap_50d", "sma_gap_200d", "macd_line", "macd_signal",
        "macd_hist", "boll_z_20d", "boll_bandwidth_20d", "channel_pos_20d",
        "log_dollar_volume", "volume_z_20d", "dollar_volume_z_20d", "volume_mom_20d",
        "amihud_20d", "ret_per_log_dollar_volume", "market_ret_1d", "market_ret_20d",
        "market_vol_20d", "market_breadth_20d", "excess_sector_ret_20d",
        "excess_subind_ret_20d", "sector_mom_rank_20d", "subind_mom_rank_20d", "beta_60d",
        "corr_market_60d", "idio_vol_60d", "sector_peer_excess_ret_20d",
        "subind_peer_excess_ret_20d", "cs_rank_ret_20d", "cs_rank_ret_60d",
        "cs_rank_mom_252d_skip_21d", "cs_rank_vol_20d", "cs_rank_volume_z_20d",
        "cs_rank_rsi_14d", "cs_rank_sma_gap_20d", "cs_rank_boll_z_20d", "cs_rank_beta_60d",
        "cs_rank_excess_sector_ret_20d", "sector_rank_mom_252d_skip_21d",
        "sector_rank_sma_gap_20d", "sector_rank_beta_60d"),
    baseline="cs_rank_mom_252d_skip_21d",
)

WEEKLY = Profile(
    returns=(1, 2, 4, 8, 12, 26, 52),
    skip_pairs=((1, 4), (4, 12), (4, 26), (4, 52)),
    accel_pairs=((1, 4), (2, 8), (4, 12), (12, 26), (26, 52)),
    vols=(4, 8, 12, 26, 52),
    vol_ratio_pairs=((4, 8), (4, 12), (12, 26), (26, 52)),
    drawdowns=(8, 12, 26, 52),
    averages=(4, 8, 12, 26, 52),
    macd=(12, 26, 9),
    rsi=(4, 12, 26),
    bollinger=(8, 26),
    channels=(8, 12, 26),
    cci=(8, 26),
    volumes=(4, 8, 12, 26, 52),
    group_returns=(4, 12, 26),
    group_states=(12, 26),
    dollar_z=12,
    location_return=12,
    excess=(1, 4, 12, 26),
    momentum_ranks=(12, 26),
    betas=(26, 52),
    targets=(1, 4, 12),
    style_inputs=("ret_12d", "vol_12d", "log_dollar_volume"),
    peer_inputs=("ret_1d", "ret_4d", "ret_12d", "vol_12d", "rsi_12d", "volume_z_12d",
                 "sma_gap_12d", "beta_26d"),
    style_peer_inputs=("ret_1d", "ret_4d", "ret_12d", "vol_12d", "rsi_12d"),
    cross_inputs=(
        "ret_1d", "ret_4d", "ret_12d", "ret_26d", "ret_52d", "mom_52d_skip_4d", "vol_12d",
        "vol_26d", "downside_vol_12d", "parkinson_vol_12d", "gk_vol_12d", "volume_z_12d",
        "dollar_volume_z_12d", "log_dollar_volume", "amihud_12d", "rsi_12d", "sma_gap_12d",
        "sma_gap_26d", "sma_gap_52d", "boll_z_8d", "channel_pos_8d", "channel_pos_26d",
        "beta_26d", "idio_vol_26d", "excess_sector_ret_12d", "excess_subind_ret_12d",
        "firm_age_years", "sp500_membership_age_years"),
    node_features=(
        "ret_4d", "ret_12d", "ret_26d", "mom_52d_skip_4d", "vol_4d", "vol_12d",
        "downside_vol_12d", "volume_z_12d", "dollar_volume_z_12d", "amihud_12d", "rsi_12d",
        "sma_gap_12d", "sma_gap_26d", "boll_z_8d", "channel_pos_8d", "log_dollar_volume"),
    core_features=(
        "ret_1d", "ret_4d", "ret_12d", "mom_12d_skip_4d", "mom_52d_skip_4d", "vol_12d",
        "rsi_12d", "sma_gap_12d", "log_dollar_volume", "volume_z_12d", "amihud_12d",
        "cs_rank_ret_12d", "cs_rank_vol_12d", "cs_rank_mom_52d_skip_4d"),
    baseline="cs_rank_mom_52d_skip_4d",
)
