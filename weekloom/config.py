"""Settings with their defaults, read from TOML if asked."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class BacktestConfig:
    # The defaults of the analytics side.
    transaction_fee: float = 0.0003
    slippage: float = 0.0005
    risk_free_rate: float = 0.03
    initial_capital: float = 1e6
    max_weight_per_industry: float = 0.3
    max_total_weight: float = 1.0
    mirror_weight: float = 0.15
    least_weight: float = 0.001


@dataclass(frozen=True)
class SignalConfig:
    lookback: int = 5
    anomaly_threshold: float = 0.03
    freq: str = "week"
    train_end: str = "2021-01-03"
    heat_scale: float = 5.0
    trend_threshold: float = 0.1


def load(path: str, section: str, default):
    """``default`` with the values of a TOML file's section; relative ``*_path`` values are anchored
    at the file's folder. Unknown keys raise."""
    file = Path(path)
    found = tomllib.loads(file.read_text(encoding="utf-8")).get(section, {})
    known = {f.name for f in fields(default)}
    if unknown := set(found) - known:
        raise ValueError(f"unknown settings in [{section}]: {sorted(unknown)}")
    return replace(default, **{k: str(file.parent / v) if k.endswith("_path") and not Path(v).is_absolute() else v for k, v in found.items()})
