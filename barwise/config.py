"""Settings as frozen dataclasses, from a mapping, a file and the environment; unknown names and other time zones than the
exchange's are refused. The environment wins: BARWISE_STORE__ROOT sets store.root, and BARWISE_CONFIG names the file."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

EXCHANGE_ZONE = "Asia/Kolkata"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class StoreSettings:
    root: str = "data/bars"
    compression: str = "zstd"


@dataclass(frozen=True)
class IntegritySettings:
    max_missing: float = 0.02
    suspect_abs_log_return: float = 0.20
    price_tolerance: float = 0.0005
    volume_tolerance: float = 0.02
    min_symbols: int = 5


@dataclass(frozen=True)
class StreamSettings:
    heartbeat_s: float = 10.0
    rest_after_s: float = 30.0
    rest_poll_s: float = 5.0
    backoff_initial_s: float = 1.0
    backoff_multiplier: float = 2.0
    backoff_max_s: float = 60.0
    jitter: float = 0.25
    max_attempts: int = 20


@dataclass(frozen=True)
class CalendarSettings:
    holidays: str | None = None
    specials: str | None = None


@dataclass(frozen=True)
class Config:
    time_zone: str = EXCHANGE_ZONE
    timeframes: tuple[str, ...] = ("1m", "5m", "15m", "1h", "1d")
    base_timeframe: str = "15m"
    history_years: int = 7
    adjust_dividends: bool = True
    store: StoreSettings = field(default_factory=StoreSettings)
    integrity: IntegritySettings = field(default_factory=IntegritySettings)
    stream: StreamSettings = field(default_factory=StreamSettings)
    calendar: CalendarSettings = field(default_factory=CalendarSettings)

    def __post_init__(self):
        if self.time_zone != EXCHANGE_ZONE:
            raise ConfigError(f"time_zone must be {EXCHANGE_ZONE}")
        if self.base_timeframe not in self.timeframes:
            raise ConfigError("base_timeframe must be among timeframes")


def from_mapping(values: dict, kind: type = Config):
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ConfigError(f"unknown settings in {kind.__name__}: {', '.join(unknown)}")
    made = {}
    for name, v in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else None
        made[name] = from_mapping(v, type(default)) if is_dataclass(default) else tuple(v) if isinstance(v, list) else v
    return kind(**made)


PREFIX = "BARWISE_"


def overridden(values: dict, environ: Mapping[str, str]) -> dict:
    """values with what the environment sets: names behind the prefix in any case, parts divided by two underscores.

    A setting's text is read as JSON where it is such (numbers, true, lists) and stays a text otherwise.
    """
    out = json.loads(json.dumps(values))
    for name in sorted(environ):
        if not name.startswith(PREFIX) or name == f"{PREFIX}CONFIG":
            continue
        *path, last = name[len(PREFIX) :].lower().split("__")
        at = out
        for part in path:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ConfigError(f"{name}: {part} is a setting, not a section")
        try:
            at[last] = json.loads(environ[name])
        except ValueError:
            at[last] = environ[name]
    return out


def load(path: str | Path | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """Settings of a JSON file (the one that BARWISE_CONFIG names, if none is given; without either the defaults), then the environment."""
    environ = os.environ if environ is None else environ
    path = path or environ.get(f"{PREFIX}CONFIG")
    return from_mapping(overridden(json.loads(Path(path).read_text()) if path else {}, environ))
