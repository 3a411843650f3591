"""Configuration from TOML, and watchlists. An unknown key is an error that names the valid ones."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from ..plans.flow import Flow
from ..plans.momentum import Momentum
from ..plans.regime import Regime
from ..plans.scan import Engine, builtin_engines
from ..script.engine import script_engine
from ..timeframe import Timeframe

#: Fixed value: the file that is read when none is named.
DEFAULT_FILE = "tickframe.toml"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class ScanDefaults:
    """The defaults."""

    provider: str = "table"
    timeframe: str = "5m"
    lookback: int = 300
    include_extended: bool = True
    filter: str = ""
    sort: str = "mb_score"
    descending: bool = True
    limit: int = 0


@dataclass
class Config:
    scan: ScanDefaults = ScanDefaults()
    momentum: Momentum = Momentum()
    flow: Flow = Flow()
    regime: Regime = Regime()
    scripts: dict[str, dict] = field(default_factory=dict)
    providers: dict[str, dict] = field(default_factory=dict)

    def engines(self, extra: dict[str, dict] | None = None) -> list[Engine]:
        """The three native engines, then the scripts of the file and the extra ones, each path once; extra inputs win."""
        scripts: dict[str, dict] = {}
        for path, inputs in [*self.scripts.items(), *(extra or {}).items()]:
            scripts[str(Path(path))] = {**scripts.get(str(Path(path)), {}), **inputs}
        return builtin_engines(self.momentum, self.regime, self.flow) + [Engine(**script_engine(p, i)) for p, i in scripts.items()]


def _timeframe(text: str) -> Timeframe | None:
    return Timeframe.parse(text) if text else None


#: Sections with fixed keys: their class, and what turns a file's value into a field's where that isn't the value itself.
SECTIONS = {
    "scan": (ScanDefaults, {}),
    "engines.momentum": (Momentum, {}),
    "engines.flow": (Flow, {}),
    "engines.regime": (Regime, {"rsi_htf": _timeframe}),
}


def _read(data: dict) -> tuple[dict[str, object], list[str]]:
    """(an object for each section, all faults of the file)."""
    made, faults = {}, []
    for name, (cls, converters) in SECTIONS.items():
        values = data
        for step in name.split("."):
            values = values.get(step, {}) if isinstance(values, dict) else {}
        known, own = {f.name for f in fields(cls)}, {}
        for key, value in (values.items() if isinstance(values, dict) else ()):
            try:
                own[key] = converters.get(key, lambda v: v)(value)
            except ValueError as e:
                faults.append(f"{name}.{key}: {e}")
            if key not in known:
                faults.append(f"{name}.{key} isn't a setting; there are {', '.join(sorted(known))}")
        made[name] = cls(**{k: v for k, v in own.items() if k in known})
    return made, faults


def load_config(path: str | Path | None = None) -> Config:
    """The file's settings over the defaults. Without a path: DEFAULT_FILE if it is there. Sections: SECTIONS, script."<path>" (input title = value),
    provider.<name>. All faults of a file are reported at once."""
    at = Path(path or DEFAULT_FILE)
    if not at.is_file():
        if path is not None:
            raise FileNotFoundError(f"no configuration file {path}")
        return Config()
    data = tomllib.loads(at.read_text())
    made, faults = _read(data)
    if faults:
        raise ConfigError(f"{at}: " + "; ".join(faults))
    free = ({k: dict(v) for k, v in data.get(name, {}).items()} for name in ("script", "provider"))
    return Config(*made.values(), *free)


def secret(name: str, env_file: str | Path = ".env") -> str:
    """From the environment, else from lines NAME=value of the file; empty if in neither."""
    if name in os.environ:
        return os.environ[name]
    at = Path(env_file)
    for line in at.read_text().splitlines() if at.is_file() else ():
        key, eq, value = line.partition("=")
        if eq and not key.lstrip().startswith("#") and key.strip().removeprefix("export ").strip() == name:
            return value.strip().strip("\"'")
    return ""


def load_watchlist(source: str) -> list[str]:
    """A file with one symbol a line (# starts a comment), or symbols with commas between; upper case, in order."""
    if Path(source).is_file():
        entries = [line.split("#", 1)[0] for line in Path(source).read_text().splitlines()]
    elif set(source) & set("/\\") or source.lower().endswith(".txt") or not source.strip():
        raise FileNotFoundError(f"no watchlist file {source!r}")
    else:
        entries = source.split(",")
    return [e.strip().upper() for e in entries if e.strip()]
