"""Engine options from TOML, with defaults, and validation that names the option at fault."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}


def duration(text: str) -> float:
    """Seconds of texts such as 90s, 1m30s or 6h."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no duration: {text!r}")
    return sum(float(a) * UNITS[b] for a, b in parts)


@dataclass
class Feed:
    name: str
    url: str
    trip_updates: str = ""
    vehicle_positions: str = ""
    poll: float = 60
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def local(self) -> bool:
        return is_local(self.url)


@dataclass
class Config:
    osm_url: str = ""
    osm_poll: float = 6 * 3600
    feeds: list[Feed] = field(default_factory=list)
    walk_kmh: float = 4.8
    bike_kmh: float = 15.0
    max_walk_access: float = 720
    max_bike_access: float = 1080
    max_transfers: int = 4
    transfer_slack: float = 90
    transfer_radius_m: int = 400
    snap_radius_m: int = 300
    min_bike_saving: float = 300
    heuristic: str = "fast"
    itineraries: int = 4
    reroute_saving: float = 300
    confirm_lead: float = 600
    first_leg_window: float = 2700
    horizon: float = 3600
    cancel_blind: float = 180
    rt_poll: float = 20
    allow_http: bool = False

    @property
    def epsilon(self) -> float:
        return {"exact": 1.0, "balanced": 1.1, "fast": 1.2}[self.heuristic]


def is_local(url: str) -> bool:
    return not re.match(r"[a-z][a-z0-9+.-]*://", url) or url.startswith("file://")


def local_path(url: str) -> str:
    return url.removeprefix("file://")


def load(path: str) -> Config:
    return parse(Path(path).read_text(encoding="utf-8"))


def parse(text: str) -> Config:
    raw = tomllib.loads(text)
    config = Config()
    known = {f for f in Config.__dataclass_fields__ if f != "feeds"}
    for section in raw:
        if section != "feed" and not isinstance(raw[section], dict) and section not in known:
            raise ValueError(f"unknown option {section}")
    flat = {k: v for k, v in raw.items() if not isinstance(v, (dict, list))}
    for section, values in raw.items():
        if isinstance(values, dict):
            flat |= values
    for key, value in flat.items():
        if key not in known:
            raise ValueError(f"unknown option {key}")
        kind = type(getattr(config, key))
        setattr(config, key, duration(value) if isinstance(value, str) and kind in (int, float) else kind(value))
    for f in raw.get("feed", []):
        config.feeds.append(Feed(**({k: duration(v) if k == "poll" and isinstance(v, str) else v for k, v in f.items()})))
    validate(config)
    return config


def validate(c: Config) -> None:
    names = [f.name for f in c.feeds]
    for ok, what in (
        (c.osm_url, "osm_url is missing"),
        (c.feeds, "no feed is given"),
        (len(set(names)) == len(names), "two feeds have one name"),
        (all(f.name and f.url for f in c.feeds), "a feed lacks its name or url"),
        (c.heuristic in ("exact", "balanced", "fast"), "heuristic is exact, balanced or fast"),
        (0 <= c.max_transfers <= 8, "max_transfers lies between 0 and 8"),
        (c.allow_http or not any(u.startswith("http://") for f in c.feeds for u in (f.url, f.trip_updates, f.vehicle_positions)), "http:// needs allow_http"),
        (c.walk_kmh > 0 and c.bike_kmh > 0, "speeds are above 0"),
        (1 <= c.itineraries <= 10, "itineraries lies between 1 and 10"),
    ):
        if not ok:
            raise ValueError(what)
