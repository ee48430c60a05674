"""Journeys under way: a stateful stream of events for each session.

Inputs are rows of one shape, tagged by kind: ``plan`` (an itinerary's legs as JSON), ``fix`` (a position),
``overlay`` (delays and positions of the session's trips as JSON) and ``tick``. Time is the rows' ``at``, in
seconds; the wall clock is never read, so a replay gives the same events. A better or a feasible itinerary can't
be searched inside a stateful operator: a ``replan`` event asks for it, a batch of the planner answers with the
next ``plan`` row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INPUT = "session_id string, at long, kind string, lat double, lon double, accuracy_m double, payload string"
EVENTS = "session_id string, at long, event string, detail string"
STATE = "state string"

#: Limits in seconds and metres.
STALE, ACCURATE, ACCURACY_CAP, VEHICLE_ERROR, NEAR_STOP = 45, 150.0, 60.0, 30.0, 40.0
STOP_HOLD, CLOCK_GRACE, MOVED, OFF_ROUTE, OFF_ROUTE_HOLD, WALK_STEP = 10, 90, 30, 300.0, 90, 30.0
RETRY, BETTER_EVERY, IMMINENT, AHEAD = 10, 180, 180, 30


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    s, t = math.sin((q - p) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    h = s * s + math.cos(p) * math.cos(q) * t * t
    return 2 * 6371e3 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


class Session:
    """The state of one journey, a JSON object between batches."""

    def __init__(self, raw: str | None):
        self.s = json.loads(raw) if raw else {"legs": [], "leg": 0, "boarded": False, "hold": {}, "told": {}, "over": {}, "fix": None, "last": 0}

    def dump(self) -> str:
        return json.dumps(self.s)

    def hold(self, name: str, condition: bool, now: int, seconds: int) -> bool:
        """Whether ``condition`` has held without a break for ``seconds``."""
        if not condition:
            self.s["hold"].pop(name, None)
            return False
        return now - self.s["hold"].setdefault(name, now) >= seconds

    def once(self, name: str, now: int, every: int) -> bool:
        if name in self.s["told"] and now - self.s["told"][name] < every:
            return False
        self.s["told"][name] = now
        return True

    def times(self) -> list[tuple[int, int]]:
        """Departure and arrival of each leg with the delays known; no leg starts before the last one ends."""
        out, cursor = [], 0
        for leg in self.s["legs"]:
            o = self.s["over"].get(str(leg.get("trip")), {})
            dep, arr = leg["dep"] + o.get("dep_delay", 0), leg["arr"] + o.get("arr_delay", 0)
            if leg["mode"] != "transit":
                dep = max(cursor, leg["dep"])
                arr = dep + leg["arr"] - leg["dep"]
            out.append((dep, arr))
            cursor = max(cursor, arr)
        return out

    def take(self, row) -> Iterator[tuple[str, dict]]:
        now = int(row.at)
        s = self.s
        if row.kind == "plan":
            plan = json.loads(row.payload)
            fresh = not s["legs"]
            old = {self.signature(x) for x in s["legs"]}
            s.update(legs=plan["legs"], leg=0, boarded=bool(plan.get("onboard")), hold={}, told={})
            s["seen"] = self.times()
            changed = [i for i, x in enumerate(plan["legs"]) if self.signature(x) not in old]
            yield ("hello", {"mode": plan.get("mode", "live")}) if fresh else ("reroute", {"reason": plan.get("reason", ""), "changed_legs": changed})
        elif row.kind == "fix":
            stale = row.at < s["last"] - STALE or (s["fix"] and row.at < s["fix"][2])
            if row.accuracy_m <= ACCURATE and not (row.lat == 0 and row.lon == 0) and not stale:
                s["fix"] = [row.lat, row.lon, now, min(row.accuracy_m, ACCURACY_CAP)]
        elif row.kind == "overlay":
            s["over"] = json.loads(row.payload)
        s["last"] = max(s["last"], now)
        if s["legs"] and s["leg"] < len(s["legs"]):
            yield from self.evaluate(max(now, s["last"]))

    @staticmethod
    def signature(leg: dict) -> str:
        return f"{leg.get('trip') if leg['mode'] == 'transit' else leg['mode']}|{leg.get('from')}|{leg.get('to')}"

    def evaluate(self, now: int) -> Iterator[tuple[str, dict]]:
        s = self.s
        times = self.times()
        fix = s["fix"] if s["fix"] and now - s["fix"][2] <= STALE else None
        while s["leg"] < len(s["legs"]):
            i, leg = s["leg"], s["legs"][s["leg"]]
            dep, arr = times[i]
            o = s["over"].get(str(leg.get("trip")), {})
            end = tuple(leg["to_at"]) if leg.get("to_at") else None
            near = bool(fix and end and metres((fix[0], fix[1]), end) <= NEAR_STOP + fix[3])
            if leg["mode"] != "transit":
                done = now >= arr or self.hold("end", near, now, STOP_HOLD)
                if not done:
                    if fix and end:
                        left = metres((fix[0], fix[1]), end)
                        if abs(left - s.get("left", 1e9)) >= WALK_STEP:
                            s["left"] = left
                            yield "progress", {"phase": "walking", "leg": i, "distance_to_stop_m": round(left)}
                    break
                yield from self.next_leg("waiting")
                continue
            passed = o.get("passed")
            if not s["boarded"]:
                if not (passed is not None and passed >= leg["board_pos"] or passed is None and now >= dep + CLOCK_GRACE):
                    break
                s["boarded"] = True
                yield "progress", {"phase": "boarded", "leg": i}
            riding_with = bool(fix and o.get("lat") is not None and metres((fix[0], fix[1]), (o["lat"], o["lon"])) <= 55 + fix[3] + VEHICLE_ERROR)
            if passed is not None and passed >= leg["alight_pos"] or passed is None and now >= arr + CLOCK_GRACE:
                if passed is not None and passed > leg["alight_pos"] and riding_with:
                    if self.once("missed", now, 1 << 30):
                        yield "deviation", {"kind": "missed_alight", "leg": i, "expected_stop": leg.get("to")}
                        yield "replan", {"reason": "missed_alight", "leg": i}
                    break
                yield from self.next_leg("alighted")
                continue
            break
        if s["leg"] >= len(s["legs"]):
            yield "arrived", {}
            return
        yield from self.watch(now, times, fix)

    def next_leg(self, phase: str) -> Iterator[tuple[str, dict]]:
        yield "progress", {"phase": phase, "leg": self.s["leg"]}
        self.s.update(leg=self.s["leg"] + 1, boarded=False, hold={}, left=1e9)

    def watch(self, now: int, times: list[tuple[int, int]], fix) -> Iterator[tuple[str, dict]]:
        """Delays, legs that can't be made, better arrivals, and travellers off their way."""
        s = self.s
        seen = s.get("seen") or times
        moved = [i for i in range(s["leg"], len(times)) if max(abs(times[i][0] - seen[i][0]), abs(times[i][1] - seen[i][1])) >= MOVED]
        if moved:
            s["seen"] = times
            yield "delay", {"legs": moved, "arrive_delta_s": times[-1][1] - s["legs"][-1]["arr"]}
        for i in range(s["leg"], len(times)):
            leg = s["legs"][i]
            o = s["over"].get(str(leg.get("trip")), {})
            late = i > s["leg"] and leg["mode"] == "transit" and times[i - 1][1] > times[i][0] and o.get("passed") is not None and o["passed"] >= leg["board_pos"]
            reason = "cancelled" if o.get("cancelled") else "stop_skipped" if o.get("skipped") else "missed_connection" if late else ""
            if reason:
                if self.once(f"warn{i}{reason}", now, 1 << 30):
                    yield "warning", {"kind": reason, "leg": i}
                if self.once("replan", now, RETRY):
                    yield "replan", {"reason": reason, "leg": i}
                return
        current = s["legs"][s["leg"]]
        imminent = current["mode"] == "transit" and not s["boarded"] and times[s["leg"]][0] - now <= IMMINENT
        if moved and not imminent and self.once("better", now, BETTER_EVERY):
            yield "replan", {"reason": "better_arrival", "arrive": times[-1][1]}
        points = [tuple(p) for p in (current.get("from_at"), current.get("to_at")) if p]
        if fix and points and current["mode"] != "transit":
            off = min(metres((fix[0], fix[1]), p) for p in points) > OFF_ROUTE + fix[3]
            if self.hold("off", off, now, OFF_ROUTE_HOLD) and self.once("off_route", now, 1 << 30):
                yield "deviation", {"kind": "off_route", "leg": s["leg"]}


def _process(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    session = Session(state.get[0] if state.exists else None)
    rows = pd.concat(list(frames)).sort_values(["at", "kind"], kind="stable")
    out = [(key[0], int(r.at), name, json.dumps(detail)) for r in rows.itertuples(index=False) for name, detail in session.take(r)]
    if any(e[2] == "arrived" for e in out):
        if state.exists:
            state.remove()
    else:
        state.update((session.dump(),))
    yield pd.DataFrame(out, columns=["session_id", "at", "event", "detail"])


def track(inputs: DataFrame) -> DataFrame:
    """Events of all sessions in a stream of INPUT rows."""
    return inputs.groupBy("session_id").applyInPandasWithState(_process, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
