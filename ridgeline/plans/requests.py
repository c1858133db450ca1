"""Validation of requests at the edge of the engine."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

MAX_AVOID = 500


def _number(value, name: str, low: float = -math.inf, high: float = math.inf) -> float:
    try:
        x = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name}: not a number") from None
    if not math.isfinite(x) or not low <= x <= high:
        raise ValueError(f"{name}: out of range")
    return x


def _id(value, name: str) -> int:
    x = _number(value, name, 1, 2**53 - 1)
    if x != int(x):
        raise ValueError(f"{name}: not a whole number")
    return int(x)


def viewport_box(query: dict) -> tuple[float, float, float, float]:
    return tuple(_number(query.get(k), k) for k in ("minLon", "minLat", "maxLon", "maxLat"))  # type: ignore[return-value]


@dataclass(frozen=True)
class PathPoint:
    segment_id: int
    direction: str
    lon: float
    lat: float
    at_m: float | None = None


@dataclass(frozen=True)
class PathRequest:
    start: PathPoint
    target: PathPoint | None
    grow: bool
    avoid: tuple[int, ...]

    @classmethod
    def parse(cls, query: dict) -> PathRequest:
        def point(prefix: str) -> PathPoint:
            key = lambda k: prefix + k[0].upper() + k[1:] if prefix else k
            direction = query.get(key("direction"))
            if direction not in ("forward", "backward"):
                raise ValueError(f"{key('direction')}: forward or backward")
            at = query.get(key("atM"))
            return PathPoint(_id(query.get(key("segmentId")), key("segmentId")), direction, _number(query.get(key("lon")), key("lon"), -180, 180), _number(query.get(key("lat")), key("lat"), -90, 90), None if at is None else _number(at, key("atM"), 0))

        given = [k in query for k in ("toSegmentId", "toDirection", "toLon", "toLat")]
        if any(given) and not all(given):
            raise ValueError("toSegmentId, toDirection, toLon and toLat go together")
        grow = query.get("grow", "true")
        if grow not in ("true", "false"):
            raise ValueError("grow: true or false")
        if grow == "false" and not any(given):
            raise ValueError("grow=false needs a point to reach")
        avoid = query.get("avoid")
        if avoid is not None and not re.fullmatch(r"\d+(,\d+)*", avoid):
            raise ValueError("avoid: a comma-separated list of segment ids")
        ids = tuple(map(int, avoid.split(","))) if avoid else ()
        if len(ids) > MAX_AVOID:
            raise ValueError(f"avoid: at most {MAX_AVOID} ids")
        return cls(point(""), point("to") if any(given) else None, grow == "true", ids)


def answer(graph, request: PathRequest, start_m: float, target_m: float | None = None):
    """(pieces, reason, branches, ahead) of a request: grown from the start, or to the target and on from there; None where the target can't be reached."""
    line = (request.start.segment_id, request.start.direction)
    if request.target is None:
        return graph.grow(line, start_m, avoid=request.avoid)
    goal = (request.target.segment_id, request.target.direction)
    way = graph.connect(line, start_m, goal, target_m)
    if way is None:
        return None
    if not request.grow:
        return way, "connected", [], 0.0
    whole = way[-1][3] + way[-1][2] - way[-1][1] if way else 0.0
    passed = tuple({p[0][0] for p in way} - {goal[0]}) + request.avoid
    more, reason, branches, ahead = graph.grow(goal, target_m, avoid=passed, rule=None)
    return [*way, *[(p[0], p[1], p[2], p[3] + whole, *p[4:]) for p in more]], reason, branches, ahead
