"""Sequential recurrences of the tracker and the sampling policies.

A kernel is ``run(values, aux, cfg, state, out) -> state`` over one consecutive
piece of one series. Everything it remembers is in ``state``, a JSON-able value, so
a series may be cut anywhere and streamed or replayed piece by piece with equal results.
``out`` collects the columns; all metrics over them are DataFrame work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from tickloom.functions.mapping import interval_function

INIT, NORMAL, OUTLIER, DRIFT = 0, 1, 2, 3
STATUS_NAMES = ("INIT", "NORMAL", "OUTLIER", "DRIFT_RESET")
_DENSITY = 1.0 / math.sqrt(2.0 * math.pi)
NAN = float("nan")


class Columns:
    """Output columns of one replayed piece; NaN and -1 stand for NULL."""

    def __init__(self) -> None:
        self.sampled: list[bool] = []
        self.interval: list[int] = []
        self.urgency: list[float] = []
        self.status: list[int] = []
        self.mean: list[float] = []
        self.std: list[float] = []
        self.z: list[float] = []
        self.alpha: list[float] = []

    def skip(self, interval: int, urgency: float) -> None:
        self.sampled.append(False)
        self.interval.append(interval)
        self.urgency.append(urgency)
        self.status.append(-1)
        self.mean.append(NAN)
        self.std.append(NAN)
        self.z.append(NAN)
        self.alpha.append(NAN)

    def take(self, interval: int, urgency: float, tick: tuple) -> None:
        self.sampled.append(True)
        self.interval.append(interval)
        self.urgency.append(urgency)
        self.status.append(tick[0])
        self.mean.append(tick[1])
        self.std.append(tick[2])
        self.z.append(tick[3])
        self.alpha.append(tick[4])


def tracker_start() -> list:
    """[mean, variance, std, consecutive outliers]; mean None = nothing seen."""
    return [None, 0.0, 0.0, 0]


def tracker_step(cfg: Mapping[str, object]) -> Callable[[list, float], tuple]:
    """``step(state, x)`` updates the tracker and returns (status, mean, std, z, alpha)."""
    base, beta = float(cfg["alpha_base"]), float(cfg["beta"])
    threshold, tolerance = float(cfg["outlier_threshold"]), int(cfg["drift_tolerance"])
    floor = float(cfg["initial_variance_floor"])
    exp, sqrt = math.exp, math.sqrt

    def restart(st: list, x: float) -> None:
        spread = abs(x) * 0.1
        st[0] = x
        st[1] = max(floor, spread * spread)
        st[2] = sqrt(st[1])
        st[3] = 0

    def step(st: list, x: float) -> tuple:
        mean = st[0]
        if mean is None:
            restart(st, x)
            return INIT, x, st[2], 0.0, 1.0
        z = (x - mean) / (st[2] + 1e-8)
        if abs(z) > threshold:
            st[3] += 1
            if st[3] >= tolerance:
                restart(st, x)
                return DRIFT, x, st[2], z, 1.0
            return OUTLIER, mean, st[2], z, 0.0
        st[3] = 0
        alpha = base * (1.0 - beta * (_DENSITY * exp(-0.5 * (z * z))))
        keep = 1.0 - alpha
        st[0] = keep * mean + alpha * x
        off = x - mean
        st[1] = keep * st[1] + alpha * (off * off)
        st[2] = sqrt(st[1])
        return NORMAL, st[0], st[2], z, alpha

    return step


def run_tracker(values, aux, cfg, state, out: Columns):
    """Every tick is read: the dense reference."""
    st = state or tracker_start()
    step = tracker_step(cfg)
    for x in values:
        out.take(1, 1.0, step(st, x))
    return st


def run_masked(values, aux, cfg, state, out: Columns):
    """The tracker sees only the ticks of a mask; urgency defaults to 1 / interval."""
    st = state or tracker_start()
    step = tracker_step(cfg)
    urgencies = aux.get("urgency") or [1.0 / i for i in aux["interval"]]
    for x, keep, interval, u in zip(values, aux["mask"], aux["interval"], urgencies):
        if keep:
            out.take(interval, u, step(st, x))
        else:
            out.skip(interval, u)
    return st


def sampler_start(cfg: Mapping[str, object]) -> dict:
    return {
        "t": tracker_start(), "u": 1.0, "steps": 0, "drift": 0.0, "outlier": 0.0,
        "ring": [], "auto": float(cfg["sigma_ref"]) == 0.0, "sigma": float(cfg["sigma_ref"]),
        "warm": 0, "acc": 0.0,
    }


def _unit(x: float) -> float:
    return 0.0 if x < 0.0 else 1.0 if x > 1.0 else x


def urgency_step(cfg: Mapping[str, object]) -> Callable[[dict, tuple], None]:
    """``update(state, tick)`` folds one read tick into the urgency."""
    sens = float(cfg["variance_sensitivity"])
    warmup, positive_only = int(cfg["warmup"]), bool(cfg["warmup_positive_std_only"])
    adapt = float(cfg["sigma_ref_adapt"])
    window, weight = int(cfg["instability_window"]), float(cfg["instability_weight"])
    boost, decay = float(cfg["drift_boost"]), float(cfg["drift_decay"])
    outlier_decay, threshold = float(cfg["outlier_decay"]), float(cfg["outlier_threshold"])
    smooth = float(cfg["urgency_smoothing"])
    cool_rate, cool_below = float(cfg["cooldown_rate"]), float(cfg["cooldown_threshold"])

    def update(s: dict, tick: tuple) -> None:
        status, std, z = tick[0], tick[2], tick[3]
        unstable = status >= OUTLIER
        ring = s["ring"]
        ring.append(1 if unstable else 0)
        if len(ring) > window:
            del ring[0]
        if s["auto"]:
            if status == NORMAL and (std > 0.0 or not positive_only):
                s["warm"] += 1
                if s["warm"] >= warmup:
                    s["sigma"], s["auto"] = std, False
            s["u"] = 1.0
            return
        if adapt > 0 and std > 0:
            s["sigma"] = (1.0 - adapt) * s["sigma"] + adapt * std
        variance = _unit((std / (s["sigma"] + 1e-8) - 1.0) * sens)
        instability = _unit(sum(ring) / len(ring) * weight)
        s["drift"] = _unit(boost) if status == DRIFT else _unit(s["drift"] * decay)
        if unstable:
            s["outlier"] = max(s["outlier"], min(1.0, (abs(z) - threshold) / threshold))
        else:
            s["outlier"] = _unit(s["outlier"] * outlier_decay)
        raw = _unit(max(variance, instability, s["drift"], s["outlier"]))
        u = smooth * s["u"] + (1.0 - smooth) * raw
        if raw < cool_below:
            u *= 1.0 - cool_rate
        s["u"] = _unit(u)

    return update


def run_sampler(values, aux, cfg, state, out: Columns):
    """Urgency-adaptive sampling; a read reports the interval that led to it."""
    s = state or sampler_start(cfg)
    step, update, interval_at = tracker_step(cfg), urgency_step(cfg), interval_function(cfg)
    tracker, steps = s["t"], s["steps"]
    interval = interval_at(s["u"])
    for x in values:
        steps += 1
        if steps >= interval or tracker[0] is None:
            tick = step(tracker, x)
            update(s, tick)
            out.take(interval, s["u"], tick)
            interval, steps = interval_at(s["u"]), 0
        else:
            out.skip(interval, s["u"])
    s["steps"] = steps
    return s


def run_feed(values, aux, cfg, state, out: Columns):
    """Every tick is read and folded into the urgency; reports the new interval."""
    s = state or sampler_start(cfg)
    step, update, interval_at = tracker_step(cfg), urgency_step(cfg), interval_function(cfg)
    tracker = s["t"]
    for x in values:
        tick = step(tracker, x)
        update(s, tick)
        out.take(interval_at(s["u"]), s["u"], tick)
    return s


def run_live(values, aux, cfg, state, out: Columns):
    """Counter reads: a read sees the sum since the last one, divided by the ticks between."""
    s = state or sampler_start(cfg)
    step, update, interval_at = tracker_step(cfg), urgency_step(cfg), interval_function(cfg)
    tracker = s["t"]
    interval = interval_at(s["u"])
    for x in values:
        s["steps"] += 1
        s["acc"] += x
        if s["steps"] >= interval or tracker[0] is None:
            tick = step(tracker, s["acc"] / max(1, s["steps"]))
            update(s, tick)
            interval = interval_at(s["u"])
            s["steps"], s["acc"] = 0, 0.0
            out.take(interval, s["u"], tick)
        else:
            out.skip(interval, s["u"])
    return s


def run_scheduled(values, aux, cfg, state, out: Columns):
    """Sampling by a given urgency column; only reads reach the tracker."""
    s = state or {"t": tracker_start(), "steps": 0}
    step, interval_at = tracker_step(cfg), interval_function(cfg)
    tracker, steps = s["t"], s["steps"]
    for x, u in zip(values, aux["urgency"]):
        u = _unit(u)
        interval = interval_at(u)
        steps += 1
        if steps >= interval or tracker[0] is None:
            out.take(interval, u, step(tracker, x))
            steps = 0
        else:
            out.skip(interval, u)
    s["steps"] = steps
    return s
