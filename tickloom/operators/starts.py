"""Candidate starts of a piece of a series, and the ends of a piece from many starts at once.

A state has three parts. What averages and windows hold is forgotten: two runs over the same reads come to the
same value, to the last bit, some thousand reads on. What a series settles once (a reference deviation, a
calibrated limit) is never forgotten and is taken from a settled state. The phase (when the next read is due) may
be kept for ever too, but has few values. So a piece runs from all phases at once, and the runs that meet go on as
one: what is left at its end are the few states that a long past can lead to.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

SEGMENT = 4096  # ticks between two looks at whether runs have met
TAIL = 512  # values before a piece that starts may use


class Nothing:
    """Columns that nobody reads."""

    def take(self, *_) -> None:
        pass

    skip = take


def sampler_starts(cfg: Mapping, base: dict, settled: dict, tail: list) -> list[dict]:
    kept = {}
    if not settled["auto"]:
        kept = {"auto": False, "warm": settled["warm"]}
        if base["auto"] or float(cfg["sigma_ref_adapt"]) <= 0:
            kept["sigma"] = settled["sigma"]
    return [{**base, **kept, "steps": j} for j in range(int(cfg["max_interval"]))]


def live_starts(cfg: Mapping, base: dict, settled: dict, tail: list) -> list[dict]:
    """What has come in since the last read is added up in its order, from zero."""
    found = sampler_starts(cfg, base, settled, tail)[:len(tail) + 1]
    for j, s in enumerate(found):
        s["acc"] = 0.0
        for x in tail[len(tail) - j:]:
            s["acc"] += x
    return found


def scheduled_starts(cfg: Mapping, base: dict, settled: dict, tail: list) -> list[dict]:
    return [{**base, "steps": j} for j in range(int(cfg["max_interval"]))]


def predictive_starts(cfg: Mapping, base: dict, settled: dict, tail: list) -> list[dict]:
    return [{**base, "every": i, "left": j, "prev": tail[j - i] if i - j <= len(tail) else base["prev"]}
            for i in sorted(set(cfg["intervals"])) for j in range(i)]


def robust_starts(cfg: Mapping, base: dict, settled: dict, tail: list) -> list[dict]:
    """The phases of the interval at hand, with the reads of that interval; other intervals soon come to it."""
    every, width = base["every"], int(cfg["reference_window"])
    out = []
    for left in range(every):
        reads = tail[::-1][every - 1 - left::every][:width][::-1]
        past = reads if len(reads) == width else base["hist"]
        out += [{**base, "left": left, "stable": k, "hist": past} for k in range(int(cfg["recovery_samples"]))]
    return out


def timer_starts(cfg: Mapping, base: dict, settled: dict, tail: list) -> list[dict]:
    kept = {n: settled[n] for n in ("limit", "cal", "age", "seen")}
    return [{**base, **kept, "wait": j} for j in range(1, int(cfg["max_interval"]) + 1)]


STARTS = {
    "urgency_adaptive": sampler_starts,
    "live_counter": live_starts,
    "always_sample": lambda *given: sampler_starts(*given)[:1],
    "scheduled_urgency": scheduled_starts,
    "predictive_frequency": predictive_starts,
    "robust_exponential": robust_starts,
    "time_or_variation": timer_starts,
}


def guesses(policy: str, cfg: Mapping, base: object, settled: object, tail: list) -> list[object]:
    """States in every phase, from a state ``base`` that is about right otherwise; ``tail``: the values before."""
    return STARTS[policy](cfg, base, settled, tail) if policy in STARTS else [base]


def written_state(state: object) -> str:
    """A state as text: equal texts are equal states, to the last bit."""
    return json.dumps(state, sort_keys=True)


def ends(kernel, values: list, aux: dict, cfg: Mapping, starts: list[str], whole: bool = False) -> dict[str, str]:
    """{start: end} of one piece from all ``starts``; runs that meet go on as one. ``whole``: not to be cut."""
    runs: dict[str, list[str]] = {s: [s] for s in starts}
    size = max(len(values), 1) if whole or len(runs) < 2 else SEGMENT
    for at in range(0, len(values), size):
        part, side = values[at:at + size], {k: v[at:at + size] for k, v in aux.items()}
        after: dict[str, list[str]] = {}
        for state, origins in runs.items():
            end = kernel(part, side, cfg, json.loads(state), Nothing())
            after.setdefault(written_state(end), []).extend(origins)
        runs = after
    return {origin: state for state, origins in runs.items() for origin in origins}
