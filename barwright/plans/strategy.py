"""Strategy configs: the four schemas, their checks, and their compilation to signals over bars.

regime: logic and conditions; expression: a boolean expression; staged: entry and exit stages with weights, optionally
an emergency exit, a stop and a target; combined: AND or OR of other strategies, any of the four.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.indicators import Kernels
from ..functions.windows import is_true
from ..operators import conditions, expression, sequential

STOP_SOURCES = {
    "bollinger_mid": lambda k, p: k.bands("close", int(p.get("period", 20)), float(p.get("std_dev", 2.0)))[0],
    "lowest_low": lambda k, p: k.lowest("low", int(p.get("period", 20))),
    "highest_high": lambda k, p: k.highest("high", int(p.get("period", 20))),
}


def parse(config: str | dict) -> dict:
    """The config as a dict; text is read as JSON."""
    return json.loads(config) if isinstance(config, str) else config


def kind_of(config: str | dict) -> str:
    """combined, staged, expression or regime, in this order of precedence; unreadable text counts as regime."""
    try:
        c = parse(config)
    except ValueError:
        return "regime"
    if isinstance(c, dict):
        for kind, key in (("combined", "strategies"), ("staged", "entry_stages"), ("expression", "expression")):
            if key in c and (kind != "combined" or "combine" in c):
                return kind
    return "regime"


def problems(config: str | dict) -> list[str]:
    """What keeps a config from being used; none for a good one. Expressions are checked for their syntax."""
    try:
        c = parse(config)
    except ValueError as error:
        return [f"not JSON: {error}"]
    if not isinstance(c, dict):
        return ["a config is an object"]
    kind = kind_of(c)
    if kind == "combined":
        found = [] if str(c.get("combine", "")).upper() in ("AND", "OR") else ["combine is AND or OR"]
        subs = c.get("strategies")
        if not isinstance(subs, list) or len(subs) < 2:
            return [*found, "a combination needs two strategies or more"]
        return found + [f"strategy {i}: {p}" for i, s in enumerate(subs, 1) for p in problems(s)]
    if kind == "staged":
        found = [f"{key} must not be empty" for key in ("entry_stages", "exit_stages") if not isinstance(c.get(key), list) or not c.get(key)]
        if c.get("take_profit") and not c.get("stop_loss"):
            found.append("take_profit needs stop_loss")
        stop = c.get("stop_loss")
        return found + ([f"unknown stop source {stop.get('source')!r}"] if stop and stop.get("source") not in STOP_SOURCES else [])
    if kind == "expression":
        try:
            expression.literals(str(c["expression"]))
        except SyntaxError as error:
            return [f"expression: {error}"]
        return [] if str(c["expression"]).strip() else ["expression is empty"]
    known = c.get("conditions")
    if not isinstance(known, list) or not known:
        return ["conditions must not be empty"]
    return [f"unknown indicator {x.get('indicator')!r}" for x in known if x.get("indicator") not in conditions.REGISTRY]


@dataclass
class Signal:
    """A compiled strategy: the weight held at each bar's close, the reasons of changes, and staged events if any."""

    weight: str
    active: Column
    inactive: Column
    events: str | None = None


def staged_columns(k: Kernels, config: dict, name: str = "staged") -> tuple[str, str]:
    """The weight and event columns of a staged config."""
    if config.get("take_profit") and not config.get("stop_loss"):
        raise ValueError("take_profit needs stop_loss, whose distance it multiplies")
    stop = config.get("stop_loss")
    if stop and stop.get("source") not in STOP_SOURCES:
        raise ValueError(f"unknown stop source {stop.get('source')!r}")

    def stage(i: int, side: str, s: dict) -> tuple[str, str]:
        signal, reason = conditions.combined(k, s), conditions.reason(k, s)
        return k.put(f"{name}_{side}{i}", lambda: signal), k.put(f"{name}_{side}{i}_why", lambda: reason)

    entries = [(sig, float(s.get("weight", 0)), why) for i, s in enumerate(config.get("entry_stages", []), 1) for sig, why in [stage(i, "in", s)]]
    exits = [stage(i, "out", s) for i, s in enumerate(config.get("exit_stages", []), 1)]
    emergency = stage(0, "emergency", config["emergency_exit"]) if config.get("emergency_exit") else None
    level = STOP_SOURCES[stop["source"]](k, stop) if stop else None
    target = float(config["take_profit"].get("multiple", 2.0)) if config.get("take_profit") else None
    return sequential.staged(k, entries, exits, emergency, level, target, name)


def boolean(k: Kernels, config: str | dict, name: str = "s") -> Column:
    """Whether the strategy is in the market at a bar, never null; a staged one is while it holds any weight."""
    c = parse(config)
    kind = kind_of(c)
    if kind == "combined":
        parts = [k.put(f"{name}_{i}", lambda made=boolean(k, s, f"{name}_{i}"): made) for i, s in enumerate(c["strategies"])]
        return reduce(and_ if str(c["combine"]).upper() == "AND" else or_, [F.col(p) for p in parts])
    if kind == "staged":
        return is_true(F.col(staged_columns(k, c, name)[0]) > 0)
    if kind == "expression":
        return F.col(expression.evaluate(k, c["expression"]))
    return conditions.combined(k, c)


def weight_columns(k: Kernels, configs: list[dict]) -> list[str]:
    """The columns of k with the weight that each config holds at a bar's close."""
    out = []
    for i, c in enumerate(configs):
        if kind_of(c) == "staged":
            out.append(staged_columns(k, c, f"c{i}")[0])
        else:
            made = boolean(k, c, f"c{i}")
            out.append(k.put(f"candidate_{i}", lambda made=made: made.cast("double")))
    return out


def compile_signal(k: Kernels, config: str | dict) -> Signal:
    """The strategy over k's bars; its columns are made in k."""
    c = parse(config)
    kind = kind_of(c)
    if kind == "staged":
        weight, events = staged_columns(k, c)
        return Signal(weight, F.lit(""), F.lit(""), events)
    signal = boolean(k, c)
    weight = k.put("position", lambda: signal.cast("double"))
    if kind == "regime":
        return Signal(weight, conditions.reason(k, c, True), conditions.reason(k, c, False))
    words = c["expression"] if kind == "expression" else f"{len(c['strategies'])} strategies by {str(c['combine']).upper()}"
    return Signal(weight, F.lit(f"{words} holds"), F.lit(f"{words} no longer holds"))


def explain(config: str | dict, most_lines: int = 5) -> str:
    """The strategy in at most so many lines of text: one a side of a staged one, and one for all that ends it early."""
    c = parse(config)
    kind = kind_of(c)
    words = lambda s: f" {str(s.get('logic', 'AND')).lower()} ".join(conditions.describe(x) for x in s.get("conditions", [])) or "nothing"
    if kind == "combined":
        which = "all" if str(c["combine"]).upper() == "AND" else "any"
        lines = [f"In the market while {which} of {len(c['strategies'])} strategies are:", *(line for i, s in enumerate(c["strategies"], 1) for line in f"{i}. {explain(s, most_lines)}".split("\n"))]
    elif kind == "staged":
        lines = ["Enter " + ", then ".join(f"{float(s.get('weight', 0)):.0%} when {words(s)}" for s in c["entry_stages"])]
        lines += ["Leave in stages when " + ", then ".join(words(s) for s in c["exit_stages"]) + "; the last one leaves altogether"] if c.get("exit_stages") else []
        lines += [f"Leave at once when {words(c['emergency_exit'])}"] if c.get("emergency_exit") else []
        lines += [f"Stop at the {str(c['stop_loss'].get('source')).replace('_', ' ')} of {c['stop_loss'].get('period', 20)} bars" + (f", target at {float(c['take_profit'].get('multiple', 2.0)):g} times that distance" if c.get("take_profit") else "")] if c.get("stop_loss") else []
    elif kind == "expression":
        lines = [f"In the market while {c['expression']}"]
    else:
        lines = [f"In the market while {words(c)}"]
    return "\n".join(lines[:most_lines])
