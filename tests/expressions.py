"""Random expressions as trees, with spellings that must not matter and changes that must."""

from __future__ import annotations

import random
from dataclasses import dataclass, field, replace

LABELS = ("cell", "rack", "tier", "zone", "pod", "env")
METRICS = ("queue_depth", "jobs_done", "used", "free", "load:1m")


@dataclass(frozen=True)
class Selector:
    metric: str
    matchers: tuple[tuple[str, str], ...]  # label, operator
    seconds: int = 0  # of its range
    offset: int = 0


@dataclass(frozen=True)
class Call:
    name: str
    of: Selector


@dataclass(frozen=True)
class Aggregate:
    name: str
    mode: str
    labels: tuple[str, ...]
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    mode: str = ""
    on: tuple[str, ...] = ()
    group: str = ""
    taken: tuple[str, ...] = field(default=())


def tree(rnd: random.Random, depth: int = 3) -> object:
    """Nodes have two labels at least where their order could matter."""
    kind = rnd.choice(["selector", "call", "aggregate", "aggregate", "binary", "binary"]) if depth else rnd.choice(["selector", "call"])
    if kind in ("selector", "call"):
        matchers = tuple((label, rnd.choice(["=", "!=", "=~", "!~"])) for label in sorted(rnd.sample(LABELS, rnd.randint(2, 4))))
        offset = rnd.choice([0, 0, 60, 5_400])
        if kind == "selector":
            return Selector(rnd.choice(METRICS), matchers, 0, offset)
        return Call(rnd.choice(["rate", "increase", "delta", "max_over_time"]), Selector(rnd.choice(METRICS), matchers, rnd.choice([90, 300, 5_400, 7_200]), offset))
    if kind == "aggregate":
        return Aggregate(rnd.choice(["sum", "max", "min", "avg", "count"]), rnd.choice(["by", "without"]), tuple(sorted(rnd.sample(LABELS, rnd.randint(2, 3)))), tree(rnd, depth - 1))
    mode = rnd.choice(["", "on", "ignoring"])
    labels = rnd.sample(LABELS, 4)
    group = rnd.choice(["", "group_left", "group_right"]) if mode else ""
    left, right = tree(rnd, depth - 1), tree(rnd, depth - 1)
    return Binary(rnd.choice("+-*/"), left, right, mode, tuple(sorted(labels[:2])) if mode else (), group, tuple(sorted(labels[2:])) if group else ())


def _duration(rnd: random.Random, seconds: int) -> str:
    hours, minutes, rest = seconds // 3_600, seconds % 3_600 // 60, seconds % 60
    parts = "".join(f"{n}{unit}" for n, unit in ((hours, "h"), (minutes, "m"), (rest, "s")) if n)
    return rnd.choice([parts, f"{seconds}s", str(seconds)])


def _blank(rnd: random.Random) -> str:
    return rnd.choice(["", "", " ", "  ", "\n", " # a note\n"])


def _listed(rnd: random.Random, labels: tuple[str, ...]) -> str:
    own = list(labels)
    rnd.shuffle(own)
    return "(" + ("," + _blank(rnd)).join(own) + ")"


def spelled(node: object, rnd: random.Random) -> str:
    """One of the texts of an expression: order of labels and matchers, matcher values, durations, blanks, notes and case of keywords vary."""
    if isinstance(node, Selector):
        own = list(node.matchers)
        rnd.shuffle(own)
        quote = rnd.choice("\"'")
        inner = ("," + _blank(rnd)).join(f"{label}{_blank(rnd)}{op}{quote}{rnd.choice(['a', 'north', 'b.c', 'x}', 'q,r'])}{quote}" for label, op in own)
        text = f"{node.metric}{{{inner}}}" + (f"[{_duration(rnd, node.seconds)}]" if node.seconds else "")
        return text + (f" offset {_duration(rnd, node.offset)}" if node.offset else "")
    if isinstance(node, Call):
        return f"{node.name}({_blank(rnd)}{spelled(node.of, rnd)}{_blank(rnd)})"
    if isinstance(node, Aggregate):
        name, grouping = rnd.choice([node.name, node.name.upper()]), f"{node.mode} {_listed(rnd, node.labels)}"
        inner = f"({_blank(rnd)}{spelled(node.of, rnd)})"
        return f"{name} {grouping} {inner}" if rnd.random() < 0.5 else f"{name}{inner} {grouping}"
    matching = f" {node.mode}{_blank(rnd)}{_listed(rnd, node.on)}" if node.mode else ""
    matching += f" {node.group}{_listed(rnd, node.taken)}" if node.group else ""
    return f"({spelled(node.left, rnd)}) {node.op}{matching} ({spelled(node.right, rnd)})"


def changes(node: object) -> list[object]:
    """Expressions that differ from this one in one thing that matters."""
    if isinstance(node, Selector):
        (label, op), *rest = node.matchers
        out = [
            replace(node, metric="other"),
            replace(node, matchers=((label, "!=" if op == "=" else "="), *rest)),
            replace(node, matchers=tuple(rest)),
            replace(node, matchers=(*node.matchers, ("more", "="))),
            replace(node, offset=node.offset + 60),
        ]
        return [*out, replace(node, seconds=node.seconds + 60)] if node.seconds else out
    if isinstance(node, Call):
        return [replace(node, name="min_over_time"), *(replace(node, of=c) for c in changes(node.of))]
    if isinstance(node, Aggregate):
        own = [
            replace(node, name="stddev"),
            replace(node, mode="by" if node.mode == "without" else "without"),
            replace(node, labels=node.labels[1:]),
            replace(node, labels=(*node.labels, "more")),
        ]
        return own + [replace(node, of=c) for c in changes(node.of)]
    own = [replace(node, op="%"), replace(node, left=node.right, right=node.left)] if node.left != node.right else [replace(node, op="%")]
    if node.mode:
        own.append(replace(node, mode="on" if node.mode == "ignoring" else "ignoring"))
        own.append(replace(node, on=node.on[1:]))
    if node.group:
        own.append(replace(node, group="group_left" if node.group == "group_right" else "group_right"))
        own.append(replace(node, taken=node.taken[1:]))
    return own + [replace(node, left=c) for c in changes(node.left)] + [replace(node, right=c) for c in changes(node.right)]


def broken(text: str) -> list[str]:
    """Texts that are no expressions any more: a bracket is gone, or a name stands behind the end."""
    return [text.replace("{", "", 1), text.rstrip() + "\n behind"]
