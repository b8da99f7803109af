"""Rewards of (prompt, completion) as column functions, kept by name; scores of a reward model's dry run."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

Reward = Callable[[Column, Column], Column]

DEFAULT, MODEL_PREFIX = "length_target", "rm:"
_KNOWN: dict[str, Reward] = {}


def register(name: str) -> Callable[[Reward], Reward]:
    """Decorator that keeps a reward under a name; a later one of the same name takes its place."""

    def keep(reward: Reward) -> Reward:
        _KNOWN[name] = reward
        return reward

    return keep


def rewards() -> list[str]:
    return sorted(_KNOWN)


def reward(name: str | None = None) -> Reward:
    """The reward of a name, the default without one; KeyError that lists the names there are."""
    if (name or DEFAULT) not in _KNOWN:
        raise KeyError(f"no reward {name!r}; there are {', '.join(rewards())}")
    return _KNOWN[name or DEFAULT]


def resolved(spec: str | None, model: Callable[[str], Reward] | None = None) -> Reward:
    """rm:<model> is the score of a reward model, by default of its dry run; anything else a reward's name."""
    if spec and spec.startswith(MODEL_PREFIX):
        return (model or (lambda name: partial(heuristic_score, model=name)))(spec.removeprefix(MODEL_PREFIX))
    return reward(spec)


@register("length_target")
def length_target(prompt: Column, completion: Column, target: int = 200) -> Column:
    """1 at the target length, falling to 0 at twice or none of it."""
    return F.greatest(F.lit(0.0), 1 - F.abs(F.length(completion) - target) / F.lit(float(target)))


@register("numeric_match")
def numeric_match(prompt: Column, completion: Column) -> Column:
    """1 if the last numbers of both texts are the same string, else 0."""
    last = lambda t: F.try_element_at(F.regexp_extract_all(t, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1))
    return F.coalesce((last(prompt) == last(completion)).cast("double"), F.lit(0.0))


@register("nonempty")
def nonempty(prompt: Column, completion: Column) -> Column:
    return completion.rlike(r"(?U)\S").cast("double")


def heuristic_score(prompt: Column, completion: Column, model: str | None = None) -> Column:
    """Half for length up to 240, 0.4 for distinct words, 0.1 for a hash of the model and both texts; within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), heuristic_base(completion) + 0.1 * F.pmod(F.xxhash64(*([F.lit(model)] if model else []), prompt, completion), F.lit(1000)) / 1000.0))


def heuristic_base(completion: Column) -> Column:
    """The part of the heuristic score that is no hash."""
    words = F.filter(F.split(completion, r"(?U)\s+"), lambda w: w != "")
    return 0.5 * F.least(F.lit(1.0), F.length(completion) / 240.0) + 0.4 * F.size(F.array_distinct(words)) / (F.size(words) + 1)
