"""Helpers that test modules of this folder import by name."""

from __future__ import annotations

import random


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(1, 9))) for _ in range(n))
