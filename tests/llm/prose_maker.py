"""Invented prose."""

import random


def prose(rng: random.Random, words: int) -> str:
    syllables = ["an", "the", "er", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words))
