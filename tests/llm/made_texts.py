"""Invented prose for the tests."""

VOCABULARY = [a + b for a in ("ti", "on", "re", "en", "ou", "la", "ché", "ß", "Th", "IN") for b in ("", "st", "nd", "er", "ing", "au", "o")]


def prose(rng, n):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", " ", ", ", ".\n", "  "]) for _ in range(n))
