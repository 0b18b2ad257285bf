"""Invented texts."""


def words(rng, n, vocabulary=800):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(2)) + str(rng.randrange(vocabulary)) for _ in range(n))
