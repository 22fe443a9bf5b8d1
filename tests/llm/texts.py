"""Made-up texts."""

import random


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = (rng.randrange(vocabulary) for _ in range(n))
    return " ".join(f"w{letters[k % 26]}{letters[k // 26 % 26]}{letters[k // 676]}" for k in made)
