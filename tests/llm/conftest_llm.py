"""Texts for the tests of this folder."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """Words of a fixed order that differs by seed, with sentences and lines."""
    state, out = seed * 7919 + 1, []
    for i in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + WORDS[(state >> 16) % len(WORDS)])
        if i % 11 == 10:
            out[-1] += "."
    return " ".join(out)
