"""Invented texts for the tests."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, size: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(size):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 16 & 15] + str(x >> 20 & 31))
    return " ".join(out)
