"""Likeness of two fingerprints from their whole strings, by the definition."""

from driftcube.llm import winnowing


def kept(print_, n, scheme):
    """Hashes of a scheme of a text of n code points: a short one's print holds all its 8-grams by position, then its 3-grams."""
    pairs = [h for h, _ in winnowing.parse(print_)]
    if n >= 64 or scheme == 2:
        return set(pairs)
    grams = pairs[: max(1, n - 7) if n else 0]
    windows = range(max(1, len(grams) - 7) if grams else 0)
    return set(grams) if scheme else {min(grams[i : i + 8]) for i in windows}


def alike(f, n, g, m):
    """Jaccard index at the coarser of the schemes of texts of n and m code points."""
    scheme = min((x < 64) + (x < 32) for x in (n, m))
    a, b = kept(f, n, scheme), kept(g, m, scheme)
    return len(a & b) / len(a | b) if a | b else 1.0
