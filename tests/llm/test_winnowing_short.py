"""Fingerprints of short texts and of texts changed every so often."""

import random

import pytest

from driftcube.llm import winnowing


@pytest.mark.parametrize("n", [8, 16, 31, 32, 63, 64, 100, 189, 400])
def test_kept_half_is_seen(n):
    draw = random.Random(n)
    text, other = ("".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for _ in range(2))
    own, edited, unlike = (winnowing.fingerprint(t)[1] for t in (text, text[: n - n // 2] + other[: n // 2], other))
    assert winnowing.likeness(own, edited) > max(0.05, winnowing.likeness(own, unlike))


def test_a_change_every_90_characters():
    draw = random.Random(9)
    text = [draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(5000)]
    changed = ["#" if i % 90 == 0 else c for i, c in enumerate(text)]
    assert winnowing.likeness(winnowing.fingerprint("".join(text))[1], winnowing.fingerprint("".join(changed))[1]) > 0.5


@pytest.mark.parametrize("n", [31, 32, 63, 64, 65])
def test_no_seam_between_schemes(n):
    draw = random.Random(1)
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(70))
    likeness = winnowing.likeness(winnowing.fingerprint(text[:n])[1], winnowing.fingerprint(text[: n + 1])[1])
    assert likeness > 0.8
