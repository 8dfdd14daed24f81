"""Words of UTF-8 texts as bytes, a bounded piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes that are split into words at once, of however long a text; a piece ends with a whole word.
PIECE = 4_000_000


def separators(keep: str, lower: bool = False) -> bytes:
    """A translation table: ASCII bytes that ``keep`` does not hold become spaces, A-Z small letters on request; bytes of other characters stay."""
    kept = {ord(c) for c in keep}
    return bytes(32 if c < 128 and c not in kept else c + 32 if lower and 65 <= c <= 90 else c for c in range(256))


def words(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """Lists of the words between the separators of ``table``, in order, each list of a bounded piece of the text."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
