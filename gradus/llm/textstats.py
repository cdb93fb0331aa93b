"""Statistics of one whole text, counted in a single pass of C-speed primitives.

A word is a run of characters other than space and x09-x0D, which is what ``bytes.split`` cuts
at, so words never depend on Unicode white space. A null or empty text has zero of everything.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\v\f\r"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_bangs", "n_bars", "n_stops", "n_commas", "n_twins", "n_kinds",
)


def repeated(words: list[bytes], width: int = 3) -> int:
    """Words inside ``width``-word windows that occur twice or more in ``words``, first included."""
    grams = list(zip(*(words[i:] for i in range(width))))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    total = end = 0
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def stats(text: str | None) -> tuple[int, ...]:
    """The counts named in NAMES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(GAPS)]
    return (
        len(words),
        len(text) - sum(map(text.count, GAPS)),
        sum(map(raw.count, SYMBOLS.encode())),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, DIGITS)),
        raw.count(b"!"),
        raw.count(b"|"),
        raw.count(b"."),
        raw.count(b","),
        sum(map(eq, words, words[1:])),
        len(set(words)),
    )
