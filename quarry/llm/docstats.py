"""Per-document text statistics used by the quality rules and the quality classifier.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split()``
yields on UTF-8 text. All functions take whole texts; empty texts give zeros."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"

#: Character classes of the byte histogram. Bytes 0x80-0xBF continue a character and count
#: nowhere; lead bytes >= 0xC0 count one non-ASCII character.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "bang", "symbol", "other_ascii", "non_ascii")


def _class_of_byte() -> np.ndarray:
    m = np.zeros((256, len(CLASSES)))
    for b in range(128):
        c = chr(b)
        if "a" <= c <= "z":
            k = 0
        elif "A" <= c <= "Z":
            k = 1
        elif "0" <= c <= "9":
            k = 2
        elif c == "\n":
            k = 4
        elif c in " \t\r\x0b\x0c":
            k = 3
        elif c in ".,;:":
            k = 5
        elif c in "!?":
            k = 6
        elif b in SYMBOLS:
            k = 7
        else:
            k = 8
        m[b, k] = 1
    m[192:, 9] = 1
    return m


CLASS_OF_BYTE = _class_of_byte()
_SYMBOL_BYTES = np.frombuffer(SYMBOLS, dtype=np.uint8)
#: Odd multipliers of the eight positions of a word window.
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) + 2 * i & (1 << 64) - 1 | 1 for i in range(8)], dtype=np.uint64)


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Each word's number in order of first appearance, and the numbering."""
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.array([put(w, len(seen)) for w in words], dtype=np.int64), seen


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words covered by windows of ``window`` words that occur twice or more, first one included.

    Windows are compared exactly: equal 64-bit hashes are checked against the word numbers."""
    n = len(ids)
    m = n - window + 1
    if m < 2:
        return 0
    u = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        x = u[k : k + m] * _MIX[k]
        h += x ^ (x >> np.uint64(29))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), dtype=bool)
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():  # a 64-bit collision: group by the words themselves
        groups: dict[bytes, list[int]] = {}
        for i in range(m):
            groups.setdefault(ids[i : i + window].tobytes(), []).append(i)
        starts = np.array([i for g in groups.values() if len(g) > 1 for i in g], dtype=np.int64)
    else:
        starts = np.unique(np.concatenate([a, b]))
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:n])))


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines)), len(lines)


def base_stats(data: bytes) -> tuple[list[bytes], np.ndarray, dict[bytes, int], np.ndarray, dict]:
    """Words, their numbers, the numbering, byte counts, and the base figures of a text."""
    words = data.split()
    counts = byte_counts(data)
    ids, seen = word_ids(words)
    n_dup, n_lines = duplicate_lines(data)
    blanks = int(counts[32] + counts[9:14].sum())
    chars = int(counts.sum() - counts[128:192].sum())
    return words, ids, seen, counts, {
        "n_words": len(words),
        "word_chars": chars - blanks,
        "n_symbols": int(counts[_SYMBOL_BYTES].sum()),
        "n_dup_lines": n_dup,
        "n_lines": n_lines,
        "n_repeat_words": repeated_words(ids),
    }
