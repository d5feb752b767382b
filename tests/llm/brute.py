"""Plain versions of what the corpus operators must return, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text: str | None) -> dict:
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def private(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = []
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text, re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def simhash(text: str | None, k: int) -> int:
    import xxhash

    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: dict[int, int], max_bits: int) -> dict[int, int]:
    """Smallest id reachable over fingerprints within max_bits, by comparing all."""
    import numpy as np

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= max_bits).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {d: ids[find(i)] for i, d in enumerate(ids)}


def without_passages(texts: dict, min_bytes: int, words: int) -> dict:
    """What is left of each text (None: all of it) without strings of `min_bytes` bytes and
    passages of `words` words in fewer bytes that occur twice, by looking each up."""
    raw = {k: (t or "").encode() for k, t in texts.items()}

    def windows(b):
        yield from ((i, i + min_bytes) for i in range(len(b) - min_bytes + 1))
        found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)]
        bounds = [(found[i][0], found[i + words - 1][1]) for i in range(len(found) - words + 1)]
        yield from ((i, j) for i, j in bounds if j - i < min_bytes)

    seen = Counter(b[i:j] for b in raw.values() for i, j in windows(b))
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i, j in windows(b):
            if seen[b[i:j]] > 1:
                gone[i:j] = b"\x01" * (j - i)
        out[k] = bytes(x for x, g in zip(b, gone, strict=True) if not g) if any(gone) else None
    return out


def without_repeats(texts: dict, min_bytes: int) -> dict:
    """(n_bytes, n_removed, n_spans, kept) of each text, by looking every window up."""
    raw = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(b[i : i + min_bytes] for b in raw.values() for i in range(len(b) - min_bytes + 1))
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - min_bytes + 1):
            if seen[b[i : i + min_bytes]] > 1:
                gone[i : i + min_bytes] = b"\x01" * min_bytes
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, kept)
    return out
