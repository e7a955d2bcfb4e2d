"""Likeness of two strings by longest common subsequences, 0 to 100, as published for indel distances.

ratio: twice the common subsequence by both lengths. partial_ratio: the best ratio of the shorter with a window of the
longer. token_set_ratio: the best ratio among the sorted common words and those with either side's other words.
"""

from __future__ import annotations

from .geometry import near

#: Likeness from which blocks are one, by token sets, by a part, by tokens of a contained one; least length.
TOKENS, PART, CONTAINED, CHARS = 88, 92, 75, 15


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, in bit-parallel rows."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n = len(a)
    windows = [b[max(i, 0) : i + n] for i in range(1 - n, len(b))]
    return max(ratio(a, w) for w in windows)


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    if not both:
        return ratio(left, right)
    # what all begin with is common to them
    n = len(both)
    one, two = n + 1 + len(left), n + 1 + len(right)
    return max(200.0 * (n + 1 + common(left, right)) / (one + two), 200.0 * n / (n + one), 200.0 * n / (n + two))


def alike(a: dict, b: dict) -> float | None:
    """How like two blocks (norm, region, x1, y1, x2, y2) are if they are one block read twice, else None. Equal norms are,
    wherever they stand; like ones if near each other or of one region; a part or a contained one only if near."""
    if not a["norm"] or not b["norm"]:
        return None
    if a["norm"] == b["norm"]:
        return 100.0
    together, region = near(a, b, 0.0, min, max, abs), a["region"] == b["region"]
    if not (together or region):
        return None
    score = token_set_ratio(a["norm"], b["norm"])
    if score >= TOKENS:
        return score
    short, long = sorted((a["norm"], b["norm"]), key=len)
    if together and len(short) >= CHARS:
        part = partial_ratio(short, long)
        if part >= PART:
            return part
        if short in long and (region or score >= CONTAINED):
            return max(score, part)
    return None


def distinct(blocks: list[dict]) -> tuple[list[dict], list[tuple[dict, dict, float]]]:
    """Blocks in order without those that are like one kept before; one of a higher quality takes its place. Also what was
    removed: (kept, removed, likeness)."""
    kept, removed = [], []
    for b in blocks:
        for i, k in enumerate(kept):
            if (score := alike(b, k)) is not None:
                better = b["quality"] > k["quality"]
                removed.append((b, k, score) if better else (k, b, score))
                if better:
                    kept[i] = b
                break
        else:
            kept.append(b)
    return kept, removed
