"""Plain Python versions of the contracts, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def pii_row(text: str | None) -> tuple:
    spans = pii_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined.encode()).hexdigest(), joined)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(repeated)


def shingles(text: str | None) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(texts: dict) -> dict:
    """doc_id -> (set size, smallest reachable id)."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def merge_dropout(text: str, ids: dict, rank, byte: list[int], rate: float, key: int) -> list[int]:
    """One agenda for a whole text: the best candidate, leftmost among equals, is skipped for good or merged."""
    mark, mask = "\u2581", (1 << 64) - 1
    parts = [(c, at) for at, c in enumerate(mark + text.replace(" ", mark))] if text else []
    skipped = set()
    while True:
        found = []
        for k in range(len(parts) - 1):
            i = ids.get(parts[k][0] + parts[k + 1][0])
            if i is not None and (parts[k][1], parts[k + 1][1], i) not in skipped:
                found.append((int(rank[i]), parts[k][1], k, i))
        if not found:
            break
        _, at, k, i = min(found)
        h = (key ^ (at * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F)) & mask
        if ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & mask) >> 32 < int(rate * (1 << 32)):
            skipped.add((at, parts[k + 1][1], i))
        else:
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], at)]
    return [x for p, _ in parts for x in ([ids[p]] if p in ids else [byte[b] for b in p.encode()])]
