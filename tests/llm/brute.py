"""Plain Python counterparts of the operators, for small tables."""

import heapq
import math
import re

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def roots(n, links):
    """Smallest reachable index of each of n."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return [find(x) for x in range(n)]


def simhash(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows):
    """{(id): smallest id of its class} of (id, text)."""
    prints = [simhash(t) for _, t in rows]
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(n, links)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    return prints, [least.get(root[i]) for i in range(n)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    """(start, kind number, end) of the base spans."""
    out = []
    for number, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), number, m.end()))
    return sorted(out)


def water(sizes, weights, share, most):
    """Targets of sources in order."""
    total, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        if not free or not total:
            return [most * s if i in capped else 0.0 for i, s in enumerate(sizes)]
        rate = (total - sum(most * sizes[i] for i in capped)) / sum(weights[i % len(weights)] for i in free)
        over = {i for i in free if weights[i % len(weights)] * rate > most * sizes[i]}
        if not over:
            return [most * s if i in capped else weights[i % len(weights)] * rate for i, s in enumerate(sizes)]
        capped |= over


def sainte_lague(votes, seats):
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    out = [0] * len(votes)
    for _ in range(seats if heap else 0):
        _, i, k = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    return out


def cosine_links(rows, threshold):
    """(n_links, component) per row of (id, vector), unusable vectors as None."""
    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    units = [unit(v) if v else None for _, v in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if units[i] and units[j] and len(units[i]) == len(units[j])
        and sum(a * b for a, b in zip(units[i], units[j])) >= threshold
    ]
    counts = [0] * len(rows)
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    return counts, [rows[r][0] for r in roots(len(rows), links)]
