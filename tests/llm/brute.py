"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM, VISIBLE = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def groups(sets: dict, percent: int) -> dict:
    """Smallest key reachable by links 100 * |a & b| >= percent * |a | b|, for each key; empty sets link with nothing."""
    holders, shared = defaultdict(list), Counter()
    for key, items in sets.items():
        for item in items:
            holders[item].append(key)
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                shared[(a, b) if a < b else (b, a)] += 1
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: root(k) for k in sets}


def near_duplicates(rows: list[tuple]) -> dict:
    """{id: (n_shingles, component)}."""
    sets = {}
    for i, text in rows:
        words = re.findall(SPACED, (text or "").translate(LOWER))
        sets[i] = {tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    found = groups(sets, 75)
    return {i: (len(sets[i]), found[i]) for i in sets}


def line_dedup(rows: list[tuple], chars: int = 4, percent: int = 80) -> dict:
    """{id: (n_lines, n_removed, kept_in, text)}."""
    places = defaultdict(list)
    for i, text in sorted(rows):
        for n, line in enumerate((text or "").split("\n")):
            if re.search(VISIBLE, line):
                places[line.translate(LOWER)].append((i, n))
    component = groups({x: {x[j:j + chars] for j in range(max(1, len(x) - chars + 1))} for x in places}, percent)
    first = {}
    for line, at in places.items():
        first[component[line]] = min([*at, first.get(component[line], (float("inf"), 0))])
    out = {}
    for i, text in rows:
        stay, lines, holders, removed = [], 0, set(), 0
        for n, line in enumerate((text or "").split("\n")):
            if re.search(VISIBLE, line):
                lines += 1
                holder = first[component[line.translate(LOWER)]]
                if holder != (i, n):
                    removed += 1
                    holders.add(holder[0])
                    continue
            stay.append(line)
        out[i] = (lines, removed, sorted(holders), "\n".join(stay))
    return out


def substring_dedup(rows: list[tuple], window: int = 35) -> dict:
    """{id: (n_words, n_removed, kept text)}."""
    words = {i: re.findall(SPACED, text or "") for i, text in rows}
    seen = Counter(tuple(w[j:j + window]) for w in words.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone[j:j + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def contamination(rows: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """{id: (n_words, n_hit, item ids as sorted strings)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = re.findall(ALNUM, (text or "").translate(LOWER))
        for j in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[j:j + window])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in rows:
        w = re.findall(ALNUM, (text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (ids := windows.get(tuple(w[j:j + size]))):
                    hit[j:j + size] = [True] * size
                    found |= ids
        out[i] = (len(w), sum(hit), sorted(found))
    return out


def runs(words: list) -> list[tuple]:
    """Every run (start, length, period) with at least max(6, 4 * period) words, by start and period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(text: str | None, doc_id: int | None = None) -> dict:
    """Runs and collapsed text; with a doc_id, of the text that its checksum asks for."""
    words = re.findall(SPACED, text or "")
    if doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found, gone = runs(words), set()
    for start, length, period in found:
        gone |= set(range(start + period, start + length))
    return {"runs": found, "text": " ".join(w for i, w in enumerate(words) if i not in gone)}


def hard_negatives(rows: list[tuple], positives: int = 5, negatives: int = 10) -> set[tuple]:
    """Rows (id, label, integer vector) to (anchor, positive, rank, negative, positive score, score); anchors have ids divisible by 100."""
    out = set()
    for i, label, v in rows:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out |= {(i, p, rank, j, -s, -t) for rank, (t, j, _) in enumerate(near, 1)}
    return out


def unigram(rows: list[tuple]) -> dict:
    """{id: (n_tokens, n_known, N, base score)} of rows (id, text)."""
    tokens = [(i, [*re.findall(SPACED, (t or "").translate(LOWER)), None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens}
