"""Plain versions of what the operators compute, for small tables."""

import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def fingerprint(text):
    ws = words((text or "").translate(LOWER))
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps, radius):
    """Smallest reachable fingerprint of each."""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def contamination(docs, items, width=13):
    """Per document (n_words, n_hit, item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        ws = ALNUM_WORD.findall((text or "").translate(LOWER))
        size = min(width, len(ws))
        for o in range(len(ws) - size + 1 if size else 0):
            windows[tuple(ws[o : o + size])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        ws = ALNUM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for o in range(len(ws) - size + 1):
                if (ids := windows.get(tuple(ws[o : o + size]))) is not None:
                    hit.update(range(o, o + size))
                    found |= ids
        out.append((len(ws), len(hit), sorted(found)))
    return out
