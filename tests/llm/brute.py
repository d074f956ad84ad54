"""Plain restatements of the operators, one row at a time, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACES = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_dedup(docs, min_chars=40, min_docs=5):
    """{(id, text): (n_lines, n_dropped, kept)}"""
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACES).translate(AZ)
    for id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(id)
    out = []
    for id, text in docs:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            held = holders.get(key(line), ())
            largest = max((h for h in held if h is not None), default=None)
            if len(held) < min_docs or id == largest:
                kept.append(line)
        out.append((id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality(text):
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def simhash(text):
    words = words_of((text or "").translate(AZ))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """prints: [(id, fingerprint)] to {id: component}; links at three bits or fewer."""
    parent = {id: id for id, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (a, x) in enumerate(prints):
        for b, y in prints[:n]:
            if (x ^ y).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {id: find(id) for id in parent}


def edit_distance(pattern, text):
    """Of a pattern to the nearest substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (p != t)))
    return min(row)


def url(value, rules):
    if value is None or "://" not in value:
        host = path = ""
    else:
        rest = value.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(AZ)
    best = None
    for verdict, name in rules:
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[1])):
            best = (verdict, name)
    return host, path, best and best[1], best[0] if best else "allow"


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
