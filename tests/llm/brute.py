"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import xxhash


def corpus(seed=5):
    """(doc_id, text) with shared passages, copies, near copies, repeats, and the odd cases."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))

    def prose(n):
        return " ".join(word() for _ in range(n))

    passages, half = [prose(60) for _ in range(3)], prose(34)
    docs = []
    for i in range(50):
        text = prose(rng.randint(0, 120))
        if i % 3 == 0:
            text += " " + rng.choice(passages) + " " + prose(20)
        if i % 4 == 0:
            text += " " + half + prose(rng.randint(0, 40))
        docs.append((i, text))
    base = prose(90).split()
    for k in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        docs.append((200 + k, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "Le " * 400), (103, prose(30) + "Le " * 150 + prose(9)), (104, "x" * 1000),
             (105, passages[0]), (106, passages[0]), (107, docs[3][1]), (108, docs[3][1][:300] + "Z" + docs[3][1][301:]),
             (109, "q" * 199), (110, "w" * 200), (111, " \n\t "), (112, "one"), (113, "two words"), (114, prose(6000))]
    return docs


def fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs, n=3, radius=3):
    """(doc_id, fingerprint, smallest id in the group), by comparing all pairs."""
    prints = [fingerprint(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, prints[k], least[find(k)]) for k, (i, _) in enumerate(docs)]


def removed(docs, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes), by counting every string."""
    seen, raws = Counter(), [(i, (t or "").encode()) for i, t in docs]
    for _, raw in raws:
        seen.update(raw[p:p + length] for p in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[raw[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def repeated_words(text, window=8):
    words = (text or "").split()
    places = defaultdict(list)
    for i in range(len(words) - window + 1):
        places[tuple(words[i:i + window])].append(i)
    return len({k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + window)})


def poisson(key, rate, seed=42):
    u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2 ** 52
    k, total = 0, math.exp(-rate)
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k
