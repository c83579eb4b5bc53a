"""Plain Python twins of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, n=4):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def components(n, linked):
    """Smallest index reachable, by repeated minima over all pairs."""
    label = np.arange(n)
    near = np.array([[i == j or linked(i, j) for j in range(n)] for i in range(n)])
    while True:
        new = np.array([label[near[i]].min() for i in range(n)])
        if (new == label).all():
            return label
        label = new


def repeats(texts, window=35):
    """(words, removed, digest) of each text."""
    own = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for w in own:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def base_scores(rows, modulus=10):
    """{row number: (held_out, tokens, known, train, base)} for (id, text) rows."""
    own = [(d is not None and zlib.crc32(str(d).encode()) % modulus == 0, [*words((t or "").translate(LOWER)), None]) for d, t in rows]
    count = collections.Counter(x for held, w in own if not held for x in w)
    n, v = sum(count.values()), len(count)
    return [(held, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for held, w in own]


def randomness(token):
    """(encoding, p_chi, p_runs, p_serial, log_p) of a token by the plain formulas."""
    from ledgerleaf.llm import secrets as sec

    core = token.rstrip("=")
    name, chars = next(((n, c) for n, p, c in sec.ALPHABETS if re.match(p, core)), ("other", sec.CHARACTERS))
    n, k, x = len(core), len(chars), [chars.index(c) for c in core]
    expected = n / k
    statistic = sum((core.count(c) - expected) ** 2 / expected for c in chars)
    z = (statistic - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    side = [v >= k / 2 for v in x]
    a, b = sum(side), n - sum(side)
    runs = 1 + sum(p != q for p, q in zip(side, side[1:]))
    mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    p_runs = tail((runs - mean) / math.sqrt(var)) if 2 * a * b > n else 0.0
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    r = sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / spread if spread else 0
    p_serial = tail((r + 1 / n) * math.sqrt(n)) if spread else 0.0
    last, kind, log = 4, 2, 0.0
    for c in core:
        own = 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3
        log += math.log10(sec.CLASS_AFTER[last][own])
        now = 2
        if own < 2:
            now = int(c.lower() in sec.VOWELS)
            v = sec.VOWEL_AFTER[kind]
            log += math.log10(v if now else 1 - v) + math.log10(sec.WRITTEN[c.lower()] / sum(w for l, w in sec.WRITTEN.items() if (l in sec.VOWELS) == bool(now)))
        else:
            log += math.log10(0.1 if own == 2 else 0.25)
        last, kind = own, now
    log_p = 0.0 if name == "decimal" else min(0.0, log + n * math.log10(k) + math.log10(len(sec.ALPHABETS) + 1))
    return name, tail(z) / 2 if z > 0 else 0.5, p_runs, p_serial, log_p


def interpolated(rows, modulus=10, rounds=200):
    """log10 scores by deleted interpolation, token by token: EM for each bucket of context counts on estimates that leave the token out."""
    own = [(d is not None and zlib.crc32(str(d).encode()) % modulus == 0, [*words((t or "").translate(LOWER)), None]) for d, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for held, w in own:
        if not held:
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    bucket = lambda c: min(c.bit_length(), 25)
    estimate = lambda before, x, less: ((two[before, x] - less) / (one[before] - less) if one[before] > less else 0.0, (one[x] - less) / max(n - less, 1), 1 / (v + 1))
    cells = collections.defaultdict(list)
    for held, w in own:
        if not held:
            for before, x in zip([None, *w], w):
                cells[bucket(one[before] - 1)].append(estimate(before, x, 1))
    weights, known = {}, np.array([0.0, 0.9, 0.1])
    for b in range(26):
        if b in cells:
            p, known = np.array(cells[b]), np.array([0.4, 0.5, 0.1])
            for _ in range(rounds):
                share = p * known
                known = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        weights[b] = known
    return [sum(math.log10(weights[bucket(one[before])] @ np.array(estimate(before, x, 0))) for before, x in zip([None, *w], w)) for _, w in own]


def runs(w, exponent=4, least=6):
    """(start, length, period) of all maximal runs, by trying every period from the smallest up."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, text):
    """The words of a text, those of a tenth of the documents with a period written into their end."""
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(LOWER))


def windows(items, window=10):
    """{window: ids of the items that hold it, as strings}."""
    out = collections.defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for i in range(max(len(w) - window + 1, min(len(w), 1))):
            out[tuple(w[i : i + window])] |= set() if item is None else {str(item)}
    return out


def leaks(texts, items, window=10):
    """(words, words hit, sorted items) of each text."""
    wanted, out = windows(items, window), []
    for t in texts:
        w, hit, held = item_words(t), set(), set()
        for k in {len(x) for x in wanted}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wanted:
                    hit |= set(range(i, i + k))
                    held |= wanted[tuple(w[i : i + k])]
        out.append((len(w), len(hit), sorted(held)))
    return out


def near_ranges(text, items, window, slack):
    """(start, end) of the stretches of alignments, none exact, that have each word of a window within ``slack`` of its place."""
    w, out = item_words(text), set()
    for x in windows(items, window):
        good = [a for a in range(-len(x) - slack, len(w) + slack) if all(any(0 <= p < len(w) and w[p] == y for p in range(a + i - slack, a + i + slack + 1)) for i, y in enumerate(x))]
        exact = {a for a in good if a >= 0 and tuple(w[a : a + len(x)]) == x}
        while good:
            run = [good.pop(0)]
            while good and good[0] == run[-1] + 1:
                run.append(good.pop(0))
            if not exact & set(run):
                out.add((max(run[0], 0), min(run[-1] + len(x), len(w))))
    return sorted(out)
