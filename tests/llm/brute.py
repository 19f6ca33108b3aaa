"""Plain versions of the operators, and a small table with every odd case."""

import hashlib
import math
import random
import re
import string
import unicodedata
import zlib
from collections import Counter, defaultdict

import regex
import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, rank int, component string, id long"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def messy(extra=()):
    """(doc_id, text): near and exact copies, shared passages, nulls, empty, short, long and repeated rows."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["the", "of", "ing", "ré", "öß", "tion", "an"]) for _ in range(rnd.randint(1, 3)))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(60):
        w = [word() for _ in range(rnd.randint(20, 90))]
        if i % 4 == 0:
            w[5:5] = passage.split()
        rows.append((i, " ".join(w)))
    for i in range(60, 80):  # near copies of document 1, by degrees
        w = rows[1][1].split()
        for _ in range((i - 60) // 2):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(80 + i, rows[2][1]) for i in range(5)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "one"), (94, "One"), (95, "a b c d"), (96, "a b c d e f"), (97, ". , ! é"), (98, "x" * 5000), (99, " ".join(["same"] * 3000))]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (None, None), (101, "😀" * 60 + " ok"), (102, "\x00\x1f \x85 ok"), *extra]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", None, "clash", k, "clash", 7) for k, (i, t) in enumerate(rows)], SCHEMA)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(text, items):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(str(i))
    w, hit, found = bench_words(text), set(), set()
    for m in {len(x) for x in windows}:
        for k in range(len(w) - m + 1):
            if tuple(w[k : k + m]) in windows:
                found |= windows[tuple(w[k : k + m])]
                hit |= set(range(k, k + m))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def base_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def cuts(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, digest) by looking at every 50-byte string."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                mark[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, mark, strict=True) if not g)
        out[(i, t)] = (len(b), sum(mark), sum(1 for k in range(len(b)) if mark[k] and (not k or not mark[k - 1])), sha(kept))
    return out


# Hashes, in whole numbers: of bytes as the operators hash words, and Spark's xxhash64 of a string or a long.
FULL = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def word_hash(b):
    if len(b) > 256:
        return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")
    h = mix((len(b) * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & FULL)
    for i in range(0, len(b), 8):
        h = mix(h ^ int.from_bytes(b[i : i + 8], "little"))
    return h


def xx(v):
    if v is None:
        return 42
    h = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def terms(text):
    return {word_hash(w.encode()) for w in bench_words(text)}


def lexicon(texts, most=0.05, least=0.0002):
    texts = {t or "" for t in texts}
    n = Counter(t for x in texts for t in terms(x))
    return {t for t, c in n.items() if c >= 2 and least * len(texts) <= c <= max(2, most * len(texts))}


def fingerprint(text, words):
    """(thin, level, codes, own) by the terms in words, or by all where it is None."""
    every = terms(text)
    some = every if words is None else every & words
    level = (len(some) - 1).bit_length() if some else -1
    codes = []
    for r in range(3) if some else []:
        below = (1 << max(level + r - 1, 0)) - 1
        for s in range(48):
            inside = [x for x in (mix((t + 0x9E3779B97F4A7C15 * (s + 1)) & FULL) for t in some) if not x & below]
            codes.append((mix(sum(map(mix, inside)) & FULL) >> 48 | 1) if inside else 0)
    return len(some) < 0.25 * len(every), level, codes, sha(text)[:32]


def fingerprint_text(text, words):
    thin, level, codes, own = fingerprint(text, words)
    if thin:
        _, level, codes, own = fingerprint(text, None)
    return f"t:{own}" if level < 0 else f"{'w' if thin else ''}{level:x}:" + "".join(f"{c:04x}" for c in codes)


def fingerprint_likeness(a, b, words):
    x, y = fingerprint(a, words), fingerprint(b, words)
    if x[0] or y[0]:
        x, y = fingerprint(a, None), fingerprint(b, None)
    if x[1] < 0 or y[1] < 0:
        return float(x[1] == y[1] and x[3] == y[3])
    if x[1:3] == y[1:3]:
        return 1.0
    high, low = max(x[1], y[1]), min(x[1], y[1])
    if high - low > 2:
        return 0.0
    for rate in (min(high, low + 1), min(high, low + 1) - 1):
        p, q = ([z[2][48 * k : 48 * k + 48] for k in [min(max(rate - z[1] + 1, 0), 2)]][0] for z in (x, y))
        some = [(c, d) for c, d in zip(p, q, strict=True) if c or d]
        if some and (both := sum(c == d for c, d in some)):
            return both / len(some)
    return 0.0


def language_model(rows, orders=(4, 3, 2, 1), smooth=0.1):
    """langs and kind -> gram -> log frequencies, from (text, lang)."""
    counts = {k: defaultdict(Counter) for k in (0, *orders)}
    for text, lang in rows:
        for w in bench_words(text.lower()):
            counts[0][w][lang] += 1
            for n in orders:
                for i in range(len(w) - n + 1):
                    counts[n][w[i : i + n]][lang] += 1
    langs = sorted({lang for _, lang in rows})
    tables = {}
    for kind, grams in counts.items():
        total = {x: sum(c[x] for c in grams.values()) for x in langs}
        tables[kind] = {g: [math.log((c[x] + smooth) / (total[x] + smooth * max(len(grams), 1))) for x in langs] for g, c in grams.items()}
    return langs, tables


def language(text, langs, tables, orders=(4, 3, 2, 1)):
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    total = [0.0] * len(langs)
    for w in bench_words(text.lower()):
        found = [tables[0][w]] if w in tables[0] else []
        for n in orders:
            found = found or [tables[n][g] for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g in tables[n]]
        if found:
            total = [t + sum(f[k] for f in found) / len(found) for k, t in enumerate(total)]
    best = total.index(max(total))
    return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


def mark_tokens(text):
    return [word_hash(t.encode()) for t in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|(?:(?![\x20\x09-\x0D])[\x00-\x2F\x3A-\x60\x7B-\x7F])+", (text or "").translate(LOWER))]


def index_vector(h, size=32):
    v = [0] * size
    for k in range(1, 5):
        x = mix((h + k * 0x9E3779B97F4A7C15) & FULL)
        v[x % size] += 1 if x >> 63 else -1
    return v


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else list(v)


def word_vectors(texts, share):
    """token -> unit vector of the sum of the index vectors up to two places away, for tokens of a share of all."""
    count, sums = Counter(), defaultdict(lambda: [0] * 32)
    for t in texts:
        some = mark_tokens(t)
        count.update(some)
        vectors = [index_vector(h) for h in some]
        for i, h in enumerate(some):
            for j in range(max(i - 2, 0), min(i + 3, len(some))):
                if j != i:
                    sums[h] = [a + b for a, b in zip(sums[h], vectors[j], strict=True)]
    return {h: unit(sums[h]) if any(sums[h]) else unit(index_vector(h)) for h, n in count.items() if n >= share * count.total()}


def quality(text, vectors, net):
    """The probability by the network's weights, from features made one by one."""
    some = mark_tokens(text)
    v = [vectors.get(h) or unit(index_vector(h)) for h in some]
    n, x = len(some), [0.0] * 70
    x[-1] = math.log1p(n)
    if n:
        mean = [sum(c) / n for c in zip(*v, strict=True)]
        x[:32], x[32:64] = mean, [math.sqrt(max(sum(a * a for a in c) / n - m * m, 0)) for c, m in zip(zip(*v, strict=True), mean, strict=True)]
        x[-2] = math.sqrt(sum(m * m for m in mean))
        for k in (1, 2):
            x[-2 - k] = sum(sum(a * b for a, b in zip(v[i], v[i - k], strict=True)) for i in range(k, n)) / n
            x[-4 - k] = sum(some[i] == some[i - k] for i in range(k, n)) / n
    z = [(a - c) / s for a, c, s in zip(x, net.centre, net.scale, strict=True)]
    hidden = [math.tanh(sum(a * w for a, w in zip(z, column, strict=True)) + b) for column, b in zip(net.w1.T, net.b1, strict=True)]
    return 1 / (1 + math.exp(-(sum(a * w for a, w in zip(hidden, net.w2, strict=True)) + net.b2[0]) / net.temperature))


BLANKS = " \t\n\x0b\f\r"


def pii_tokens(text):
    """(start, end, value, pattern) of every identifier-like token, by reading word after word."""
    plain = lambda x: re.sub("[1-9]", "0", x).lower()
    before, out = ["", ""], []
    for w in re.finditer(r"[^ \t\n\x0b\f\r]+", text):
        glued, past = "", 0
        for m in re.finditer(r"(?<![A-Za-z0-9._%+@/:-])[A-Za-z._%+/:-]*[0-9@][A-Za-z0-9._%+@/:-]*", w.group()):
            left = glued + w.group()[past : m.start()]
            if len(m.group()) >= 6:
                pattern = (before[1], plain(left)) if left else tuple(before)
                out.append((w.start() + m.start(), w.start() + m.end(), m.group(), pattern))
            glued, past = m.group(), m.end()
        before = [before[1], plain(w.group())]
    return out


def pii(texts):
    """The base and the discovered spans (start, rank, kind, end) of each text."""
    base = [base_spans(t) for t in texts]
    seen = []
    for k, t in enumerate(texts):
        for a, b, value, pattern in pii_tokens(t):
            known = any(s < b and a < e for s, _, _, e in base[k])
            seed = known or bool(re.search(r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$", value))
            seen.append((k, a, b, value, pattern, known, float(seed)))
    seeds = defaultdict(float)
    for _, _, _, value, pattern, _, seed in seen:
        seeds[pattern, value] = max(seeds[pattern, value], seed)
    support, mass = Counter(p for p, _ in seeds), Counter()
    for (p, _), seed in seeds.items():
        mass[p] += seed
    for _ in range(3):
        belief = defaultdict(float)
        for (p, v), seed in seeds.items():
            belief[v] = max(belief[v], seed, mass[p] / (support[p] + 1))
        mass = Counter()
        for p, v in seeds:
            mass[p] += belief[v]
    sure = {p for p, n in support.items() if n >= 5 and mass[p] / (n + 1) >= 0.6}
    return [(b, sorted([*b, *{(a, 4, "id", e) for i, a, e, _, p, known, _ in seen if i == k and p in sure and not known}])) for k, b in enumerate(base)]


def shards(rows, n, cells=8192, heavy=64, split=0.25):
    """Sorted (doc_id, size, crc, shard) of rows (doc_id, text), with the group that each row goes with."""
    count = lambda t: len(regex.findall(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", t or ""))
    made = [(i, len((t or "").encode()) + 16, count(t), zlib.crc32((t or "").encode()), t) for i, t in rows]
    add = lambda some: [sum(r[1] for r in some), sum(r[2] for r in some), len(some)]
    total = [max(1.0, x / n) for x in add(made)]
    groups, items = defaultdict(list), defaultdict(list)
    for r in made:
        groups[xx(r[4])].append(r)
    for g, some in groups.items():
        weight = max(a / b for a, b in zip(add(some), total, strict=True))
        for r in some:
            if weight < 1 / heavy:
                items[g % cells, -1].append(r)
            else:
                items[g, xx(r[0]) % math.ceil(weight / split)].append(r)
    loads = {k: add(some) for k, some in items.items()}
    all_ = [max(sum(x[c] for x in loads.values()), 1) for c in range(3)]
    vector = {k: [x / a * n for x, a in zip(v, all_, strict=True)] for k, v in loads.items()}
    residual, where = [[1.0] * 3 for _ in range(n)], {}
    for k in sorted(vector, key=lambda k: (-max(vector[k]), k)):
        v = vector[k]
        fits = [s for s in range(n) if all(r >= x for r, x in zip(residual[s], v, strict=True))]
        if fits:
            s = max(fits, key=lambda s: (sum(r * x for r, x in zip(residual[s], v, strict=True)), -s))
        else:
            s = min(range(n), key=lambda s: (sum(max(x - r, 0) for r, x in zip(residual[s], v, strict=True)), s))
        residual[s] = [r - x for r, x in zip(residual[s], v, strict=True)]
        where[k] = s
    return sorted(((r[0], r[1], r[3], where[k]) for k, some in items.items() for r in some), key=str)


def run_counts(rows, longest=3):
    """(lang, run) -> occurrences, and lang -> words, from (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return f, n


def collocations(rows, longest=3, least=10, share=50, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score)."""
    f, n = run_counts(rows, longest)
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = defaultdict(int)
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, w[i : i + k]] = max(around[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in cands.items():
        if 100 * around[lang, w] >= share * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, some in out.items() for i, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1)]


def resampled(rows, target, longest=1, buckets=10_000, percent=10, least_words=20):
    """Rows (doc_id, n_features, weight, score, rank) of (doc_id, text)."""

    def features(text):
        w = bench_words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((float(t[b] + 1) * float(s.total() + buckets)) / (float(s[b] + 1) * float(t.total() + buckets))))
    made = []
    for i, x in rows:
        n, b = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, b))
        made.append([n < least_words, -(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))), i is None, i or 0, len(b), weight])
    made.sort()
    draw = percent * sum(not m[0] for m in made) // 100
    return [(None if m[2] else m[3], m[4], m[5], -m[1], k if k <= draw and not m[0] else None) for k, m in enumerate(made, 1)]


def toxicity(text, net, size=16, stride=12, grams=(4, 6), bits=16):
    """The probability by a network's weights, a window, a word and a unit at a time."""
    w = bench_words(text)
    rows = {int(h): k for k, h in enumerate(net.vocabulary)}

    def given(word):
        b = f"\x02{word}\x03"
        own = net.own[rows[word_hash(word.encode())]].tolist() if word_hash(word.encode()) in rows else [0.0] * net.own.shape[1]
        parts = [b[i : i + n] for n in grams for i in range(max(len(b) - n + 1, 1))]
        found = [net.spelt[word_hash(p.encode()) >> (64 - bits)].tolist() for p in parts]
        return own + [sum(c) / math.sqrt(len(parts)) for c in zip(*found, strict=True)]

    def read(xs, weights, u, bias):
        n = u.shape[0]
        h, out = [0.0] * n, []
        for x in xs:
            a = [sum(p * q for p, q in zip(x, weights[:, k].tolist(), strict=True)) + float(bias[k]) for k in range(3 * n)]
            b = [sum(p * q for p, q in zip(h, u[:, k].tolist(), strict=True)) for k in range(3 * n)]
            z = [1 / (1 + math.exp(-a[k] - b[k])) for k in range(n)]
            r = [1 / (1 + math.exp(-a[k] - b[k])) for k in range(n, 2 * n)]
            c = [math.tanh(a[2 * n + k] + r[k] * b[2 * n + k]) for k in range(n)]
            h = [(1 - z[k]) * c[k] + z[k] * h[k] for k in range(n)]
            out.append(h)
        return out

    logits, at = [], 0
    while w:
        xs = [given(x) for x in w[at : at + size]]
        both = [f + b for f, b in zip(read(xs, net.wf, net.uf, net.bf), read(xs[::-1], net.wb, net.ub, net.bb)[::-1], strict=True)]
        e = [math.exp(sum(math.tanh(sum(s * float(net.look[i, k]) for i, s in enumerate(h)) + float(net.lean[k])) * float(net.query[k]) for k in range(len(net.query)))) for h in both]
        pooled = [sum(a * h[i] for a, h in zip(e, both, strict=True)) / sum(e) for i in range(len(net.out))]
        logits.append(sum(p * float(q) for p, q in zip(pooled, net.out, strict=True)) + float(net.bias[0]))
        if at + size >= len(w):
            break
        at += stride
    return 1 / (1 + math.exp(-max(logits, default=float(net.bias[0]))))
