"""Plain-Python versions of the numbered queries, written apart from the operators."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op1(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        host, path = m.group().translate(LOW), re.match(r"[^?#]*", rest[m.end() :]).group()
    rule = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (rule is None or len(h + p) > len(rule[0])):
            rule = (h + p, verdict)
    return host, path, rule


def op4_pieces(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)]
    return [(k, a, z - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:z]))) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]


def op5(vectors, every=50):
    q = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q[i] = [math.floor(256 * float(x)) for x in v]
    out = []
    for i in q:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], w)), j) for j, w in q.items() if j != i)[:5]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def shingle_set(text, size=2):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def op6(docs, size=2):
    sets = {d: shingle_set(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in index[x] if e < d).items():
            if 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def op7(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def op9(docs, length=200):
    raws = {d: (t or "").encode() for d, t in docs}
    seen = Counter(r[i : i + length] for r in raws.values() for i in range(len(r) - length + 1))
    out = {}
    for d, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out[d] = (len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def encoding(path, pattern):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("brute", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def op10(text, enc):
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def op3(docs, min_run=100):
    """(text, bytes removed) by doc_id: chunks are compared as bytes, none by a digest."""
    from termloom.llm.chunk_dedup import BITS, GEAR, LEAST, MOST

    pieces, seen = {}, {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        h, last, own = 0, 0, []

        def cut(end):
            nonlocal last
            own.append((last, end))
            last = end

        for place, byte in enumerate(raw, 1):
            h = ((h << 1) + int(GEAR[byte])) & 0xFFFFFFFF
            if h >> (32 - BITS) == 0 and place - last >= LEAST:
                while place - last > MOST:
                    cut(last + MOST)
                if place > last:
                    cut(place)
        while len(raw) - last > MOST:
            cut(last + MOST)
        if len(raw) > last:
            cut(len(raw))
        pieces[d] = (raw, own)
        for a, z in own:
            seen.setdefault(raw[a:z], (d, a))
    out = {}
    for d, (raw, own) in pieces.items():
        runs = []
        for a, z in own:
            if seen[raw[a:z]] != (d, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
        gone = bytearray(len(raw))
        for a, z in runs:
            if z - a < min_run:
                continue
            while a < z and raw[a] & 0xC0 == 0x80:
                a += 1
            while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
                z -= 1
            gone[a:z] = b"\1" * (z - a)
        out[d] = (bytes(b for b, g in zip(raw, gone) if not g).decode(), sum(gone))
    return out


class Pseudonyms:
    """The pseudonyms of values, one at a time."""

    def __init__(self, key):
        self.key = key

    def mix(self, tweak, i, x):
        return int(hashlib.sha256(f"{self.key}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)

    def pair(self, a, b, m, n, tweak):
        for i in range(8):
            if i % 2 == 0:
                a = (a + self.mix(tweak, i, b)) % m
            else:
                b = (b + self.mix(tweak, i, a)) % n
        return a, b

    def digits(self, d, tweak):
        k = len(d) // 2
        a, b = self.pair(int(d[:k]), int(d[k:]), 10**k, 10 ** (len(d) - k), tweak)
        return f"{a:0{k}d}{b:0{len(d) - k}d}"

    @staticmethod
    def laid_out(form, digits):
        rest = iter(digits)
        return re.sub("[0-9]", lambda m: next(rest), form)

    @staticmethod
    def luhn(d):
        doubled = [int(c) * (1 + (i % 2)) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0

    def email(self, m):
        name, domain = m.split("@")[0], m.split("@")[-1]
        hexed = lambda x: hashlib.sha256(f"{self.key}|email|{domain.lower()}|{x}".encode()).hexdigest()
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
            if len(name) == 1 and name in letters:
                return sorted(letters, key=lambda c: hexed(f"one|{c}"))[letters.index(name)] + m[1:]
        if len(name) == 1:
            return m

        def added(x, h):
            out = ""
            for j, c in enumerate(x):
                shift = int(h[2 * (j % 32) : 2 * (j % 32) + 2], 16)
                first, size = ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("0", 10) if "0" <= c <= "9" else (c, 1)
                out += chr(ord(first) + (ord(c) - ord(first) + shift) % size)
            return out

        a, b = name[: len(name) // 2], name[len(name) // 2 :]
        for i in range(8):
            if i % 2 == 0:
                a = added(a, hexed(f"{i}|{b}"))
            else:
                b = added(b, hexed(f"{i}|{a}"))
        return f"{a}{b}@{domain}"

    def ip(self, m):
        x = [int(p) for p in m.split(".")]
        if max(x) > 255:
            return None
        a, b = self.pair(x[0] * 256 + x[1], x[2] * 256 + x[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def iban(self, m):
        x = m.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        own = re.sub("[^0-9]", "", x[4:])
        if not 15 <= len(x) <= 34 or len(own) < 2 or number(x[4:] + x[:4]) % 97 != 1:
            return None
        y = self.laid_out(x[4:], self.digits(own, "iban"))
        rest = iter(f"{x[:2]}{98 - number(y + x[:2] + '00') % 97:02d}{y}")
        return re.sub("[^ ]", lambda c: next(rest), m)

    def ssn(self, m):
        a, b, c = (int(p) for p in m.split("-"))
        if not 1 <= a <= 899 or a == 666 or not b or not c:
            return None
        p, q = self.pair((a - 1 - (a > 666)) * 99 + b - 1, c - 1, 898 * 99, 9999, "ssn")
        area = p // 99 + 1
        return f"{area + (area >= 666):03d}-{p % 99 + 1:02d}-{q + 1:04d}"

    def date(self, m):
        import datetime

        sign, p = re.search("[-/.]", m).group(), re.split("[-/.]", m)

        def day(y, mo, d):
            try:
                return datetime.date(int(p[y]), int(p[mo]), int(p[d]))
            except ValueError:
                return None

        order = (0, 1, 2) if re.match("[0-9]{4}", m) else (2, 0, 1) if sign != "." and day(2, 0, 1) else (2, 1, 0)
        v, begin = day(*order), datetime.date(1600, 1, 1)
        if v is None or not 1600 <= v.year <= 2399:
            return None
        a, b = self.pair(*divmod((v - begin).days, 773), 378, 773, "date")
        w = begin + datetime.timedelta(a * 773 + b)
        short = re.search("(^|[-/.])[0-9]([-/.]|$)", m)
        part = lambda x: str(x) if short else f"{x:02d}"
        parts = [""] * 3
        parts[order[0]], parts[order[1]], parts[order[2]] = f"{w.year:04d}", part(w.month), part(w.day)
        return sign.join(parts)

    def phone(self, m):
        from termloom.llm.pseudonyms import AMERICAN, COUNTRY

        x = re.sub("[^0-9]", "", m)
        z = len(x) - 10 if re.fullmatch(AMERICAN, m) else len((re.match(COUNTRY, x) or re.match("", x)).group())
        if not 7 <= len(x) <= 15 or len(set(x[z:])) < 2:
            return None
        return self.laid_out(m, x[:z] + self.digits(x[z:], "phone"))

    def card(self, m):
        x = re.sub("[^0-9]", "", m)
        if not self.luhn(x):
            return None
        y = self.digits(x[:-1], "card")
        return self.laid_out(m, y + next(c for c in "0123456789" if self.luhn(y + c)))

    def kind(self, m):
        from termloom.llm.pseudonyms import AMERICAN

        forms = [
            ("email", ".*@.*"), ("ip", r"[0-9]{1,3}([.][0-9]{1,3}){3}"), ("iban", "[A-Z].*"), ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
            ("date", "[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}"), ("phone", rf"\+.*|{AMERICAN}"), ("card", ".*"),
        ]
        return next(k for k, form in forms if re.fullmatch(form, m))


def op2(text, key):
    """(text, counts by kind)."""
    from termloom.llm.pseudonyms import PATTERN

    if text is None:
        return None, Counter()
    p, n = Pseudonyms(key), Counter()

    def new(m):
        kind = p.kind(m.group())
        value = getattr(p, kind)(m.group())
        n[kind] += value is not None
        return m.group() if value is None else value

    return re.sub(PATTERN, new, text, flags=re.ASCII), n


def op11(rows, least_docs=30, most_terms=50):
    """{(lang, source, part, item): (value, rank)} of rows (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    lower, counts, docs = {i: i + 32 for i in range(65, 91)}, {}, {}
    for lang, source, text in rows:
        mine = counts.setdefault(lang, {}).setdefault(source, Counter())
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        mine.update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = {}
    for lang, sources in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(c, kept=kept):
            size = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // size for t in kept}

        whole, each = shares(sum(sources.values(), Counter())), {s: shares(c) for s, c in sources.items()}
        for s, p in each.items():
            pairs = [(-sum(abs(p[t] - q[t]) for t in kept), o.encode()) for o, q in each.items() if o != s]
            terms = [(whole[t] - p[t], t.encode()) for t in kept if sources[s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, most_terms)):
                for k, (value, item) in enumerate(sorted(found)[:most], 1):
                    out[lang, s, part, item.decode()] = (-value, k)
    return out


def op12(rows, k=16, rounds=3, dimensions=64, scale=64, seed="1"):
    """{row number: (cluster, distance, cluster inertia, inertia, hash of the centroid)} of the kept ones of rows (vec_id, components)."""
    kept = {i: [math.floor(scale * x) for x in v] for i, (_, v) in enumerate(rows) if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)}
    name = lambda i: hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest()
    centroids = [list(kept[i]) for i in sorted(kept, key=lambda i: (rows[i][0] is None, name(i), kept[i]))[:k]]
    for r in range(rounds + 1):
        near = {i: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for i, v in kept.items()}
        for n in range(len(centroids) if r < rounds else 0):
            own = [kept[i] for i in kept if near[i][1] == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    spread = Counter()
    for d, n in near.values() if kept else ():
        spread[n] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return {i: (n, d, spread[n], sum(spread.values()), names[n]) for i, (d, n) in (near.items() if kept else ())}


WIDE, MULTIPLIERS = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x):
    x ^= x >> 30
    x = x * MULTIPLIERS[1] & WIDE
    x ^= x >> 27
    x = x * MULTIPLIERS[2] & WIDE
    return x ^ (x >> 31)


BYTE = [mixed((b + 1) * MULTIPLIERS[0] & WIDE) for b in range(256)]


def op8_counts(text, dimensions):
    """Hashed n-grams of 1 to 4 bytes of one text; digits, signs and white space are one gap, of a run of gaps the first counts."""
    folded = [b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalpha() else 32 for b in (text or "").encode()]
    skip = [b == 32 and i > 0 and folded[i - 1] == 32 for i, b in enumerate(folded)]
    out = Counter()
    for size in (1, 2, 3, 4):
        for i in range(len(folded) - size + 1):
            if skip[i] or skip[i + size - 1]:
                continue
            g = 0
            for b in folded[i : i + size]:
                g = (g * MULTIPLIERS[2] + BYTE[b]) & WIDE
            out[((g ^ (g >> 31)) * MULTIPLIERS[0] & WIDE) >> (64 - dimensions.bit_length() + 1)] += 1
    return out


def op8(text, idf, vectors, languages):
    """The language of the centroid with the highest cosine, and that cosine; ``und`` for a text without a letter."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = {k: math.log1p(n) * idf[k] for k, n in op8_counts(text, len(idf)).items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    cosine = [sum(v * c[k] for k, v in x.items()) / size for c in vectors]
    best = max(range(len(cosine)), key=lambda i: cosine[i])
    return languages[best], min(max(cosine[best], 0.0), 1.0)


def op13_score(x, model):
    """The calibrated sum of an additive model's cells at a row of features."""
    bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
    m = model.bias + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[i]][bins[j]] for (i, j), t in model.pairs.items())
    return 1 / (1 + math.exp(-(model.slope * m + model.offset)))
