"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def token_counts(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)


def ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(ids, "t"):
        ids.t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return ids.t.encode(text or "", add_special_tokens=False).ids + [1]


def crc(values) -> int:
    return zlib.crc32(b"".join(int(v).to_bytes(4, "little") for v in values))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_stats(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base_spans(text):
    out, counts = [], []
    for kind, p in PATTERNS.items():
        found = []
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(found))
        out += found
    return (*counts, sha(",".join(out).encode()))


def repeats(rows, size=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if w in seen:
                cut[k : k + size] = b"\1" * size
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(b)) if cut[k] and (k == 0 or not cut[k - 1]))
        out.append((i, len(b), sum(cut), spans, sha(bytes(x for x, c in zip(b, cut) if not c))))
    return out


def sets_of(rows, size=3):
    out = {}
    for i, t in rows:
        w = words((t or "").translate(AZ))
        out[i] = frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
    return out


def near(rows, size=3, num=9, den=10):
    sets = sets_of(rows, size)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having, degree = defaultdict(list), Counter()
    for i in sorted(sets):
        shared = Counter()
        for w in sets[i]:
            shared.update(having[w])
            having[w].append(i)
        for j, k in shared.items():
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                degree[i] += 1
                degree[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), degree[i]) for i in sets)


def exact(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[sha((t or "").translate(AZ).encode())].append(i)
    return sorted((i, max(g), len(g), i == max(g), h) for h, g in by.items() for i in g)
