"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def spans_joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def _luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (2 if n % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return [
        (m.start(), n, m.end(), k)
        for n, (k, p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m.group())
    ]


def secrets_base(text):
    text = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.I | re.A) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_duplicates(rows, percent=85):
    """{doc_id: (n_shingles, component)} from (doc_id, text), by all pairs that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        n = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    holders, root = {}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for doc_id, shingles in sets.items():
        for s in shingles:
            holders.setdefault(s, []).append(doc_id)
    seen = set()
    for together in holders.values():
        for i, a in enumerate(together):
            for b in together[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    shared = len(sets[a] & sets[b])
                    if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def without_repeats(rows, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} from (doc_id, text) with distinct ids."""
    first = {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], doc_id)
    out = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out
