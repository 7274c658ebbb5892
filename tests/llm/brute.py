"""Plain versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def removed_bytes(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rule_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    inside = set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            inside.update(range(i, i + 5))
    n, r = len(words), len(inside)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def jaccard_components(rows: list[tuple[int | None, str | None]], width: int, num: int, den: int) -> list[tuple[int, int | None, int]]:
    """(n_shingles, component_id, n_links) of each row."""
    sets = [shingles(t, width) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num:
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [(len(s), least.get(find(i)), links[i]) for i, s in enumerate(sets)]


ASSIGN = re.compile(r"""(?P<k>[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str | None) -> tuple[int, int, int, str]:
    """n_assign, n_access, n_hex, base_sha256."""
    text = text or ""
    kinds = [[m.span() for m in ASSIGN.finditer(text) if len(m["v"]) >= 6], [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20], [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]]
    spans = sorted((s, i, e) for i, found in enumerate(kinds) for s, e in found)
    listed = ",".join(f"{('assign', 'access', 'hex')[i]}:{s}:{e}" for s, i, e in spans)
    return *map(len, kinds), hashlib.sha256(listed.encode()).hexdigest()


def best_products(rows: list[tuple[int, list | None]], every: int, k: int) -> set[tuple[int, int, int, int]]:
    """(query_id, rank, vec_id, score)."""
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def pfair_slots(blocks: dict[str, int], weights: dict[str, int]) -> dict[tuple[str, int], int]:
    """Slot of each (source, block), one slot at a time: of the blocks released, the one due first; a new phase when a source has none left."""
    left, done, start, now, out = dict(blocks), dict.fromkeys(blocks, 0), 0, 0, {}
    placed = dict.fromkeys(blocks, 0)
    while any(left.values()):
        active = [s for s in sorted(left) if left[s]]
        total = sum(weights[s] for s in active)
        due = [(-(-(placed[s] + 1) * total // weights[s]), s) for s in active if placed[s] * total // weights[s] <= now - start]
        _, s = min(due)
        out[s, done[s]] = now
        done[s] += 1
        placed[s] += 1
        left[s] -= 1
        now += 1
        if not left[s]:
            start, placed = now, dict.fromkeys(blocks, 0)
    return out


def differenced(sizes: list[int], shards: int) -> list[int]:
    """Sorted shard sums of Karmarkar-Karp differencing, for sizes without ties."""
    parts = [sorted([0] * (shards - 1) + [x]) for x in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return parts[0]


def divergence(rows: list[tuple[str | None, str | None]], common: dict[str, str]) -> list[tuple[float, float, bool]]:
    """(char_distance, word_distance, base_failed) of each (text, lang)."""
    import math

    bins = sorted({w for x in common.values() for w in x.split()})
    langs = [*common, None]

    def char_class(c):
        for k, test in enumerate((str.islower, str.isupper, str.isdigit)):
            if c.isascii() and test(c):
                return k
        return 6 if not c.isascii() else 3 if c in " \t\n\r\x0b\x0c" else 4 if c in ".,;:!?'\"()-" else 5

    def shares(counts):
        return [x / max(sum(counts), 1) for x in counts]

    measured = []
    for text, lang in rows:
        text = text or ""
        chars = Counter(map(char_class, text))
        words = []
        for w in WORD.findall(text):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            words.append(w[:-1] if len(w.encode()) > 1 and w[-1] in ".,;:!?" else w)
        found = Counter(w if w in bins else None for w in words)
        measured.append((lang if lang in common else None, [chars[k] for k in range(7)], [found[b] for b in [*bins, None]], rule_counts(text)[5]))

    def reference(kind, least, lang):
        own = [shares(m[kind]) for m in measured if m[0] == lang and not m[3] and sum(m[kind]) >= least]
        return shares([sum(round(x[k] * 1e6) for x in own) for k in range(len(measured[0][kind]))])

    def distance(p, q):
        side = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y, strict=True) if a > 0)
        return math.sqrt(max((side(p, q) + side(q, p)) / 2, 0))

    refs = {lang: (reference(1, 200, lang), reference(2, 40, lang)) for lang in langs}
    out = []
    for lang, chars, words, failed in measured:
        c = distance(shares(chars), refs[lang][0]) if sum(chars) >= 200 and sum(refs[lang][0]) else 0.0
        w = distance(shares(words), refs[lang][1]) if sum(words) >= 40 and lang and sum(refs[lang][1]) else 0.0
        out.append((c, w, failed))
    return out


def markov_spans(text: str, models: list[list[float]], ordinary: int) -> list[str]:
    """markov:start:end of the tokens that the random models explain best, apart from base spans."""
    uuid = re.compile("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
    taken = [m.span() for m in ASSIGN.finditer(text) if len(m["v"]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", text)]
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        token = uuid.sub("", m[0])
        if len(token) < 20 or any(s < m.end() and m.start() < e for s, e in taken):
            continue
        sums = [sum(w[(ord(a) - 43) * 80 + ord(b) - 43] for a, b in zip(token, token[1:])) for w in models]  # noqa: B905
        score = max(sums[ordinary:]) - max(sums[:ordinary])
        if score >= 20 and score >= 0.75 * len(token):
            out.append(f"markov:{m.start()}:{m.end()}")
    return out
