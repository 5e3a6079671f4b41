"""Plain loops that say what the operators over documents must return."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the and ing tion er es an or st le que ment pa ré ión ß über an de la".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, component_id string, n_words string, N_Tokens int, `a.b` string, _gone string, _k1 string, _copy int"


def prose(rng: random.Random, words: int, lines: int = 1) -> str:
    made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    step = max(1, words // lines)
    return "\n".join(" ".join(made[k : k + step]) + "." for k in range(0, words, step))


def documents(seed: int = 3, many: int = 60) -> list[tuple]:
    """Rows with nulls in every column, empty, blank and very long texts, ties, copies near and exact, and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(25, 120), rng.randint(1, 8)) for _ in range(many)]
    passage = prose(rng, 60, 4)
    texts += [texts[0], texts[0], texts[1] + " more", texts[2].replace(" ", "  "), texts[3].upper(), passage + "\n" + texts[4], texts[5] + "\n" + passage, passage]
    texts += [None, "", "", " \n\t ", "one", "two words", "\n\n\n\n\n", "a\na\na\na\na\na", "é́ 漢字 🎉 ▁x  y \x00 z w", "don't <|endoftext|> stop", " lead", "trail ", "x" * 3000]
    texts += [("over and over again " * 900).strip(), prose(rng, 6000, 40), "### $$$ %%% &&& *** ||| " * 10]
    rows = [(k, t, rng.choice(["en", "fr", None, "de"]), rng.choice(["a", "a", "a", "b", "ç", None, "😀", "z"]), len(t or ""), 7, "k", "c", "w", 1, "ab", "g", "k", 2) for k, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "a", 1, 7, *[None] * 8)] * 2  # the same row twice more
    rows += [(None, texts[6], *[None] * 12), (None, "unlike any other text here", "en", "b", 1, 1, "", "", "", 1, "", "", "", 1)]
    return rows


def exact_keepers(rows: list[tuple]) -> dict[str, tuple[int, int | None]]:
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return {t: (len(ids), max((i for i in ids if i is not None), default=None)) for t, ids in groups.items()}


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    words = WORD.findall(t)
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    places = defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    covered = {p + d for at in places.values() if len(at) > 1 for p in at for d in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dups, len(covered)


def simhash(text: str | None, shingle: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    runs = [words[k : k + shingle] for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_groups(prints: list[int], radius: int) -> list[int]:
    """Index of the group of each entry, all pairs compared."""
    group = list(range(len(prints)))

    def top(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            group[max(top(i), top(j))] = min(top(i), top(j))
    return [top(k) for k in range(len(prints))]


def without_windows(rows: list[tuple], width: int = 3) -> dict[tuple, str | None]:
    """(doc_id, text) to the text without later windows, rows alike in both being one document."""
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, gone = set(), defaultdict(set)
    for d in docs:
        lines = (d[1] or "").split("\n")
        for p in range(len(lines) - width + 1):
            window = tuple(lines[p : p + width])
            if not any(WORD.search(x) for x in window):
                continue
            if window in seen:
                gone[d] |= set(range(p, p + width))
            seen.add(window)
    return {d: d[1] if not gone[d] else "\n".join(x for k, x in enumerate((d[1] or "").split("\n")) if k not in gone[d]) for d in docs}


def targets(sizes: dict, weights=(1, 2, 3), cap: float = 3.0) -> dict:
    """Shares by weight, stopped at the cap, the excess dealt again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while len(fixed) < len(order):
        left, open_ = total - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}
    return fixed


def tilt(sizes: list[int], target: float, cap: float) -> list[float]:
    """Rates min(cap, exp(lambda * size / mean)) whose sum of rate * size is the target, by bisection."""
    mean = sum(sizes) / len(sizes)
    rate = lambda lam: [min(cap, math.exp(min(50.0, lam * s / mean))) for s in sizes]
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(r * s for r, s in zip(rate(mid), sizes, strict=True)) < target else (low, mid)
    return rate((low + high) / 2)


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def lengths(counts: list[int]) -> list[tuple]:
    found = Counter(counts)
    return sorted((n, c, sum(x > n for x in counts), sum(min(x, n) for x in counts)) for n, c in found.items())


def phrase_table(rows: list[tuple], minimum: int, longest: int, first: int, share: int = 50) -> set[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang), every phrase counted."""
    found: dict[str, Counter] = defaultdict(Counter)
    totals: Counter = Counter()
    for text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                found[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= minimum}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return out


def vector_codes(rows: list[tuple], parts: int, entries: int, rounds: int, scale: int = 256) -> tuple[list[tuple], str]:
    """((id, code, error, label_error), ...) and the digest, in Python's integers and all distances."""
    sound = [(i, label, v) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))  # repeated ids: by components, before they are rounded
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in sound]
    width = len(kept[0][2]) // parts
    seeds = kept[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(s[2], p) for s in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                groups[p, near(v, p)[1]].append(cut(v, p))
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    coded = [(i, label, [near(v, p) for p in range(parts)]) for i, label, v in kept]
    sums = Counter()
    for _, label, found in coded:
        sums[label] += sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), sums[label]) for i, label, found in coded], digest


def lower_words(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base_scores(rows: list[tuple], is_held) -> list[tuple]:
    """(id, held out, tokens, known tokens, training tokens, base score) of rows (id, text)."""
    c: Counter = Counter()
    for i, text in rows:
        if not is_held(i):
            c.update(lower_words(text))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        tokens = [*lower_words(text), None]
        out.append((i, is_held(i), len(tokens), sum(c[t] > 0 for t in tokens), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    return out


def letter_trigrams(text: str | None, buckets: int) -> Counter:
    """Hashed trigrams around each letter of the lower-cased text, character by character."""
    padded = f"\n{(text or '').lower()}\n"
    signs = [ord(c) if c.isalpha() else 32 for c in padded]
    out: Counter = Counter()
    for k in range(1, len(padded) - 1):
        if padded[k].isalpha():
            h = (signs[k - 1] * 0x9E3779B1 + signs[k] * 0x85EBCA77 + signs[k + 1] * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            out[(h >> 16) % buckets] += 1
    return out


def language_model(rows: list[tuple], buckets: int, prior: float) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram probabilities from rows (text, lang)."""
    sums: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        if lang is not None:
            sums[lang].update(letter_trigrams(text, buckets))
    names = sorted(n for n in sums if sums[n])
    table = np.array([[sums[n][b] + prior for b in range(buckets)] for n in names])
    return names, table / table.sum(axis=1, keepdims=True)


def _fitted(p: np.ndarray, n: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    share = np.full(len(p), 1 / len(p))
    for _ in range(steps):
        part = share[:, None] * p
        share = (part / part.sum(axis=0) * n).sum(axis=1) / n.sum()
    return share, float((n * np.log(share @ p)).sum())


def language_mixture(text: str | None, names: list[str], table: np.ndarray, steps: int) -> tuple[str, float]:
    """The language of the largest proportion in the set of highest penalised likelihood; every set size is fitted in full."""
    found = letter_trigrams(text, table.shape[1])
    if not found or not names:
        return "und", 0.0
    at, n = np.array(list(found)), np.array(list(found.values()), float)
    p = table[:, at]
    penalty = 0.5 * math.log(n.sum() + 1)
    single = (n * np.log(p)).sum(axis=1)
    best = (float(single.max()), names[int(single.argmax())], 1.0)
    order = np.argsort(-_fitted(p, n, steps)[0], kind="stable")
    for k in range(2, len(names) + 1):
        some = np.sort(order[:k])
        share, likely = _fitted(p[some], n, steps)
        if likely - (k - 1) * penalty > best[0]:
            best = (likely - (k - 1) * penalty, names[int(some[share.argmax()])], float(share.max()))
    return best[1], best[2]
