"""Plain versions of the operators, for small fixtures: one loop over everything, no cleverness."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size=5, lower=lowered):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def jaccard_components(docs):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows with distinct ids, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def link_counts(docs):
    """{doc_id: number of linked documents} of rows with distinct ids, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    return {i: sum(1 for j, o in sets.items() if i != j and s and o and 100 * len(s & o) >= 80 * len(s | o)) for i, s in sets.items()}


def cut_windows(docs, size=50):
    """{doc_id: (n_words, n_removed, kept text)}."""
    every, own = {i: words(t) for i, t in docs}, {}
    for i in sorted(every):
        for k in range(len(every[i]) - size + 1):
            own.setdefault(tuple(every[i][k : k + size]), i)
    out = {}
    for i, w in every.items():
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if own[tuple(w[k : k + size])] < i:
                keep[k : k + size] = [False] * size
        out[i] = len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k)
    return out


def leaks(docs, items, size=5, percent=80):
    """{(doc_id, item_id): (item_shingles, shared)}."""
    sets = {n: [(i, {tuple(w[k : k + n]) for w in [words((t or "").lower())] for k in range(len(w) - n + 1)}) for i, t in docs] for n in range(1, size + 1)}
    out = {}
    for item, text in items:
        q = shingle_set(text, size, str.lower)
        for i, s in sets[min(size, max(1, len(words(text))))]:
            if q and 100 * len(q & s) >= percent * len(q):
                out[(i, item)] = len(q), len(q & s)
    return out


def winnowed(text, token=6, long_run=64, k=4, w=8):
    """The fingerprint of a text, window by window: position:hash of the rightmost least gram of each."""
    spaceless = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]")
    tokens = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
        for part in re.findall(f"{spaceless.pattern}|[^{spaceless.pattern[1:-1]}]+", run):
            tokens += list(part) if len(part) > long_run else [part[i : i + token] for i in range(0, len(part), token)]

    def hash_of(parts):
        h = 42
        for part in parts:
            h = xxhash.xxh64_intdigest(part.encode(), h)
        return h >> 25

    grams = [(hash_of(tokens[i : i + k]), -i) for i in range(len(tokens) - k + 1)] if len(tokens) >= k else [(hash_of([" ".join(tokens)]), 0)] if tokens else []
    picked = list(dict.fromkeys(min(grams[i : i + w]) for i in range(max(1, len(grams) - w + 1)))) if grams else []
    return " ".join(f"{-at:X}:{h:x}" for h, at in picked)


def likeness(one, other):
    """Jaccard likeness of the hashes of two fingerprints."""
    a, b = ({g.split(":")[1] for g in f.split()} for f in (one, other))
    return len(a & b) / len(a | b) if a | b else 1.0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sentence(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed: int = 5) -> list[tuple[int, str | None]]:
    """Texts with copies, chains of near copies, a shared passage, very long, short, blank and null texts, in shuffled order."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\n", "one", "One", "two words", "a b c d", "a b c d e", "A B C D E"]
    hot = sentence(rng, 120)
    texts += [hot] * 15
    for _ in range(30):  # near copies of one text
        w = hot.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        texts.append(" ".join(w))
    chain = sentence(rng, 100).split()
    for _ in range(12):  # each a near copy of the one before
        texts.append(" ".join(chain))
        chain = chain[8:] + sentence(rng, 8).split()
    passage = sentence(rng, 70)
    for _ in range(25):
        texts.append(f"{sentence(rng, rng.randint(1, 60))}\n{passage}  {sentence(rng, rng.randint(1, 60))}")
    texts.append(sentence(rng, 30_000))
    texts += [sentence(rng, rng.randint(5, 150)) for _ in range(60)]
    texts.append(" ".join(["same"] * 400))
    texts.append(f"{passage} {passage}")
    rng.shuffle(texts)
    ids = rng.sample(range(3 * len(texts)), len(texts))
    return list(zip(ids, texts))


def phrases(docs, least, top, longest=5):
    """{lang: [(rank, phrase, a, l, r, n, score)]} of (lang, text) rows, from all n-grams."""
    total, f = {}, {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] = total.get(lang, 0) + len(w)
            for n in range(1, longest + 1):
                for k in range(len(w) - n + 1):
                    key = lang, tuple(w[k : k + n])
                    f[key] = f.get(key, 0) + 1
    often = {key: n for key, n in f.items() if n >= least and len(key[1]) > 1}
    inside = set()
    for (lang, s), n in often.items():
        for m in range(2, len(s)):
            for k in range(len(s) - m + 1):
                part = lang, s[k : k + m]
                if part in often and 100 * n >= 100 * often[part]:
                    inside.add(part)
    rows = {}
    for (lang, s), a in often.items():
        if (lang, s) not in inside:
            cuts = [(1000 * a * total[lang] // (f[lang, s[:k]] * f[lang, s[k:]]), k, f[lang, s[:k]], f[lang, s[k:]]) for k in range(1, len(s))]
            score, _, left, right = min(cuts)
            rows.setdefault(lang, []).append((" ".join(s), a, left, right, total[lang], score))
    return {lang: [(i + 1, *r) for i, r in enumerate(sorted(own, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top])] for lang, own in rows.items()}


def token_bytes(tokenizer, pieces):
    """(bytes of an id of A, bytes of an id of B)."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return (
        lambda i: bytes(letters[c] for c in tokenizer.id_to_token(i)),
        lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode(),
    )


def alignments(rows, tokenizer, pieces):
    """Sorted (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of (doc_id, text) rows, by comparing every two tokens of a group."""
    a_bytes, b_bytes = token_bytes(tokenizer, pieces)
    counts, found = {}, []
    for doc_id, text in rows:
        a = tokenizer.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if not text or b"".join(map(a_bytes, a)) != f" {text}".encode() or b"".join(map(b_bytes, b)) != f" {text}".encode():
            found.append((doc_id, None))
            continue
        spans = []
        for ids, of in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of(i)), i))
                at += len(of(i))
            spans.append(own)
        groups, links, i, j = [], [], 0, 0
        while i < len(a):
            own = [[spans[0][i]], [spans[1][j]]]
            i, j = i + 1, j + 1
            while own[0][-1][1] != own[1][-1][1]:
                if own[0][-1][1] < own[1][-1][1]:
                    own[0].append(spans[0][i])
                    i += 1
                else:
                    own[1].append(spans[1][j])
                    j += 1
            links += [(x[2], y[2]) for x in own[0] for y in own[1] if x[0] < y[1] and y[0] < x[1]]
            groups.append("|".join(",".join(str(t[2]) for t in side) for side in own))
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        found.append((doc_id, (len(a), len(b), len(groups), links, ";".join(groups))))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = [
        (i, 0, 0, 0, 0, 0, 0, "") if x is None
        else (i, *x[:3], len(x[3]), sum(counts[k] == most[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), sha(x[4]))
        for i, x in found
    ]
    return sorted(out, key=repr)
