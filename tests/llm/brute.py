"""Plain versions of the corpus operators, for small fixtures."""

from __future__ import annotations

import collections
import re

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE_WORD.findall((text or "").encode())


def substring_dedup(rows, window):
    """(words, removed, kept text) per row."""
    split = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                hit[i : i + window] = [True] * window
        out.append((len(w), sum(hit), b" ".join(x for x, h in zip(w, hit) if not h).decode()))
    return out


def jaccard(rows, n=5):
    """id -> (class, copy_of, copies, links)."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    rep = {}
    for i in sorted(sets):
        if sets[i]:
            rep.setdefault(sets[i], i)
    having = collections.defaultdict(list)
    for s, i in rep.items():
        for g in s:
            having[g].append(i)
    links = collections.defaultdict(set)
    for s, i in rep.items():
        for j, k in collections.Counter(j for g in s for j in having[g] if j != i).items():
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                links[i].add(j)
    label = {}
    for i in sorted(rep.values()):
        todo = [] if i in label else [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += links[x]
    copies = collections.Counter(sets.values())
    out = {}
    for i, s in sets.items():
        r = rep.get(s, i)
        out[i] = (label.get(r, r), r, copies[s] - 1 if s else 0, len(links[r]))
    return out


def edits(a, b, most):
    """Edit distance, or more than `most`; only cells near the diagonal."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
        row = new
    return min(row.get(len(b), far), far)


def is_blank(line):
    return not line.strip(" \t\n\x0b\x0c\r")


def line_dedup(rows, classes=((10, 1), (20, 2))):
    """Per row (text, lines, exact, near); rows that are equal are one document."""
    distance = classes[-1][1]

    def allowed(a, b):
        return max([d for least, d in classes if min(len(a), len(b)) >= least], default=0)

    seen, near_texts, done, out = set(), collections.defaultdict(list), {}, {}
    for key in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        keep, n, exact, near = [], 0, 0, 0
        for line in key[1].split("\n"):
            if is_blank(line):
                keep.append(line)
                continue
            n += 1
            if line in seen:
                exact += 1
                continue
            seen.add(line)
            if len(line) >= classes[0][0]:
                close = any(edits(line, x, distance) <= allowed(line, x) for d in range(-distance, distance + 1) for x in near_texts[len(line) + d])
                near_texts[len(line)].append(line)
                if close:
                    near += 1
                    continue
            keep.append(line)
        done[key] = ("\n".join(keep), n, exact, near)
    for r in rows:
        out[r] = done.get(r, (None, 0, 0, 0))
    return out


BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def bench_words(text):
    return BENCH_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def decontamination(rows, items, window=13):
    """Per row (words, hit words, sorted items)."""
    phrases = collections.defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[k : k + n])].update([] if item is None else [str(item)])
    out = []
    for _, text in rows:
        w, hit, named = bench_words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
                    named |= phrases[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(named)))
    return out


def repeat_words(w):
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})
