"""Brute-force versions of the operators, one text at a time."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(w), len(inside)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def covered(n, starts, size):
    hit = bytearray(n)
    for s in starts:
        hit[s : s + size] = b"\1" * size
    return hit


def decontaminate(texts, items):
    windows = {}
    for item, text in items:
        w = PLAIN.findall((text or "").translate(LOWER))
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for text in texts:
        w = PLAIN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[k]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def bytes_removed(texts, size=400):
    data = [(t or "").encode() for t in texts]
    each = [[b[i : i + size] for i in range(len(b) - size + 1)] for b in data]
    count = Counter(x for e in each for x in e)
    out = []
    for b, e in zip(data, each):
        hit = covered(len(b), [i for i, x in enumerate(e) if count[x] > 1], size)
        spans = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        out.append((len(b), sum(hit), spans, sha(bytes(c for c, h in zip(b, hit) if not h))))
    return out


def words_removed(texts, size=35):
    words = [WORD.findall(t or "") for t in texts]
    each = [[tuple(w[i : i + size]) for i in range(len(w) - size + 1)] for w in words]
    count = Counter(x for e in each for x in e)
    out = []
    for w, e in zip(words, each):
        hit = covered(len(w), [i for i, x in enumerate(e) if count[x] > 1], size)
        out.append((len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit) if not h))))
    return out


def near(rows, size=3, least=85):
    """{id: (set size, component)} of (id, text)."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = sorted((find(i), find(j)))
                low[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
digits = lambda m: re.sub("[^0-9]", "", m)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def private(text):
    out, text = [], text or ""
    for kind, pattern, ok in (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
                              ("card", CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m.group())]
    return out


def halved(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def merkle(rows, fields=("doc_id", "source", "lang", "n_chars", "text")):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of dicts, in no order."""
    leaf = lambda x: sha("".join("-" if x[c] is None else f"{len(str(x[c]).encode())}:{x[c]}" for c in fields))
    by = defaultdict(list)
    for x in rows:
        by[x["lang"]].append(x)
    names, trees = sorted(by, key=lambda k: (k is not None, (k or "").encode())), {}
    for k in names:
        by[k].sort(key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, leaf(x)))
        trees[k] = halved([leaf(x) for x in by[k]])
    crown, out = halved([trees[k][-1][0] for k in names]), []
    for j, k in enumerate(names):
        for i, x in enumerate(by[k]):
            now, near = leaf(x), []
            if x["doc_id"] is not None and x["n_chars"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 7 == 0:
                now = leaf(x | {"n_chars": x["n_chars"] + 1})
            for levels, at in ((trees[k], i), (crown, j)):
                for level in levels[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    near += [z for q, z in enumerate(run) if q != at % 2]
                    run[at % 2] = now
                    now, at = sha("".join(run)), at // 2
            out.append((x["doc_id"], leaf(x), trees[k][-1][0], crown[-1][0], sha("".join(near)), now, now == crown[-1][0]))
    return out


def repair(rows):
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by a search over all edits, cheapest and least first."""
    by, out = defaultdict(list), {}
    for x in rows:
        by[x["conv_id"]].append(x)
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for k, members in by.items():
        after = []
        for x in members:
            conv, turn, role, text = (" " if v is None else v for v in (k, x["turn"], x["role"], x["text"]))
            what = zlib.crc32(f"{conv}:{turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(what, text)
            after += [(x["turn"], "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in after:
            left = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {x[0] for x in after if x[0] is not None}
        heap, done = [(0, "", 0, "", [])], set()
        while True:
            cost, audit, i, last, lines = heapq.heappop(heap)
            if i == len(after) and last in ("", "a"):
                break
            if (i, last) in done:
                continue
            done.add((i, last))
            roles = [(c, w) for c, w in (("u", "user"), ("a", "assistant")) if (last, c) in follows]
            moves = [(2, "I", i, c, [f"{w}:"]) for c, w in roles]
            if i < len(after):
                _, role, text = after[i]
                moves.append((3, "D", i + 1, last, []))
                if faults[i] not in ("b", "d"):
                    more = faults[i] == "t"
                    if (last, role[:1]) in follows:
                        moves.append((more, "K", i + 1, role[:1], [f"{role}:{text}"]))
                    moves += [(2 + more, "R", i + 1, c, [f"{w}:{text}"]) for c, w in roles]
            for c, e, j, to, add in moves:
                heapq.heappush(heap, (cost + c, audit + e, j, to if e != "D" else last, lines + add))
        out[k] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(c) for c in "bdt"],
                  sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:])), cost, audit, sha("\n".join(lines)))
    return out


def token_rows(rows, encode):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) in order; ``encode`` gives the ids of a text."""
    out, at = [], 0
    for ident, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*encode(text or ""), 1]
        out.append((ident, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out
