"""Plain Python versions of the corpus operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    for rank, (kind, pattern) in enumerate(zip(("email", "ip", "card", "phone"), patterns)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                True,
                rank == 1 and all(int(x) <= 255 for x in m[0].split(".")),
                14 <= len(digits) <= 19 and luhn(digits),
                10 <= len(digits) <= 15,
            )[rank]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def pii(text):
    found = base_spans(text)
    counts = Counter(k for *_, k in found)
    spans = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return tuple(counts[k] for k in ("email", "ip", "card", "phone")), sha(spans), spans


def repetition(text):
    text = text or ""
    found = TOKEN.findall(text)
    grams = Counter(zip(found, found[1:], found[2:]))
    inside = set()
    for i in range(len(found) - 2):
        if grams[tuple(found[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if TOKEN.search(line):
            again += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def components(texts, n=3, percent=90):
    """{id: (set size, component)} for {id: text}."""
    sets = {}
    for key, text in texts.items():
        found = TOKEN.findall((text or "").translate(LOWER))
        grams = {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}
        sets[key] = grams if len(found) >= n else ({tuple(found)} if found else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    having = defaultdict(list)
    for key in sorted(sets):
        shared = Counter(other for g in sets[key] for other in having[g])
        for other, both in shared.items():
            if 100 * both >= percent * (len(sets[key]) + len(sets[other]) - both):
                a, b = find(key), find(other)
                root[max(a, b)] = min(a, b)
        for g in sets[key]:
            having[g].append(key)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def windows(found, width=10):
    k = min(len(found), width)
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if k else set()


def contamination(text, items):
    """(n_words, n_hit, items found) for items {id: words}."""
    found, hit, names = words(text), set(), set()
    for item, its in items.items():
        for window in windows(its):
            k = len(window)
            for i in range(len(found) - k + 1):
                if tuple(found[i : i + k]) == window:
                    names.add(str(item))
                    hit |= set(range(i, i + k))
    return len(found), len(hit), sorted(names)


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def licenses(text):
    """(n_words, n_base, first, last, base labels)."""
    found, places = words(text), []
    for label, phrase in PHRASES.items():
        want = phrase.split(" ")
        places += [(i, label) for i in range(len(found)) if found[i : i + len(want)] == want]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return len(found), len(places), min(starts, default=None), max(starts, default=None), labels


def url(text):
    """(host, path, rule, verdict by rule)."""
    _, mark, rest = (text or "").partition("://")
    host = re.split(r"[/?#]", rest)[0] if mark else ""
    path = re.split(r"[?#]", rest[len(host) :])[0] if mark else ""
    host = host.translate(LOWER)
    rules = {
        "com/": "allow",
        "example.com/en/": "block",
        "www.example.com/en/": "allow",
        "net/es/": "block",
        "net/fr/": "block",
    }
    best = None
    for rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            best = max(best or "", rule, key=len)
    return host, path, best, rules.get(best)


def without_repeats(texts, width=13):
    """{id: (n_words, n_removed, kept)} for [(id, text)]; rows of one id give a list."""
    first, found = {}, [(i, TOKEN.findall(t or "")) for i, t in texts]
    for i, w in found:
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in found:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def prefix_nodes(conversations):
    """Rows of the prefix trie of {id: [(role, text), ...]}."""
    members = {}
    for i, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(i)
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) > len(x) and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(i) for i in sorted(inside) if len(conversations[i]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), len(kids), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def aligned(texts, tokens_a, tokens_b):
    """Rows of the alignment of [(id, text)], given functions text -> [(token id, bytes)]."""
    rows, held = [], Counter()
    for key, text in texts:
        a, b = (tokens_a(text), tokens_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        spans = []
        for tokens in (a, b):
            at, found = 0, []
            for token, data in tokens:
                found.append((at, at + len(data), token))
                at += len(data)
            spans.append(found)
        links = [(x, y) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[t for s, e, t in side if low <= s and e <= high] for side in spans] for low, high in zip([0, *cuts], cuts)]
        pairs = [(x[2], y[2]) for x, y in links]
        held.update(set(pairs))
        rows.append((key, a, b, groups, pairs))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for key, a, b, groups, pairs in rows:
        told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(held[p] == top[p[0]] for p in pairs)
        total = sum(held[p] for p in pairs)
        in_groups = sum(len(x) * len(y) for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(pairs), best, total, sha(told) if told else "", in_groups))
    return sorted(out, key=str)


def host_verdicts(pages, edges, damping=0.85, least=0.1):
    """{host: (trust, distrust, verdict)} of [(host, rule verdict)] and {(src, dst): links}."""
    counts = {}
    for host, verdict in pages:
        counts.setdefault(host, []).append(verdict)

    def ranks(kind, links):
        seed = {h: v.count(kind) / len(v) for h, v in counts.items()}
        out = Counter()
        for (src, _), n in links.items():
            out[src] += n
        rank = Counter(seed)
        for _ in range(400):
            new = Counter(seed)
            for (src, dst), n in links.items():
                new[dst] += damping * rank[src] * n / out[src]
            rank = new
        return rank

    trust, distrust = ranks("allow", edges), ranks("block", {(b, a): n for (a, b), n in edges.items()})
    bad = lambda h: distrust[h] > trust[h] and distrust[h] >= least
    return {h: (trust[h], distrust[h], "block" if bad(h) else "allow") for h in {*counts, *trust, *distrust}}
