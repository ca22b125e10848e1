"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import re

import xxhash

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_words(docs, window):
    """{doc_id: (n_words, n_removed, kept)} for (doc_id, text) rows with distinct ids."""
    first = {}
    for i, text in docs:
        own = words(text)
        for at in range(len(own) - window + 1):
            key = tuple(own[at : at + window])
            first[key] = min(first.get(key, i), i)
    found = {}
    for i, text in docs:
        own, gone = words(text), set()
        for at in range(len(own) - window + 1):
            if first[tuple(own[at : at + window])] < i:
                gone.update(range(at, at + window))
        found[i] = (len(own), len(gone), " ".join(w for p, w in enumerate(own) if p not in gone))
    return found


def fingerprint(text, shingle):
    own = words((text or "").translate(FOLD))
    if not own:
        return 0
    runs = [" ".join(own[i : i + shingle]) for i in range(max(1, len(own) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    """{node: all nodes linked to it, itself included}."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: {m for m in nodes if top(m) == top(n)} for n in nodes}


def near_groups(docs, shingle, distance):
    """{doc_id: component_id}."""
    marks = {i: fingerprint(t, shingle) for i, t in docs}
    ids = sorted(marks)
    pairs = [(a, b) for a in ids for b in ids if a < b and (marks[a] ^ marks[b]).bit_count() <= distance]
    return {i: min(g) for i, g in groups(pairs, ids).items()}


def test_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


test_words.__test__ = False


def hits(docs, items, window, slack=0):
    """{doc_id: (n_words, hit positions, sorted item ids)}."""
    found = {}
    for i, text in docs:
        own, hit, named = test_words(text), set(), set()
        for item, asked in items:
            terms = test_words(asked)
            size = min(window, len(terms))
            for at in range(len(terms) - size + 1) if size else ():
                want = terms[at : at + size]
                reach = size + slack
                for start in range(-slack, len(own)):
                    run = own[max(0, start) : start + reach]
                    if run[:size] == want if not slack else set(want) <= set(run):
                        hit.update(range(max(0, start), min(len(own), start + reach)))
                        named.add(str(item))
        found[i] = (len(own), hit, sorted(named))
    return found


def cleaned(docs, min_sites):
    """{doc_id: (text, n_removed)} for (doc_id, site, text) rows with distinct ids."""
    sites, first = {}, {}
    for i, site, text in sorted(docs, key=lambda r: r[0]):
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            key = line.strip(" ")
            if key:
                sites.setdefault(key, set()).update({site} - {None})
                first.setdefault(key, (i, pos))
    found = {}
    for i, _, text in docs:
        if text is None:
            found[i] = (None, 0)
            continue
        own = text.split("\n")
        gone = {
            p for p, line in enumerate(own)
            if (k := line.strip(" ")) and len(sites[k]) >= min_sites and first[k] != (i, p)
        }
        found[i] = ("\n".join(x for p, x in enumerate(own) if p not in gone), len(gone))
    return found
