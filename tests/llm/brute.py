"""Plain versions of the operators' contracts, for small inputs."""

import re


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(rows, percent=80):
    """{doc_id: (n_shingles, component)} of [(doc_id, text)], over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by_token = {}
    for k, (_, s) in enumerate(sets):
        for t in s:
            by_token.setdefault(t, []).append(k)
    for k, (i, s) in enumerate(sets):
        for m in {m for t in s for m in by_token[t] if m < k}:
            j, z = sets[m]
            both = len(s & z)
            if 100 * both >= percent * len(s | z) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets}
