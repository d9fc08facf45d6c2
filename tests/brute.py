"""Plain single-machine counterparts used only to check the Spark operators."""

import numpy as np


def density(vec, m, k):
    """Top-down density clustering: labels (up to numbering) and persistence per label."""
    n = len(vec)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    d = np.round(np.clip(1 - unit @ unit.T, 0, 2), 9)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(k, n - 1)]
    mr = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # Kruskal over all pairs gives the merge tree.
    iu = np.triu_indices(n, 1)
    order = np.argsort(mr[iu], kind="stable")
    comp = {i: i for i in range(n)}
    node = {i: (None, None, 0.0, [i]) for i in range(n)}
    owner = list(range(n))
    nxt = n
    for e in order:
        a, b = owner[iu[0][e]], owner[iu[1][e]]
        if a == b:
            continue
        pts = node[a][3] + node[b][3]
        node[nxt] = (a, b, max(mr[iu][e], 1e-12), pts)
        for p in pts:
            owner[p] = nxt
        nxt += 1
    clusters = []  # [birth, stability, children, points]
    lams = []

    def parts(i):
        """Components that exist just below the weight of a node: equal weights split at once."""
        found = []
        for j in node[i][:2]:
            found += parts(j) if node[j][0] is not None and node[j][2] == node[i][2] else [j]
        return found

    def walk(i, birth):
        c = {"birth": birth, "rows": 0.0, "kids": [], "pts": node[i][3]}
        clusters.append(c)
        while True:
            lam = 1 / node[i][2]
            lams.append(lam)
            below = parts(i)
            large = [j for j in below if len(node[j][3]) >= m]
            c["rows"] += (lam - birth) * (len(node[i][3]) - (len(node[large[0]][3]) if len(large) == 1 else 0))
            if len(large) == 1:
                i = large[0]
                continue
            c["kids"] = [walk(j, lam) for j in large]
            return c

    labels = np.full(n, -1)
    if n < m:
        return labels, {}
    import sys

    sys.setrecursionlimit(10000)
    top = walk(nxt - 1, 0.0)

    def best(c):
        below = sum(best(k) for k in c["kids"])
        c["chosen"] = c["rows"] >= below * (1 - 1e-9)
        return max(c["rows"], below)

    for k in top["kids"]:
        best(k)
    out = {}

    def pick(c):
        if c["chosen"]:
            label = len(out)
            labels[c["pts"]] = label
            out[label] = c["rows"] / (len(c["pts"]) * max(lams))
        else:
            for k in c["kids"]:
                pick(k)

    for k in top["kids"]:
        pick(k)
    return labels, out
