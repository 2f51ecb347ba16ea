"""Plain Python versions of the operators, for small tables."""

import collections
import re

import numpy as np

from tessera.llm import language_id
from tessera.llm import line_dedup as line_dedup_module
from tessera.llm import lm_scoring, quality_classifier, toxicity
from tessera.llm import textblocks as tb

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall(text or "")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def join(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


def shingles(text, n=3):
    w = words((text or "").translate(LOWER))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similar(rows, share=70, whole=100):
    """[(doc_id, n_shingles, n_similar, component_id)] in the order of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    rank = {i: k for k, i in enumerate(order)}
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if whole * both >= share * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    join(parent, rank[i], rank[j])
    return [(rows[i][0], len(sets[i]), links[i], rows[order[find(parent, rank[i])]][0]) for i in range(len(rows))]


def base_counts(text):
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def longest_increasing(values):
    """A longest strictly increasing subsequence by dynamic programming: its length."""
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


def patience(a, b, i, m, j, n):
    """Recursive patience diff of a[i:m] and b[j:n]."""
    if i < m and j < n and a[i] == b[j]:
        return [(i, j), *patience(a, b, i + 1, m, j + 1, n)]
    if i < m and j < n and a[m - 1] == b[n - 1]:
        return [*patience(a, b, i, m - 1, j, n - 1), (m - 1, n - 1)]
    unique = [x for x in range(i, m) if a[i:m].count(a[x]) == 1 and b[j:n].count(a[x]) == 1]
    spots = [j + b[j:n].index(a[x]) for x in unique]
    out, low, there = [], i, j
    for k in line_dedup_module.increasing(spots):
        out += [*patience(a, b, low, unique[k], there, spots[k]), (unique[k], spots[k])]
        low, there = unique[k] + 1, spots[k] + 1
    return out + (patience(a, b, low, m, there, n) if unique else [])


def strip(line):
    return line.strip(" \t\r\x0b\x0c\n")


def cut_against(own, theirs, min_words):
    """Places of blocks that the lines ``own`` share with ``theirs``, turn after turn."""
    gone = set()
    while True:
        a = [i for i, x in enumerate(own) if x and i not in gone and x in theirs]
        b = [j for j, x in enumerate(theirs) if x and x in {own[i] for i in a}]
        found = [(a[x], b[y]) for x, y in patience([own[i] for i in a], [theirs[j] for j in b], 0, len(a), 0, len(b))]
        blocks = []
        for i, j in found:
            if blocks and not any(own[blocks[-1][-1][0] + 1 : i]) and not any(theirs[blocks[-1][-1][1] + 1 : j]):
                blocks[-1].append((i, j))
            else:
                blocks.append([(i, j)])
        spans = [range(x[0][0], x[-1][0] + 1) for x in blocks]
        new = {k for x in spans if sum(len(words(own[k])) for k in x) >= min_words for k in x}
        if not new - gone:
            return gone
        gone |= new


def line_units(text, min_words):
    """{line number: the least run of lines from it on with enough words, as one string}."""
    found, raw = {}, (text or "").split("\n")
    for i, line in enumerate(raw):
        n = 0
        for j in range(i, len(raw)):
            n += len(words(raw[j]))
            if words(line) and n >= min_words:
                found[i] = strip("\n".join(raw[i : j + 1]))
                break
    return found


def line_dedup(rows, min_words, rare):
    """[(doc_id, text, n_lines, deleted)] for rows (doc_id, version, text)."""
    order = sorted({(d, v, t) for d, v, t in rows if d is not None and t}, key=lambda r: r[:2])
    units = {(d, v): line_units(t, min_words) for d, v, t in order}
    lines = {(d, v): [strip(x) for x in t.split("\n")] for d, v, t in order}
    holders = {}
    for d, v, t in order:
        for u in set(units[d, v].values()):
            holders.setdefault(u, []).append((d, v))
    gone, seen = {}, set()
    for d, v, t in order:
        own, mine = lines[d, v], set()
        if t in seen and units[d, v]:
            gone[d, v] = list(range(len(own)))
            continue
        seen.add(t)
        for turn in (False, True):
            covered = {own[k] for k in mine} if turn else set()
            wanted = {holders[u][0] for u in units[d, v].values() if (len(holders[u]) > rare) == turn and holders[u][0] != (d, v) and u not in covered}
            mine = mine.union(*(cut_against(own, lines[w], min_words) for w in wanted))
        gone[d, v] = sorted(mine)
    out = []
    for d, v, t in rows:
        lost = gone.get((d, v), []) if d is not None and t else []
        out.append((d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in set(lost)), len((t or "").split("\n")) if t else 0, lost))
    return out


def near_vectors(rows, least=0.9):
    """{position: (n_links, component)} of rows (vec_id, vector)."""
    x, ok = [], []
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    for _, v in rows:
        good = v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)
        ok.append(good)
        x.append(np.array([*v, *[0.0] * (dim - len(v))], float) / np.linalg.norm(v) if good else None)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    rank = {i: k for k, i in enumerate(order)}
    parent, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and float(x[i] @ x[j]) >= least:
                links[i] += 1
                links[j] += 1
                join(parent, rank[i], rank[j])
    return [(links[i], rows[order[find(parent, rank[i])]][0]) for i in range(len(rows))]


def word_hash(word, table=None):
    raw = np.frombuffer(word, np.uint8)
    return int(tb.hashes(raw, np.array([0]), np.array([len(raw)]), table)[0])


def sigmoid(z):
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def quality_score(model, text):
    """One text's score, indicator by indicator."""
    raw = (text or "").encode()
    at = np.array([0, len(raw)])
    buckets = {int(k) & ((1 << model.bits) - 1) for k in quality_classifier.indicators(np.frombuffer(raw, np.uint8), at, model.bits)}
    total = sum(float(model.weight[b]) for b in buckets)
    length = sum(float(model.square[b]) for b in buckets) ** 0.5
    return sigmoid(model.slope * (total / max(length, 1e-12) + model.intercept) + model.offset)


def toxic_score(net, text):
    """One text's score, filter by filter and place by place."""
    strip = bytes(np.flatnonzero(tb.SPACE | toxicity.STRIP).tolist())
    found = [w for w in re.split(b"[" + re.escape(strip) + b"]+", (text or "").encode()) if w]
    ids = [max(word_hash(w, tb.LOWER) >> (64 - net.bits), 1) for w in found]
    padded = ids + [0] * toxicity.REACH
    z = float(net.p["c"][0])
    for f, width in enumerate(toxicity.WIDTHS):
        best = max(sum(float(net.e[padded[i + j]] @ net.p["w"][j, :, f]) for j in range(width)) for i in range(len(ids) + 1))
        z += max(best + float(net.p["b"][f]), 0.0) * float(net.p["o"][f])
    votes = [0] * len(net.shift)
    for i in ids:
        if net.languages[i] >= 0:
            votes[net.languages[i]] += 1
    return sigmoid(net.slope * (z - net.shift[votes.index(max(votes))]))


def softmax_log(x):
    top = max(x)
    total = np.log(sum(np.exp(v - top) for v in x)) + top
    return [v - total for v in x]


def language_scores(net, text):
    """Log-probabilities of one text, window by window and place by place."""
    raw = [int(language_id._BYTES[b]) for b in (text or "").encode()]
    mean = [0.0] * len(net.names)
    starts = range(0, len(raw), language_id.WINDOW)
    for s in starts:
        w = raw[s : s + language_id.WINDOW]
        w += [0] * (language_id.WINDOW + language_id.REACH - len(w))
        out = [float(c) for c in net.p["c"]]
        for f, width in enumerate(language_id.WIDTHS):
            best = max(sum(float(net.p["e"][w[i + j]] @ net.p["w"][j, :, f]) for j in range(width)) for i in range(language_id.WINDOW))
            for k in range(len(out)):
                out[k] += max(best + float(net.p["b"][f]), 0.0) * float(net.p["o"][f, k])
        mean = [m + v / len(starts) for m, v in zip(mean, softmax_log(out))]
    return softmax_log(mean)


def form_of(word):
    """The form class of a lower-cased word, from its last letters."""
    raw = word.encode()
    end = bool(lm_scoring.PUNCTUATION[raw[-1]])
    last = max(len(raw) - 1 - end, 0)
    value = raw[last] | raw[max(last - 1, 0)] << 8 | end << 16
    return int(tb.mix(np.array([value], np.uint64))[0]) % lm_scoring.FORMS


def model_score(model, counts, text):
    """log10 probability of a text, token by token, with plain sums over all clusters and members; ``counts`` by hash."""
    p, end = model.p, model.words
    symbol = dict(zip(model.head.tolist(), model.head_symbol.tolist()))
    total, before = 0.0, [end] * lm_scoring.CONTEXT
    for w in [*words((text or "").translate(LOWER)), None]:
        h = None if w is None else word_hash(w.encode())
        s = end if w is None else symbol.get(h, -1)
        if s < 0:
            form = form_of(w)
            s = end + 1 + form
            total += np.log10((counts.get(h, 0) + 0.5) / model.mass[form])
        q = sum(p["r"][before[k]].astype(float) * p["a"][k] for k in range(lm_scoring.CONTEXT))
        c = int(model.cluster[s])
        total += softmax_log([float(q @ p["s"][k]) + float(p["t"][k]) for k in range(len(p["s"]))])[c] / np.log(10)
        group = model.members[c].tolist()
        total += softmax_log([float(q @ p["o"][m]) + float(p["b"][m]) for m in group])[group.index(s)] / np.log(10)
        before = [s, *before[:-1]]
    return total
