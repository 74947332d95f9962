"""Plain versions of the operators, for small tables: one Python loop each."""

import base64
import hashlib
import math
import re
import zlib

import regex


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def substring(docs, window=50):
    """docs: [(doc_id, text)] -> {(doc_id, n_words, n_removed, kept_sha256)} as a sorted list."""
    words = [(i if i is not None else float("inf"), (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, w), (doc_id, _) in zip(words, docs):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def near(docs, words=5, percent=80):
    """docs: [(doc_id, text)] with distinct ids -> [(doc_id, n_shingles, component_id)]."""
    sets = {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    done = set()
    for group in where.values():
        for x in range(len(group)):
            for y in range(x):
                a, b = group[y], group[x]
                if (a, b) not in done:
                    done.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * len(sets[a] | sets[b]):
                        p, q = sorted((root(a), root(b)))
                        up[q] = p
    return [(i, len(s), root(i)) for i, s in sets.items()]


def exact(docs):
    """docs: [(doc_id, text)] with distinct ids -> {doc_id: keep_id}."""
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    keep = {g: min(v)[1] for g, v in groups.items()}
    return {i: keep[re.sub(r"[\x20\x09-\x0D]", "", t or "")] for i, t in docs}


LEAK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def leak_words(t):
    return re.findall(LEAK_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def leaks(docs, items, window=10):
    """docs: [(doc_id, text)], items: [(item_id, text)] -> [(doc_id, n_words, n_hit, n_items)]."""
    windows = {}
    for i, t in items:
        w = leak_words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = leak_words(t), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        out.append((i, len(w), len(hit), len(found)))
    return out


def warc(pages):
    """pages: [(page_id, url, html)] -> [(page_id, payload_bytes, payload_digest, record_type, refers_to)]."""
    first, out = {}, []
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in pages:
        raw, f = (h or "").encode(), first.get(h or "")
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return out


def toxic_chance(text, model):
    """The chance of grade 1 or more, word by word."""
    weights, theta = model
    words = set(regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()))
    count = {}
    for w in words:
        for f in ["=" + w, *(w[:k] for k in (4, 5, 6, 7, 8) if len(w) > k)]:
            count[f] = count.get(f, 0) + 1
    z = sum(weights[f] * math.log(1 + n) for f, n in count.items() if f in weights) * math.sqrt(100 / max(len(words), 20))
    return 1 / (1 + math.exp(theta[0] - z))


def spelling(docs, size=6, least=5, ratio=5, drop=199):
    """docs: [(doc_id, text)] -> [(word, form, root, n, n_near, form_n)]."""
    n = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= size and k >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, count = {}, {}
    for a in n:
        close = sorted((-n[b], b) for b in n if abs(len(a) - len(b)) < 2 and near(a, b))
        count[a] = len(close)
        form[a] = close[0][1] if close and -close[0][0] >= ratio * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, n[a], count[a], n[form[a]] if form[a] else None))
    return out


def audit(docs, least=3, top=200):
    """docs: [(lang, source, text)] -> [(lang, source, part, item, value, rank)]."""
    docs = [tuple(x or "" for x in d) for d in docs]
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(s, [w.translate(fold) for w in word.findall(t)]) for x, s, t in docs if x == lang]
        in_docs, n, sources = {}, {}, {s for s, _ in mine}
        for s, ws in mine:
            for w in set(ws):
                in_docs[w] = in_docs.get(w, 0) + 1
            for w in ws:
                n[s, w] = n.get((s, w), 0) + 1
        kept = [w for w, k in in_docs.items() if k >= least]
        total = {s: sum(n.get((s, w), 0) for w in kept) for s in sources}
        share = lambda k, whole: 1 + 10**9 * (k + 1) // (whole + len(kept))  # noqa: B023, E731
        p = {s: {w: share(n.get((s, w), 0), total[s]) for w in kept} for s in sources}
        q = {w: share(sum(n.get((s, w), 0) for s in sources), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if n.get((s, w), 0) and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found) if part == "pair" or k < top]
    return out


def substring_bytes(docs, window=50):
    """docs: [(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]."""
    data = [(i if i is not None else float("inf"), (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in data:
        for k in range(len(b) - window + 1):
            first[b[k:k + window]] = min(first.get(b[k:k + window], i), i)
    out = []
    for (i, b), (doc_id, _) in zip(data, docs):
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k:k + window]] < i:
                gone[k:k + window] = b"\x01" * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def quality_score(text, model):
    """The score of one text, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shapes = []
    for w in words:
        for pattern, by in ((r"\p{Lu}", "A"), (r"[\p{L}\p{M}]", "a"), (r"\p{N}", "9")):
            w = regex.sub(pattern, lambda m, by=by: by, w)
        shapes.append(re.sub(r"A{2,}", "AA", re.sub(r"a{2,}", "aa", re.sub(r"9{2,}", "99", w)))[:12])
    shapes += [" repeat" for x, y in zip(words, words[1:]) if x == y]
    n = max(len(words), 1)
    x = [math.sqrt(shapes.count(k) / n) for k in model["known"].to_pylist()] + [1 / math.sqrt(n)]
    worth = sum(min(max((v - c) / s, -4), 4) * w for v, c, s, w in zip(x, model["centre"], model["scale"], model["w"]))
    return 1 / (1 + math.exp(-min(max((worth - model["cut"]) / (0.5 * model["spread"]) + math.log(0.7 / 0.3), -35), 35)))
