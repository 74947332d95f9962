import math

from casegraph.llm import pii

FILL = "common words that every document has"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def spans(df):
    return {r["doc_id"]: [x for x in r["spans"].split(",") if x] for r in df.collect()}


def test_rare_entities(spark):
    docs = [(i, FILL) for i in range(1000)]
    docs[7] = (7, f"Zyxwing {FILL} a@b.org zyxwing")  # entity and term of one document
    docs[8] = (8, f"{FILL} shared a2@b.org")
    docs[9:40] = [(i, f"{FILL} shared") for i in range(9, 40)]  # a term that says little
    docs[50:60] = [(i, f"{FILL} many@b.org" + (" quorl" if i < 54 else "")) for i in range(50, 60)]  # under half of the entity's documents, and nowhere else
    docs += [(2000, None), (None, f"{FILL} 10.0.0.1 nullrow"), (7, "zyxwing")]
    out = pii.find_pii(frame(spark, docs))
    got = spans(out)
    assert got[7] != [] and got[8] == ["email:44:52"] and got[0] == got[9] == got[2000] == []
    both = sorted((r["n_email"], r["spans"]) for r in out.where("doc_id = 7").collect())  # each row on its own text, one document in the statistics
    assert both == [(0, "term:0:7"), (1, "email:45:52,term:0:7,term:53:60")]
    assert got[50][1:] == ["term:48:53"] and got[55] == ["email:37:47"]
    assert got[None] == ["ip:37:45", "term:46:53"]
    assert {r["sanitised"] for r in out.where("doc_id = 50").collect()} == {f"{FILL} [EMAIL] "}


def test_against_plain(spark):
    import random
    import re

    rnd = random.Random(1)
    vocab = [w + x for w in ("alpha", "bravo", "delta", "gamma") for x in map(str.lower, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(1, 4)) + ([f"u{rnd.randint(1, 12)}@x.yz"] if rnd.random() < 0.1 else []))) for i in range(1500)]
    sets = [(set(re.findall(r"[^\W\d_]{4,}", t)), set(re.findall(r"\S+@\S+", t))) for _, t in docs]
    n, want = len(docs), {}
    for (i, _), (terms, held) in zip(docs, sets):
        for e in held:
            n_e = sum(e in h for _, h in sets)
            for t in terms:
                n_t, n_te = sum(t in s for s, _ in sets), sum(t in s and e in h for s, h in sets)
                pmi = math.log2((n_te + pii.PRIOR * n_e / n) / (n_t + pii.PRIOR) * n / n_e)
                if pmi >= pii.BITS and pmi >= pii.SHARE * math.log2(n / n_e):
                    want.setdefault(i, set()).add(t)
    texts = dict(docs)
    got = {i: {texts[i][int(a):int(b)] for k, a, b in (x.split(":") for x in s) if k == "term"} for i, s in spans(pii.find_pii(frame(spark, docs))).items()}
    assert {i: t for i, t in got.items() if t} == want
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_string_ids_and_lists(spark):
    """Ids that are no numbers, and a long list of entities and rare words, copied with changes: no table of all their pairs."""
    import time

    many = " ".join(f"u{k}@x.org word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}zz" for k in range(3000))
    docs = [(f"d{k}", f"{FILL} {k}") for k in range(600)] + [("long", many), ("copy", many), (None, many + " lastone"), ("half", many[: len(many) // 2])]
    began = time.time()
    out = {r["doc_id"]: (r["n_email"], r["n_term"]) for r in pii.find_pii(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert out["long"] == out["copy"] == (3000, 3000) and out[None] == (3000, 3001) and out["d5"] == (0, 0) and time.time() - began < 60


def test_base_spans(spark):
    """The four kinds against their plain patterns, on random texts of the characters that matter."""
    import random
    import re

    rnd = random.Random(8)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    texts = ["".join(rnd.choices(rnd.choice(["0123456789. -+()", "ab@.-é 1", "4 -0", "+1 ()-.", "25.0", "@.a"]), k=rnd.randint(0, 120))) for _ in range(400)]
    texts += ["4111 1111 1111 1111 4111111111111111", "x@y.z.", "+1 (555) 010-9999", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1"]
    want = {}
    for k, t in enumerate(texts):
        want[k] = [f"{kind}:{m.start()}:{m.end()}" for kind, p in plain.items() for m in re.finditer(p, t) if valid(kind, m[0])]
    got = {i: [x for x in s if not x.startswith("term")] for i, s in spans(pii.find_pii(frame(spark, list(enumerate(texts))))).items()}
    assert got == want
