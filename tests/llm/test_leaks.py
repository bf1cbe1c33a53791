import random

from tracewell.llm import leaks
from tracewell.llm.leaks import forms, holds_passage, leaked_items, words

rng = random.Random(6)
VOCABULARY = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
ITEM = {i: [rng.choice(VOCABULARY) for _ in range(60)] for i in range(30)}
FILL = lambda n: " ".join(rng.choice(["some", "other", "the", "and", "filler"]) for _ in range(n))
DOCS = "doc_id long, text string, item_id int, item string, key int"


def test_disguises(spark):
    docs, want = [], set()

    def add(body, leaked=()):
        docs.append((len(docs), FILL(15) + "\n" + body + "\n" + FILL(15), 0, "", 0))
        want.update((len(docs) - 1, i) for i in leaked)

    for i, w in ITEM.items():
        s = rng.randrange(30)
        run = w[s : s + 26]
        add(" ".join(run).upper(), [i])
        add("\n> ".join(" ".join(run[k : k + 4]) for k in range(0, 26, 4)), [i])
        add("<p>" + " ".join(f"<b>{x}</b>" if rng.random() < 0.3 else x for x in run) + "</p>", [i])
        add('{"q": "' + "\\n".join(" ".join(run[k : k + 6]) for k in range(0, 26, 6)) + '"}', [i])
        add(", ".join(x if k % 11 else "such" for k, x in enumerate(run, 1)), [i])
        add(" ".join(w[s : s + 9]))  # a short quote
        mixed = list(w)
        rng.shuffle(mixed)
        add(" ".join(mixed))
        add(" ".join(x if k % 4 else "such" for k, x in enumerate(run)))  # too many replaced
    docs += [(90_000, None, 0, "", 0), (90_001, "", 0, "", 0), (90_002, (FILL(9) + " ") * 4_000 + " ".join(ITEM[3]), 0, "", 0), (0, docs[0][1], 0, "", 0)]
    want.add((90_002, 3))
    items = [(i, " ".join(w), "t") for i, w in ITEM.items()] + [(100, "too short", "t"), (101, None, "t"), (102, "", "t")]
    d, e = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    rows = [tuple(r) for r in leaked_items(d, e).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want
    brute = {(r[0], i) for r in docs if r[1] for i, w in ITEM.items() if holds_passage(words(r[1], True), " ".join(w))}
    assert brute == want
    assert leaked_items(d.limit(0), e).collect() == [] == leaked_items(d, e.limit(0)).collect()


def test_every_disguise_that_is_verified_is_found(spark):
    """One reader for index and alignment, and no pair that alignment accepts is lost before it."""
    plain = " ".join(ITEM[5][:40])
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" or "0" <= c <= "9" else c for c in plain)
    numbered = lambda sep: "".join(f"12 {k} 7 {w}{sep}" for k, w in enumerate(plain.split()))
    dotted = [*plain.split()[:12], "subscription.region_code", *plain.split()[12:30]]
    tag = "<a " + " ".join(f'data-{k}="{"x" * 40}"' for k in range(30)) + ">"
    item = {5: plain, 7: " ".join(dotted)}
    texts = {
        1: wide, 2: "".join(f"&#{ord(c)};" if k % 3 == 0 else c for k, c in enumerate(plain)), 3: "".join(f"\\u{ord(c):04x}" if k % 4 == 0 else c for k, c in enumerate(plain)),
        4: numbered(" "), 5: numbered("\n"), 6: plain.replace(" ", f" {tag} "), 7: "if (a <b) " + plain + " x> y",
        8: plain.replace(" ", "\\n"), 9: plain.replace(" ", " ­\t"), 10: " ".join(w if k % 10 else "thing" for k, w in enumerate(plain.split(), 1)),
    }
    assert all(any(holds_passage(f, plain) for f in forms(t)) for t in texts.values())
    texts[11] = " ".join(["thing" if "." in w else w for w in dotted][3:24])  # one of three words for one between spaces
    docs = spark.createDataFrame([(k, FILL(30) + " " + t + " " + FILL(30)) for k, t in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame(list(item.items()), "item_id long, text string")
    got = {tuple(r) for r in leaked_items(docs, items).collect()}
    assert {(k, 5) for k in range(1, 11)} | {(11, 7)} <= got
    want = {(k, i) for k, t in texts.items() for i, x in item.items() if any(holds_passage(f, x) for f in forms(t))}
    assert got == want


def test_against_brute_force_in_blocks(spark, monkeypatch):
    chance = random.Random(11)
    few = [f"v{k}" for k in range(40)]
    item = {i: [chance.choice(few) + chance.choice(["", "", ".x"]) for _ in range(chance.choice([19, 20, 21, 35]))] for i in range(40)}
    docs = []
    for d in range(300):
        w = list(item[chance.randrange(40)])
        for _ in range(chance.randrange(4)):
            w[chance.randrange(len(w))] = chance.choice(few)
        for _ in range(chance.randrange(6)):
            w.insert(chance.randrange(len(w)), "n 1 2")
        docs.append((d, " ".join([chance.choice(few) for _ in range(20)] + w + [chance.choice(few) for _ in range(20)])))
    monkeypatch.setattr(leaks, "BLOCK", 300)
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()], "item_id long, text string")
    got = {tuple(r) for r in leaked_items(d, e).collect()}
    want = {(k, i) for k, t in docs for i, w in item.items() if holds_passage(words(t, False), " ".join(w))}
    assert got == want and 50 < len(want)
