import random
from collections import Counter

from grovelight.llm import contamination as c

R = random.Random(4)
VOCAB = [f"w{k}x" for k in range(900)]
ITEMS = [(i, " ".join(R.choice(VOCAB) for _ in range(R.randrange(48, 110)))) for i in range(25)]
DOCS = "doc_id long, text string, source string, item_id long, kind string"


def filler(n):
    return " ".join(R.choice(VOCAB) + "q" for _ in range(n))


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def brute(docs, items):
    out = set()
    for i, t in items:
        w = c.words_of(t)
        if not w:
            continue
        runs = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for d, x in docs:
            y = c.words_of(x)
            if any(tuple(y[k : k + 12]) in runs for k in range(len(y) - 11)):
                out.add((i, d))
                continue
            n = int(1.5 * len(w) + 1e-9)
            if 3 * sum((Counter(w) & Counter(y)).values()) >= 2 * len(w) and any(3 * lcs(w, y[s : s + n]) >= 2 * len(w) for s in range(max(1, len(y)))):
                out.add((i, d))
    return out


def corpus():
    docs = []
    for d in range(90):
        w = R.choice(ITEMS)[1].split()
        kind = d % 6
        if kind == 0:  # a run of 11 or 12 words
            s = R.randrange(len(w) - 12)
            part = w[s : s + 11 + d % 2]
        elif kind == 1:  # words replaced and put between, near the limits
            part = [x for x in w if R.random() < R.choice([0.6, 0.7, 0.8])]
            part = [y for x in part for y in ([x, "zz"] if R.random() < R.choice([0.3, 0.9]) else [x])]
        elif kind == 2:
            part = [x.upper() + "," for x in w]
        elif kind == 3:
            part = [f"<b>{x}</b>&nbsp;\n" for x in w]
        elif kind == 4:  # out of order
            part = R.sample(w, len(w))
        else:
            part = []
        docs.append((d, filler(R.randrange(120)) + " " + " ".join(part) + " " + filler(R.randrange(120))))
    docs.append((500, filler(30000) + " " + ITEMS[0][1] + " " + filler(30000)))
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    rows = [(d, t, "s", 1, "clash") for d, t in docs] + [(600, None, "s", 1, "x"), (601, "", "s", 1, "x"), (None, ITEMS[0][1], "s", 1, "x")]
    items = spark.createDataFrame([*[(i, t, "clash") for i, t in ITEMS], (90, None, "x"), (91, "", "x"), (92, "two words", "x")], "item_id long, item_text string, doc_id string")
    want = brute(docs, ITEMS)
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.item_id, r.doc_id) for r in c.leaks(df, items).collect()}
    assert got == want and 30 < len(want) < 90
    # queries in several blocks give the same
    assert {(r.item_id, r.doc_id) for r in c.leaks(df, items, block_bytes=4000).collect()} == want
    assert c.leaks(df.limit(0), items).count() == 0 and c.leaks(df, items.limit(0)).count() == 0


def test_copies_without_the_rare_words():
    """Two thirds of an item in order, but none of the words that tell it from the others."""
    r = random.Random(9)
    common = [f"c{k}" for k in range(40)]
    items = [(i, " ".join(r.choice(common) if k % 3 else f"rare{i}x{k}" for k in range(r.randrange(24, 140)))) for i in range(8)]
    docs = []
    for d, (_, t) in enumerate(items):
        cut = ["zz" if x.startswith("rare") else x for x in t.split()]
        if not 3 * sum(x != "zz" for x in cut) >= 2 * len(cut):
            cut[0] = t.split()[0]
        docs += [(2 * d, filler(60 * (d % 4)) + " " + " ".join(cut) + " " + filler(120)), (2 * d + 1, " ".join(r.sample(cut, len(cut))))]
    index = c.Index().build(items)
    got = {(i, docs[d][0]) for i, d, kind in index.search([t for _, t in docs]) if kind == "edited"}
    assert got == brute(docs, items) >= {(i, 2 * i) for i, _ in items}


def test_template_items():
    """Items on one template: a document that holds only the template's words holds two thirds of each."""
    r = random.Random(2)
    template = [f"t{k}" for k in range(27)]
    items = []
    for i in range(60):
        w = list(template)
        for k in sorted(r.sample(range(28), 9), reverse=True):
            w.insert(k, f"own{i}x{k}")
        items.append((i, " ".join(w)))
    index = c.Index().build(items)
    docs = [filler(40) + " " + " ".join(template) + " " + filler(90), filler(50) + " " + " ".join(reversed(template))]
    got = index.search(docs)
    assert {(i, d) for i, d, _ in got} == brute(list(enumerate(docs)), items) == {(i, 0) for i in range(60)}


def test_recall_on_common_words():
    """Items of frequent words only, random edits: the same pairs as by brute force, each document alone or in a batch."""
    r = random.Random(11)
    common = [f"c{k}" for k in range(60)]
    items = [(i, " ".join(r.choice(common) for _ in range(r.choice([1, 2, 5, 11, 12, 13, 30, 60, 64, 90])))) for i in range(30)]
    docs = []
    for d in range(60):
        w = r.choice(items)[1].split()
        part = [x for x in w if r.random() < 0.8]
        docs.append((d, " ".join(r.choice(common) for _ in range(r.randrange(80))) + " " + " ".join(part) + " " + " ".join(r.choice(common) + "q" for _ in range(r.randrange(80)))))
    index = c.Index().build(items)
    want = brute(docs, items)
    assert {(i, d) for i, d, _ in index.search([t for _, t in docs])} == want and len(want) > 100
    assert {(i, d) for d, t in docs for i, _, _ in index.search([t])} == want


def test_words():
    assert c.words_of("A&amp;B <p class='x'>c<b>d</b>e</p> caf&eacute;­​s\nF_g-h") == ["a", "b", "cde", "cafés", "f", "g", "h"]
    assert c.words_of(None) == [] and c.words_of("  ") == []
    assert c.words_of("a < b and c > d") == ["a", "b", "and", "c", "d"]
