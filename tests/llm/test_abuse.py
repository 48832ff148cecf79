import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from grovelight.llm import abuse as a
from grovelight.llm import clause_model as cm

DATA = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
TEXT = """you are a worthless idiot and nobody likes you the people of the town are kind and every person here knows the way to the harbour
hands clothes strangers porn clips tonight vermin driven out live wire break legs friend watch videos for free""".split()


@pytest.fixture(scope="module")
def decoder():
    return a.Decoder(a.language_model(a.count_table(Counter({w: 50 for w in TEXT}))))


@pytest.fixture(scope="module")
def meaning():
    telling = frozenset("idiot worthless whore asshole salope stupid kill slut".split())
    words = [*TEXT, "whore", "asshole", "salope", "stupid", "kill", "slut", *"letter ville salle little happy street loss".split()]
    return a.Decoder(a.language_model(a.count_table(Counter({w: 50 for w in words}))), telling)


@pytest.mark.parametrize(
    "seen,meant",
    [("you are an 1d10t", "idiot"), ("such i.d.i.o.t. talk", "idiot"), ("p o r n clips", "porn"), ("peoooople", "people"), ("h@nd5", "hands"), ("ve​rmin", "vermin"), ("clоthеs", "clothes"), ("frее", "free"), ("W.A.T.C.H. it", "watch"), ("v?ermin", "vermin")],
)
def test_restores(decoder, seen, meant):
    assert meant in decoder.restore(seen).replace(".", " ").split()


def test_plain_text_stays(decoder):
    for t in ("Room 101, 3rd floor: 25 m2 at 10:30, see www.example.com/a_b", "Ein großer Tag, très bien, źle", "a b", ""):
        assert decoder.restore(t).split() == a.folded(t).split()
    assert a.mended("fÃ¼r dich") == "für dich"
    assert a.folded("ÉÈ ß ł Ö") == "ee ss l o"


WHO = "you, your brother, that neighbour, the new clerk, my landlord, the driver, her sister".split(", ")
FOUL = "worthless idiot, filthy pig, stupid worm, lying rat, brainless clown, disgusting cow, rotten bastard".split(", ")
TAME = "patient teacher, tall farmer, quiet singer, careful baker, old sailor, busy tailor, clever weaver".split(", ")
PLACES = "harbour, mill, orchard, station, chapel, market, bridge".split(", ")


def page(r, kind):
    """A page of harmless sentences, of which one is abusive (1), quotes abuse in a report (2), or neither (0)."""
    out = [f"{r.choice(WHO)} is a {r.choice(TAME)} from the {r.choice(PLACES)}." for _ in range(r.randrange(2, 6))]
    out += [f"The {r.choice(PLACES)} opens at {r.randrange(6, 12)} on market days." for _ in range(2)]
    if kind == 1:
        out.insert(r.randrange(len(out)), r.choice(["{} is a {}, get lost!", "go away {}, nothing but a {}!", "everyone knows that {} is a {}."]).format(r.choice(WHO), r.choice(FOUL)))
    if kind == 2:
        out.insert(r.randrange(len(out)), f"the court fined a man who called {r.choice(WHO)} a {r.choice(FOUL)}, the report said.")
    return "\n".join(out)


def pages(n, seed):
    r = random.Random(seed)
    kinds = [r.choice((0, 0, 1, 2)) for _ in range(n)]
    return [page(r, k) for k in kinds], kinds


def test_fit_finds_the_clause_and_spares_reports():
    texts, kinds = pages(700, 1)
    y = [int(k == 1) for k in kinds]
    for k in range(0, 700, 50):  # a few wrong reviews
        y[k] = 1 - y[k]
    m = cm.fit([a.folded(t) for t in texts], np.array(y))
    assert {"idiot", "bastard"} & m.telling and not {"harbour", "teacher"} & m.telling
    held, kinds = pages(400, 2)
    got = cm.Scorer(m).scores([a.folded(t) for t in held]) >= 0.5
    right = np.mean(got == (np.array(kinds) == 1))
    assert right > 0.97, right


def test_windows_and_batches():
    texts, kinds = pages(300, 3)
    m = cm.fit([a.folded(t) for t in texts], np.array([int(k == 1) for k in kinds]))
    one = [float(cm.Scorer(m).scores([a.folded(t)])[0]) for t in texts[:20]]
    assert np.allclose(cm.Scorer(m).scores([a.folded(t) for t in texts[:20]]), one)
    long = "fine words " * 5000 + "you are a worthless idiot get lost " + "fine words " * 5000
    assert cm.Scorer(m).scores([long, "", "...", "fine words " * 9000])[1:3].tolist() == [0.0, 0.0]
    ids = np.r_[np.arange(1, 78), 0, 0, 1, 0]
    a_, b_ = cm.instances(ids)
    assert set(np.concatenate([np.arange(x, y) for x, y in zip(a_, b_)])) == set(np.flatnonzero(ids)) and (b_ - a_).max() <= cm.LONGEST
    f, c = cm.features(np.array([1, 2, 3, 0, 4, 0]), np.array([0, 4]), np.array([3, 5]), np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64))
    assert np.bincount(c).tolist() == [9, 2]


def test_nothing_to_learn():
    m = cm.fit(["a b", "c d"], np.array([0, 0]))
    assert cm.Scorer(m).scores(["a b"])[0] < 1e-9 and not m.telling


def test_best_cut():
    z = np.array([5.0, 4, 3, 2, 1, 0])
    assert 1 < cm.best_cut(z, np.array([1, 1, 1, 1, 0, 0])) < 2
    assert 3 < cm.best_cut(z, np.array([1, 1, 0, 0, 0, 1])) < 4


@pytest.mark.parametrize("seen,meant", [("a whor3, she", "whore"), ("you asshol3!", "asshole"), ("quelle salop3", "salope"), ("stuupid", "stupid"), ("an idioot.", "idiot"), ("poor-whor3", "whore"), ("w h o r 3", "whore"), ("whoooor3", "whore"), ("i will ki11 you", "kill"), ("5lut", "slut")])
def test_last_signs_and_doubled_letters(meaning, seen, meant):
    assert meant in re.findall("[a-z]+", meaning.restore(seen))


def test_numbers_and_double_letters_stay(meaning):
    for t in ("file3 mp3 utf8 room101 idiot! rat3 3rd 5pm", "letter ville salle little happy street", "x-3 loss4"):
        assert meaning.restore(t) == t


def plain_search(model, steps):
    """All contexts in a dict, whatever their number."""
    best = {(0, 0, 0): (0.0, "")}
    for step in steps:
        new = {}
        for x, (s, w) in best.items():
            for text, chance in step:
                t, y = s + chance, x
                for ch in text:
                    k = 0 if ch == " " else ord(ch) - 96
                    t += float(model[(*y, k)])
                    y = (0, 0, 0) if k == 0 else (y[1], y[2], k)
                if y not in new or t > new[y][0]:
                    new[y] = (t, w + text)
        best = new
    return max(best.items(), key=lambda kv: kv[1][0] + float(model[(*kv[0], 0)]))[1][1]


def test_search_is_exact():
    """Masks open more contexts than a beam keeps; the end decides about the beginning."""
    r = random.Random(3)
    noise = Counter({"".join(r.choice("abcdefghijklmnoprstuwz") for _ in range(r.randrange(3, 9))): r.randrange(1, 30) for _ in range(800)})
    model = a.language_model(a.count_table(Counter({w: 50 for w in TEXT}) + noise))
    d = a.Decoder(model)
    for seen in ("c***p", "z****ij", "wo**hl*ss", "i***t", "b**akkkk", "p3**le", "str**gers", "a*1**", "***t"):
        steps = d.lattice(seen, False)
        assert d.decode(seen) == plain_search(model, steps), seen
    steps = d.lattice("w*r*he11o", True)
    assert d.search(steps) == plain_search(model, steps)


def test_scripts():
    assert a.folded("Привет") == "привет"  # a script of its own stays
    assert a.folded("clоthеs") == "clothes"


def test_operator(spark):
    texts, kinds = pages(300, 5)
    bad = next(t for t, k in zip(texts, kinds) if k == 1)
    rows = [(i, t, "s1" if i % 2 else None, "clash", 0.5, 7) for i, t in enumerate(texts)] + [(1000, None, "s2", "x", 0.5, 7), (1001, "fine words " * 30000 + "\n" + bad, "s2", "x", 0.5, 7), (1001, bad, "s2", "x", 0.5, 7), (None, bad, "s2", "x", 0.5, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, restored string, score double, toxic int")
    reviews = [(i, int(k == 1)) for i, k in enumerate(kinds)] + [(0, None), (None, 1), (1, int(kinds[1] == 1)), (99999, 1)]
    lab = spark.createDataFrame([(*r, "extra") for r in reviews], "doc_id long, toxic int, text string")
    s = a.scored(df, lab).cache()
    assert s.count() == len(rows)
    got = {r.doc_id: r.score for r in s.collect()}
    assert np.mean([(got[i] >= 0.5) == (k == 1) for i, k in enumerate(kinds)]) > 0.98
    assert got[1000] == 0.0 and got[1001] >= 0.5
    r = {x.source: x for x in a.rates(s).collect()}
    assert r["s2"].docs == 4 and r["s2"].abusive == 3 and set(r) == {None, "s1", "s2"}
    assert a.scored(df.limit(0), lab).count() == 0
    assert [x.score for x in a.scored(df.limit(2), lab.limit(0)).collect()] == [0.0, 0.0]
    n = a.reviewed(df, lab, 40).groupBy("toxic").count().collect()
    assert all(5 <= x["count"] <= 40 for x in n)  # bounded, by hash


@pytest.mark.skipif(not os.path.exists(DATA), reason="no labelled data")
def test_against_labels(spark):
    """Fitted to four fifths of the reviews, held against the rest; a few reviews are wrong (about one in eight positive ones)."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lab = spark.read.parquet(f"{DATA}/doc_labels.parquet").filter("toxic is not null")
    most = "pmod(xxhash64(doc_id, 'part'), 5) <> 0"
    s = a.scored(docs, lab.filter(most), keep=("doc_id",))
    one = lab.filter(f"not ({most})").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    rows = s.join(one, "doc_id").collect()
    hit = [r for r in rows if r.score >= 0.5]
    assert sum(r.toxic for r in hit) / len(hit) > 0.8
    assert sum(r.toxic for r in hit) / sum(r.toxic for r in rows) > 0.5
