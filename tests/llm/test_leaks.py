import random

import numpy as np
import pytest

from canopy.llm import leaks
from canopy.llm.leaks import leaked_items, words_of

RND = random.Random(8)
VOCABULARY = [f"w{k}" for k in range(300)]
ITEMS = [(100 + k, " ".join(RND.choice(VOCABULARY) for _ in range(RND.choice([11, 12, 13, 40])))) for k in range(30)] + [(200, None), (201, ""), (202, "one two")]


def documents():
    rows = [(1, None), (2, ""), (3, "  "), (4, "short")]
    for k in range(10, 200):
        words = [RND.choice(VOCABULARY) for _ in range(RND.randint(0, 60))]
        if k % 2:
            item = RND.choice([w for _, t in ITEMS if t for w in [t.split()] if len(w) >= 11])
            a = RND.randint(0, max(0, len(item) - 12))
            words[5:5] = item[a : a + RND.choice([11, 12, 20])]
        rows.append((k, " ".join(words)))
    rows.append((300, "<p>" + ITEMS[3][1].upper().replace(" ", "&nbsp;</p><p>") + "</p>"))
    rows.append((301, ITEMS[3][1].replace("w", "ｗ").replace(" ", ", ")))
    rows.append((302, ITEMS[3][1]))
    rows.append((302, ITEMS[3][1]))
    rows.append((303, "z " * 50_000 + ITEMS[5][1]))
    return rows


DOCUMENTS = documents()


def brute(passage=12):
    out = set()
    for d, text in DOCUMENTS:
        w = words_of(text)
        own = {tuple(w[i : i + passage]) for i in range(len(w) - passage + 1)}
        for i, t in ITEMS:
            x = words_of(t)
            if any(tuple(x[j : j + passage]) in own for j in range(len(x) - passage + 1)):
                out.add((d, i))
    return out


def test_words():
    assert words_of("A<br/>b &amp;lt; c&nbsp;d <3 x_y Ⅳ １２ a<b") == ["a", "b", "lt", "c", "d", "3", "x", "y", "iv", "12", "a", "b"]
    assert words_of(None) == words_of("") == []


#: All at once, and in blocks of a few items.
BOUNDS = [leaks.MOST_SIGNATURES, 150]


@pytest.mark.parametrize("most", BOUNDS)
def test_exact_passages(spark, most):
    d = spark.createDataFrame([*DOCUMENTS, (None, ITEMS[5][1])], "doc_id bigint, text string").selectExpr("*", "'x' as item_id", "1 as salt").repartition(3)
    i = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "'x' as doc_id")
    got = [(r.doc_id, r.item_id) for r in leaked_items(d, i, most_signatures=most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute() | {(None, i) for d, i in brute() if d == 303}
    assert len(got) > 40 and any(doc is None for doc, _ in got)
    assert leaked_items(d.limit(0), i, most_signatures=most).count() == 0
    assert leaked_items(d, i.limit(0), most_signatures=most).count() == 0


def edited(words, edits, rnd):
    for _ in range(edits):
        k, kind = rnd.randint(0, len(words) - 1), rnd.randint(0, 2)
        words = words[:k] + ([] if kind == 1 else [rnd.choice(VOCABULARY)]) + words[k + (kind != 2) :]
    return words


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_recall_within_edits(spark, edits):
    """Against all windows of all documents and items, compared one by one."""
    rnd = random.Random(edits)
    items = [(k, " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.choice([12, 12, 20])))) for k in range(60)]
    docs = []
    for k, t in [*items, *items, *items]:
        docs.append((len(docs), "before it " + " ".join(edited(t.split(), rnd.randint(0, edits), rnd)) + " and after it comes more"))
    want = {}
    for d, text in docs:
        w = words_of(text)
        for i, t in items:
            x = words_of(t)
            if set(w) & set(x):
                n = min(leaks.edit_distance(x[b : b + 12], w[a : a + 12], edits) for a in range(len(w) - 11) for b in range(len(x) - 11))
                if n <= edits:
                    want[d, i] = n
    sides = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in leaked_items(*sides, edits=edits).collect()}
    assert got.keys() <= want.keys() and all(got[k] >= want[k] for k in got)
    assert len(want) > 100 and len(got) / len(want) >= 0.9
    for n in range(edits + 1):
        at = [k for k in want if want[k] == n]
        assert sum(k in got for k in at) / len(at) >= 0.9
    blocks = {(r.doc_id, r.item_id): r.edits for r in leaked_items(*sides, edits=edits, most_signatures=3000).collect()}
    assert blocks == got


def test_edit_distance(monkeypatch):
    d = leaks.edit_distance
    assert d(list("abc"), list("abd"), 1) == 1 and d(list("abc"), list("xbd"), 1) == 2
    assert d(list("abcd"), list("bcd"), 1) == 1 and d(list("abcd"), list("cd"), 1) == 2 and d(list("ab"), list("ab"), 0) == 0
    rnd = random.Random(9)
    rows = [([rnd.randint(0, 3) for _ in range(8)], [rnd.randint(0, 3) for _ in range(8)]) for _ in range(500)] + [([1] * 8, [1] * 8)]
    for most in range(4):
        a, b = (np.array([r[k] for r in rows], np.uint64) for k in (0, 1))
        assert leaks.edit_distances(a, b, most).clip(max=most + 1).tolist() == [d(x, y, most) for x, y in rows]
    needed = [leaks.repetitions(e, 12) for e in range(7)]
    assert needed[0] == 1 < needed[1] and needed == sorted(needed)
    monkeypatch.setattr(leaks, "MOST_REPETITIONS", 20)
    with pytest.raises(ValueError):
        leaks.repetitions(6, 12)
