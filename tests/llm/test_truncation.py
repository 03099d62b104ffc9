import random

from canopy.llm.truncation import judge_texts, truncated_share

RND = random.Random(2)
NOUNS = ["garden", "window", "ladder", "basket", "harbour", "lantern", "kettle", "orchard", "village", "compass"]
VERBS = ["carries", "follows", "watches", "mentions", "collects", "remembers"]


def sentence():
    return f"The {RND.choice(NOUNS)} {RND.choice(VERBS)} the {RND.choice(NOUNS)} near the {RND.choice(NOUNS)}."


def prose(n):
    return " ".join(sentence() for _ in range(n))


def corpus():
    rows, want, k = [], set(), 0

    def add(text, source, truncated):
        nonlocal k
        k += 1
        rows.append((k, text, source))
        if truncated:
            want.add(k)

    for _ in range(120):
        for source in ("field", "bytes", "mail", "log", "free", None):
            add(prose(RND.randint(1, 3)), source, False)
    for _ in range(20):
        text = prose(12)
        add(text[:200] if text[199] != "." else text[:199] + "x", "field", True)
        add(text[:180].rstrip(" .") + " é" * 10 + text[180:185].replace(".", "a"), "free", True)
        add((text[:280].rstrip(". ") + "x" * 300)[:277] + "...", "mail", True)
        add(("é" * 40 + " " + text)[:240].rstrip(". "), "other", True)
    add("y" * 199 + ".", "field", False)
    for text in ("Kind regards\nthe garden", "- basket", "Status: open", "A small garden", "[x] done", "Chapter 3", "See /a/b", "👍"):
        add(prose(2) + "\n" + text if text[0] in "K-S[👍" else text, "free", False)
    add(prose(2) + " The garden carries the ladder, I think ...", "free", False)
    add(prose(2) + " The ladd", "free", True)
    add("A garden and its orch", "free", True)
    add("<p>" + prose(2) + "</p><p>The garden", "free", True)
    add("<p>" + prose(2) + "</p><p>The garden.</p>", "free", False)
    add(prose(1) + " The gard�", "free", True)
    add("<p>" + prose(1) + "</p><a hre", "free", True)
    for text in (None, "", "  \n"):
        add(text, "field", False)
    return rows, want


def test_cases(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as token", "'x' as body").repartition(4)
    judged = judge_texts(df)
    got = {r.doc_id for r in judged.where("truncated").collect()}
    texts = {k: t for k, t, _ in rows}
    assert not {(k in got, texts[k][-60:]) for k in got ^ want}
    assert judged.count() == len(rows) - 3
    for r in judged.collect():  # form alone decides nothing
        assert r.truncated == bool(r.evidence) and set(r.evidence) <= {"limit", "block", "word", "phrase"}
    shares = {r.source: (r.texts, r.truncated) for r in truncated_share(judged).collect()}
    assert shares["log"] == (120, 0) and shares[None] == (120, 0) and shares["mail"] == (140, 20)
    assert judge_texts(df.limit(0)).count() == 0


def test_long_and_repeated(spark):
    long = "word " * 50_000
    rows = [(1, long + "end.", "s"), (2, long, "s"), (3, "x" * 100_000, "s"), (3, "x" * 100_000, "s")]
    judged = judge_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = sorted((r.doc_id, r.truncated) for r in judged.collect())
    assert [k for k, _ in got] == [1, 2, 3, 3] and got[0] == (1, False) and got[1] == (2, True)


def test_limits_of_words_and_single_longer_texts(spark):
    """A limit that keeps whole words, one that a longer text exceeds, one that few texts reach."""
    rows, k = [], 0

    def add(text, source):
        nonlocal k
        k += 1
        rows.append((k, text, source))
        return k

    whole = [add(prose(RND.randint(1, 4)), s) for s in ("words", "chars", "rare") for _ in range(400)]
    cut_off = []
    for _ in range(40):
        text = "\n" + prose(12)
        cut_off.append(add(text[: text[:300].rindex(" ")].rstrip("."), "words"))
        cut_off.append(add(text[:260].rstrip(" .").ljust(260, "e"), "chars"))
    whole.append(add(prose(30), "chars"))
    for _ in range(3):  # fewer than a hundredth of the source
        cut_off.append(add(prose(12)[:350].rstrip(" .").ljust(350, "e"), "rare"))
    judged = judge_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    evidence = {r.doc_id: r.evidence for r in judged}
    assert all("limit" in evidence[c] for c in cut_off) and not any("limit" in evidence[w] for w in whole)


def test_marks(spark):
    """Any word in brackets can stand for the rest; the cut word before it doesn't become a known one."""
    rows = [(k, prose(3), "s") for k in range(50)]
    rows += [(100, prose(2) + " The garden follows the [truncated]", "s"), (101, prose(2) + " The garden (optional)", "s"), (102, prose(2) + " The gard [more]", "s"), (103, prose(1) + " The gard (continued)", "t"), (104, "A garden (see)", "s")]
    got = {r.doc_id: r.evidence for r in judge_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("truncated").collect()}
    assert got[100] == ["phrase"] and "word" in got[102] and "word" in got[103] and 104 not in got
