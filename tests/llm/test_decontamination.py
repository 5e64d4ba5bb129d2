import random
import re

from cases import ODD, empty, odd

from tidegrid.llm.decontamination import contamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc = words(text)
    hit, found = set(), set()
    for name, item in items:
        item = words(item)
        size = min(10, len(item))
        for w in {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else ():
            for s in range(len(doc) - size + 1):
                if tuple(doc[s : s + size]) == w:
                    hit.update(range(s, s + size))
                    found |= {name}
    return len(doc), len(hit), sorted(str(x) for x in found if x is not None)


def check(spark, docs, items, **more):
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    assert sorted((r.doc_id, (r.n_words, r.n_hit, r["items"])) for r in got) == sorted((i, brute(t, items)) for i, t in docs)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    some = [f"w{i}" for i in range(12)] + ["é", "the", "A1"]
    items = [(i, " ".join(rng.choices(some, k=k))) for i, k in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30, 30, 40])]
    items += [(99, None), (98, "..."), (None, "nobody owns this item at all it has no id"), (7, items[7][1]), (7, "another text of the same id")]
    docs = []
    for i in range(60):
        parts = rng.choices(some, k=rng.randrange(60))
        if i % 3 == 0:
            own = rng.choice(items[:11])[1].upper().split()
            a = rng.randrange(len(own))
            parts[5:5] = own[a : a + rng.randrange(4, 25)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "nobody owns this item at all it has no id")]
    check(spark, docs, items)
    check(spark, docs, items, hot_most=0)
    check(spark, docs, items, hot_share=0.005, hot_most=15)
    check(spark, docs, items, hot_share=0)


def test_odd_rows(spark):
    items = [(1, "quick brown fox jumps over the lazy dog the quick brown"), (2, "one")]
    got = contamination(odd(spark), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.n_hit} == {1, 2, 9}
    assert contamination(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    got = contamination(odd(spark), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(ODD) and not any(r.n_hit for r in got)
