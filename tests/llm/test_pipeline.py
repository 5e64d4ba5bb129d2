import random
from collections import defaultdict
from pathlib import Path

from cases import ODD, empty, odd

import corpus_pipeline


def corpus():
    rng = random.Random(21)
    letters = "bcdfglmnprst"
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(20)) for i in range(5)]
    clean = {i: prose(120) for i in range(40)}
    docs = dict(clean)
    docs[100] = clean[3]  # exact copy
    docs[101] = clean[4] + "\n"
    docs[102] = "too short"
    docs[103] = " ".join(w + "###" for w in prose(100).split())
    docs[104] = prose(60) + " " + items[2][1] + " " + prose(60)
    docs[105] = prose(60) + " write to ann@mail.example.com now " + prose(60)
    return clean, docs, items


def write(spark, path, docs, items):
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_decide_and_leave_clean_documents(spark, tmp_path):
    clean, docs, items = corpus()
    write(spark, tmp_path, docs, items)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in table.select("doc_id").collect()})
    assert ids[0] == set(docs) - {102, 103}
    assert ids[1] == ids[0] - {100, 101}
    assert ids[2] == ids[3] == ids[1] - {104} == set(clean) | {105}
    texts = {r.doc_id: (r.text, r.n_chars) for r in table.collect()}
    assert all(texts[i] == (t, len(t)) for i, t in clean.items())
    assert "[EMAIL]" in texts[105][0] and "@" not in texts[105][0] and texts[105][1] == len(texts[105][0])
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id] += 1
    assert set(pieces) == ids[3]


def test_odd_rows(spark, tmp_path):
    _, _, items = corpus()
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {r[0] for r in ODD}
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_edited_copies_are_near_duplicates(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, copies = {}, set()
    for i in range(30):
        words = fresh(rng.randrange(60, 300))
        texts[i] = " ".join(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
            words[at] = "edited"
        texts[100 + i] = " ".join(words)
        if jaccard(texts[i], texts[100 + i]) >= 0.8:
            copies.add(100 + i)
        texts[200 + i] = " ".join(words[: len(words) // 2] + fresh(100))
    assert len(copies) > 20 and all(jaccard(texts[i], texts[200 + i]) < 0.8 for i in range(30))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(texts) - copies


def test_rows_without_or_with_a_shared_id_are_documents_of_their_own(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    item = " ".join(f"item{k}" for k in range(15))
    a, b, c, clean = (prose() for _ in range(4))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
        return sorted(stage(spark, docs, str(tmp_path)).collect(), key=str)

    rows = [(None, f"{a} {item}", "x"), (3, clean, "x"), (3, f"{b} {item}", "x"), (4, f"{c} {item}", "x"), (None, c, "x")]
    assert run(corpus_pipeline.decontaminate, rows) == sorted([(3, clean, "x"), (None, c, "x")], key=str)
    rows = [(3, a, "x"), (3, b, "x"), (None, a, "x"), (None, a, "x"), (None, c, "x"), (None, c, "x"), (5, b, "x"), (6, None, "x")]
    assert run(corpus_pipeline.near_dedup, rows) == sorted([(3, a, "x"), (3, b, "x"), (None, c, "x"), (6, None, "x")], key=str)


def test_stages_leave_no_tables_that_nothing_reads(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 60 + k}" for k in range(80)) + f" end{i}", "en", "s", 100) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([("a", " ".join(f"w{k}" for k in range(30)))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))
    clean = corpus_pipeline.decontaminate(spark, kept, str(tmp_path))
    assert 0 not in {r.doc_id for r in clean.collect()} and clean.count() > 10
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before) == ["contaminated", "near-copies", "numbered", "numbered"]
