import hashlib
import random
import re

import pytest
from cases import ODD, empty, odd
from pyspark.sql import functions as F

from tidegrid.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, t):
    d = re.sub("[^0-9]", "", t)
    if kind == "ip":
        return all(int(p) <= 255 for p in t.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PLAIN.items()}


def texts():
    rng = random.Random(3)
    pieces = ["a@b.c", "x.y%d@e-f.gh.i", "@", ".", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111", "+1 (743) 555-3824", "+49.30.1234", "+1 2", "é", "𝄞", " ", "-", "12", "word", "\n", "a@b", "%", "(", ")", "+"]
    return ["".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(400)] + ["7" * 30_000, "1." * 20_000, "a" * 50_000 + "@b.c", None, "", "+1 " * 5000]


def test_base_spans_equal_plain_patterns(spark):
    rows = list(enumerate(texts()))
    got = pii.with_base_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert {k: [(x.s, x.e) for x in r[k]] for k in pii.KINDS} == brute(r.text), r.text


def people(n=600):
    rng, rows = random.Random(4), []
    for i in range(n):
        words = [rng.choice(["order", "call", "page", "the", "of", "for", "mail"]) for _ in range(20)]
        words.insert(5, rng.choice(["4111 1111 1111 1111", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", f"ann.{i}@mail{i % 9}.example.com", f"10.{i % 250}.3.4", f"{rng.randrange(10**6, 10**7)}", f"20{rng.randrange(10, 99)}-{rng.randrange(10, 12)}-{rng.randrange(10, 28)}", f"{rng.randrange(10**15, 10**16)}"]))
        words.insert(9, rng.choice(["12", "2024", f"{rng.randrange(10**6, 10**8)}", "3.5"]))
        rows.append((i, " ".join(words)))
    return rows


ALTERED = ["({}) 555-{}", "1 ({}) 555 {}", "1-{}-555-{}"]


def planted(n=120):
    """Whole documents with one span each in a form that the base rules don't know: (text, start, end, kind)."""
    rng, out = random.Random(11), []
    for i in range(n):
        words = lambda k: " ".join(rng.choice(["order", "call", "page", "the", "of", "for", "mail", "at", "and", "is", "was", "it", "2024-05-06", "1234567", "3.1415926"]) for _ in range(k))
        a, b = rng.randrange(200, 999), rng.randrange(1000, 9999)
        kind, t = [("phone", ALTERED[i % 3].format(a, b)), ("email", f"ann.{i} (at) mail{i % 9}.example.com"), ("ip", f"10[.]{i % 250}[.]3[.]4"), ("card", "4111.1111.1111.1111")][i % 4]
        before = words(300) + " "
        out.append((before + t + " " + words(300), len(before), len(before) + len(t), kind))
    return out


def test_altered_data_is_found_in_whole_documents_and_the_rest_left(spark):
    found, docs = planted(), people()
    clean = [f"on 2023-01-1{i % 10} there were 12345{i} of 1 234 567 at 10.30 or 3.14159265, chapter 12.4.2, sold at {i}.50 dot" for i in range(100)]
    rows = [*docs, *((10_000 + i, x[0]) for i, x in enumerate(found)), *((20_000 + i, t) for i, t in enumerate(clean))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.fit(table) is not None
    got = {r.doc_id: r for r in pii.with_spans(table).collect()}
    for doc_id, text in rows:
        base = brute(text)
        assert {k: [(x.s, x.e) for x in got[doc_id][k]] for k in pii.KINDS} == base
        spans = [s for v in base.values() for s in v]
        assert not any(x.s < e and s < x.e for x in got[doc_id].added for s, e in spans)
    for kind in pii.KINDS:
        own = [(10_000 + i, s, e) for i, (_, s, e, k) in enumerate(found) if k == kind]
        hit = [any(x.kind == kind and min(e, x.e) - max(s, x.s) >= 0.8 * (e - s) for x in got[i].added) for i, s, e in own]
        assert sum(hit) >= 0.9 * len(hit), kind
    others = sum(not (x.s < e and s < x.e) for i, (_, s, e, _) in enumerate(found) for x in got[10_000 + i].added)
    assert others == 0 and sum(bool(got[20_000 + i].added) for i in range(100)) <= 2
    redacted = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert "[PHONE]" in redacted[10_000] and all(redacted[20_000 + i] == t for i, t in enumerate(clean) if not got[20_000 + i].added)


def test_many_spans_in_one_text(spark):
    """Lists of spans, and redaction, by pieces: equal to the plain way for a text with thousands."""
    text = " ".join(f"a{i}@b.co, é+1 (743) 555-{1000 + i % 9000}" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.with_base_spans(docs).first()
    assert {k: [(x.s, x.e) for x in row[k]] for k in pii.KINDS} == brute(text)
    assert pii.redact(docs).first().text == " ".join(["[EMAIL], é[PHONE]"] * 3000)


def test_trees_as_columns_score_like_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(1)
    rows = [(*(float(rng.randrange(20)) for _ in pii.FEATURES), float(rng.random() < 0.4)) for _ in range(500)]
    cases = spark.createDataFrame(rows, [*pii.FEATURES, "label"])
    vectors = VectorAssembler(inputCols=list(pii.FEATURES), outputCol="features").transform(cases)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(vectors)
    trees = [(w, t.toDebugString) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    scored = model.transform(vectors).withColumn("mine", pii.score_column(trees, {n: F.col(n) for n in pii.FEATURES}))
    for r in scored.select("rawPrediction", "mine").collect():
        assert r.mine == pytest.approx(r.rawPrediction[1], abs=1e-9)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.co or +1 (743) 555-3824, 4111 1111 1111 1111!", "en"), (2, None, "en"), (3, "clean", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "é mail [EMAIL] or [PHONE], [CARD]!", 2: None, 3: "clean"}
    assert pii.redact(docs).columns == docs.columns


def test_odd_rows_and_digest(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.op8_pii_candidates(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    for doc_id, text in {r[0]: r[1] for r in ODD}.items():
        base = brute(text)
        shown = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in base[k])
        assert by[doc_id].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pii.op8_pii_candidates(spark, str(tmp_path / "none")).count() == 0


def test_every_document_gives_cases_however_long(spark):
    """Spans of texts of any length and number are learnt from: their counts are those of all documents."""
    long = "x " * 15_000 + "call +1 (743) 555-3824 now on 2023-01-12"
    rows = [(i, long if i % 2 else "call +1 (743) 555-3824 now on 2023-01-12") for i in range(40)]
    counts = lambda rows: {tuple(r[:-1]): r.n for r in pii.cases_of(spark.createDataFrame(rows, "doc_id long, text string").select("text")).collect()}
    all_, short = counts(rows), counts([(0, rows[0][1])])
    by = lambda found: sum(found.values())
    assert by(all_) == 40 * by(short) > 0
