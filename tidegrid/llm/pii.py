"""Personal data: regular base rules plus gradient-boosted candidates, in Spark functions alone.

Base spans follow fixed patterns and checks. Beyond them, high-recall generators propose further spans: numbers with separators,
addresses with a written-out or bracketed "at", hosts with bracketed dots or in hexadecimal groups. Proposals may overlap. Boosted
trees score each by its format and its surroundings, and those above the calibrated threshold of their kind that touch no base
span are added. The trees are plain CASE expressions over the row's proposals, so no text is shuffled and no Python runs on the executors.

The trees are fitted on all documents, in one pass that makes cases of their spans. Positive cases are the base spans in forms
that the base rules don't know: without the plus sign, with "at" written out, with other separators, with bracketed dots, in
hexadecimal. Negative cases are dates, counts, decimals, times, addresses without a host, and cards of a wrong check digit in the same
surroundings, and the documents' own proposals that are clearly none of these kinds. Other proposals count as neither. Equal cases are counted
before they are shuffled, so the fit works on distinct rows of features with their numbers; each kind's positive and negative cases weigh the same
in all. A third of the documents is held back; on these, the threshold of each kind is the lowest that leaves the wanted precision.

Defined results: a null text is empty; a null id and repeated rows keep their rows; without positive and negative cases
nothing is added to the base spans, and nothing of a kind without held-back positive cases.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import documents, stored
from tidegrid.llm.native import apart, let, replaced, spans_of

KINDS = ("email", "ip", "card", "phone")
N_TREES, DEPTH = 12, 4
#: Bins of a feature, more than any has values; up to the square of this number of rows the trees' split points come from all of them.
BINS = 1024
#: Share of right ones that a calibrated threshold must leave among the held-back proposals of its kind.
PRECISION = 0.98
CONTEXT = 24

# Each pattern starts where a run starts and never steps back into it, so that a scan is linear in the text; the
# leftmost matches are those of the plain pattern that the comment gives.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Generators of proposals. A run of digits with marks between them; digits in the usual groups of a card or a phone, whatever
#: digits stand beside them; an address; a host.
GENERATORS = {
    "national": r"(?<![0-9A-Za-z(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "grouped": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-]{1,3}[0-9]{4}){3}(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,}+",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[{]at[)\]}]\x20?|\x20at\x20(?=[A-Za-z0-9-]++\x20dot\x20))[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "host": r"(?<![0-9A-Za-z:.])(?:[0-9]++(?:[(\[{]\.[)\]}][0-9]++){3}+|[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){3,}+)(?![0-9A-Za-z:])",
}
_PLAIN = r"(?:[0-9]{4}[-.][0-9]{1,2}[-.][0-9]{1,2}|[0-9]{1,2}[-.][0-9]{1,2}[-.][0-9]{2,4}|[0-9]{6,9}|[0-9]+\.[0-9]+)"
#: Proposals that are clearly no personal data: dates, plain counts, grouped or decimal numbers, times, and several of these in a row.
CLEAR = rf"^(?:{_PLAIN}(?: {_PLAIN})*|[0-9]{{4}} [0-9]{{1,2}} [0-9]{{1,2}}|[0-9]{{1,3}}(?: [0-9]{{3}})+|[0-9]{{4}}[- ][0-9]{{4}}|[0-9]{{1,2}}(?::[0-9]{{2}}){{2,3}})$"

FEATURES = ("kind", "digits", "length", "marks", "spaces", "dots", "hyphens", "brackets", "letters", "colons", "longest", "shortest", "groups", "date", "starts_zero", "said_before", "after_mark", "luhn", "large_part", "letter_host")


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""

    def add(total: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(k % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _ip_ok(t: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) > 3, False).otherwise(F.concat(F.lit("0"), bare).cast("int") <= 255)

    return F.forall(F.split(t, r"\."), small)


def _card_ok(t: Column) -> Column:
    return let(digits_of(t), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def _phone_ok(t: Column) -> Column:
    return F.length(digits_of(t)).between(8, 15)


CHECKS = {"email": None, "ip": _ip_ok, "card": _card_ok, "phone": _phone_ok}


def with_base_spans(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds one array column of spans for each kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({prefix + kind: spans_of(text, PATTERNS[kind], CHECKS[kind]) for kind in KINDS})


SPAN = "array<struct<s:int,e:int,t:string,kind:string>>"


def proposals_of(text: Column) -> Column:
    """What the generators propose: (s, e, t, kind); proposals of different generators may overlap."""

    def kinded(name: str) -> Column:
        kind = {"address": lambda x: F.lit("email"), "host": lambda x: F.lit("ip"), "grouped": lambda x: F.lit("card"), "national": lambda x: F.lit("phone"), "number": lambda x: F.when(F.length(digits_of(x["t"])) >= 16, "card").otherwise("phone")}[name]
        return F.transform(spans_of(text, GENERATORS[name]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), kind(x).alias("kind")))

    return F.concat(*map(kinded, GENERATORS))


def features_of(text: Column, span: Column) -> dict[str, Column]:
    """Format and context features of one proposal."""
    t = span["t"]
    count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    before = F.substring(text, F.greatest(span["s"] - CONTEXT, F.lit(0)) + 1, F.least(span["s"], F.lit(CONTEXT)))
    after = F.substring(text, span["e"] + 1, F.lit(1))
    digits = digits_of(t)
    parts = F.filter(F.split(t, "[^0-9A-Za-z]+"), lambda p: p != "")
    sizes = F.transform(parts, lambda p: F.length(p))
    return {
        "kind": sum((F.when(span["kind"] == k, n).otherwise(0) for n, k in enumerate(KINDS)), F.lit(0)),
        "digits": F.length(digits),
        "length": F.length(t),
        "marks": F.size(F.split(t, "[0-9A-Za-z]+")) - 1,
        "spaces": count(" "),
        "dots": count(r"\."),
        "hyphens": count("-"),
        "brackets": count(r"[()\[\]{}]"),
        "letters": count("[A-Za-z]"),
        "colons": count(":"),
        "longest": F.array_max(sizes),
        "shortest": F.array_min(sizes),
        "groups": F.size(parts),
        "date": t.rlike(CLEAR).cast("int"),
        "starts_zero": digits.startswith("0").cast("int"),
        "said_before": F.lower(before).rlike("phone|tel|call|fax|mobile|mail|card|visa|contact|address|host").cast("int"),
        "after_mark": after.rlike("[A-Za-z0-9%$]").cast("int"),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits).cast("int")).otherwise(-1),
        "large_part": F.exists(parts, lambda p: (F.length(p) > 3) | (F.coalesce(p.try_cast("int"), F.lit(0)) > 255)).cast("int"),
        "letter_host": F.element_at(F.concat(F.array(F.lit("")), parts), -1).rlike("^[A-Za-z]{2,}$").cast("int"),
    }


def variants(kind: str, t: Column) -> tuple[list[Column], list[Column]]:
    """A base span in forms that the base rules don't know, and look-alikes of it that are no personal data."""
    digits, lit = digits_of(t), F.lit
    some = lambda n, at=1: F.rpad(F.substring(digits, at, n), n, "7")
    date = F.concat(lit("20"), some(2), lit("-0"), (F.length(digits) % 9 + 1).cast("string"), lit("-1"), some(1))
    if kind == "phone":
        bare = F.regexp_replace(t, r"^\+", "")
        national = F.regexp_replace(t, r"^\+[0-9]{1,3}[\x20.-]*(?=.{7})", "")
        right = [bare, F.regexp_replace(bare, "-", " "), national, F.regexp_replace(national, r"[\x20().-]+", " "), F.regexp_replace(F.regexp_replace(bare, r"[\x20().-]+", "-"), "^-", ""), F.regexp_replace(bare, r"[\x20().-]+", "."), F.regexp_replace(bare, r"[\x20().-]+", " ")]
        return right, [date, F.regexp_replace(date, "-", "."), some(7), some(9), F.concat(some(4), lit("."), some(4)), F.concat(some(2), lit(" "), some(3), lit(" "), some(3))]
    if kind == "email":
        at = lambda by: F.regexp_replace(t, "@", by)
        right = [at(" (at) "), F.regexp_replace(at("[at]"), r"\.", "[dot]"), F.concat(F.regexp_replace(F.substring_index(t, "@", 1), r"\.", "_"), lit(" at "), F.regexp_replace(F.substring_index(t, "@", -1), r"\.", " dot "))]
        return right, [F.concat(lit("cost (at) 1"), F.length(t).cast("string"), lit(".50")), F.concat(lit("rate@"), F.length(t).cast("string"), lit(".5")), lit("sold [at] 3[dot]20")]
    if kind == "ip":
        parts = F.split(t, r"\.")
        group = lambda k: F.lower(F.hex(F.get(parts, lit(k)).try_cast("int")))
        right = [F.regexp_replace(t, r"\.", "[.]"), F.regexp_replace(t, r"\.", "(.)"), F.concat(lit("2001:db8:"), F.concat_ws(":", *(F.concat(lit("a"), group(k)) for k in range(4)))), F.concat_ws(":", lit("fe80:"), *(F.concat(lit("1"), group(k)) for k in range(4)))]
        return right, [F.regexp_replace(F.concat(lit("7"), F.lpad(t, 15, "9")), r"\.", "[.]"), lit("10:20:30:40"), F.concat(lit("0"), some(1), lit(":45:12:07")), F.regexp_replace(F.concat(lit("1999.300."), some(1), lit(".999")), r"\.", "[.]")]
    four = lambda by: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{by}")
    wrong = F.concat(F.substring(digits, 1, 15), ((F.substring(digits, 16, 1).cast("int") + 1) % 10).cast("string"), F.substring(digits, 17, 3))
    wrong_four = lambda by: F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", f"$1{by}")
    return [four("."), four("  "), four("- "), F.regexp_replace(digits, "([0-9]{6})(?=[0-9])", "$1.")], [wrong_four("."), wrong_four("  "), wrong, wrong_four("- ")]


def tree_column(shown: str, features: dict[str, Column]) -> Column:
    """A fitted tree, given as its printed form, as a CASE expression."""
    lines = [x.strip() for x in shown.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node(at: int) -> tuple[Column, int]:
        if lines[at].startswith("Predict"):
            return F.lit(float(lines[at].split(":")[1])), at + 1
        number, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        low, at = node(at + 1)
        high, at = node(at + 1)
        return F.when(features[FEATURES[int(number)]] <= float(bound), low).otherwise(high), at

    return node(0)[0]


def cases_of(texts: DataFrame) -> DataFrame:
    """texts(text) -> the features of all cases with label, of (the kind), held, and n, how many there are of each."""
    based = with_base_spans(texts.filter("text is not null").select("text", (F.crc32("text") % 3 == 0).alias("held")))
    text = F.col("text")
    before = lambda x: F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
    after = lambda x: F.substring(text, x["e"] + 1, F.lit(CONTEXT))
    case = lambda x, t, label, kind, clear: F.struct(before(x).alias("before"), t.alias("t"), after(x).alias("after"), F.lit(label).alias("label"), kind.alias("kind"), F.lit(clear).alias("clear"))

    def altered(kind: str) -> Column:
        def forms(x: Column) -> Column:
            right, wrong = variants(kind, x["t"])
            return F.array(*(case(x, f, label, F.lit(kind), False) for label, own in ((1.0, right), (0.0, wrong)) for f in own))

        return F.flatten(F.transform(F.filter(kind, lambda x: F.length(x["t"]) < 80), forms))

    own = F.concat(*(F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS))
    clear = F.filter(apart(proposals_of(text), own), lambda x: x["t"].rlike(CLEAR))
    made = F.concat(*map(altered, KINDS), F.transform(clear, lambda x: case(x, x["t"], 0.0, x["kind"], True)))
    shown = based.select("held", F.explode(made).alias("v")).filter("v.t is not null")
    shown = shown.select(F.concat("v.before", "v.t", "v.after").alias("text"), F.length("v.before").alias("s"), (F.length("v.before") + F.length("v.t")).alias("e"), "v.t", "v.label", "v.kind", "v.clear", "held")
    itself = F.array(F.struct("s", "e", "t", "kind")).cast(SPAN)
    found = shown.withColumn("span", F.explode(F.when(F.col("clear"), itself).otherwise(proposals_of(text))))
    overlap = F.least("e", F.col("span.e")) - F.greatest("s", F.col("span.s"))
    found = found.filter((2 * overlap > F.col("e") - F.col("s")) & ((F.col("label") == 0) | (F.col("span.kind") == F.col("kind"))))
    cases = found.select(*(f.cast("double").alias(n) for n, f in features_of(text, F.col("span")).items()), "label", F.col("span.kind").alias("of"), "held")
    return cases.groupBy(*cases.columns).agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, text_col: str = "text") -> tuple[list[tuple[float, str]], dict[str, float]] | None:
    """(weight, printed form) of the boosted trees and the calibrated threshold of each kind; None if there is nothing to fit."""
    cases = stored(cases_of(docs.select(F.col(text_col).cast("string").alias("text"))), "pii-cases")
    sizes = cases.groupBy("held", "label", "of").agg(F.sum("n").alias("n")).collect()
    if len({(r.held, r.label) for r in sizes}) < 4:
        return None
    learnt = [r for r in sizes if not r.held]
    weight = F
    for r in learnt:
        weight = weight.when((F.col("of") == r["of"]) & (F.col("label") == r.label), F.col("n") * (sum(x.n for x in learnt) / len(learnt) / r.n))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(cases.filter("not held").withColumn("weight", weight))
    model = GBTClassifier(maxIter=N_TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=0.3, seed=5, weightCol="weight").fit(vectors.select("features", "label", "weight"))
    trees = [(w, t.toDebugString) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    scored = cases.filter("held").select(score_column(trees, {n: F.col(n) for n in FEATURES}).alias("score"), "label", "of", "n")
    judged = scored.groupBy("of", "score").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    thresholds = {}
    for kind in KINDS:
        right = n = 0
        own = sorted((r for r in judged if r["of"] == kind), key=lambda r: -r.score)
        for r, below in zip(own, [*own[1:], None], strict=True):
            right, n = right + r.right, n + r.n
            if right >= PRECISION * n and r.right:  # in the middle of the gap below
                thresholds[kind] = r.score if below is None else (r.score + below.score) / 2
    return (trees, thresholds) if thresholds else None


def score_column(trees: list[tuple[float, str]], features: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for weight, shown in trees:
        total = total + F.lit(weight) * tree_column(shown, features)
    return total


def with_spans(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Base spans by kind, and ``added``: the proposals (kind, start, end) that the trees select."""
    found = with_base_spans(docs, text_col, prefix)
    fitted = fit(docs, text_col)
    nothing = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    if fitted is None:
        return found.withColumn(prefix + "added", nothing)
    trees, thresholds = fitted
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(*(F.transform(prefix + k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS))

    def selected(span: Column) -> Column:
        least = F
        for kind, threshold in thresholds.items():
            least = least.when(span["kind"] == kind, threshold)
        scored = lambda f: score_column(trees, {n: f[n] for n in FEATURES}) >= least.otherwise(float("inf"))
        return let(F.struct(*(c.alias(n) for n, c in features_of(text, span).items())), scored)

    chosen = let(proposals_of(text), lambda found: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.filter(apart(found, base), selected)))
    return found.withColumn(prefix + "added", F.transform(chosen, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))


def _shown(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def all_spans(prefix: str, kind: str) -> Column:
    """Base and added spans of a kind by start."""
    added = F.transform(F.filter(prefix + "added", lambda x: x["kind"] == kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.array_sort(F.concat(F.transform(prefix + kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), added))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns, each span of the text replaced by its kind in brackets; overlapping spans become one."""
    prefix = "__pii_"
    found = with_spans(docs, text_col, prefix)
    named = lambda kind: F.transform(all_spans(prefix, kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("by")))
    spans = F.array_sort(F.concat(*map(named, KINDS)))
    return found.withColumn(text_col, let(spans, lambda rows: replaced(F.col(text_col), rows))).select(*docs.columns)


def op8_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = with_spans(docs)
    base = F.concat(*(_shown(k, F.col(k)) for k in KINDS))
    every = F.concat(*(_shown(k, all_spans("", k)) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )
