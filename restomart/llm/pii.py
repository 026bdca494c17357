"""Personal data in messages: wide candidates, boosted trees, calibrated thresholds."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import contents, materialize

KINDS = ("email", "ip", "card", "phone")
GROUP_WEIGHT = 2_000  # that the candidates of each kind and label have together at most, whatever their number
TREES, DEPTH = 12, 4
PRECISION = 0.99  # that a threshold must reach on held-out candidates
CONTEXT = 24  # characters before a candidate that its features see

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"

# The exact kinds. Possessive repeats and a look behind, with the end of the last match as an
# alternative, find the same spans as plain repeats but take linear time on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap tests of a whole text before the patterns above and below are tried.
BASE_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
# High-recall generators: other ways of writing the same things. They may overlap each other.
WIDE = {
    "email": r"[\p{L}0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[\p{L}0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\p{L}0-9-]{1,63}+){0,6}",
    "ip": r"[0-9]{1,4}+(?: ?[.,] ?[0-9]{1,4}+){3}|(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}",
    "card": r"[0-9](?:[ ./_-]?[0-9]){11,21}",
    "phone": r"(?:\+|\()?[0-9](?:[ ()./-]{0,2}[0-9]){6,16}",
}
WIDE_HINT = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9] ?[.,] ?[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]",
             "card": r"[0-9](?:[ ./_-]?[0-9]){11}", "phone": r"[0-9](?:[ ()./-]{0,2}[0-9]){6}"}

_CONTACT = r"(?i)(e-?mail|mail|contact|tel|phone|call|fax|mobile|whatsapp|reach|text)\W*\w{0,3}\W*$"
_NUMBER = r"(?i)(order|invoice|ticket|sku|item|ref|no|nr|id|version|total|amount|token|key|#|\$|=)\W*$"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})?"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Check of a string of at least one digit."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    twice = lambda i: 2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0),
                        lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(digit(i)))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"[^0-9]+"), lambda p: p.rlike(f"^{_PART}$"))


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {"email": F.lit(True), "ip": _small_parts(value), "phone": n.between(10, 15),
            "card": F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)}[kind]


def _located(text: Column, pattern: str, hint: str, kind: str) -> Column:
    """Matches with their places in code points: lengths of what lies between them are summed."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), begin.alias("start"), end.alias("end"),
                        pair["value"].alias("value"))
        return F.when(pair["value"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found")))

    hinted = F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint)
    return F.when(hinted, F.aggregate(pairs, start, step, lambda acc: acc["found"])).otherwise(
        F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the exact kinds, by start and then kind."""
    valid = lambda kind: lambda s: _valid(kind, s["value"])
    found = [F.filter(_located(text, BASE[k], BASE_HINT[k], k), valid(k)) for k in KINDS]
    return F.array_sort(F.transform(F.concat(*found), lambda s: F.struct(
        s["start"], s["kind"], s["end"], s["value"])))


def features(kind: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    digits = _digits(value)
    count = lambda pattern: (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("double")
    return [
        kind.cast("double"), F.length(value).cast("double"), F.length(digits).cast("double"),
        count(r"\p{L}"), count(r"[ ]"), count(r"[.]"), count(r"[-]"), count(r"[()\[\]]"), count(r"[,:/_]"),
        flag(luhn(digits)), flag(_small_parts(value)), flag(value.startswith("+")), flag(value.contains("@")),
        flag(value.rlike(r"\p{L}{2,24}$")), flag(before.rlike(r"[\p{L}0-9]$")), flag(after.rlike(r"^[\p{L}0-9]")),
        flag(before.rlike(r"[.,:/_+-]$")), flag(after.rlike(r"^[.,:/_-][0-9]")),
        flag(before.rlike(_CONTACT)), flag(before.rlike(_NUMBER)),
    ]


N_FEATURES = 20


def plausible(kind: Column, value: Column, before: Column) -> Column:
    """Whether a candidate, its spelling undone, can be what its kind says; only the others are look-alikes."""
    plain = F.regexp_replace(F.regexp_replace(value, r" ?(?:@|\(at\)|\[at\]) ?", "@"), r" ?(?:\.|\(dot\)|\[dot\]) ?", ".")
    n = F.length(_digits(value))
    quad = value.rlike(r"^[0-9]{1,4} ?[.,] ?[0-9]{1,4} ?[.,] ?[0-9]{1,4} ?[.,] ?[0-9]{1,4}$")
    written = value.rlike(r"[+( ./-]") | before.rlike(_CONTACT)  # a bare run of digits is no phone by itself
    dated = value.rlike(r"^(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}")
    right = F.when(kind == 0, plain.rlike(r"^[^@]+@(?:[\p{L}0-9-]+\.)+\p{L}{2,24}$")).when(
        kind == 1, F.when(value.contains(":"), value.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}")).otherwise(
            ~value.contains(",") & _small_parts(F.trim(value)))).when(
        kind == 2, _valid("card", value)).otherwise(_valid("phone", value) & ~quad & ~dated & written)
    return right & ((kind == 0) | ~before.rlike(_NUMBER))


def candidates(text: Column) -> Column:
    """Spans that the wide generators propose, with their surroundings."""
    found = F.concat(*[_located(text, WIDE[k], WIDE_HINT[k], k) for k in KINDS])
    return F.transform(found, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(s["start"], F.lit(CONTEXT))).alias("before"),
        F.substring(text, s["end"] + 1, F.lit(3)).alias("after")))


def _tree(text: str, at) -> Column:
    """One fitted tree as an expression; ``at(i)`` is feature i."""
    lines = [line.strip() for line in text.strip().splitlines() if re.match(r"\s*(If|Else|Predict)", line)]

    def read() -> Column:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        index, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = read()
        lines.pop(0)
        return F.when(at(int(index)) <= float(bound), left).otherwise(read())

    return read()


class Detector:
    """Boosted trees as an expression, and the least score that selects a candidate of each kind."""

    def __init__(self, trees: list[tuple[float, str]], thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, at) -> Column:
        margin = sum((w * _tree(t, at) for w, t in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def selected(self, kind: Column, score: Column) -> Column:
        least = F.lit(2.0)
        for k, bound in self.thresholds.items():
            least = F.when(kind == k, bound).otherwise(least)
        return score >= least


def _rewritten(known: DataFrame) -> DataFrame:
    """Exact spans in other spellings, in their own surroundings: further positive examples."""
    kind, value = F.col("kind"), F.col("value")
    return known.filter("label = 1").withColumn("value", F.when(
        kind == 0, F.regexp_replace(F.regexp_replace(value, "@", " (at) "), r"\.(?=[^.]*$)", " (dot) ")).when(
        kind == 1, F.regexp_replace(value, r"\.", " . ")).when(
        kind == 2, F.regexp_replace(_digits(value), "(?<=[0-9])(?=(?:[0-9]{4})+$)", ".")).otherwise(
        F.regexp_replace(value, r"^\+", "")))


def fit_detector(messages: DataFrame, group_weight: int = GROUP_WEIGHT) -> Detector | None:
    """Boosted trees that tell personal data from look-alikes; None without both sorts.

    Every message proposes candidates. Those that are exact spans are positive examples, also in
    other spellings. Negative are those that cannot be their kind in any spelling (``plausible``) or that
    overlap an exact span of another kind. The rest may be personal data in another spelling: they are no
    examples, for the trees or for the thresholds. All different candidates count; those of a kind and label that
    are more than ``group_weight`` weigh as much together. Candidates of equal features are one weighted row, so the
    trees read few rows. A third of the values sets, for each kind, the least score at which ``PRECISION`` of the
    selected, by weight, are positive.
    """
    rows = contents(messages).filter(F.col("content").rlike("[0-9]|@|[(\\[]at[)\\]]"))
    wide = rows.select(base_spans(F.col("content")).alias("base"), candidates(F.col("content")).alias("wide"))
    exact = lambda c: F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] == c["start"])
                               & (b["end"] == c["end"]))
    other = lambda c: F.exists("base", lambda b: (b["kind"] != c["kind"]) & _overlap(b, c))
    label = lambda c: F.when(exact(c), 1).when(
        other(c) | ~plausible(c["kind"], c["value"], c["before"]), 0)
    known = materialize(wide.filter(F.size("wide") > 0).select(F.inline(F.transform("wide", lambda c: F.struct(
        c["kind"].alias("kind"), c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"),
        label(c).alias("label"))))).filter("label is not null"), "candidates")
    known = known.distinct()
    sizes = {(r["kind"], r["label"]): r["n"] for r in known.groupBy("kind", "label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if len({label for _, label in sizes}) < 2:
        return None
    share = F.lit(0.0)
    for (kind, label), n in sizes.items():
        share = F.when((F.col("kind") == kind) & (F.col("label") == label), min(1.0, group_weight / n)).otherwise(share)
    known = known.withColumn("share", share)
    known = known.unionByName(_rewritten(known))
    x = [c.alias(f"f{i}") for i, c in enumerate(features(*[F.col(c) for c in ("kind", "value", "before", "after")]))]
    keys = ["kind", "label", "part", *[f"f{i}" for i in range(len(x))]]
    table = known.select("kind", "label", "share", F.pmod(F.xxhash64("value"), F.lit(3)).alias("part"), *x).groupBy(
        *keys).agg((F.count(F.lit(1)) * F.first("share")).alias("weight"))
    table = materialize(table.orderBy(*keys), "pii-training")
    learnt = table.filter("part > 0")
    if learnt.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(x))], outputCol="features").transform(learnt)
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(vectors)
    found = Detector([(float(w), t.toDebugString) for w, t in zip(model.treeWeights, model.trees)], {})
    scored = table.filter("part = 0").select("kind", "label", "weight", F.floor(100 * found.score(
        lambda i: F.col(f"f{i}"))).alias("score"))
    bins = scored.groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect()
    for kind in range(len(KINDS)):
        good = n = 0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["score"]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n and r["score"] >= 50:
                found.thresholds[kind] = r["score"] / 100
    return found


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _added(detector: Detector | None) -> Column:
    """Selected candidates that touch no exact span and no better candidate."""
    if detector is None or not detector.thresholds:
        return F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    shaped = F.transform(F.filter("wide", lambda c: ~F.exists("base", lambda b: _overlap(b, c))), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
        F.array(*features(c["kind"], c["value"], c["before"], c["after"])).alias("x")))
    scored = F.transform(shaped, lambda c: F.struct(
        detector.score(lambda i: F.get(c["x"], F.lit(i))).alias("score"), c["kind"].alias("kind"),
        c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value")))
    best = F.array_sort(F.filter(scored, lambda c: detector.selected(c["kind"], c["score"])), lambda a, b: F.when(
        a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(
        a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    kept = F.aggregate(best, F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"),
                       lambda acc, c: F.when(F.exists(acc, lambda d: _overlap(c, d)), acc).otherwise(
                           F.concat(acc, F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"),
                                                          c["end"].alias("end"), c["value"].alias("value"))))))
    return kept


def find_personal_data(messages: DataFrame, detector: Detector | None) -> DataFrame:
    """Personal data in every message: ``id``, ``content``, and the spans ``base`` and ``added``.

    Takes ``messages`` (``id``, ``content``) and what ``fit_detector`` learnt from them or from others (None:
    exact spans only). ``base`` are email addresses, IP addresses, card numbers and phone numbers by their
    exact patterns; ``added`` are other spellings that wide patterns propose and the boosted trees select.
    A span has ``start`` and ``end`` (code points, end exclusive), ``kind`` (place in ``KINDS``) and ``value``.
    Both lists are sorted by start, then kind. All of it runs in SQL functions, in one pass, without a shuffle.

    Null content is empty and has no spans. Texts of any length are searched whole. Repeated rows and
    null ids stay as they are; other columns are ignored; an empty table gives an empty result.
    """
    return _with_spans(contents(messages), detector)


def _with_spans(rows: DataFrame, detector: Detector | None) -> DataFrame:
    rows = rows.select("*", base_spans(F.col("content")).alias("base"), candidates(F.col("content")).alias("wide"))
    return rows.withColumn("added", F.array_sort(_added(detector))).drop("wide")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(content: Column, spans: Column) -> Column:
    """The content with every span, or joined overlapping spans, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(content, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                                                       acc["text"].alias("text"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["text"], kept, F.get(names, s["kind"])).alias("text")))

    done = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(
        acc["text"], F.substring(content, acc["at"] + 1, F.length(content))))
    return F.when(F.size(spans) > 0, done).otherwise(content)


def redact(rows: DataFrame, detector: Detector | None, column: str = "content") -> DataFrame:
    """The same rows and columns with personal data in ``column`` replaced by its kind in brackets.

    Null stays null. No row is dropped, and columns of any other name are kept as they are.
    """
    kept = rows.select(F.struct("*").alias("row"), F.coalesce(F.col(column), F.lit("")).alias("content"))
    done = _with_spans(kept, detector).select("row", F.when(F.col(f"row.{column}").isNotNull(), redacted(
        F.col("content"), F.concat("base", "added"))).alias("content"))
    return done.select(*[F.col("content").alias(c) if c == column else F.col(f"row.`{c}`") for c in rows.columns])
