"""Personal data: base patterns, high-recall candidates and boosted trees, all as DataFrame functions.

Spans are found with regular expressions whose matches and gaps give the positions (in code points). Candidates of
further generators get format and context features; gradient-boosted trees, trained on counts of feature values, score
them, and a threshold for each kind selects. The trees are column expressions: nothing leaves the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import crc_fold, drop, whole_texts, written

SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"

#: A dot before a letter, digit or hyphen is this letter while e-mail addresses are looked for; see ``emails``.
DOT, OTHER = "", ""
# Patterns without nested repetition, so that very long texts can't exhaust the stack, and without restarts inside a run.
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+\-{DOT}]))[A-Za-z0-9._%+\-{DOT}]++@[A-Za-z0-9\-]++{DOT}[A-Za-z0-9\-{DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ \-])[0-9](?:[ \-]?[0-9]){13,18}(?![ \-]?[0-9])"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
OCTET = "^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?$"
#: Base kinds, in the order of digests, and the generators' kinds.
BASE = ("email", "ip", "card", "phone")
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{16,}+",
    "phone_like": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[ .\-]?)?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9A-Za-z])",
    "number_like": r"(?<![0-9])(?<![0-9][ \-])[0-9](?:[ \-]?[0-9]){8,18}(?![ \-]?[0-9])",
    "email_like": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9\-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9\-]{2,63}){1,4}",
}
KINDS = (*BASE, *GENERATORS)


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, also where lambdas use it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, state: Column, outputs: str, step, block: int = 256) -> Column:
    """The outputs of step(state, item), which gives the next state and an output, along an array.

    Arrays grow block by block, so the work is in proportion to the length times the block, never to its square.
    """
    none, nones = F.array().cast(f"array<{outputs}>"), F.array().cast(f"array<array<{outputs}>>")

    def one(acc, item):
        after, out = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def whole(acc, part):
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.aggregate(F.array(inner), acc, lambda old, new: F.struct(new["state"].alias("state"), F.concat(old["out"], F.array(new["out"])).alias("out")))

    parts = bound(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - 1), F.lit(block)), lambda at: F.slice(x, at + 1, F.lit(block))))
    return F.flatten(F.aggregate(parts, F.struct(state.alias("state"), nones.alias("out")), whole, lambda acc: acc["out"]))


def spans(text: Column, pattern: str, kind: str, restored=lambda value: value) -> Column:
    """All matches as kind, start, end (exclusive, code points), value, and what stands before (24 code points) and after (1).

    before reaches back to the begin of the match before at most. Positions come from the lengths of matches and gaps.
    """

    def step(at, p):
        start = at + F.length(p["gap"])
        end = start + F.length(p["found"])
        before, after = F.concat(p["last"], p["gap"]), F.concat(p["then"], F.substring(p["follows"], 1, 1))
        return end, F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), restored(p["found"]).alias("value"), F.substring(before, -24, 24).alias("before"), F.substring(after, 1, 1).alias("after"))

    def placed(x):
        found, gaps, n = x["found"], x["gaps"], F.size(x["found"])
        last = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.greatest(F.lit(0), n - 1)))
        follows = F.concat(F.slice(found, F.lit(2), F.greatest(F.lit(0), n - 1)), F.array(F.lit("")))
        pairs = F.slice(F.arrays_zip(found.alias("found"), gaps.alias("gap"), last.alias("last"), F.slice(gaps, F.lit(2), n).alias("then"), follows.alias("follows")), F.lit(1), n)
        return F.when(n > 0, scan(pairs, F.lit(0), SPAN.removeprefix("array<").removesuffix(">"), step)).otherwise(F.array().cast(SPAN))

    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn test."""
    d = F.reverse(digits(value))
    doubled = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
    terms = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 0, doubled(F.substring(d, i, F.lit(1)).cast("int"))).otherwise(F.substring(d, i, F.lit(1)).cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def emails(text: Column) -> Column:
    marked = F.regexp_replace(F.translate(text, DOT, OTHER), r"\.(?=[A-Za-z0-9\-])", DOT)
    return spans(marked, EMAIL, "email", lambda value: F.translate(value, DOT, "."))


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds that pass their tests; a failing match is dropped without another try."""
    none = F.array().cast(SPAN)
    ok_ip = lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(OCTET))
    ok_phone = lambda s: F.length(digits(s["value"])).between(10, 15)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), emails(text)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP, "ip"), ok_ip)).otherwise(none),
        F.when(text.rlike("[0-9]"), F.filter(spans(text, CARD, "card"), lambda s: luhn(s["value"]))).otherwise(none),
        F.when(text.rlike(r"\+[0-9]"), F.filter(spans(text, PHONE, "phone"), ok_phone)).otherwise(none),
    )


def candidates(text: Column) -> Column:
    """Overlapping spans of all generators, with the text around each."""
    none = F.array().cast(SPAN)
    gates = {"secret": text.rlike("[0-9]"), "phone_like": text.rlike("[0-9]{3}"), "number_like": text.rlike("[0-9]{2}"), "email_like": text.rlike(r"[\[(]at[\])]")}
    return F.concat(*[F.when(gates[k], spans(text, p, k)).otherwise(none) for k, p in GENERATORS.items()])


#: Features in two views. All are small whole numbers, so that their combinations are at most 27,648 and 256.
FORMAT = ("kind", "length", "n_digits", "letters", "hex", "separators", "plus", "checksum")
CONTEXT = ("kind", "keyword", "denied", "assigned", "after_space", "start_of_word")
#: Words, in several languages, that announce personal data or a secret, and words that announce other things.
KEYWORD = r"(?:passw|token|secret|key|auth|tel|phone|fone|call|card|mail|konto|iban|account|ssn|contact)[a-z]{0,6}[^a-z0-9]{0,4}$"
DENIED = r"(?:^|[^a-z])(?:order|invoice|version|build|isbn|issn|sku|commit|sha|md5|hash|page|line|lot|part|item|ticket|release|tracking|serial)[a-z0-9]{0,6}[^a-z0-9]{0,4}$"


def features(s: Column) -> dict[str, Column]:
    """What describes a candidate's format and its context."""
    value, n, before = s["value"], F.length(s["value"]), F.lower(s["before"])
    d = F.length(digits(value))
    flag = lambda c: c.cast("int")
    return {
        "kind": F.coalesce(*[F.when(s["kind"] == k, i) for i, k in enumerate(GENERATORS)]),
        "length": F.least(F.lit(5), F.floor(n / 8)).cast("int"),
        "n_digits": F.least(F.lit(7), F.floor(d / 3)).cast("int"),
        "letters": flag(value.rlike("[a-z]")) + 2 * flag(value.rlike("[A-Z]")),
        "hex": flag(value.rlike("^[0-9a-fA-F]++$")),
        "separators": F.least(F.lit(2), F.length(F.regexp_replace(value, r"[^ ().\-/_]", ""))),
        "plus": flag(value.startswith("+")),
        "checksum": F.when(d.between(12, 19), flag(luhn(value))).otherwise(-1),
        "keyword": flag(before.rlike(KEYWORD)),
        "denied": flag(before.rlike(DENIED)) + 2 * flag(before.rlike("[a-z0-9/_.-]$")),
        "assigned": flag(before.rlike(r"[=:] ?[\"']?$")),
        "after_space": flag(s["after"].rlike(r"^(?:[\s,;.\"']|$)")),
        "start_of_word": flag((before == "") | before.rlike(r"[\s\"'(=:]$")),
    }


def format_says(s: Column) -> Column:
    """Whether a candidate's own characters make it personal data or a secret: 2 for sure, 1, 0, or null where they can't tell."""
    value = s["value"]
    d = F.length(digits(value))
    mixed = (d >= 4) & value.rlike("[A-Za-z]") & (F.length(value) >= 16) & ~value.rlike("[/_-]")
    return (
        F.when(s["kind"] == "secret", F.when(value.rlike("^AKIA[0-9A-Z]{16}$"), 2).when(mixed, 1).otherwise(0))
        .when(s["kind"] == "phone_like", F.when(value.rlike(r"^\+[0-9]{1,3}[ .\-]?\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}$"), 2).when(value.rlike(r"^\([0-9]{3}\)"), 1).when(~value.rlike(r"[ .\-()+]"), 0))
        .when(s["kind"] == "number_like", F.when(d.between(14, 19), luhn(value).cast("int")))
        .otherwise(F.when(value.rlike(r"(?i)\b(?:com|org|net|edu|de|fr|es)[\])]?$"), 1))
    )


def context_says(s: Column) -> Column:
    """Whether what stands around a candidate announces personal data or a secret: 1, 0, or null where it can't tell.

    Words of other things, and letters, digits or joining signs right before, speak against it; prose tells nothing.
    """
    before = F.lower(s["before"])
    return F.when(before.rlike(DENIED) | before.rlike("[a-z0-9/_.-]$"), 0).when(before.rlike(KEYWORD), 1)


def label_of(s: Column) -> Column:
    """1 or 0 for a candidate: a format that is sure, else the context, else the format, else 0 as nothing speaks for it."""
    own = format_says(s)
    return F.when(own == 2, 1).otherwise(F.coalesce(context_says(s), own, F.lit(0)))


@dataclass(frozen=True)
class PiiModel:
    """For each view a base and trees (feature, cut, (feature, cut, low, high), (feature, cut, low, high)); a logit threshold for each kind."""

    base: float
    trees: tuple
    thresholds: dict[str, float]

    def logit(self, x: dict[str, Column]) -> Column:
        def stump(t):
            return F.when(x[t[0]] <= t[1], t[2]).otherwise(t[3])

        total = F.lit(self.base)
        for f, cut, low, high in self.trees:
            total = total + F.when(x[f] <= cut, stump(low)).otherwise(stump(high))
        return total

    def value(self, row: dict[str, int]) -> float:
        stump = lambda t: t[2] if row[t[0]] <= t[1] else t[3]
        return self.base + sum(stump(low) if row[f] <= cut else stump(high) for f, cut, low, high in self.trees)


def best_stump(rows, names, grads, hess, ridge: float = 1.0):
    """The cut of one feature that lowers the loss most, and Newton's values on both sides."""
    best = None
    for f in names:
        sums: dict[int, list[float]] = {}
        for r, g, h in zip(rows, grads, hess, strict=True):
            s = sums.setdefault(r[f], [0.0, 0.0])
            s[0] += g
            s[1] += h
        total_g, total_h, g, h = sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values()), 0.0, 0.0
        for v in sorted(sums):
            g, h = g + sums[v][0], h + sums[v][1]
            gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, v, g / (h + ridge), (total_g - g) / (total_h - h + ridge))
    return best


def boost(table: list[dict], names: tuple[str, ...], rounds: int = 24, rate: float = 0.4) -> tuple[float, tuple]:
    """Gradient boosting with logistic loss on rows of feature values with counts n and sums of labels y."""
    n, y = sum(r["n"] for r in table), sum(r["y"] for r in table)
    base = math.log((y + 1) / (n - y + 1))
    score, trees = [base] * len(table), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        grads = [r["y"] - r["n"] * q for r, q in zip(table, p, strict=True)]
        hess = [r["n"] * q * (1 - q) for r, q in zip(table, p, strict=True)]
        _, f, cut, _, _ = best_stump(table, names, grads, hess)
        sides = []
        for low in (True, False):
            k = [i for i, r in enumerate(table) if (r[f] <= cut) == low]
            if k:
                _, g, c, a, b = best_stump([table[i] for i in k], names, [grads[i] for i in k], [hess[i] for i in k])
                sides.append((g, c, rate * a, rate * b))
            else:
                sides.append((f, cut, 0.0, 0.0))
        trees.append((f, cut, *sides))
        model = PiiModel(0.0, (trees[-1],), {})
        score = [s + model.value(r) for s, r in zip(score, table, strict=True)]
    return base, tuple(trees)


def fit(docs: DataFrame, precision: float = 0.95, folds: int = 5) -> PiiModel:
    """Trains on all candidates of all texts, whose labels come from their formats and contexts (``label_of``).

    The tables mark no spans, so a checksum, a complete form or a word before a candidate labels it, and the trees learn what
    such candidates have in common. Trees over format features and trees over context features are trained apart; a
    candidate's logit is the sum of both. Candidates are counted by their features in a written table; of it each view's own
    counts reach the driver, at most 27,648 and 256 rows however many candidates there are, and a threshold for each kind.
    Trees are trained outside one fold of doc_id; on that fold each kind's threshold is the lowest score from which on the
    share of true ones (smoothed by one false one) reaches ``precision``. A kind without such a score selects nothing.
    Null and empty texts have no candidates; without any, nothing is selected.
    """
    found = whole_texts(docs).select((crc_fold("doc_id", folds) == 0).alias("held"), F.explode(candidates(F.col("text"))).alias("s"))
    names = tuple(dict.fromkeys(FORMAT + CONTEXT))
    marked = found.select(F.coalesce("held", F.lit(False)).alias("held"), label_of(F.col("s")).alias("label"), *[c.alias(k) for k, c in features(F.col("s")).items()])
    table = written(marked.groupBy("held", *names).agg(F.count("*").alias("n"), F.sum("label").alias("y")), "pii-counts")
    base, trees = 0.0, ()
    for view in (FORMAT, CONTEXT):
        sums = table.where(~F.col("held")).groupBy(*view).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        rows = sorted((r.asDict() for r in sums.collect()), key=lambda r: tuple(r[f] for f in view))
        if rows:
            own_base, own_trees = boost(rows, view)
            base, trees = base + own_base, trees + own_trees
    model = PiiModel(base, trees, {})
    kind = Window.partitionBy("kind")
    scored = table.withColumn("score", model.logit({f: F.col(f) for f in names}))
    # a kind without candidates in the held fold is judged on the others
    scores = scored.withColumn("judged", F.max("held").over(kind)).where("held = judged").groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    down = kind.orderBy(F.desc("score"))
    passed = scores.withColumn("share", F.sum("y").over(down) / (F.sum("n").over(down) + 1)).where(F.col("share") >= precision)
    kinds = list(GENERATORS)
    thresholds = {kinds[k]: least - 1e-9 for k, least in passed.groupBy("kind").agg(F.min("score")).collect()}
    drop(table)
    return PiiModel(base, trees, dict(sorted(thresholds.items())))


def selected(text: Column, model: PiiModel) -> Column:
    """The candidates that the trees and thresholds select."""

    def chosen(s):
        z = model.logit(features(s))
        passed = F.lit(False)
        for kind, least in model.thresholds.items():
            passed = passed | ((s["kind"] == kind) & (z >= least))
        return passed

    return F.filter(candidates(text), chosen) if model.thresholds else F.array().cast(SPAN)


FOUND = "struct<start:int,place:int,end:int,kind:string,value:string>"


def ordered(found: Column) -> Column:
    """Spans by start and then by the kind's place in KINDS."""
    place = lambda s: F.coalesce(*[F.when(s["kind"] == k, i) for i, k in enumerate(KINDS)])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.array_sort(keyed)


def uncovered(found: Column) -> Column:
    """Of ordered spans, those of base kinds and those that no base span covers (base spans come first at the same start)."""

    def step(end, s):
        base = s["place"] < len(BASE)
        return F.when(base, F.greatest(end, s["end"])).otherwise(end), F.when(base | (s["end"] > end), s).otherwise(F.lit(None).cast(FOUND))

    return F.filter(scan(found, F.lit(0), FOUND, step), lambda s: s.isNotNull())


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, text, base (array of spans) and spans (base ones and the method's) of every whole text, in order.

    A null text counts as empty and has no spans. Repeated rows give repeated rows; other columns are left out.
    """
    out = whole_texts(docs).withColumn("base", ordered(base_spans(F.col("text")))).withColumn("more", ordered(selected(F.col("text"), model)))
    return out.select("doc_id", "text", "base", F.when(F.size("more") > 0, uncovered(F.array_sort(F.concat("base", "more")))).otherwise(F.col("base")).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as one string."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: PiiModel, chunk: int = 8192) -> DataFrame:
    """docs with each stretch of overlapping spans in ``text`` replaced by its first span's kind in brackets.

    All columns and rows stay; null texts stay null; texts without spans stay as they are. Texts are cut from chunks of
    ``chunk`` code points, so that very long ones aren't read from their begin for each span.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def stretch(end, s):
        apart = s["start"] >= end
        return F.greatest(end, s["end"]), F.when(apart, F.struct(end.alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))).otherwise(F.lit(None).cast("struct<from:int,start:int,kind:string>"))

    def cut(chunks, start, end):
        """The text from start to end, from its chunks."""
        i, j = F.floor(start / chunk).cast("int"), F.floor(end / chunk).cast("int")
        at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        inner = F.array_join(F.slice(chunks, i + 2, F.greatest(F.lit(0), j - i - 1)), "")
        one = F.substring(at(i), start % chunk + 1, end - start)
        return F.when(i == j, one).otherwise(F.concat(F.substring(at(i), start % chunk + 1, F.lit(chunk)), inner, F.substring(at(j), F.lit(1), end % chunk)))

    def cleaned(x):
        stretches = F.filter(scan(x["spans"], F.lit(0), "struct<from:int,start:int,kind:string>", stretch), lambda s: s.isNotNull())
        chunks = F.transform(F.sequence(F.lit(0), F.length(x["text"]), F.lit(chunk)), lambda k: F.substring(x["text"], k + 1, F.lit(chunk)))
        tail = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return bound(chunks, lambda c: F.concat(F.array_join(F.transform(stretches, lambda s: F.concat(cut(c, s["from"], s["start"]), F.lit("["), s["kind"], F.lit("]"))), ""), cut(c, tail, F.length(x["text"]))))

    found = ordered(F.concat(base_spans(text), selected(text, model)))
    clean = bound(F.struct(text.alias("text"), found.alias("spans")), lambda x: F.when(F.size(x["spans"]) > 0, cleaned(x)).otherwise(x["text"]))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))
