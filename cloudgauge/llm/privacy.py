"""Personal data in answers: generators that propose much, boosted trees that choose.

Everything that touches a text is a column expression. Strict rules with checks (octets,
Luhn, digit counts) give the base spans, which always stay. Looser generators propose
overlapping candidates; each is described by a few small whole numbers of its format and
context. Equal descriptions are one cell, so all candidates of all answers fold into a
bounded table of counts. The trees are fitted to those counts and are applied as one
generated expression. A candidate is known to be personal if it meets a base span or is an
account number whose check digits hold. No feature tells what makes a rule strict (the
plus, the at sign, check digits), so what only misses that is like the known ones; it is
chosen where nearly all of its like are known.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudgauge.llm.common import CELL_ID, RESPONSE, text_or_empty, written
from cloudgauge.llm.divergence import bound_once

# Possessive loops and the looks behind keep the matches of the plain patterns, without
# recursion and without a second try inside a run that has failed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
GENERATORS = {
    "contact": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{2,64}+ ?(?:@|[\(\[]at[\)\]]| at ) ?[\p{L}0-9-]{2,64}+ ?(?:\.|[\(\[]dot[\)\]]| dot ) ?\p{L}{2,24}+",
    "number": r"(?<![0-9])(?:\+|\()?[0-9][0-9().\x20/-]{5,40}[0-9]",
    "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
}
KINDS = (*BASE, *GENERATORS)
# what tells an address from a sentence, written out or not
MARK = r"@|[\(\[](?:at|dot)[\)\]]| dot "
DOT = r" ?[\(\[]dot[\)\]] ?| dot "
# words before a candidate that announce personal data
CUES = r"(?i)(phone|tel\b|tel[.:é]|call|fax|mobil|mail|card|karte|carte|tarjeta|iban|account|konto|compte|cuenta|\bssn\b|\bip\b)"
FEATURES = {"generator": 2, "digits": 20, "separators": 3, "dots": 3, "marked": 1, "letters": 2, "cue": 1, "before": 2, "after": 2}
CELLS = int(np.prod([most + 1 for most in FEATURES.values()]))  # no more cells than this, whatever the input

SPAN = "struct<start:int,end:int,value:string>"


def find_all(text: Column, pattern: str) -> Column:
    """All matches from left to right as (start, end, value); code points, end exclusive.

    Splitting by the pattern and extracting it see the same matches, so the lengths of
    what lies between them give the places.
    """
    none = F.array().cast(f"array<{SPAN}>")
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("between")
    )

    def place(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("spans"))

        def step(acc: Column, value: Column) -> Column:
            start = acc["at"] + F.length(F.get(x["between"], acc["i"]))
            end = start + F.length(value)
            one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"))
            return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["spans"], F.array(one)).alias("spans"))

        return F.when(F.size(x["match"]) == 0, none).otherwise(F.aggregate(x["match"], zero, step, lambda acc: acc["spans"]))

    return bound_once(parts, place)


def guarded(has: Column, spans: Column) -> Column:
    return F.when(has, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def octets_hold(value: Column) -> Column:
    def holds(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return F.when(F.length(short) > 3, F.lit(False)).otherwise(F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), holds)


def card_holds(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def account_holds(value: Column) -> Column:
    """Check digits of an account number: remainder 1 by 97, letters being 10 to 35."""
    bare = F.translate(value, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.left(bare, F.lit(4)))

    def step(acc: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 65, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def phone_holds(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> Column:
    """The strict spans, by kind as listed and then by start."""
    digit = text.rlike("[0-9]")
    by_kind = [
        guarded(F.contains(text, F.lit("@")), find_all(text, EMAIL)),
        F.filter(guarded(digit, find_all(text, IP)), lambda s: octets_hold(s["value"])),
        F.filter(guarded(digit, find_all(text, CARD)), lambda s: card_holds(s["value"])),
        F.filter(guarded(F.contains(text, F.lit("+")), find_all(text, PHONE)), lambda s: phone_holds(s["value"])),
    ]

    def of_kind(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(k).alias("kind_no"), s["start"].alias("start"), s["end"].alias("end")))

    return F.flatten(F.array(*[of_kind(k, spans) for k, spans in enumerate(by_kind)]))


def counted(value: Column, outside: str, most: int) -> Column:
    return F.least(F.length(F.regexp_replace(value, outside, "")), F.lit(most))


def side(char: Column) -> Column:
    """0 white space, punctuation or nothing; 1 a letter; 2 a digit."""
    return F.when(char.rlike(r"[0-9]"), 2).when(char.rlike(r"\p{L}"), 1).otherwise(0)


def candidate_spans(text: Column, base: Column) -> Column:
    """Proposals of all generators, described: (kind_no, start, end, features..., met, checked)."""
    generated = [
        guarded(text.rlike("@|[(\\[ ]at[)\\] ]"), find_all(text, GENERATORS["contact"])),
        guarded(text.rlike("[0-9]"), find_all(text, GENERATORS["number"])),
        guarded(text.rlike("[A-Z][0-9]"), find_all(text, GENERATORS["account"])),
    ]

    def described(g: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: one(g, s))

    def one(g: int, s: Column) -> Column:
        start, end, value = s["start"], s["end"], s["value"]
        before = F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))
        return F.struct(
            F.lit(len(BASE) + g).alias("kind_no"),
            start.alias("start"),
            end.alias("end"),
            F.lit(g).alias("generator"),
            counted(value, "[^0-9]", 20).alias("digits"),
            # those of written-out marks are no format of their own
            (counted(value, r"[^ ()/-]", 3) if KINDS[len(BASE) + g] != "contact" else F.lit(0)).alias("separators"),
            counted(F.regexp_replace(value, DOT, "."), r"[^.]", 3).alias("dots"),
            value.rlike(MARK).cast("int").alias("marked"),
            F.least(F.ceil(F.length(F.regexp_replace(value, r"\P{L}", "")) / 8).cast("int"), F.lit(2)).alias("letters"),
            before.rlike(CUES).cast("int").alias("cue"),
            F.when(start == 0, 0).otherwise(side(F.right(before, F.lit(1)))).alias("before"),
            side(F.substring(text, end + 1, F.lit(1))).alias("after"),
            F.exists(base, lambda b: (b["start"] < end) & (b["end"] > start)).alias("met"),
            (account_holds(value) if KINDS[len(BASE) + g] == "account" else F.lit(False)).alias("checked"),
        )

    return F.flatten(F.array(*[described(g, spans) for g, spans in enumerate(generated)]))


def with_candidates(receipts: DataFrame, response_content: str = RESPONSE) -> DataFrame:
    """The rows with `base_spans` and `candidates` added."""
    text = text_or_empty(response_content)
    based = receipts.withColumn("base_spans", base_spans(text))
    return based.withColumn("candidates", candidate_spans(text, F.col("base_spans")))


@dataclass
class BoostedTrees:
    """Trees of depth two over cell features, and a score threshold per generator."""

    bias: float = -20.0
    trees: list[tuple] = field(default_factory=list)  # (feature, cut, (leaf or feature, cut, low, high) x 2)
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(GENERATORS))

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, cut, *sides in self.trees:
            low = x[:, f] <= cut
            for mask, (g, inner, a, b) in ((low, sides[0]), (~low, sides[1])):
                out += np.where(mask, np.where(x[:, g] <= inner, a, b), 0.0)
        return out

    def score(self, x: Column) -> Column:
        """The same as an expression over a candidate."""
        names = list(FEATURES)
        total = F.lit(self.bias)
        for f, cut, low, high in self.trees:
            leaf = [F.when(x[names[g]] <= inner, F.lit(a)).otherwise(F.lit(b)) for g, inner, a, b in (low, high)]
            total = total + F.when(x[names[f]] <= cut, leaf[0]).otherwise(leaf[1])
        return 1 / (1 + F.exp(-total))

    def chosen(self, x: Column) -> Column:
        """Whether the score reaches the threshold of the candidate's generator."""
        limits = F.array(*[F.lit(float(t)) for t in self.thresholds])
        return bound_once(self.score(x), lambda p: p >= F.get(limits, x["generator"]))


def fold_cells(described: DataFrame, cell_id: str = CELL_ID) -> DataFrame:
    """Counts of candidates by features and fold: at most 5 * CELLS rows, from all rows.

    A fifth of the answers (by hash of the id) is the fold that thresholds are set on.
    """
    fold = F.pmod(F.xxhash64(F.col(cell_id).cast("string")), F.lit(5)).cast("int")
    each = described.select(fold.alias("fold"), F.explode("candidates").alias("c")).select("fold", "c.*")
    return each.groupBy("fold", *FEATURES).agg(F.count("*").alias("n"), F.sum((F.col("met") | F.col("checked")).cast("long")).alias("positive"))


def calibration(cells: DataFrame, model: BoostedTrees, bins: int = 10) -> DataFrame:
    """Per generator and score bin of the held-out fold: (generator, bin, n, known, mean
    score, chosen), to read how far scores are shares of known personal data."""
    names = F.array(*[F.lit(k) for k in GENERATORS])
    x = F.struct(*FEATURES)
    scored = cells.filter("fold = 0").select("generator", "n", "positive", model.score(x).alias("score"), model.chosen(x).alias("is_chosen"))
    bin_no = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return scored.groupBy(F.get(names, F.col("generator")).alias("generator"), bin_no).agg(
        F.sum("n").alias("n"),
        F.sum("positive").alias("known"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_score"),
        F.sum(F.when(F.col("is_chosen"), F.col("n")).otherwise(0)).alias("chosen"),
    )


def best_cut(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, mask: np.ndarray, ridge: float) -> tuple[int, int, float, float, float]:
    """(feature, cut, low leaf, high leaf, gain) of the best split of the masked cells."""
    g_all, h_all = grad[mask].sum(), hess[mask].sum()
    whole = float(g_all / (h_all + ridge))
    best = (0, int(max(FEATURES.values())), whole, whole, 0.0)
    for f, most in enumerate(FEATURES.values()):
        g = np.bincount(x[mask, f], grad[mask], most + 1).cumsum()[:-1]
        h = np.bincount(x[mask, f], hess[mask], most + 1).cumsum()[:-1]
        gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
        if len(gain) and gain.max() > best[4] + 1e-9:
            c = int(gain.argmax())
            best = (f, c, float(g[c] / (h[c] + ridge)), float((g_all - g[c]) / (h_all - h[c] + ridge)), float(gain[c]))
    return best


def fit_trees(
    cells: DataFrame, rounds: int = 40, rate: float = 0.3, ridge: float = 1.0, min_precision: float = 0.9
) -> BoostedTrees:
    """Gradient boosting on the folded counts (a bounded table, whatever the corpus).

    Each generator's threshold is the lowest score at which at least `min_precision` of
    the held-out candidates at or above it are known to be personal; without such a score
    the generator chooses nothing.
    """
    table = np.array([[r[c] for c in ("fold", *FEATURES, "n", "positive")] for r in cells.collect()], np.int64)
    if not len(table) or not table[:, -1].sum():
        return BoostedTrees()
    fold, x, n, positive = table[:, 0], table[:, 1:-2], table[:, -2].astype(float), table[:, -1].astype(float)
    held = fold == 0
    weight = np.where(held & (n[~held].sum() > 0), 0.0, n)
    hits = np.where(weight > 0, positive, 0.0)
    rate_all = np.clip(hits.sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model = BoostedTrees(bias=float(np.log(rate_all / (1 - rate_all))))
    logit = np.full(len(x), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = hits - weight * p, weight * p * (1 - p)
        f, cut, _, _, gain = best_cut(x, grad, hess, np.ones(len(x), bool), ridge)
        if gain <= 1e-6:
            break
        low = x[:, f] <= cut
        inner = [best_cut(x, grad, hess, side_, ridge)[:4] for side_ in (low, ~low)]
        tree = (f, cut, *[(g, c, a * rate, b * rate) for g, c, a, b in inner])
        model.trees.append(tree)
        logit = model.logits(x)
    p = 1 / (1 + np.exp(-logit))
    for g in range(len(GENERATORS)):
        own = (x[:, 0] == g) & (held if (held & (x[:, 0] == g)).any() else True)
        order = np.argsort(-p[own], kind="stable")
        score, precision = p[own][order], (positive[own][order].cumsum() / n[own][order].cumsum())
        last = np.append(score[1:] != score[:-1], True) if len(score) else np.zeros(0, bool)
        good = score[last & (precision >= min_precision)]
        model.thresholds[g] = float(good.min()) - 1e-9 if len(good) else 2.0
    return model


def choose_spans(described: DataFrame, model: BoostedTrees) -> DataFrame:
    """Adds `pii_spans`: base spans and chosen candidates clear of them, by kind, start and
    end; structs (kind_no, start, end, kind). Drops the working columns."""
    names = F.array(*[F.lit(k) for k in KINDS])
    extra = F.filter("candidates", lambda c: ~c["met"] & model.chosen(c))
    slim = F.transform(extra, lambda c: F.struct(c["kind_no"].alias("kind_no"), c["start"].alias("start"), c["end"].alias("end")))
    spans = F.sort_array(F.concat("base_spans", slim))
    named = F.transform(spans, lambda s: F.struct(s["kind_no"], s["start"], s["end"], F.get(names, s["kind_no"]).alias("kind")))
    return described.withColumn("pii_spans", named).drop("base_spans", "candidates")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are
    replaced once, by the kind of the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    rest = F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def pii_spans(
    receipts: DataFrame, keep: list[str] | None = None, cell_id: str = CELL_ID, response_content: str = RESPONSE
) -> DataFrame:
    """The answers with `pii_spans`: strict spans of email, ip, card and phone, and the
    candidates (contact, number, account) that the boosted trees choose.

    `keep` lists the columns to return besides, by default only `cell_id`; a column that
    is called pii_spans, base_spans or candidates is replaced. The described rows are
    written once: the trees are fitted to the counts of all of them, then they are chosen
    from. Null answers are empty; repeated rows count and are reported each; without any
    strict span in the table no candidate is chosen.
    """
    keep = [c for c in (keep or [cell_id]) if c not in ("pii_spans", "base_spans", "candidates")]
    described = with_candidates(receipts.select(*dict.fromkeys([*keep, cell_id, response_content])), response_content)
    rows = written(described.select(*keep, *([] if cell_id in keep else [cell_id]), "base_spans", "candidates"), "pii-candidates")
    model = fit_trees(fold_cells(rows, cell_id))
    return choose_spans(rows, model).select(*keep, "pii_spans")
