"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame functions only.

Four base kinds (email, ip, card, phone) are found by pattern and checked by format; these spans always stay.
High-recall generators propose further spans, which may overlap others: local phone numbers, identity numbers,
bank accounts and access keys. Boosted trees score each proposal from its format (entropy and check sum among it) and
its context, and a threshold per kind, calibrated on held-out labelled proposals, selects what is added.

Trees are fitted on all proposals of the documents that have a weak label, from cue words, assignments, entropy and
check sums, and on ``PRIOR_ROWS`` generated ones for kinds that a corpus lacks. Spark counts the proposals by their
features, and weights balance kinds and labels. Half of the matches only calibrate. The trees become plain column expressions, so documents never leave
the JVM and every text is handled inside its own row.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import let, table

#: Patterns of the base kinds, in the order of their rank. A possessive run equals a greedy one where nothing that
#: follows could use what it gives back; the look-behinds (or the end of the last match) only skip starts inside a
#: run, from which a match fails whenever it fails from the start of the run. So long runs cost linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of the proposed kinds.
PROPOSED = {
    "local_phone": r"(?<![0-9+.)-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
}
KINDS = [*BASE, *PROPOSED]
CONTEXT, GROUP = 32, 512
#: Generated proposals, and the most of them that all real ones of a kind and label weigh as much as.
PRIOR_ROWS, WEIGHT = 2000, 500
TREES, RATE, PRECISION, BINS = 24, 0.4, 0.98, 12
#: Words before a proposal that speak for it, and the signs of an assignment.
CUES = r"(?i)(?:tel|phone|call|fax|mobile|ssn|social|identity|iban|account|konto|compte|cuenta|key|token|secret|password)\W{0,4}\w*\W{0,4}$"
ASSIGNED = r"[=:]>?\s*[\"'`]?$"
QUOTE = r"^[\"'`]"
DIALLED = r"\+[0-9]{1,3}[\x20.-]?$"
PREFIX = r"^(?:AKIA|ASIA|sk-|sk_|ghp_|gho_|xox[bp]-|AIza)"
FEATURES = ["kind", "length", "digits", "upper", "lower", "cue", "prefix", "joined", "assigned", "quoted", "entropy", "checked", "brackets", "dashes"]
#: Tenths of a bit a character that a key must have to be labelled as one.
RANDOM = 30


# -- spans --------------------------------------------------------------------------------------------------


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code point offsets (end exclusive) and nearby text.

    Splitting by the pattern gives the gaps between the matches; offsets are running sums of both. The sums are
    built in groups, so that many matches in one text do not copy a long array for each.
    """
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        item = F.struct(
            start.alias("start"), end.alias("end"), x["match"].alias("match"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(CONTEXT)).alias("after"),
        )
        return F.struct(end.alias("at"), F.array_append(acc["out"], item).alias("out"))

    def grouped(gaps: Column, matches: Column) -> Column:
        n = F.size(matches)
        pieces = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), matches.alias("match"), F.slice(gaps, F.lit(2), n).alias("next"))

        def fold(acc: Column, group: Column) -> Column:
            inner = F.aggregate(group, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
            return let(inner, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

        groups = lambda p: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int")), lambda g: F.slice(p, g * GROUP + 1, GROUP))
        start = F.struct(F.lit(0).alias("at"), F.array(empty).alias("out"))
        return F.flatten(F.aggregate(let(pieces, groups), start, fold)["out"])

    split = lambda matches: F.when(F.size(matches) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda gaps: grouped(gaps, matches)))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def add(total: Column, k: Column) -> Column:
        digit = F.substring(number, F.length(number) - k, F.lit(1)).cast("int") * (k % 2 + 1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The format check of a base kind."""
    if kind == "ip":
        return F.forall(
            F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "")),
            lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")),
        )
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


# -- features -----------------------------------------------------------------------------------------------


def _entropy(match: str) -> int:
    n = len(match)
    return math.floor(10 * sum(-match.count(c) / n * math.log2(match.count(c) / n) for c in set(match)) + 1e-9)


def entropy(match: Column) -> Column:
    """Tenths of a bit per character."""
    n = F.length(match).cast("double")
    share = lambda c: (n - F.length(F.replace(match, c, F.lit("")))) / n
    bits = lambda c: let(share(c), lambda p: -p * F.log2(p))
    each = F.array_distinct(F.filter(F.split(match, ""), lambda c: c != ""))
    return F.floor(F.aggregate(each, F.lit(0.0), lambda total, c: total + bits(c)) * 10 + 1e-9).cast("int")


def _account_checks(match: str) -> bool:
    bare = match.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def account_checks(match: Column) -> Column:
    """Whether letters and digits of a bank account pass the check sum modulo 97, its first four read last."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    step = lambda rest, c: let(value(c), lambda v: (rest * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _features(kind: str, before: str, match: str, after: str) -> list[int]:
    count = lambda p: len(re.findall(p, match))
    seen = lambda p, text: int(re.search(p, text) is not None)
    joined = seen(r"[A-Za-z0-9]$", before) or seen(r"^[A-Za-z0-9]", after)
    checked = kind == "account" and _account_checks(match)
    return [
        KINDS.index(kind), len(match), count("[0-9]"), count("[A-Z]"), count("[a-z]"), seen(CUES, before), seen(PREFIX, match),
        joined, seen(ASSIGNED, before), seen(QUOTE, after), _entropy(match), int(checked), count("[(]"), count("-"),
    ]


def features(kind: str, x: Column) -> Column:
    """The same features as columns."""
    count = lambda p: F.length(F.regexp_replace(x["match"], p, ""))
    flag = lambda c: c.cast("int")
    checked = flag(account_checks(x["match"])) if kind == "account" else F.lit(0)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.length(x["match"]).alias("length"), count("[^0-9]").alias("digits"),
        count("[^A-Z]").alias("upper"), count("[^a-z]").alias("lower"), flag(x["before"].rlike(CUES)).alias("cue"),
        flag(x["match"].rlike(PREFIX)).alias("prefix"), flag(x["before"].rlike("[A-Za-z0-9]$") | x["after"].rlike("^[A-Za-z0-9]")).alias("joined"),
        flag(x["before"].rlike(ASSIGNED)).alias("assigned"), flag(x["after"].rlike(QUOTE)).alias("quoted"), entropy(x["match"]).alias("entropy"), checked.alias("checked"),
        count("[^(]").alias("brackets"), count("[^-]").alias("dashes"),
    )


# -- labelled proposals -------------------------------------------------------------------------------------


def weak_label(kind: str, x: Column) -> Column:
    """1 or 0 where the surroundings or the check sum of a proposal tell what it is, else null."""
    cue, assigned = x["before"].rlike(CUES), x["before"].rlike(ASSIGNED)
    if kind == "key":
        return F.when(cue & assigned & (entropy(x["match"]) >= RANDOM), 1).when(~cue & ~assigned & ~x["match"].rlike(PREFIX), 0)
    if kind == "account":
        return account_checks(x["match"]).cast("int")
    return F.when(cue | x["before"].rlike(DIALLED), 1)


def observed(docs: DataFrame) -> np.ndarray:
    """A row for each combination of features, label and ``held`` among the labelled proposals of all documents, and their number.

    Proposals of the same match in the same surroundings count once, so copies of a text add nothing. ``held`` tells the
    half of the matches that only calibrate. Rows are as many as there are different combinations, and sorted.
    """
    text = F.col("text")
    each = lambda k: F.transform(located(text, PROPOSED[k]), lambda x: F.struct(F.lit(k).alias("kind"), x["before"], x["match"], x["after"], weak_label(k, x).alias("label")))
    rows = docs.select("text").filter(text.rlike("[0-9]")).select(F.explode(F.concat(*[each(k) for k in PROPOSED])).alias("p"))
    rows = rows.select("p.*").filter("label is not null").distinct()
    x = {c: F.col(c) for c in ("before", "match", "after")}
    of = F.coalesce(*[F.when(F.col("kind") == k, features(k, x)) for k in PROPOSED])
    rows = rows.select(of.alias("f"), "label", (F.xxhash64("match") % 2 == 0).cast("int").alias("held")).groupBy("f", "label", "held").agg(F.count("*").alias("n"))
    names = [*FEATURES, "label", "held", "n"]
    got = rows.select("f.*", "label", "held", "n").toArrow()
    cells = np.stack([got[c].to_numpy().astype(np.int64) for c in names], axis=1)
    return cells[np.lexsort(cells.T[::-1])]


def generated(rows: int = PRIOR_ROWS) -> list[tuple]:
    """Labelled proposals from a fixed seed; every second one is held out."""
    r = random.Random(17)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    upper, lower, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    cues = {"local_phone": ["call ", "tel: ", "phone ", "fax: "], "identity": ["ssn ", "social security: ", "identity no. "], "account": ["iban ", "account: ", "konto "], "key": ["key=", "token: ", "secret = '", 'password "', 'api_key: "', 'TOKEN="']}
    plain = ["see ", "in part ", "of the ", "version ", "item ", "table ", "und der ", "la serie ", "", "id=", "commit: ", 'href="', "sha1 "]
    out = []
    for k in range(rows):
        kind, label = r.choice([*PROPOSED]), r.random() < 0.5
        spoken = r.random() < (0.75 if label else 0.01 if kind == "identity" else 0.05)
        if kind == "local_phone":
            match = r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(digit(3), digit(3), digit(4)) if label else r.choice(["{} {} {}", "{}.{}.{}"]).format(digit(3), digit(3), digit(4))
        elif kind == "identity":
            match = f"{digit(3)}-{digit(2)}-{digit(4)}"
        elif kind == "account":
            land, body = pick(upper, 2), digit(r.choice([12, 14, 16, 18]))
            check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97
            match = f"{land}{check:02}{body}" if label else f"{land}{(check + r.randint(1, 96)) % 97:02}{body}"
        elif label:
            bare = r.choice([pick(hexa, 32), pick(hexa, 40), pick(hexa, 64), pick(upper + lower + "0123456789", 24), pick(upper + lower + "0123456789", 40)])
            known = r.choice([f"AKIA{pick(upper + '234567', 16)}", f"sk-{pick(upper + lower + '0123456789', 32)}", f"ghp_{pick(upper + lower + '0123456789', 36)}"])
            match = bare if spoken else known
        else:
            match = r.choice([pick(hexa, 40), pick(lower, 14) + digit(4), f"{pick(lower, 8)}-{pick(lower, 8)}-{digit(2)}", digit(18), f"{digit(4)}-{digit(2)}-{digit(2)}-{pick(lower, 8)}"])
            spoken = spoken and not re.fullmatch("[0-9a-f]{40}", match)
        before, after = r.choice(cues[kind] if spoken else plain), r.choice([" ", ".", ", ", ""])
        out.append((kind, before, match, before[-1:] if before[-1:] in ("'", '"') else after, int(label), k % 2 == 1))
    return out


# -- trees --------------------------------------------------------------------------------------------------


class Model:
    """Depth-2 boosted trees [(feature, cut, (feature, cut, low, high), (...))] and the threshold of each kind.

    Rows that are not held out fit the trees; the others give, per kind, the lowest score from which on at least
    PRECISION of them are personal data, at even odds or better (infinite if there is none).
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, weight: np.ndarray):
        fitted = np.flatnonzero(~held)
        self.cuts = []
        for f in range(len(FEATURES)):
            order = fitted[np.argsort(x[fitted, f], kind="stable")]
            values, reached = x[order, f], np.cumsum(weight[order])
            at = [min(int(np.searchsorted(reached, reached[-1] * k / BINS, "right")), len(order) - 1) for k in range(BINS)] if len(order) else []
            self.cuts.append(sorted({int(values[k]) for k in at} - {int(values[-1])}) if len(order) else [])
        #: How many cuts of each feature a row lies beyond.
        bins = np.stack([np.searchsorted(self.cuts[f], x[:, f]) for f in range(len(FEATURES))], axis=1)
        score = np.zeros(len(x))
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            f, k = self._best(fitted, bins, g, h)
            sides = []
            for low in (True, False):
                own = fitted[(bins[fitted, f] <= k) == low]
                f2, k2 = self._best(own, bins, g, h)
                parts = [own[(bins[own, f2] <= k2) == below] for below in (True, False)]
                values = [round(RATE * float(g[of].sum()) / (float(h[of].sum()) + 1.0), 6) for of in parts]
                for of, v in zip(parts, values, strict=True):
                    score[of] += v
                sides.append((f2, self._cut(f2, k2), *values))
            self.trees.append((f, self._cut(f, k), *sides))
        self.thresholds, self.recall = {}, {}
        for kind in PROPOSED:
            own = np.flatnonzero(held & (x[:, 0] == KINDS.index(kind)))
            total = np.round(self.totals(x[own]), 9)
            own, total = own[np.argsort(-total, kind="stable")], np.sort(total)[::-1]
            good, every = np.cumsum(weight[own] * y[own]), np.cumsum(weight[own])
            least, caught = math.inf, 0.0
            for k, s in enumerate(total.tolist()):
                if good[k] >= PRECISION * every[k] - 1e-9 and (k + 1 == len(own) or total[k + 1] < s):
                    least, caught = max(0.0, s - 1e-6), float(good[k]) if s >= 0 else caught
            self.thresholds[kind], self.recall[kind] = least, caught / max(float(good[-1]) if len(own) else 0.0, 1.0)

    def _cut(self, f: int, k: int) -> int:
        return self.cuts[f][k] if k < len(self.cuts[f]) else 1 << 30

    def _best(self, of: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        """The feature and the number of its cut that part the rows best, from sums of each bin."""
        top = (-1.0, 0, 0)
        for f, cuts in enumerate(self.cuts):
            gs, hs = (np.bincount(bins[of, f], v[of], len(cuts) + 1).tolist() for v in (g, h))
            a = b = 0.0
            for k in range(len(cuts)):
                a, b = a + gs[k], b + hs[k]
                c, d = sum(gs) - a, sum(hs) - b
                top = max(top, (a * a / (b + 1) + c * c / (d + 1), -f, -k))
        return -top[1], -top[2]

    def totals(self, x: np.ndarray) -> np.ndarray:
        """The scores of rows of features."""
        out = np.zeros(len(x))
        for f, cut, *sides in self.trees:
            low, high = (np.where(x[:, f2] <= cut2, a, b) for f2, cut2, a, b in sides)
            out += np.where(x[:, f] <= cut, low, high)
        return out

    def total(self, v: list[int]) -> float:
        return float(self.totals(np.array([v]))[0])

    def score(self, v: Column) -> Column:
        """The trees as one expression over a struct of features."""
        value = lambda f2, cut2, a, b: F.when(v[FEATURES[f2]] <= cut2, a).otherwise(b)
        parts = [F.when(v[FEATURES[f]] <= cut, value(*low)).otherwise(value(*high)) for f, cut, low, high in self.trees]
        return functools.reduce(lambda a, b: a + b, parts)


def fit(docs: DataFrame | None = None) -> Model:
    """A model from the generated proposals and, if there are documents, all labelled ones of theirs.

    A real proposal weighs as much as a generated one, or less where all of its kind and label would exceed WEIGHT.
    """
    prior = generated()
    cells = np.array([[*_features(*r[:4]), r[4], r[5], 1] for r in prior], np.int64)
    weight = np.ones(len(cells))
    if docs is not None:
        real = observed(docs)
        groups, of = np.unique(real[:, [0, len(FEATURES)]], axis=0, return_inverse=True)
        share = np.minimum(1.0, WEIGHT / np.maximum(np.bincount(of.ravel(), real[:, -1], len(groups)), 1))
        cells, weight = np.concatenate([cells, real]), np.concatenate([weight, real[:, -1] * share[of.ravel()]])
    n = len(FEATURES)
    return Model(cells[:, :n], cells[:, n], cells[:, n + 1] == 1, weight)


# -- operator -----------------------------------------------------------------------------------------------


def detected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` with ``pii``: an array of (start, rank, end, kind, match, score), by start and rank.

    Without a ``model`` one is fitted on all of ``docs``; without proposals there, on generated ones alone. Base spans have score null. A proposal that lies inside a base span is left out; other overlaps stay. A null or
    empty text has no spans. Texts without digits and without "@" cannot match and are not searched. Rows are handled
    one by one, so repeats and ties need no rule; a column named ``pii`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    model = model or fit(docs)
    kind_of = "array<struct<start:int,rank:int,end:int,kind:string,match:string,score:double>>"

    def base(kind: str) -> Column:
        kept = F.filter(located(text, BASE[kind]), lambda x: valid(kind, x["match"]))
        return F.transform(
            kept,
            lambda x: F.struct(x["start"], F.lit(KINDS.index(kind)).alias("rank"), x["end"], F.lit(kind).alias("kind"), x["match"], F.lit(None).cast("double").alias("score")),
        )

    def proposed(kind: str) -> Column:
        scored = F.transform(
            located(text, PROPOSED[kind]),
            lambda x: F.struct(
                x["start"], F.lit(KINDS.index(kind)).alias("rank"), x["end"], F.lit(kind).alias("kind"), x["match"], let(features(kind, x), model.score).alias("score")
            ),
        )
        return F.filter(scored, lambda s: s["score"] >= F.lit(model.thresholds[kind]))

    found = F.concat(*[base(k).cast(kind_of) for k in BASE])
    more = F.concat(*[proposed(k).cast(kind_of) for k in PROPOSED])
    outside = lambda b: F.filter(more, lambda s: ~F.exists(b, lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"])))
    spans = F.array_sort(let(found, lambda b: F.concat(b, outside(b))))
    nothing = F.array().cast(kind_of)
    return docs.drop("pii").withColumn("pii", F.when(text.rlike("[0-9@]"), spans).otherwise(nothing))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = lambda p: F.filter(p, lambda s: s["rank"] < len(BASE))
    number = lambda p, k: F.size(F.filter(p, lambda s: s["kind"] == k)).cast("long")
    digest = let(
        F.col("pii"),
        lambda p: F.struct(*[number(p, k).alias(f"n_{k}") for k in BASE], F.sha2(written(base(p)), 256).alias("base_sha256"), written(p).alias("spans")),
    )
    return found.select("doc_id", digest.alias("d")).select("doc_id", "d.*")
