"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose candidate spans. Four labelers vote on each (+1, -1 or 0 to abstain): the
strict form of its kind, a gazetteer (top-level domains, calling codes, issuer prefixes,
given names, reserved networks), cue words in the context before it, and the characters
around it. Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability for the two hidden classes; an abstention is no evidence for either.
The posteriors it ends with train the final classifier, a logistic model over kind, votes
and traits of the span itself (its surroundings and shape), which decides on the spans. Its
weights are held to those of a plain majority and its intercepts bounded, so that a kind
whose candidates were wrong so far is still found where the evidence is for it. Spans of
the four base kinds that pass their check are always kept.

Everything that touches texts is a Spark expression. Only the table of patterns of votes
and traits, at most kinds x 3^4 x 2^5 rows whatever the corpus, reaches the driver. The
candidates (narrow rows) are written to the shared folder, so the texts are scanned once.

A match's place comes from splitting the text by the pattern: the lengths of the pieces
and matches before it add up to its start, in code points. Patterns carry \\G and
possessive quantifiers so that they find exactly the leftmost non-overlapping matches of
the plain forms without walking back over long runs.

Defined results: a null text is the empty text, which has no spans; an empty table gives
no rows; repeated or null ids are separate rows; other columns are not read by ``detect``
and pass through ``masked`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import materialise, whole_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "local_phone", "ssn", "iban", "person")
LABELERS = ("form", "gazetteer", "context", "border")
#: Code points of context that the cue words are looked up in.
CONTEXT = 40

# Fixed patterns: the base kinds' plain forms, made linear.
_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "address": r"(?i)\b[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[a-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]) ?[a-z0-9-]{1,63}+){1,4}+",
    "local_phone": r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?+",
}
# A cheap test without which a text cannot match; for an address in lower case, as its pattern takes either.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-", "address": "at"}
# Fixed word lists of the gazetteer and context labelers. Any two letters may be a country's domain.
_DOMAINS = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|travel|jobs|museum|aero|coop|app|dev|page|cloud|online|site|store|shop|tech|blog|xyz|club|live|news|email|agency|digital|studio|design|world|group|company|solutions|services|academy|example|test|invalid|local"
_CALLING = "1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[05][0-9]|88[0-9]|9[0-58]|9[679][0-9]"
_ISSUERS = "4|5[0-8]|2[2-7]|3[47]|3[0689]|6011|6[2-9]|35|1[2-9]"
_NAMES = (
    "Aaron|Adam|Adrian|Alan|Albert|Alejandro|Alexander|Alice|Amanda|Amy|Ana|Andrea|Andreas|Andrew|Angela|Anna|Anne|Anthony|Antonio|Barbara|Benjamin|Bernd|Brian|Camille|Carlos|Carmen|Caroline|Charles|Charlotte|Christian|Christine|Christopher|Claire|Claude|Claudia|Daniel|David|Diego|Donald|Dorothy"
    "|Edward|Elena|Elizabeth|Emily|Emma|Eric|Eva|Fernando|Francisco|Frank|Franz|Gabriel|George|Hans|Heinz|Helen|Helga|Henri|Henry|Isabel|Jack|Jacques|James|Jan|Javier|Jean|Jennifer|Jessica|Joan|Johann|John|Jorge|Joseph|Juan|Julia|Julie|Karen|Karl|Katharina|Kevin|Klaus|Laura|Lena|Linda|Lisa|Louis|Lucas|Luis"
    "|Manuel|Marc|Marco|Margaret|Maria|Marie|Mark|Martin|Mary|Matthew|Maximilian|Michael|Michel|Miguel|Monika|Nancy|Nathalie|Nicholas|Nicolas|Olivier|Pablo|Patricia|Patrick|Paul|Pedro|Peter|Philippe|Pierre|Rafael|Richard|Robert|Rosa|Sandra|Sarah|Sebastian|Sofia|Sophie|Stefan|Steven|Susan|Sylvie|Thomas|Ursula|Uwe|Victor|William|Wolfgang"
)
_CUES = {
    "email": r"e-?mail|contact|write to|mailto|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|from",
    "card": r"card|visa|master|credit|karte|carte|tarjeta|paid",
    "phone": r"tel|phone|call|mobile|fax|handy|tél|llame",
    "address": r"e-?mail|contact|write to|reach|correo|courriel",
    "local_phone": r"tel|phone|call|mobile|fax|handy|tél|llame",
    "ssn": r"ssn|social|security",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "person": r"name|dear|sincerely|regards|signed|patient|client",
}
_ANTI_CUES = r"version|isbn|issn|doi|order no|invoice|serial|build|release|figure|table|section|commit"

#: What a span is told by besides the votes, each 0 or 1.
TRAITS = ("after a mark", "before a word's end", "one digit over and over", "long", "capital first")

_SPAN = "array<struct<kind: string, start: bigint, end: bigint, votes: array<int>, traits: array<int>>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _small_parts(value: Column) -> Column:
    """All dotted parts at most 255, whatever zeros lead them."""
    plain = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda x: (F.length(plain(x)) <= 3) & (F.substr(plain(x), F.lit(1), F.lit(3)).cast("int") <= 255))


def _check_digits(account: Column) -> Column:
    """Whether an account number of 15 to 34 characters, its first four moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    turned = F.concat(F.substr(account, F.lit(5), F.lit(30)), F.left(account, F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.length(account).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), add) == 1)


def _valid(kind: str, value: Column) -> Column:
    """The check that a base kind's match must pass, and the strict form of any other kind."""
    n = F.length(_digits(value))
    if kind == "ip":
        return _small_parts(value)
    if kind == "card":
        return n.between(13, 19) & _luhn(value)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")
    if kind == "iban":
        return _check_digits(F.replace(value, F.lit(" "), F.lit("")))
    if kind == "local_phone":
        return value.rlike(r"^\(?[2-9]")
    return F.lit(True)


def _gazetteer(kind: str, value: Column) -> Column:
    known = {
        "email": value.rlike(rf"(?i)\.(?:{_DOMAINS})$"),
        "ip": ~value.rlike(r"^(?:0|127|255)\."),
        "card": _digits(value).rlike(f"^(?:{_ISSUERS})"),
        "phone": _digits(value).rlike(f"^(?:{_CALLING})"),
        "address": value.rlike(rf"(?i)(?:{_DOMAINS})$"),
        "iban": value.rlike("^(?:DE|FR|ES|IT|NL|BE|AT|CH|GB|PT|IE|LU|PL|SE|NO|DK|FI)"),
        "person": value.rlike(rf" (?:{_NAMES})\b"),
    }
    return F.when(known[kind], 1).otherwise(-1) if kind in known else F.lit(0)


def _candidates(kind: str, text: Column) -> tuple[Column, Column]:
    """Matches and the pieces between them; both null where the text has none."""
    pattern = _PATTERN[kind]
    able = (F.lower(text) if kind == "address" else text).contains(_NEEDS[kind]) if kind in _NEEDS else F.lit(True)
    found = F.when(able, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(F.size(found) > 0, found), F.split(text, pattern, -1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value as its variable, so that the value is computed once however often a lambda in the body reads it."""
    return F.transform(F.array(value), body)[0]


def _span(kind: str, value: Column, gap: Column, after: Column, begin: Column) -> tuple[Column, Column]:
    """A match as a span with votes and traits, and whether it stays a candidate: base kinds that fail their check do not."""
    context, before, behind = F.lower(F.right(gap, F.lit(CONTEXT))), F.right(gap, F.lit(1)), F.left(after, F.lit(1))
    valid = _valid(kind, value)
    border = before.rlike(r"[A-Za-z0-9_]") | behind.rlike("[A-Za-z0-9_]")
    if kind == "local_phone":  # the tail of a longer number is no number of its own
        border = border | F.right(gap, F.lit(8)).rlike(r"[+0-9][0-9 ().-]*$")
    votes = F.array(F.when(valid, 1).otherwise(-1), _gazetteer(kind, value), F.when(context.rlike(_CUES[kind]), 1).when(context.rlike(_ANTI_CUES), -1).otherwise(0), F.when(border, -1).otherwise(1))
    flags = (context.rlike("[:=(<#\"'] ?$"), (behind == "") | behind.rlike(r"[\s.,;:!?)>\"']"), _digits(value).rlike(r"([0-9])\1{5}"), F.length(value) >= 20, value.rlike("^[A-Z]"))
    traits = F.array(*[F.when(x, 1).otherwise(0) for x in flags])
    end = begin + F.length(value)
    one = F.struct(F.lit(kind).alias("kind"), begin.cast("long").alias("start"), end.cast("long").alias("end"), votes.alias("votes"), traits.alias("traits"))
    return one, valid if kind in BASE_KINDS else F.lit(True)


def _placed(kind: str, matches: Column, gaps: Column) -> Column:
    """The matches as spans with votes and traits.

    A fold adds up the lengths before each match. It works on blocks of a square root of the
    matches, each with its own start, as appending to one array would copy it every time.
    """
    n = F.size(matches)
    whole = F.lit(0).cast("long")
    sizes = F.struct(F.ceil(F.sqrt(n.cast("double"))).cast("int").alias("b"), F.transform(matches, lambda m, k: (F.length(gaps[k]) + F.length(m)).cast("long")).alias("sizes"))

    def blocks(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), n - 1, x["b"]), lambda at: F.aggregate(F.slice(x["sizes"], at + 1, x["b"]), whole, lambda s, v: s + v))
        return F.struct(x["b"].alias("b"), sums.alias("sums"))

    def folded(x: Column) -> Column:
        def one_block(_: Column, i: Column) -> Column:
            start = F.struct(F.aggregate(F.slice(x["sums"], F.lit(1), i), whole, lambda s, v: s + v).alias("at"), F.array().cast(_SPAN).alias("spans"))

            def step(acc: Column, k: Column) -> Column:
                begin = acc["at"] + F.length(gaps[k])
                one, keep = _span(kind, matches[k], gaps[k], gaps[k + 1], begin)
                return F.struct((begin + F.length(matches[k])).cast("long").alias("at"), F.when(keep, F.concat(acc["spans"], F.array(one).cast(_SPAN))).otherwise(acc["spans"]).alias("spans"))

            return F.aggregate(F.sequence(i * x["b"], F.least(i * x["b"] + x["b"], n) - 1), start, step, lambda acc: acc["spans"])

        return F.flatten(F.transform(x["sums"], one_block))

    return F.when(matches.isNull(), F.array().cast(_SPAN)).otherwise(_let(_let(sizes, blocks), folded))


def candidates(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with a column of candidate spans (kind, start, end, votes), by kind as listed, then start."""
    names, text = docs.columns, whole_text(f"`{text_col}`")
    found = docs.select(*[F.col(f"`{c}`") for c in names], *[_candidates(k, text)[0].alias(f"_m_{k}") for k in KINDS])
    split = found.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"_m_{k}") for k in KINDS], *[F.when(F.col(f"_m_{k}").isNotNull(), _candidates(k, text)[1]).alias(f"_g_{k}") for k in KINDS])
    return split.select(*[F.col(f"`{c}`") for c in names], F.concat(*[_placed(k, F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in KINDS]).alias(spans_col))


# -- reliabilities and the classifier, over patterns of votes and traits ----------------------

Pattern = tuple[str, tuple[int, ...], tuple[int, ...], float]


def estimate(patterns: list[Pattern], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posteriors by kind and votes, by expectation-maximisation; votes count as independent given the class, abstentions not at all."""
    counts: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind, votes, _, n in patterns:
        counts[kind, votes] = counts.get((kind, votes), 0.0) + n
    # A kind's prior, and of labeler j, class c the probability that a vote it casts is for the span; each counts as ten spans at first.
    prior = {k: 0.7 for k, _ in counts}
    rates = [[0.25, 0.75] for _ in LABELERS]
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, votes in counts:
            no, yes = 1 - prior[kind], prior[kind]
            for (wrong, right), v in zip(rates, votes, strict=True):
                if v:
                    no *= wrong if v > 0 else 1 - wrong
                    yes *= right if v > 0 else 1 - right
            posterior[kind, votes] = yes / (yes + no)
        for kind in prior:
            own = [(posterior[k, v], n) for (k, v), n in counts.items() if k == kind]
            prior[kind] = (7 + sum(p * n for p, n in own)) / (10 + sum(n for _, n in own))
        for j in range(len(LABELERS)):
            for c, start in ((0, 2.5), (1, 7.5)):
                cast = [(n * (posterior[k] if c else 1 - posterior[k]), k[1][j]) for k, n in counts.items() if k[1][j]]
                rates[j][c] = (start + sum(n for n, v in cast if v > 0)) / (10 + sum(n for n, _ in cast))
    return posterior


class Model(NamedTuple):
    """The span classifier: intercepts by kind, weights of the votes, weights of the traits by kind."""

    intercepts: dict[str, float]
    votes: list[float]
    traits: dict[str, list[float]]

    def odds(self, kind: str, votes: tuple[int, ...], traits: tuple[int, ...]) -> float:
        return self.intercepts[kind] + sum(w * v for w, v in zip(self.votes, votes, strict=True)) + sum(w * t for w, t in zip(self.traits[kind], traits, strict=True))


def train(patterns: list[Pattern], rounds: int = 300, rate: float = 1.0, hold: float = 0.02) -> Model:
    """Logistic regression on the posteriors, each kind weighing as the logarithm of its spans.

    Weights are drawn to those of a majority (a vote 1, a trait 0); votes never count
    against what they say, intercepts lie in -1..2 and a trait's weight in -1..1.
    """
    posterior = estimate(patterns)
    model = Model(dict.fromkeys(KINDS, 0.0), [1.0] * len(LABELERS), {k: [0.0] * len(TRAITS) for k in KINDS})
    sums = {k: sum(n for kind, _, _, n in patterns if kind == k) for k in KINDS}
    total = sum(math.log1p(n) for n in sums.values()) or 1.0
    rows = [(k, v, t, math.log1p(sums[k]) * n / sums[k] / total, posterior[k, v]) for k, v, t, n in patterns]
    for _ in range(rounds if rows else 0):
        step_k, step_v = dict.fromkeys(KINDS, 0.0), [hold * (1.0 - w) for w in model.votes]
        step_t = {k: [-hold * w for w in ws] for k, ws in model.traits.items()}
        for kind, votes, traits, share, target in rows:
            error = share * (target - 1 / (1 + math.exp(-model.odds(kind, votes, traits))))
            step_k[kind] += error
            for j, v in enumerate(votes):
                step_v[j] += error * v
            for j, t in enumerate(traits):
                step_t[kind][j] += error * t
        model = Model(
            {k: min(max(b + 4 * rate * step_k[k], -1.0), 2.0) for k, b in model.intercepts.items()},
            [max(w + rate * s, 0.0) for w, s in zip(model.votes, step_v, strict=True)],
            {k: [min(max(w + rate * s, -1.0), 1.0) for w, s in zip(ws, step_t[k], strict=True)] for k, ws in model.traits.items()},
        )
    return model


def _kept(spans: Column, model: Model) -> Column:
    """Base spans, and others that the classifier gives at least even odds."""
    by_kind = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    bias = by_kind({k: F.lit(float(v)) for k, v in model.intercepts.items()})
    traits = by_kind({k: F.array(*[F.lit(float(w)) for w in ws]) for k, ws in model.traits.items()})

    def odds(s: Column) -> Column:
        votes = [s["votes"][j] * F.lit(float(w)) for j, w in enumerate(model.votes)]
        return reduce(add, [*votes, *[s["traits"][j] * traits[s["kind"]][j] for j in range(len(TRAITS))]], bias[s["kind"]])

    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS) | (odds(s) >= 0))


def fitted(found: DataFrame, spans_col: str = "spans") -> Model:
    """The classifier for a table of candidates; at most len(KINDS) * 3^4 * 2^5 rows reach the driver."""
    each = found.select(F.explode(spans_col).alias("s")).groupBy("s.kind", "s.votes", "s.traits").count()
    return train(sorted((r["kind"], tuple(r["votes"]), tuple(r["traits"]), float(r["count"])) for r in each.collect()))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): the personal data of every row as spans (kind, start, end), by kind as listed, then start."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = materialise(candidates(rows).select("id", "spans"), "pii-candidates")
    kept = _kept(F.col("spans"), fitted(found))
    return found.select("id", F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digest(detected: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans in one string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return detected.select("id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; texts without any stay as they are.

    Overlapping spans become one, named after the first. count_col, if there is such a
    column, gets the new length of changed texts. The columns and their order stay.
    """
    names = docs.columns
    work = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    found = materialise(candidates(work, text, "spans"), "pii-candidates")
    ordered = F.array_sort(F.transform(_kept(F.col("spans"), fitted(found)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substr(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(before, mark))).otherwise(acc["parts"]).alias("parts"))

    rest = lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substr(F.col(text), (acc["at"] + 1).cast("int"), F.length(text)))), "")
    clean = F.when(F.size("marked") > 0, F.aggregate("marked", start, step, rest)).otherwise(F.col(text))
    marked = found.withColumn("marked", ordered).withColumn("clean", clean)
    columns = []
    for i, name in enumerate(names):
        column = F.col(f"c{i}")
        if name == text_col:
            column = F.col("clean")
        elif name == count_col:
            column = F.when(F.size("marked") > 0, F.length("clean").cast(docs.schema[name].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return marked.select(*columns)
