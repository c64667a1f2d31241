"""Personal data in texts by weak supervision; DataFrame and SQL functions only.

Base patterns give spans that always stand. Wider patterns propose further ones. Four labelers vote on every
proposal, for (1), against (-1) or not at all (0): the strict pattern, a gazetteer of endings and number
ranges, the words around it, and its shape. Votes are counted over the corpus by kind, votes and features;
expectation-maximisation on those counts estimates how reliable each labeler is and how likely each
proposal is personal data, and a logistic span classifier is fitted to these probabilities. Proposals
that it accepts and that touch no base span are added.

There are at most kinds * 3^4 * 2^2 counts, whatever the corpus; they are fitted by plain loops on the
driver, and the classifier is a column expression. Finding and classifying spans is a projection of
each row, without any shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: kinds in the order of results, with the base patterns. Possessive runs and the look-behind
# give the same matches as the plain patterns, in linear time: a match can only start where a run of
# its first characters starts or where the last match ended.
KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
LABEL = r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what a text must hold for a pattern to match at all
HINTS = {
    "email": "contains({t}, '@')",
    "ip": r"{t} rlike r'[0-9]\.[0-9]'",
    "card": r"{t} rlike r'(?:[0-9][\x20-]?){{12}}[0-9]'",
    "phone": "contains({t}, '+')",
}
# wider proposals
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++\x20?[\[(]at[\])]\x20?{LABEL}++(?:\x20?(?:\.|[\[(]dot[\])])\x20?{LABEL}++)++",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_HINTS = {
    "email": r"{t} rlike r'[\[(]at[\])]'",
    "phone": r"{t} rlike r'[0-9]{{3}}[\x20.-][0-9]{{4}}'",
}
OCTETS = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# labelers' knowledge
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "nl", "uk", "us", "eu", "ch", "at")
CUES = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "master", "credit", "payment"), "phone": ("phone", "tel", "call", "fax", "mobile")}
COUNTER_CUES = ("version", "isbn", "order", "invoice", "sku", "section", "chapter", "serial")
REACH = 40

SPAN = "struct<start:int,stop:int,match:string>"
PROPOSAL = "struct<kind:string,start:int,stop:int,base:boolean,votes:array<int>,marked:int,edged:int>"


@dataclass(frozen=True)
class Aggregation:
    """Settings of the estimation: rounds of EM, steps of the classifier, and when a proposal is accepted."""

    rounds: int = 40
    steps: int = 300
    rate: float = 0.5
    accept: float = 0.5


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def matches(text: str, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches with code point offsets, end exclusive; ``text`` is a column's name.

    The pieces between matches and the matches themselves, in turn, give the offsets.
    """
    found = f"regexp_extract_all({text}, {_raw(pattern)}, 0)"
    pieces = f"split({text}, {_raw(pattern)}, -1)"
    return F.expr(f"""if({hint.format(t=text)}, aggregate(
        zip_with({found}, {pieces}, (m, p) -> named_struct('gap', char_length(p), 'match', m)),
        cast(named_struct('at', 0, 'out', array()) as struct<at:int,out:array<{SPAN}>>),
        (acc, x) -> if(x.match is null, acc, named_struct(
            'at', acc.at + x.gap + char_length(x.match),
            'out', concat(acc.out, array(named_struct(
                'start', acc.at + x.gap, 'stop', acc.at + x.gap + char_length(x.match), 'match', x.match))))),
        acc -> acc.out), cast(array() as array<{SPAN}>))""")


def _digits(match: str) -> str:
    return f"regexp_replace({match}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    return f"""aggregate(transform(sequence(1, char_length({digits})), i -> cast(substr(reverse({digits}), i, 1) as int)
        * if(i % 2 = 0, 2, 1)), 0, (s, d) -> s + if(d > 9, d - 9, d)) % 10 = 0"""


VALID = {
    "email": "true",
    "ip": rf"x.match rlike r'^{OCTETS}(?:\.{OCTETS}){{3}}$'",
    "card": f"if(char_length({_digits('x.match')}) between 16 and 19, {_luhn(_digits('x.match'))}, false)",
    "phone": f"char_length({_digits('x.match')}) between 8 and 15",
}
# proposals that fail the strict pattern but are near enough to be voted on
NEAR = {"email": "false", "ip": "true", "card": f"char_length({_digits('x.match')}) between 13 and 19", "phone": "true"}


def _gazetteer(kind: str) -> str:
    first = {
        "email": f"regexp_extract(lower(right(x.match, 24)), r'([a-z0-9-]+)$', 1) in ({', '.join(repr(e) for e in ENDINGS)})",
        "ip": r"not x.match rlike r'^0*(?:0|127|22[4-9]|2[3-5][0-9])\.'",
        "card": f"{_digits('x.match')} rlike r'^(?:4|5[1-5]|2[2-7]|3[47]|6[0245])'",
        "phone": r"x.match rlike r'^(?:\+[1-9]|\(?[2-9])'",
    }[kind]
    return f"if({first}, 1, -1)"


def _shape(kind: str) -> str:
    first = {
        "email": r"x.match rlike r'^[^@\[(]{2,64}'",
        "ip": r"not x.match rlike r'(?:^|\.)0[0-9]'",
        "card": r"x.match rlike r'^[0-9]{16,19}$' or x.match rlike r'^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}$'",
        "phone": f"char_length({_digits('x.match')}) >= 10",
    }[kind]
    return f"if({first}, 1, -1)"


def _context(kind: str, text: str) -> str:
    around = f"lower(concat(substring({text}, greatest(x.start - {REACH}, 0) + 1, least({REACH}, x.start)), ' ', substring({text}, x.stop + 1, {REACH})))"
    return f"if({around} rlike r'{'|'.join(CUES[kind])}', 1, if({around} rlike r'{'|'.join(COUNTER_CUES)}', -1, 0))"


def _proposals(kind: str, spans: str, text: str, strict: bool) -> str:
    valid = VALID[kind] if strict else "false"
    keep = f"({VALID[kind]}) or ({NEAR[kind]})" if strict else "true"
    pattern = f"if({valid}, 1, -1)" if strict else "0"
    return f"""transform(filter({spans}, x -> {keep}), x -> named_struct('kind', '{kind}', 'start', x.start, 'stop', x.stop, 'base', {valid},
        'votes', array({pattern}, {_gazetteer(kind)}, {_context(kind, text)}, {_shape(kind)}),
        'marked', if(substring({text}, greatest(x.start - 2, 0) + 1, least(2, x.start)) rlike '[:=]', 1, 0),
        'edged', if(substring({text}, x.stop + 1, 1) rlike r'^[A-Za-z0-9]', 0, 1)))"""


def proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__text`` (null is empty) and ``__found``, the proposals of each text that are base spans or touch none.

    Proposals are ordered by kind, then start.
    """
    kept = docs.columns
    out = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    for kind in KINDS:
        out = out.withColumn(f"__{kind}", matches("__text", PATTERNS[kind], HINTS[kind]))
    for kind in LOOSE:
        out = out.withColumn(f"__loose_{kind}", matches("__text", LOOSE[kind], LOOSE_HINTS[kind]))
    parts = []
    for kind in KINDS:
        parts.append(_proposals(kind, f"__{kind}", "__text", True))
        if kind in LOOSE:
            parts.append(_proposals(kind, f"__loose_{kind}", "__text", False))
    out = out.withColumn("__all", F.expr(f"cast(concat({', '.join(parts)}) as array<{PROPOSAL}>)"))
    out = out.withColumn("__base", F.filter("__all", lambda x: x["base"]))
    free = F.expr("filter(__all, x -> x.base or not exists(__base, b -> b.start < x.stop and x.start < b.stop))")
    # as the one element of an array: else later filters are pushed down with all that computes the spans
    return out.select(*[F.col(f"`{c}`") for c in kept], "__text", F.explode(F.array(free)).alias("__found"))


def _em(counts: list[tuple[tuple[int, ...], int]], rule: Aggregation) -> list[float]:
    """Probability of personal data for each pattern of votes (Dawid-Skene with two classes and abstentions)."""
    labelers = len(counts[0][0])
    # before anything is known, a labeler is right about four times in five when it votes
    belief = [1 / (1 + math.exp(-1.4 * sum(v))) for v, _ in counts]
    for _ in range(rule.rounds):
        rates = []
        for j in range(labelers):
            table = [[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]]
            for (votes, n), b in zip(counts, belief, strict=True):
                table[1][votes[j] + 1] += n * b
                table[0][votes[j] + 1] += n * (1 - b)
            rates.append([[math.log(x / sum(row)) for x in row] for row in table])
        total = sum(n for _, n in counts)
        share = (1 + sum(n * b for (_, n), b in zip(counts, belief, strict=True))) / (2 + total)
        belief = []
        for votes, _ in counts:
            odds = math.log(share / (1 - share)) + sum(rates[j][1][v + 1] - rates[j][0][v + 1] for j, v in enumerate(votes))
            # base spans stand by definition; all else is estimated
            belief.append(1.0 if votes[0] > 0 else 1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
    return belief


def _classifier(rows: list[tuple[list[float], int, float]], rule: Aggregation) -> list[float]:
    """Logistic weights (the last is the bias) fitted to probabilities, by gradient steps on counts."""
    size = len(rows[0][0])
    weights = [0.0] * (size + 1)
    total = sum(n for _, n, _ in rows)
    for _ in range(rule.steps):
        g = [0.0] * (size + 1)
        for x, n, target in rows:
            z = weights[size] + sum(w * v for w, v in zip(weights, x, strict=False))
            miss = n / total * (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - target)
            for i, v in enumerate(x):
                g[i] += miss * v
            g[size] += miss
        weights = [w - rule.rate * (d + 1e-4 * w) for w, d in zip(weights, g, strict=True)]
    return weights


@dataclass
class SpanModel:
    """Classifier weights by kind: the votes, the two features, the bias; and what EM found."""

    weights: dict[str, list[float]]
    counts: dict[str, int]


def fit(docs: DataFrame, rule: Aggregation = Aggregation()) -> SpanModel:
    """Estimate labelers and classifier from all proposals of ``docs`` (column text); without any, nothing is accepted."""
    found = proposals(docs.select("text")).select(F.explode("__found").alias("x")).select("x.*")
    rows = found.groupBy("kind", "votes", "marked", "edged").count().orderBy("kind", "votes", "marked", "edged").collect()
    weights, sizes = {}, {}
    for kind in KINDS:
        mine = [r for r in rows if r["kind"] == kind]
        if not mine:
            continue
        patterns = sorted({tuple(r["votes"]) for r in mine})
        summed = [(v, sum(r["count"] for r in mine if tuple(r["votes"]) == v)) for v in patterns]
        belief = dict(zip(patterns, _em(summed, rule), strict=True))
        weights[kind] = _classifier(
            [([*map(float, r["votes"]), float(r["marked"]), float(r["edged"])], r["count"], belief[tuple(r["votes"])]) for r in mine], rule)
        sizes[kind] = sum(r["count"] for r in mine)
    return SpanModel(weights, sizes)


def spans(docs: DataFrame, model: SpanModel, rule: Aggregation = Aggregation()) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with ``spans``, an array of (kind, start, stop, base) by kind, then start.

    ``docs`` needs a column text and may have any others, whatever their names. Null and empty texts have no
    spans; offsets count code points of the whole text, ends exclusive. Each row is treated by itself.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    score = "case x.kind "
    for kind, w in model.weights.items():
        terms = " + ".join([f"{w[j]!r}D * x.votes[{j}]" for j in range(4)] + [f"{w[4]!r}D * x.marked", f"{w[5]!r}D * x.edged", f"{w[6]!r}D"])
        score += f"when '{kind}' then {terms} "
    score = score + "else -1e9D end" if model.weights else "-1e9D"
    limit = math.log(rule.accept / (1 - rule.accept))
    order = "case {0}.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    taken = F.expr(f"filter(__found, x -> x.base or ({score}) >= {limit!r}D)")
    listed = F.transform(taken, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["base"].alias("base")))
    ranked = F.expr(f"""transform(array_sort(transform(__taken, x -> named_struct('o', {order.format('x')}, 's', x.start, 'e', x.stop, 'x', x))),
        y -> y.x)""")
    return proposals(rows).withColumn("__taken", listed).withColumn("spans", ranked).select("row", "spans")


def named(spans_column: str, only_base: bool) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = f"filter({spans_column}, x -> x.base)" if only_base else spans_column
    return F.expr(f"array_join(transform({chosen}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')")


def redacted(docs: DataFrame, model: SpanModel, rule: Aggregation = Aggregation()) -> DataFrame:
    """``docs`` with every span of text replaced by its kind in brackets; null texts stay null.

    Overlapping spans are replaced once, by the kind of the first.
    """
    found = spans(docs, model, rule).withColumn("__text", F.col("row.text").cast("string"))
    by_place = found.withColumn("__placed", F.expr("array_sort(transform(spans, x -> named_struct('s', x.start, 'e', x.stop, 'kind', x.kind)))"))
    clean = F.expr("""if(__text is null or size(__placed) = 0, __text, aggregate(__placed,
        named_struct('at', 0, 'out', ''),
        (acc, x) -> if(x.s < acc.at, named_struct('at', greatest(acc.at, x.e), 'out', acc.out), named_struct(
            'at', x.e, 'out', concat(acc.out, substring(__text, acc.at + 1, x.s - acc.at), '[', upper(x.kind), ']'))),
        acc -> concat(acc.out, substring(__text, acc.at + 1, char_length(__text) - acc.at))))""")
    fields = [clean.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return by_place.select(*fields)
