"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions find candidates. Labelers (strict pattern, checksum and gazetteer, cue words before, what
stands next to it) vote yes, no or nothing on each. The votes are counted, expectation-maximisation estimates
how reliable each labeler is for each kind, and its posteriors are the labels from which a naive Bayes
classifier over the shape of a span and its neighbours is trained. Spans of the strict patterns always stay;
a looser candidate is added if the classifier holds it for one of its kind. Only counts per combination of
votes and shapes (a bounded number) reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.runtime import stored

KINDS = ("email", "ip", "card", "phone")
ADDED = 0.9  # least probability of an added span

# Patterns as described, in forms that neither recurse nor search a run of characters twice: the parts that
# cannot give back a character are possessive, and a match does not begin inside a run that was tried before.
_MAIL = r"[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms: written-out addresses, version 6 addresses, grouped card numbers, national telephone numbers.
LOOSE = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9][\x20-])(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.()-])\(?[0-9]{2,5}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){2,4}(?![0-9.-])",
}
# Gazetteers: words that announce a kind, words that announce other numbers, and common last labels of hosts.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|courriel|correo|kontakt|write|address)\b",
    "ip": r"(?i)\b(?:ip|ipv4|ipv6|host|server|client|login|adresse|address)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|carte|tarjeta|karte|kreditkarte|payment)\b",
    "phone": r"(?i)\b(?:tel|phone|telephone|call|fax|mobile|cell|telefon|handy|tél|téléphone|teléfono|móvil)\b",
}
OTHER = r"(?i)\b(?:version|release|isbn|issn|order|invoice|page|figure|fig|section|chapter|sku|serial|token|hash|id|no|nr)[\x20.:#=]*$"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|ch|at|it|nl|be|pt|br|mx|co)$"
CONTEXT = 32  # code points before a candidate that labelers see

VOTES = ("strict", "check", "cue", "beside")
SHAPES = ("digits", "breaks", "before", "after")


_FIELDS = ["kind:int", "start:int", "end:int", "is_strict:boolean", *[f"{v}:int" for v in VOTES], *[f"{s}:string" for s in SHAPES]]
_CANDIDATES = f"array<struct<{','.join(_FIELDS)}>>"


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost non-overlapping matches; code points, end exclusive."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: F.struct(F.length(p).alias("skip"), f.alias("found")))
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["skip"]
        end = start + F.length(part["found"])
        span = F.struct(start.alias("start"), end.alias("end"), part["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    # Every second digit from the right is doubled; two digits count with their sum.
    figures = F.transform(F.reverse(F.split(_digits(found), "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(figures, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    """What a strict match must fulfil besides the pattern."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(found)).between(13, 19) & _luhn(found)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    """A cheap test that is true for every text with a match of either form."""
    if kind == "email":
        return F.contains(text, F.lit("@")) | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]"))
    return text.rlike("[0-9]")


def _side(char: Column) -> Column:
    """Class of a neighbouring character: none or space, letter, digit, quote or sign, other."""
    return F.when((char == "") | char.rlike(r"\s"), "s").when(char.rlike(r"\p{L}"), "l").when(char.rlike("[0-9]"), "d").when(char.rlike(r"[\"'=#$%&*_/\\]"), "q").otherwise("o")


def _described(kind: str, text: Column, span: Column, strict: bool) -> Column:
    """A candidate with its votes (1, 0, or 2 for none) and shape."""
    found, start = span["found"], span["start"]
    left = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    before, after = _side(F.right(left, F.lit(1))), _side(F.substring(text, span["end"] + 1, F.lit(1)))
    n = F.length(_digits(found))
    yes, no, none = F.lit(1), F.lit(0), F.lit(2)
    check = {
        "email": F.when(found.rlike(DOMAINS), yes).otherwise(none),
        "ip": F.when(found.rlike(r"^[0-9](?:\.[0-9]){3}$"), no).otherwise(yes),
        "card": F.when(_luhn(found), yes).otherwise(no),
        "phone": F.when(n.between(10, 12), yes).when(n.between(9, 15), none).otherwise(no),
    }[kind]
    votes = {
        "strict": yes if strict else none,
        "check": check,
        "cue": F.when(left.rlike(CUES[kind]), yes).when(left.rlike(OTHER), no).otherwise(none),
        "beside": F.when(before.isin("l", "d", "q") | after.isin("l", "d", "q"), no).otherwise(yes),
    }
    shapes = {
        "digits": F.least(F.floor(n / 4), F.lit(5)).cast("string"),
        "breaks": F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")), F.lit(6)).cast("string"),
        "before": before,
        "after": after,
    }
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        start.alias("start"),
        span["end"].alias("end"),
        F.lit(strict).alias("is_strict"),
        *[votes[v].alias(v) for v in VOTES],
        *[shapes[s].alias(s) for s in SHAPES],
    )


def candidates(text: Column) -> Column:
    """All candidates of a text, without looser ones that overlap a strict span of any kind or a looser one before."""
    strict, loose = [], []
    for kind in KINDS:
        firm = F.filter(_located(text, STRICT[kind]), lambda s: _holds(kind, s["found"]))
        firm = F.transform(firm, lambda s: _described(kind, text, s, True)).cast(_CANDIDATES)
        free = F.transform(_located(text, LOOSE[kind]), lambda s: _described(kind, text, s, False)).cast(_CANDIDATES)
        strict.append(F.when(_may_have(kind, text), firm).otherwise(F.array().cast(_CANDIDATES)))
        loose.append(F.when(_may_have(kind, text), free).otherwise(F.array().cast(_CANDIDATES)))
    return F.struct(F.concat(*strict).alias("strict"), F.concat(*loose).alias("loose"))


def _clear(found: Column) -> Column:
    """The looser candidates that overlap no strict one and no looser one of an earlier start."""

    def over(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    free = F.filter(found["loose"], lambda c: ~F.exists(found["strict"], lambda s: over(c, s)))
    ahead = lambda a, b: (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))
    return F.filter(free, lambda c: ~F.exists(free, lambda s: over(c, s) & ahead(s, c)))


def with_candidates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with column `found`: (strict, loose) candidates. Most texts have neither a digit nor an address."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    raw = docs.withColumn("found", candidates(text))
    return raw.withColumn("found", F.struct(F.col("found.strict").alias("strict"), _clear(F.col("found")).alias("loose")))


@dataclass(frozen=True)
class Model:
    """Log-odds of the classifier: per kind, and per kind, feature and value."""

    bias: dict[int, float]
    weights: dict[tuple[int, str, str], float]
    accuracy: dict[tuple[int, str], float]  # what EM says of the labelers, for the reader

    def probability(self, c: Column) -> Column:
        """Of one candidate. Values never seen say nothing."""
        table = F.create_map(*[x for (k, f, v), w in sorted(self.weights.items()) for x in (F.lit(f"{k}|{f}|{v}"), F.lit(w))]) if self.weights else None
        total = F.element_at(F.array(*[F.lit(self.bias.get(k, -10.0)) for k in range(len(KINDS))]), c["kind"] + 1)
        for name in (*SHAPES, *VOTES[1:]):
            if table is not None:
                key = F.concat_ws("|", c["kind"].cast("string"), F.lit(name), c[name].cast("string"))
                total = total + F.coalesce(F.try_element_at(table, key), F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _reliability(rows: list, rounds: int = 60) -> tuple[dict, dict]:
    """One-coin Dawid and Skene by EM over (votes, n): accuracy per labeler, posterior per combination of votes."""
    accuracy, prior, posterior = dict.fromkeys(VOTES, 0.8), 0.5, {}
    accuracy["strict"] = 0.95
    for _ in range(rounds):
        for votes in {r[0] for r in rows}:
            yes, no = prior, 1 - prior
            for name, vote in zip(VOTES, votes):
                if vote != 2:
                    right = accuracy[name]
                    yes, no = yes * (right if vote else 1 - right), no * (1 - right if vote else right)
            posterior[votes] = yes / (yes + no)
        total = sum(n for _, n in rows)
        prior = min(0.99, max(0.01, (1 + sum(n * posterior[v] for v, n in rows)) / (2 + total)))
        for k, name in enumerate(VOTES):
            cast = [(v, n) for v, n in rows if v[k] != 2]
            agreed = sum(n * (posterior[v] if v[k] else 1 - posterior[v]) for v, n in cast)
            # Labelers are taken to be better than chance, so that classes cannot change places.
            accuracy[name] = min(0.99, max(0.55, (8 * 0.8 + agreed) / (8 + sum(n for _, n in cast))))
    return accuracy, posterior


def fit(found: DataFrame) -> Model:
    """Reliabilities and classifier from all candidates of a table with column `found`. No candidates: an empty model."""
    each = found.select(F.explode(F.concat("found.strict", "found.loose")).alias("c"))
    counts = each.groupBy("c.kind", *[f"c.{v}" for v in VOTES], *[f"c.{s}" for s in SHAPES]).count().collect()
    bias, weights, reliable = {}, {}, {}
    for kind in range(len(KINDS)):
        rows = [r for r in counts if r["kind"] == kind]
        if not rows:
            continue
        summed: dict = defaultdict(int)
        for r in rows:
            summed[tuple(r[v] for v in VOTES)] += r["count"]
        accuracy, posterior = _reliability(list(summed.items()))
        reliable |= {(kind, v): a for v, a in accuracy.items()}
        mass, total = defaultdict(lambda: [0.0, 0.0]), [1.0, 1.0]
        for r in rows:
            p = posterior[tuple(r[v] for v in VOTES)]
            for y, share in enumerate((1 - p, p)):
                total[y] += share * r["count"]
                for name in (*SHAPES, *VOTES[1:]):
                    mass[name, str(r[name])][y] += share * r["count"]
        bias[kind] = math.log(total[1] / total[0])
        values = {name: sum(1 for n, _ in mass if n == name) for name, _ in mass}
        for (name, value), (no, yes) in mass.items():
            weights[kind, name, value] = math.log((yes + 1) / (total[1] + values[name])) - math.log((no + 1) / (total[0] + values[name]))
    return Model(bias, weights, reliable)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _spans(of: Column) -> Column:
    return F.transform(of, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def _accepted(model: Model) -> Column:
    return F.concat(_spans(F.col("found.strict")), _spans(F.filter(F.col("found.loose"), lambda c: model.probability(c) >= ADDED)))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_email, n_ip, n_card, n_phone (spans of the strict patterns), base_sha256, spans.

    Null texts are empty; texts without personal data have zeros, the hash of an empty text, and ''. Repeated
    rows give a row each. Other columns are not looked at. Candidates are stored once, without texts.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    found = stored(with_candidates(source, "t").select("id", "found"), "candidates")
    model = fit(found)
    kinds = F.transform("found.strict", lambda c: c["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("id").alias(id_column),
        *counts,
        F.sha2(_listed(_spans(F.col("found.strict"))), 256).alias("base_sha256"),
        _listed(_accepted(model)).alias("spans"),
    )


def mask(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with every span replaced by `<KIND>`; all other columns, their order and the rows stay.

    Spans that overlap are replaced together, under the kind that starts first. Null texts stay null. The
    first pass reads the texts for counts only, the second replaces; nothing is shuffled.
    """
    names = list(docs.columns)
    # The text under a name of its own, so that no column of `docs` clashes with the working columns.
    slim = docs.select(F.col(text_column).alias("t"))
    model = fit(with_candidates(slim, "t"))
    packed = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(text_column).alias("t"))
    spans = with_candidates(packed, "t").select("row", "t", _accepted(model).alias("s"))
    order = F.sort_array(F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], between, F.element_at(labels, s["kind"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t")))
    masked = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, tail)
    clean = F.when(F.col("t").isNull() | (F.size("s") == 0), F.col("t")).otherwise(masked)
    return spans.select(*[(clean if c == text_column else F.col("row")[c]).alias(c) for c in names])
