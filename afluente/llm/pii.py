"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

Everything that touches the texts is DataFrame or SQL functions. The trees are fitted on counts: one row per combination
of binned features, so that their size is bounded by the bins and not by the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afluente.functions.columns import computed

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the base patterns: the same matches without backtracking. A run of signs is tried from its start
# only, or from where the match before ended, as a later start in it matches no more than the first.
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators: other separators and written-out signs, and numbers without their usual marks.
WIDE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[{_HOST}]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[{_HOST}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:[.,:][0-9]++){3}+",
    "card": r"[0-9](?:[\x20./-]?[0-9]){11,}+",
    "phone": r"(?:\+|\(|(?<![0-9]))[0-9][\x20()./0-9-]{5,60}[0-9]",
}
# A text without this has no candidate of the kind, which is cheaper to see.
_NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9][.,:][0-9]", "card": r"[0-9]{2}|[0-9][\x20./-][0-9]", "phone": r"[0-9]"}
# Words before a candidate that tell what it is, and formats that do.
CUES = {
    "email": "mail|@|write|contact",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "card": "card|visa|iban|pay|token|key",
    "ip": r"\b(?:ip|host|server|addr|address|login|ping)\b",
}
_WRITTEN_OUT = r"\(at\)|\[at\]"
_GROUPED = r"^(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$"
BEFORE, AFTER = 24, 8  # characters of context
CHUNK = 256  # matches of a text that are brought into place together

TREES = 16
DEPTH = 3
LEARNING_RATE = 0.4
PENALTY = 1.0
LEAST_PRECISION = 0.95  # of the candidates that a threshold lets through, on documents kept from training


def _matches(text: Column, regex: str, needs: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return F.when(text.rlike(needs), found).otherwise(F.array().cast("array<string>"))


def _located(matches: Column, parts: Column) -> Column:
    """``s``, ``e``, ``m`` and the context ``b``, ``a`` of every match; ``parts`` is the text between the matches.

    Starts are sums of the lengths before. Chunks keep the copying of growing arrays short in texts with many matches.
    """
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string,a:string>>")

    def one(state: Column, k: Column) -> Column:
        start = state["at"] + F.length(F.get(parts, k))
        end = start + F.length(F.get(matches, k))
        span = F.struct(
            start.alias("s"),
            end.alias("e"),
            F.get(matches, k).alias("m"),
            F.right(F.get(parts, k), F.lit(BEFORE)).alias("b"),
            F.left(F.get(parts, k + 1), F.lit(AFTER)).alias("a"),
        )
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def chunk(state: Column, c: Column) -> Column:
        last = F.least((c + 1) * CHUNK, F.size(matches)) - 1
        made = F.aggregate(F.sequence(c * CHUNK, last), F.struct(state["at"].alias("at"), none.alias("found")), one)
        return F.struct(made["at"].alias("at"), F.concat(state["found"], F.array(made["found"])).alias("found"))

    chunks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,m:string,b:string,a:string>>>").alias("found"))
    return F.when(F.size(matches) > 0, F.flatten(F.aggregate(chunks, start, chunk)["found"])).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        digit = digits.substr(n - k, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern counts."""
    digits = _digits(match)
    if kind == "ip":
        # At most 255, whatever zeros stand before; longer numbers never fit an int.
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


# Binned features of a candidate, each with its number of bins.
FEATURES = {"kind": 4, "digits": 8, "marks": 4, "size": 6, "left": 5, "right": 5, "hint": 5, "sign": 2, "shape": 3, "form": 3, "check": 2}


def _side(sign: Column) -> Column:
    return (
        F.when(sign == "", 0).when(sign.rlike(r"\s"), 1).when(sign.rlike("[0-9]"), 2).when(sign.rlike(r"[\p{L}_@]"), 3).otherwise(4)
    )


def _features(kind: str, span: Column) -> dict[str, Column]:
    match, digits = span["m"], F.length(_digits(span["m"]))
    marks = F.length(F.regexp_replace(match, r"[A-Za-z0-9]", ""))
    length = F.length(match)
    before = F.lower(span["b"])
    hints = F.when(before.rlike(CUES[kind]), 4)  # the cue of its own kind, or of another
    for number, other in enumerate(("email", "phone", "card"), 1):
        hints = hints.when(before.rlike(CUES[other]), number)
    return {
        "kind": F.lit(KINDS.index(kind)),
        "digits": F.when(digits < 4, 0).when(digits < 8, 1).when(digits < 10, 2).when(digits < 12, 3).when(digits < 14, 4).when(digits < 16, 5).when(digits < 20, 6).otherwise(7),
        "marks": F.least(marks, F.lit(3)),
        "size": F.when(length < 9, 0).when(length < 13, 1).when(length < 17, 2).when(length < 22, 3).when(length < 32, 4).otherwise(5),
        "left": _side(F.right(span["b"], F.lit(1))),
        "right": _side(F.left(span["a"], F.lit(1))),
        "hint": hints.otherwise(0),
        "sign": F.when(match.startswith("+") | match.contains("@"), 1).otherwise(0),
        "shape": F.when(match.rlike(r"[\x20]"), 1).when(match.rlike("[()\\[\\],:/]"), 2).otherwise(0),
        "form": F.when(match.rlike(_WRITTEN_OUT), 1).when(match.rlike(_GROUPED), 2).otherwise(0),
        "check": valid(kind, F.translate(match, ",:", "..")).cast("int"),
    }


def _plausible(kind: str, span: Column) -> Column:
    """The weak label of training: a base span as a whole, or a wide form that passes the same checks once its signs are
    brought back, with a cue word or a telling format where numbers alone say too little."""
    match, before = span["m"], F.lower(span["b"])
    strict = match.rlike(f"^(?:{BASE[kind]})$") & valid(kind, match)
    digits = F.length(_digits(match))
    if kind == "email":
        usual = F.regexp_replace(F.regexp_replace(match, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
        spaced = F.regexp_replace(usual, r"\x20?@\x20?", "@")  # a space at a plain point ends a sentence
        signs = match.rlike(_WRITTEN_OUT) | before.rlike(CUES["email"])
        return strict | (spaced.rlike(rf"^[{_LOCAL}]+@[{_HOST}]+(?:\.[{_HOST}]+)*\.[A-Za-z]{{2,}}$") & signs)
    if kind == "ip":
        one_sign = match.rlike(r"^[0-9]+([.,:])[0-9]+(?:\1[0-9]+){2}$")
        return strict | (one_sign & valid(kind, F.translate(match, ",:", "..")) & before.rlike(CUES["ip"]))
    if kind == "card":
        one_sign = match.rlike(r"^[0-9]+(?:([\x20./-])[0-9]+(?:\1[0-9]+)*)?$")
        return strict | (one_sign & valid(kind, match))
    dated = match.rlike(r"^\(?(?:19|20)[0-9]{2}[-/.][0-9]{2}[-/.]")
    return strict | (digits.between(10, 15) & ~dated & (before.rlike(CUES["phone"]) | match.rlike(_GROUPED)))


@dataclass
class PiiModel:
    """Trees as nested tuples (feature, last bin to the left, left, right) or leaf values, and a threshold per kind."""

    start: float
    trees: list
    thresholds: dict[str, float]

    def raw(self, features: dict[str, Column]) -> Column:
        def walk(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, last, left, right = tree
            return F.when(features[name] <= last, walk(left)).otherwise(walk(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + walk(tree)
        return total


def _grow(rows: list, depth: int):
    """A tree on rows (features, gradient sum, curvature sum), splits by the largest gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    for name, bins in FEATURES.items() if depth else ():
        by_bin: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for features, gradient, curvature in rows:
            cell = by_bin[features[name]]
            cell[0] += gradient
            cell[1] += curvature
        gl = hl = 0.0
        for last in range(bins - 1):
            gl, hl = gl + by_bin[last][0], hl + by_bin[last][1]
            if min(hl, h - hl) < 1e-3:
                continue
            gain = gl * gl / (hl + PENALTY) + (g - gl) ** 2 / (h - hl + PENALTY) - g * g / (h + PENALTY)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = (gain, name, last)
    if best is None:
        return -LEARNING_RATE * g / (h + PENALTY)
    _, name, last = best
    return name, last, _grow([r for r in rows if r[0][name] <= last], depth - 1), _grow([r for r in rows if r[0][name] > last], depth - 1)


def _value(tree, features: dict) -> float:
    while isinstance(tree, tuple):
        name, last, left, right = tree
        tree = left if features[name] <= last else right
    return tree


def fit(cells: list[tuple[dict, bool, int, int]]) -> PiiModel:
    """Boosted trees with logistic loss on cells (features, held out, candidates, true ones)."""
    learn = [c for c in cells if not c[1]]
    total, true = sum(c[2] for c in learn), sum(c[3] for c in learn)
    if not 0 < true < total:
        return PiiModel(0.0, [], {})
    start = math.log(true / (total - true))
    scores, trees = [start] * len(learn), []
    for _ in range(TREES):
        rows = []
        for (features, _, count, good), score in zip(learn, scores):
            p = 1 / (1 + math.exp(-score))
            rows.append((features, count * p - good, count * p * (1 - p)))
        tree = _grow(rows, DEPTH)
        trees.append(tree)
        scores = [s + _value(tree, c[0]) for s, c in zip(scores, learn)]
    thresholds = {}
    for number, kind in enumerate(KINDS):  # the lowest score above which held-out candidates are nearly all true
        ranked = defaultdict(lambda: [0, 0])
        for features, out, count, good in cells:
            if out and features["kind"] == number:
                cell = ranked[round(start + sum(_value(t, features) for t in trees), 9)]
                cell[0] += count
                cell[1] += good
        count = good = 0
        for score in sorted(ranked, reverse=True):
            count, good = count + ranked[score][0], good + ranked[score][1]
            if good >= LEAST_PRECISION * count:
                thresholds[kind] = score - 1e-6
    return PiiModel(start, trees, thresholds)


def _found(documents: DataFrame) -> DataFrame:
    """Base spans and candidates of every text, each kind in an array column; nothing is worked out twice."""
    id_column, text = documents["doc_id"].cast("long"), documents["text"].cast("string")
    rows = documents.select(id_column.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    patterns = {**{f"base_{k}": (BASE[k], _NEEDS[k]) for k in KINDS}, **{f"wide_{k}": (WIDE[k], _NEEDS[k]) for k in KINDS}}
    rows = computed(rows, **{f"m_{n}": _matches(F.col("text"), p, needs) for n, (p, needs) in patterns.items()})
    none = F.array().cast("array<string>")
    rows = computed(
        rows, **{f"p_{n}": F.when(F.size(f"m_{n}") > 0, F.split("text", p, -1)).otherwise(none) for n, (p, _) in patterns.items()}
    )
    rows = rows.drop("text")
    rows = computed(rows, **{n: _located(F.col(f"m_{n}"), F.col(f"p_{n}")) for n in patterns})
    kept = {}
    for kind in KINDS:
        kept[f"ok_{kind}"] = F.filter(f"base_{kind}", lambda x: valid(kind, x["m"]))
    return computed(rows.select("doc_id", *patterns), **kept)


def train(documents: DataFrame) -> PiiModel:
    """A model from the candidates of all documents; the label is whether a candidate passes the checks of its kind
    in its base form or a wide one. A fifth of the documents calibrates the thresholds. Only counts per feature
    combination reach the driver: there are no more than the product of the bins, whatever the corpus."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = []
    for kind in KINDS:

        def cell(x: Column) -> Column:
            bins = (c.cast("int").alias(n) for n, c in _features(kind, x).items())
            return F.struct(*bins, _plausible(kind, x).alias("good"))

        rows.append(F.transform(f"wide_{kind}", cell))
    found = _found(documents).select(out.alias("out"), F.explode(F.flatten(F.array(*rows))).alias("c"))
    counts = found.groupBy("out", *(F.col(f"c.{n}").alias(n) for n in FEATURES)).agg(
        F.count("*").alias("n"), F.sum(F.col("c.good").cast("int")).alias("good")
    )
    cells = [({n: r[n] for n in FEATURES}, r["out"], r["n"], r["good"]) for r in counts.collect()]
    return fit(sorted(cells, key=lambda c: (tuple(c[0].values()), c[1])))


def _first_place(spans: Column, reached) -> Column:
    """How many of the ordered spans come before the first that ``reached`` holds for, by halving."""

    def halve(bounds: Column, _: Column) -> Column:
        middle = F.shiftright(bounds["low"] + bounds["high"], 1)
        hit = reached(F.get(spans, middle))
        done = bounds["low"] >= bounds["high"]
        return F.struct(
            F.when(done | hit, bounds["low"]).otherwise(middle + 1).alias("low"), F.when(~done & hit, middle).otherwise(bounds["high"]).alias("high")
        )

    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(spans))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda bounds: bounds["low"])


def _by_kind(spans: str) -> dict[str, Column]:
    """The spans of each kind, as columns of their own."""

    def of(kind: int) -> Column:
        return F.filter(spans, lambda y: y["k"] == kind)

    return {f"_{spans}_{kind}": of(kind) for kind in range(len(KINDS))}


def _any(x: Column, columns: list[str], test) -> Column:
    """Whether a span that overlaps ``x`` passes ``test``. Each column holds spans in order that do not overlap each other."""
    found = F.lit(False)
    for name in columns:
        spans = F.col(name)
        first = _first_place(spans, lambda y: y["e"] > x["s"])
        past = _first_place(spans, lambda y: y["s"] >= x["e"])
        found = found | ((F.size(spans) > 0) & F.exists(F.slice(spans, first + 1, F.greatest(past - first, F.lit(0))), test))
    return found


def find_pii(documents: DataFrame, model: PiiModel) -> DataFrame:
    """Spans of personal data of every whole text, in code points, ends exclusive.

    ``base``: spans of the base patterns, failing ones dropped. ``spans``: those and the candidates whose score passes
    the threshold of their kind and that overlap no base span; of overlapping candidates the best score stays, then
    the earliest. Both are arrays of ``s``, ``k`` (number of the kind), ``e``, in this order. ``n_<kind>`` counts base
    spans. All is worked out within the row, without a shuffle. Spans of one kind never overlap, so those that meet a
    span are found by halving; very long texts take little more than time in proportion. Precision and thresholds are
    measured against the rules that label the candidates, as there are no marked data.

    Null and empty texts have no spans. Repeated rows each give a row; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = _found(documents)
    kind_span = "array<struct<s:int,k:int,e:int>>"
    own, scored = [], []
    for i, kind in enumerate(KINDS):
        own.append(F.transform(f"ok_{kind}", lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))))
        least = model.thresholds.get(kind)
        if least is None:
            continue

        def score(x: Column) -> Column:
            return F.struct(model.raw(_features(kind, x)).alias("score"), x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))

        scored.append(F.filter(F.transform(f"wide_{kind}", score), lambda x: x["score"] >= least))
    base = F.array_sort(F.flatten(F.array(*own)).cast(kind_span))
    more = F.flatten(F.array(*scored)) if scored else F.array().cast("array<struct<score:double,s:int,k:int,e:int>>")
    rows = computed(rows, base=base, more=more)
    # base spans may overlap, but those of one kind do not; nor do candidates of one kind
    rows = computed(rows, **_by_kind("base"))
    free = F.filter("more", lambda x: ~_any(x, [f"_base_{i}" for i in range(len(KINDS))], lambda y: F.lit(True)))
    rows = computed(rows, free=free)
    rows = computed(rows, **_by_kind("free"))
    better = lambda x, y: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (F.struct(y["s"], y["k"]) < F.struct(x["s"], x["k"])))
    best = F.filter("free", lambda x: ~_any(x, [f"_free_{i}" for i in range(len(KINDS))], lambda y: better(x, y)))
    added = F.transform(best, lambda x: F.struct(x["s"], x["k"], x["e"])).cast(kind_span)
    return rows.select(
        "doc_id", *(F.size(f"ok_{k}").cast("long").alias(f"n_{k}") for k in KINDS), "base", F.array_sort(F.concat("base", added)).alias("spans")
    )


def spans_as_text(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(spans, lambda x: F.concat(F.get(name, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    return F.array_join(text, ",")
