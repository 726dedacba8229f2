"""Personal data by weak supervision, in DataFrame functions throughout.

Base spans come from exact patterns with checks. Further candidates (long tokens and number groups) get votes
of regex, gazetteer and context labelers; expectation-maximisation over the counted vote patterns estimates
each labeler's reliability; its posteriors train a final span classifier over the span's features.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import staged, text_or_empty

#: Kinds in their order; those after phone are found by the method.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE_KINDS = KINDS[:4]

#: The contract's patterns, in forms that a text of any length passes in linear time: a look-behind (or the end
#: of the match before) keeps a failed run of characters from being tried again from each of them.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates of the method: tokens of 20 and more characters, and groups of digits.
TOKENS = r"(?=[A-Za-z0-9_+/=-])(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"
NUMBERS = r"(?=[0-9(])(?<![0-9A-Za-z.,+-])\(?[0-9]++(?:\)?[\x20.-][0-9]++)*+(?![0-9A-Za-z])"
#: Words that name personal data or secrets before a span.
GAZETTEER = ("account", "apikey", "api_key", "auth", "bearer", "call", "card", "credential", "iban", "id", "key", "password", "passwd", "phone", "pin", "pwd", "secret", "ssn", "tel", "token")
CONTEXT = 24
ROUNDS = 15
ACCEPT = 0.5
#: Code points of a text that are cut out of one piece of it, so that a cut does not walk the whole text.
CHUNK = 4096
_FAR = (1 << 31) - 1


# Spans are located in SQL text: it is parsed at once, where nested column functions are built call by call.


def _once(value: str, name: str, body: str) -> str:
    """body of a value that is evaluated once, under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _swept(items: str, first: int, value: Callable[[str], str], combine: Callable[[str, str], str], keep: Callable[[str, str], str], emit: Callable[[str, str], str], kind: str) -> str:
    """array of emit(at, item) of the items that keep(at, item), where at combines the values of all items before.

    Works in blocks of the square root of the number of items: what enters each block comes from the blocks'
    totals, and results are appended within a block only, so that long arrays are not copied over and over.
    """
    width = "CAST(ceil(sqrt(size(xs))) AS INT)"
    blocks = f"transform(sequence(0, CAST(floor((size(xs) - 1) / {width}) AS INT)), k -> slice(xs, k * {width} + 1, {width}))"
    totals = f"transform(bs, b -> aggregate(b, {first}, (a, x) -> {combine('a', value('x'))}))"
    enters = f"aggregate(slice(p.totals, 1, k), {first}, (a, c) -> {combine('a', 'c')})"
    step = f"named_struct('at', {combine('d.at', value('x'))}, 'out', if({keep('d.at', 'x')}, concat(d.out, array({emit('d.at', 'x')})), d.out))"
    run = f"flatten(transform(p.blocks, (b, k) -> aggregate(b, named_struct('at', {enters}, 'out', CAST(array() AS {kind})), (d, x) -> {step}, d -> d.out)))"
    inner = _once(blocks, "bs", _once(f"named_struct('blocks', bs, 'totals', {totals})", "p", run))
    return _once(items, "xs", f"if(size(xs) > 0, {inner}, CAST(array() AS {kind}))")


_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def located(text: str, pattern: str, fine: Callable[[str], str] = lambda value: "true") -> str:
    """Leftmost non-overlapping matches whose value is fine: code points, end exclusive, and what stands around them."""
    near = lambda s: f"coalesce(substring({s}, -{CONTEXT}, {CONTEXT}), '')"
    items = (
        "transform(hits, (h, i) -> named_struct('gap', length(get(gaps, i)), 'value', h,"
        f" 'before', substring(concat({near('get(hits, i - 1)')}, {near('get(gaps, i)')}), -{CONTEXT}, {CONTEXT}),"
        " 'after', substring(concat(substring(get(gaps, i + 1), 1, 4), coalesce(substring(get(hits, i + 1), 1, 4), '')), 1, 4)))"
    )
    width = lambda x: f"{x}.gap + length({x}.value)"
    span = lambda at, x: f"named_struct('start', {at} + {x}.gap, 'end', {at} + {width(x)}, 'value', {x}.value, 'before', {x}.before, 'after', {x}.after)"
    spans = _swept(items, 0, width, lambda a, b: f"{a} + {b}", lambda at, x: fine(f"{x}.value"), span, _SPANS)
    some = _once(f"split({text}, r'{pattern}', -1)", "gaps", spans)
    return _once(f"regexp_extract_all({text}, r'{pattern}', 0)", "hits", f"if(size(hits) > 0, {some}, CAST(array() AS {_SPANS}))")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "ip":
        bare = "regexp_replace(q, '^0+', '')"
        return f"forall(split({value}, r'\\.'), q -> length({bare}) <= 3 AND coalesce(try_cast(substring({bare}, 1, 4) AS INT), 0) <= 255)"
    if kind == "card":
        digit = "CAST(substring(r, i + 1, 1) AS INT)"
        luhn = _once(f"reverse({digits})", "r", f"aggregate(sequence(0, length(r) - 1), 0, (a, i) -> a + if(i % 2 = 1, 2 * {digit} - if({digit} > 4, 9, 0), {digit})) % 10 = 0")
        return f"if(length({digits}) BETWEEN 14 AND 19, {luhn}, false)"
    return f"length({digits}) BETWEEN 10 AND 15" if kind == "phone" else "true"


_BASE = "array<struct<start:int,kind:int,end:int>>"
_MARKED = "array<struct<start:int,what:int,end:int,value:string,before:string,after:string>>"
_CANDIDATES = "array<struct<start:int,kind:int,end:int,value:string,before:string,after:string>>"


def with_base(docs: DataFrame) -> DataFrame:
    """docs with _base: base spans as array<struct<start, kind (index), end>>, in order."""
    guard = {"email": "contains(_text, '@')", "phone": "contains(_text, '+')"}

    def checked(kind: str) -> str:
        named = f"transform({located('_text', PATTERNS[kind], lambda v: _valid(kind, v))}, s -> named_struct('start', s.start, 'kind', {BASE_KINDS.index(kind)}, 'end', s.end))"
        return f"if({guard.get(kind, 'true')}, {named}, CAST(array() AS {_BASE}))"

    return docs.withColumn("_text", text_or_empty()).withColumn("_base", F.expr(f"array_sort(concat({', '.join(map(checked, BASE_KINDS))}))"))


def _candidates(kind: str) -> str:
    """Candidates of _text that touch no span of _base, with what stands around them.

    Base spans and candidates are swept together by start, once forwards (does a base span before reach in?) and once
    backwards (does one after begin too early?).
    """
    fine = (lambda v: f"length(regexp_replace({v}, '[^0-9]', '')) BETWEEN 7 AND 19") if kind == "number" else (lambda v: "true")
    base = "transform(_base, s -> named_struct('start', s.start, 'what', 0, 'end', s.end, 'value', CAST(NULL AS STRING), 'before', CAST(NULL AS STRING), 'after', CAST(NULL AS STRING)))"
    own = "transform(cs, s -> named_struct('start', s.start, 'what', 1, 'end', s.end, 'value', s.value, 'before', s.before, 'after', s.after))"
    larger, smaller = (lambda a, b: f"greatest({a}, {b})"), (lambda a, b: f"least({a}, {b})")
    forth = _swept(f"array_sort(concat({base}, {own}))", 0, lambda x: f"if({x}.what = 0, {x}.end, 0)", larger, lambda at, x: f"{x}.what = 0 OR {at} <= {x}.start", lambda at, x: x, _MARKED)
    back = _swept(f"reverse({forth})", _FAR, lambda x: f"if({x}.what = 0, {x}.start, {_FAR})", smaller, lambda at, x: f"{x}.what = 1 AND {at} >= {x}.end", lambda at, x: x, _MARKED)
    free = f"if(size(_base) > 0, reverse({back}), {own})"
    named = f"transform({free}, s -> named_struct('start', s.start, 'kind', {KINDS.index(kind)}, 'end', s.end, 'value', s.value, 'before', s.before, 'after', s.after))"
    return _once(located("_text", TOKENS if kind == "secret" else NUMBERS, fine), "cs", f"if(size(cs) > 0, {named}, CAST(array() AS {_CANDIDATES}))")


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs with _base and _found, the method's candidates."""
    return with_base(docs).withColumn("_found", F.expr(f"concat({_candidates('secret')}, {_candidates('number')})"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def labelers(c: Column) -> dict[str, Column]:
    """Votes of each labeler on a candidate: 1 for, -1 against, 0 for none."""
    value, before, after = c["value"], c["before"], c["after"]
    number = c["kind"] == KINDS.index("number")
    digits = F.length(_digits(value))
    nothing = F.lit(False)
    return {
        "regex_hex": _vote(value.rlike("^[0-9a-fA-F]{32,}$") & value.rlike("[0-9]"), nothing),
        "regex_mixed": _vote(~number & value.rlike("[0-9]") & value.rlike("[A-Za-z]"), ~number & ~value.rlike("[0-9]")),
        "regex_groups": _vote(number & digits.between(9, 16) & value.rlike("[ ().-]"), number & ~digits.between(9, 16)),
        "gazetteer": _vote(F.lower(before).rlike(r"\b(?:" + "|".join(GAZETTEER) + r")\b"), nothing),
        "context_assigned": _vote(before.rlike("[=:#][ \"']*$"), before.rlike("[A-Za-z,] $")),
        "context_quoted": _vote(before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), nothing),
        "context_prose": _vote(nothing, ~value.rlike("[0-9]") | value.rlike("^[-_=+/]+$")),
    }


def features(c: Column) -> Column:
    """Names of a candidate's features, one value of each."""
    value = c["value"]
    length = F.least(F.floor(F.log2(F.length(value))), F.lit(8)).cast("int")
    share = F.floor(F.length(_digits(value)) * 4 / F.length(value)).cast("int")
    case = F.when(~value.rlike("[A-Za-z]"), "none").when(~value.rlike("[A-Z]"), "lower").when(~value.rlike("[a-z]"), "upper").otherwise("both")
    near = lambda x: F.when(x == "", "edge").when(x.rlike("[\"'`]"), "quote").when(x.rlike("[=:#]"), "assign").when(x.rlike(r"\s"), "space").otherwise("other")
    return F.array(
        F.concat(F.lit("kind="), c["kind"].cast("string")),
        F.concat(F.lit("length="), length.cast("string")),
        F.concat(F.lit("digits="), share.cast("string")),
        F.concat(F.lit("case="), case),
        F.concat(F.lit("hex="), value.rlike("^[0-9a-fA-F]+$").cast("string")),
        F.concat(F.lit("left="), near(F.substring(c["before"], -1, 1))),
        F.concat(F.lit("right="), near(F.substring(c["after"], 1, 1))),
    )


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def fit_reliabilities(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, float]]:
    """Prior log-odds and each labeler's log-odds of voting right, by expectation-maximisation.

    patterns: one row per vote pattern, a column per labeler, and n, its candidates; at most three to the
    power of the labelers, whatever the corpus. Only the estimates come to the driver.
    """
    prior, right = 0.0, dict.fromkeys(names, log(0.8 / 0.2))
    for _ in range(rounds):
        q = _sigmoid(F.lit(prior) + sum((F.col(k) * F.lit(right[k]) for k in names), F.lit(0.0)))
        agrees = [F.sum(F.col("n") * F.when(F.col(k) == 1, q).when(F.col(k) == -1, 1 - q).otherwise(0.0)).alias(f"a_{k}") for k in names]
        votes = [F.sum(F.col("n") * F.abs(k)).alias(f"v_{k}") for k in names]
        row = patterns.agg(F.sum(F.col("n") * q).alias("q"), F.sum("n").alias("n"), *agrees, *votes).first()
        if not row["n"]:
            break
        share = (row["q"] + 1) / (row["n"] + 2)
        prior = log(share / (1 - share))
        for k in names:
            a = min(0.99, max(0.51, (row[f"a_{k}"] + 4) / (row[f"v_{k}"] + 5)))
            right[k] = log(a / (1 - a))
    return prior, right


def fit(docs: DataFrame) -> tuple[float, dict[str, float]]:
    """The span classifier: its prior log-odds and the weight of each feature value, from all of docs."""
    found = with_candidates(docs.select("text")).select(F.explode("_found").alias("c"))
    votes = labelers(F.col("c"))
    counted = staged(found.select(*[v.alias(k) for k, v in votes.items()], features(F.col("c")).alias("features")).groupBy(*votes, "features").agg(F.count("*").alias("n")), "pii-votes")
    names = list(votes)
    prior, right = fit_reliabilities(counted.groupBy(*names).agg(F.sum("n").alias("n")), names)
    q = _sigmoid(F.lit(prior) + sum((F.col(k) * F.lit(right[k]) for k in names), F.lit(0.0)))
    each = counted.select(F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature"), (F.col("n") * q).alias("yes"), (F.col("n") * (1 - q)).alias("no"))
    sums = {r["feature"]: (r["yes"], r["no"]) for r in each.groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()}
    yes, no = sums.pop("", (0.0, 0.0))
    weights = {f: log((a + 0.5) / (yes + 1)) - log((b + 0.5) / (no + 1)) for f, (a, b) in sums.items()}
    return log((yes + 1) / (no + 1)), weights


def _score(c: Column, model: tuple[float, dict[str, float]]) -> Column:
    prior, weights = model
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return _sigmoid(F.aggregate(features(c), F.lit(float(prior)), lambda a, f: a + F.coalesce(table[f], F.lit(0.0))))


def with_spans(docs: DataFrame, model: tuple[float, dict[str, float]] | None = None) -> DataFrame:
    """docs with _text (never null), _base and _spans: base spans and those that the classifier accepts.

    Spans are structs of start, kind (its index in KINDS) and end, in code points, end exclusive, by start and
    then kind. Null text counts as empty; null ids, repeated rows, empty tables and other columns stay as they
    are (columns of these three names are replaced).
    """
    model = model or fit(docs)
    found = with_candidates(docs)
    added = F.transform(F.filter("_found", lambda c: _score(c, model) >= ACCEPT), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.withColumn("_added", added).withColumn("_spans", F.array_sort(F.concat("_base", "_added"))).drop("_found", "_added")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: tuple[float, dict[str, float]] | None = None) -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; overlapping spans become one, of the first.

    n_chars, where it is there, becomes the new length of changed texts; null texts stay null; other columns
    stay as they are, whatever their names.
    """
    found = with_spans(docs.select("text", F.struct("*").alias("_row")), model)
    names = f"array({', '.join(f"'[{k.upper()}]'" for k in KINDS)})"
    at = lambda x: f"CAST(floor({x} / {CHUNK}) AS INT)"
    cut = lambda a, b: f"substring(array_join(slice(chunks, {at(a)} + 1, greatest(0, {at(f'({b} - 1)')} - {at(a)} + 1)), ''), {a} - {at(a)} * {CHUNK} + 1, greatest(0, {b} - {a}))"
    pieces = _swept(
        "_spans", 0, lambda s: f"{s}.end", lambda a, b: f"greatest({a}, {b})", lambda at, s: f"{s}.start >= {at}",
        lambda at, s: f"concat({cut(at, f'{s}.start')}, get({names}, {s}.kind))", "array<string>",
    )
    rest = "aggregate(_spans, 0, (a, s) -> greatest(a, s.end))"
    whole = F.expr(_once(f"regexp_extract_all(_text, r'(?s).{{1,{CHUNK}}}', 0)", "chunks", f"concat(array_join({pieces}, ''), {_once(rest, 'z', cut('z', 'length(_text)'))})"))
    changed = F.size("_spans") > 0
    out = found.select("_row", changed.alias("_changed"), F.when(changed, whole).otherwise(F.col("text")).alias("_new"))
    length = F.when(F.col("_changed"), F.length("_new").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None
    own = {"text": F.col("_new"), "n_chars": length}
    return out.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op1_pii_weak_supervision(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(docs)

    def number(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))
