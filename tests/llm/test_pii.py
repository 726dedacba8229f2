import hashlib
import random
import re

from pyspark.sql import functions as F

from glyphmill.llm.pii import BASE_KINDS, KINDS, NUMBERS, features, fit, fit_reliabilities, op1_pii_weak_supervision, redact, with_base, with_candidates, with_spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), i, m.end()) for i, k in enumerate(BASE_KINDS) for m in re.finditer(PLAIN[k], text or "") if good(k, m[0]))


def test_base_spans_of_whole_texts(spark, sf, texts):
    rows = op1_pii_weak_supervision(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        joined = ",".join(f"{s}:{KINDS[k]}:{e}" for s, k, e in spans)
        shown = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), (r["doc_id"], joined)
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(shown.split(",")) - {""} <= set((r["spans"] or "").split(","))


def test_base_spans_of_random_strings(spark):
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "-", " ", "+", "1.2.3.4", "255", "256", "0", "12", "4111 1111 1111 1111", "+1 (2) 3-4567890", "x_y", "%", "é", "😀", "(", ")", "99999999999999999999"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in with_base(df).select("text", "_base").collect():
        assert [tuple(s) for s in r["_base"]] == brute(r["text"]), r["text"]


def test_reliabilities_tell_good_labelers_from_bad(spark):
    rng = random.Random(1)
    names, rates = ["sure", "fair", "weak"], [0.95, 0.8, 0.55]
    rows = []
    for _ in range(4000):
        y = 1 if rng.random() < 0.4 else -1
        rows.append((*(y if rng.random() < p else -y for p in rates), 1))
    patterns = spark.createDataFrame(rows, "sure int, fair int, weak int, n long").groupBy(*names).agg(F.sum("n").alias("n"))
    _, right = fit_reliabilities(patterns, names, 40)
    assert right["sure"] > right["fair"] > right["weak"]


def test_secrets_are_found_by_the_method(spark):
    rng = random.Random(5)
    token = lambda: "".join(rng.choice("0123456789abcdefABCDEFGHJKL") for _ in range(40))
    rows = [(i, f"settings\npassword = \"{token()}\"\nthe end of internationalisationstrategies") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [[KINDS[s["kind"]] for s in r["_spans"]] for r in with_spans(df).collect()]
    assert sum("secret" in s for s in spans) >= 55
    assert all(len(s) <= 1 for s in spans)


def test_redaction_keeps_rows_and_columns(odd):
    model = (-9.0, {"kind=4": 0.0})
    out = {(r["doc_id"], r["size"]): r for r in redact(odd, model).collect()}
    assert redact(odd, model).columns == odd.columns
    assert out[8, "size-8"]["text"] == "mail [EMAIL] or [PHONE], card [CARD], host [IP]"
    assert out[8, "size-8"]["n_chars"] == len(out[8, "size-8"]["text"])
    assert out[8, "size-8"]["_text"] == "_text-8"
    assert out[2, "size-2"]["text"] is None


def test_long_texts_of_many_spans(spark):
    """A text of 1 MB with 60,000 spans is located, freed of what overlaps, and redacted as the plain rules say."""
    rng = random.Random(9)
    line = lambda i: f"{i},{rng.randrange(10**9)},10.0.{i % 256}.7,u{i}@x.org,+49 {rng.randrange(10**10, 10**11)}"
    text = "\n".join(map(line, range(20_000)))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = (-9.0, {"kind=4": 0.0})
    (row,) = with_spans(df, model).select("_base", "_spans").collect()
    assert [tuple(s) for s in row["_base"]] == brute(text) and row["_spans"] == row["_base"]
    (out,) = redact(df, model).collect()
    assert out["text"].split("\n")[0].endswith("10.0.0.7,[EMAIL],[PHONE]".replace("10.0.0.7", "[IP]")) and out["text"].count("[EMAIL]") == 20_000


def plain_candidates(text):
    """Long tokens and number groups that touch no base span, by plain expressions."""
    base = brute(text)
    tokens = [(m.start(), 4, m.end()) for m in re.finditer(r"[A-Za-z0-9_+/=-]{20,}", text)]
    numbers = [(m.start(), 5, m.end()) for m in re.finditer(NUMBERS.replace("++", "+").replace(")*+", ")*"), text) if 7 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
    return [c for c in sorted(tokens) + sorted(numbers) if not any(b[0] < c[2] and c[0] < b[2] for b in base)]


def test_candidates_of_the_method_against_plain_expressions(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in with_candidates(df).select("doc_id", "_found").collect():
        text = texts[r["doc_id"]]
        assert [(c["start"], c["kind"], c["end"]) for c in r["_found"]] == plain_candidates(text), r["doc_id"]
        assert all(c["value"] == text[c["start"] : c["end"]] and text[: c["start"]].endswith(c["before"]) and text[c["end"] :].startswith(c["after"]) for c in r["_found"])


def test_added_spans_of_the_query_are_those_above_even_odds(spark, sf, documents):
    """The final classifier by hand: prior and weights of the features of each candidate, in plain sums."""
    prior, weights = fit(documents)
    found = with_candidates(documents).select("doc_id", F.explode("_found").alias("c"))
    want = {}
    for r in found.select("doc_id", "c", features(F.col("c")).alias("f")).collect():
        if prior + sum(weights.get(f, 0.0) for f in r["f"]) >= 0:
            want.setdefault(r["doc_id"], set()).add(f"{KINDS[r['c']['kind']]}:{r['c']['start']}:{r['c']['end']}")
    for r in op1_pii_weak_supervision(spark, sf).collect():
        added = {s for s in r["spans"].split(",") if s.split(":")[0] not in BASE_KINDS and s}
        assert added == want.get(r["doc_id"], set())
