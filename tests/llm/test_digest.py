from hashlib import sha256

import numpy as np
from xxhash import xxh64_intdigest

from glyphmill.llm.digest import MOST_DIFFERENCE, compare_with_edits, difference, digest, digest_hex, likeness, op8_quartile_digest, with_successor_order


def plain_counts(data):
    counts = [0] * 128
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 25] += 1
    return counts


def test_codes_are_quartiles_of_triplet_counts():
    data = ("some words, repeated words, and more words " * 9).encode()
    counts = plain_counts(data)
    ranked = sorted(counts)
    codes = [sum(n > ranked[32 * k - 1] for k in (1, 2, 3)) for n in counts]
    assert digest(data)[3:].tolist() == codes


def test_difference_is_bounded_and_symmetric():
    rng = np.random.default_rng(0)
    some = [digest(rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (0, 2, 3, 50, 4000)]
    for a in some:
        assert difference(a, a) == 0 and likeness(a, a) == 1
        for b in some:
            assert difference(a, b) == difference(b, a) and 0 <= likeness(a, b) <= 1
    assert MOST_DIFFERENCE == 256 and digest_hex(some[0]) == "0" * 68


def brute(rows):
    """In descending order of doc_id, null last, then of the text's hash as a signed number."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1e18), signed(xxh64_intdigest(r[1].encode(), 42)), r[1]))
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        d = [digest(x.encode()) for x in (text, edited, after)]
        yield doc_id, len(text), sha256(edited.encode()).hexdigest(), digest_hex(d[0]), digest_hex(d[1]), likeness(d[0], d[1]), likeness(d[0], d[2])


def shown(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def test_query_against_brute_force(spark, sf, texts):
    assert shown(op8_quartile_digest(spark, sf).collect()) == shown(brute(list(texts.items())))


def test_odd_rows_against_brute_force(odd, spark):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]
    assert shown(compare_with_edits(odd).collect()) == shown(brute(rows))
    one = spark.createDataFrame([(4, "abcd", "x")], "doc_id long, text string, part string")
    assert shown(compare_with_edits(one).collect()) == shown(brute([(4, "abcd")]))


def test_edits_are_likelier_than_other_texts(spark, sf):
    rows = op8_quartile_digest(spark, sf).collect()
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows])


def test_an_id_of_a_third_of_all_rows_is_cut_into_parts(spark):
    rows = [(i if i % 3 else None, f"text {i * i} of many " * (i % 5)) for i in range(600)]
    found = compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string"))
    assert shown(found.collect()) == shown(brute(rows))
    parts = with_successor_order(spark.createDataFrame(rows, "doc_id long, text string")).filter("NOT guest AND doc_id IS NULL").groupBy("part").count().collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 150
