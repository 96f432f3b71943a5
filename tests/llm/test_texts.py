from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from sightline.llm import mixing, packing, tokens, truncation

DOC = "doc_id long, text string, source string, tokens int, piece int, rank int, start int, _v int, _b int, block int, body string, word string, uses int, h1 int"
pytestmark = pytest.mark.skipif(not Path(tokens.DEFAULT_VOCABULARY).exists(), reason="no vocabulary")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0, 0, 0, 0, 0, 0, "b", "w", 0, 0) for i, t, s in rows], DOC)


def size(text):
    return len(tokens.encoder().encode_ordinary(text))


def test_plan_packs_places_everything():
    rng = np.random.default_rng(0)
    histogram = Counter(int(x) for x in rng.integers(1, 101, 5000))
    plan = packing.plan_packs(histogram, 100)
    placed = Counter()
    for pattern, count in plan:
        assert sum(pattern) <= 100
        for length in pattern:
            placed[length] += count
    assert placed == histogram
    packs = sum(c for _, c in plan)
    assert packs <= 1.02 * sum(k * n for k, n in histogram.items()) / 100 + 1
    with pytest.raises(ValueError):
        packing.plan_packs({101: 1}, 100)


def test_packing(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 500, "a"), (4, "x" * 20_000, "a"), *[(i, "some words here", "b") for i in range(5, 60)], (60, "one two three " * 40, None)]
    packed = packing.pack_documents(docs(spark, rows), 64).collect()
    full, whole = defaultdict(int), defaultdict(int)
    for r in packed:
        full[r["container"]] += r["tokens"]
        whole[r["doc_id"]] += r["tokens"]
    assert max(full.values()) <= 64
    assert dict(whole) == {i: size(t) for i, t, _ in rows if t}
    pieces = Counter(r["doc_id"] for r in packed)
    assert all(pieces[i] == -(-size(t) // 64) for i, t, _ in rows if t)
    assert {r["doc_id"] for r in packing.oversized_documents(docs(spark, rows), 64).collect()} == {i for i, t, _ in rows if t and size(t) > 64}
    report = packing.fill_report(packing.pack_documents(docs(spark, rows), 64), 64).first()
    assert report["tokens"] == sum(whole.values()) and report["containers"] == len(full)
    assert packing.pack_documents(docs(spark, []), 64).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 5):
            out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(out.tolist()) == list(range(n))


def test_drawn_shares():
    assert mixing.drawn_shares([0.5, 0.3, 0.2], [900, 900, 900], 1000) == ([0.5, 0.3, 0.2], set())
    (a, b, c), short = mixing.drawn_shares([0.5, 0.3, 0.2], [900, 900, 100], 1000)
    assert short == {2} and c == 0.1 and abs(a / b - 5 / 3) < 1e-9 and abs(a + b + c - 1) < 1e-9
    # one that fills its own share but not its part of the rest is short as well
    (a, b, c), short = mixing.drawn_shares([0.5, 0.3, 0.2], [520, 2000, 0], 1000)
    assert short == {0, 2} and c == 0 and a == 0.52 and abs(b - 0.48) < 1e-9
    assert mixing.drawn_shares([0.5, 0.5], [100, 100], 1000) == ([0.1, 0.1], {0, 1})


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 16)
    rows = [(i, "many words in a row " * 4, " Big ") for i in range(200)] + [(i, "few words", "small") for i in range(200, 210)] + [(300, None, "small"), (301, "x", None), (302, "other text", "other")]
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("none", 0.2, 4)], "source string, target_share double, max_uses int")
    mixed, report = mixing.mix(docs(spark, rows), targets)
    got = {r["source"]: r for r in report.collect()}
    total = sum(size(t) for _, t, _ in rows if t)
    small = sum(size(t) for _, t, s in rows if t and s == "small")
    assert got["small"]["short"] and got["none"]["short"] and not got["big"]["short"]
    assert got["small"]["mixed_tokens"] == 3 * small and got["none"]["mixed_tokens"] == 0
    # big takes the place of the sources that cannot fill their share: the mix is as large as asked
    assert abs((got["big"]["mixed_tokens"] + 3 * small) / total - 1) < 0.05
    assert got["small"]["ran_out"] and got["none"]["ran_out"] and not got["big"]["ran_out"]
    assert abs(sum(r["reached_share"] for r in got.values()) - 1) < 1e-9
    uses = mixed.groupBy("source", "doc_id", "first_token").count().collect()
    assert all(r["count"] <= {"big": 2, "small": 3}[r["source"]] for r in uses)
    odd = spark.createDataFrame([("big", None, 2), ("small", 0.4, None)], targets.schema)
    assert mixing.mix(docs(spark, rows), odd)[0].count() == 0
    assert mixing.mix(docs(spark, rows), odd.limit(0))[1].count() == 0
    assert mixing.mix(docs(spark, []), targets)[1].where("reached_share > 0").count() == 0


def test_truncation(spark):
    whole = [f"The shelf {w} holds {n} boxes and the lid is closed." for w in ("alpha", "beta", "gamma", "delta") for n in range(40)]
    rows = [(i, t, "notes") for i, t in enumerate(whole)]
    rows += [(500, "The shelf beta holds 17 boxes and the li", " NOTES "), (501, "The shelf beta holds 17 boxes and the li", "notes"), (502, "The shelf gamma holds 3 boxes and", "notes"), (503, "Inventory of room five", "notes")]
    rows += [(504, None, "notes"), (505, "", "notes"), (506, "  ", "notes"), (507, "The shelf beta holds 9 boxes and the lid is � ".strip() + "�", "notes"), (508, "The shelf is closed…", None)]
    limited = [(600 + i, ("The same lamp was seen on the table number %04d today and it was bright" % (i * 37))[: 40] + "...", "tickets") for i in range(8)]
    open_end = [(700 + i, "A lamp was seen " + "yet " * i + "...", "tickets") for i in range(1, 6)]
    judged = {r["doc_id"]: r["truncated"] for r in truncation.judged_texts(docs(spark, rows + limited + open_end)).collect()}
    cut = {i for i, x in judged.items() if x}
    assert cut == {500, 501, 502, 507} | {i for i, _, _ in limited}
    assert len(judged) == len(rows) + len(limited) + len(open_end)
    shares = {r["source"]: r for r in truncation.truncation_by_source(docs(spark, rows)).collect()}
    assert shares["notes"]["truncated"] == 4
    assert truncation.judged_texts(docs(spark, [])).count() == 0


def test_longer_copy_overrules_a_title(spark):
    whole = [f"Nothing was moved: the box {n} is still on shelf {w}." for w in ("alpha", "beta", "gamma") for n in range(30)]
    rows = [(i, t, "notes") for i, t in enumerate(whole)]
    rows += [(500, "Nothing was moved", "notes"), (501, "Nothing was moved", "notes"), (502, "Inventory of room five", "notes")]
    # titles of which one goes on after a word that ends others
    rows += [(510 + i, t, "notes") for i, t in enumerate(("Contents of the annex", "Contents of the annex and the attic", "Plan of the annex", "Keys of the annex", "Boxes in the attic", "Plan of the attic", "Keys of the attic"))]
    judged = {r["doc_id"]: r["truncated"] for r in truncation.judged_texts(docs(spark, rows)).collect()}
    assert {i for i, x in judged.items() if x} == {500, 501}


def test_longer_copies_are_all_found(spark):
    rng = np.random.default_rng(2)
    texts = sorted({"".join(rng.choice(list("ab"), int(n))) for n in rng.integers(1, 9, 400)} | {"é" * 3, "é" * 5, "z" * 100_000, "z" * 100_001})
    found = truncation.longer_copies(spark.createDataFrame([(t,) for t in texts], "body string").repartition(5))
    want = sum(any(u != t and u.startswith(t) for u in texts) for t in texts)
    assert found.count() == want


def test_a_continuation_inside_the_word_is_seen_behind_others(spark):
    texts = ["the foo ba", "the foo ba!", "the foo ba and more", "the foo bar and more", "x", "x y", "x-y", "une \u00e9", "une \u00e9, deux", "une \u00e9t\u00e9"]
    found = truncation.longer_copies(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "body string, n int").repartition(3).select("body"))
    by_hash = {r["h1"]: r["goes_on"] for r in found.collect()}
    hashes = {r["body"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "body string").selectExpr("body", "xxhash64(body) AS h").collect()}
    assert {t: by_hash[h] for t, h in hashes.items() if h in by_hash} == {"the foo ba": "r", "x": " ", "une \u00e9": "t"}


def test_long_last_words_and_lines(spark):
    long = "w" * 1000
    rows = [(1, f"ends in {long}", "a"), (2, f"first\n{long} {long} end", "a"), (3, long, "a"), (4, f"{long}\u00a0\n \t", "a"), (5, "x" * 300 + "\nGreta 12", "a")]
    judged = truncation.judged_texts(docs(spark, rows))
    assert judged.count() == 5 and judged.where("truncated is null").count() == 0
