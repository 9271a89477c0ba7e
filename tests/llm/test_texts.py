"""Tokenizer, mixing and repetition."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex

from ledgerloom.llm import mixing, queries, repetition
from ledgerloom.llm.tokenizer import PIECES, corpus_sizes, encode_corpus, encoder, vocabulary_path
from ledgerloom.session import table

from ..compare import assert_same
from ..conftest import DATA


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=encoder(vocabulary_path()).ranks, special_tokens={})


def test_tokens_of_all_documents(spark, reference):
    docs = table(spark, DATA, "documents")
    want = {r.doc_id: reference.encode_ordinary(r.text or "") for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in encode_corpus(docs).collect()} == want
    sizes = {r.doc_id: r.n_tokens for r in corpus_sizes(docs, ["doc_id"]).collect()}
    nulls = {r.doc_id for r in docs.where("text is null").select("doc_id").collect()}
    assert sizes == {k: None if k in nulls else len(v) for k, v in want.items()}


def test_tokens_of_odd_texts(reference):
    enc, rnd = encoder(vocabulary_path()), random.Random(2)
    parts = ["a", "b", "Word", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\f", "\xa0", "\x1c", "​", "'s", "'ll", "1", "22", "-", ".", "é", "é", "東京", "😀", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert enc.encode(text) == reference.encode_ordinary(text) and enc.count(text) == len(enc.encode(text)), repr(text)


def test_tokens_of_long_pieces(reference):
    enc, rnd = encoder(vocabulary_path()), random.Random(3)
    for text in ("a" * 30_000, "".join(rnd.choice("abcdeXYZ") for _ in range(30_000)), "東" * 3000, "ab" * 17, "-" * 999):
        assert enc.encode(text) == reference.encode_ordinary(text)
    whole = enc.encode("word " * 50_000)
    assert len(whole) == 50_001


def test_encode_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a", "z"), (3, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (2, []), (None, [64]), (3, [64, 275])], key=str)
    assert encode_corpus(df.limit(0)).count() == 0


def sizes_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def targets_frame(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mixture_shares(spark):
    rnd = random.Random(7)
    rows = [(i, "big", rnd.randint(1, 50)) for i in range(3000)] + [(10_000 + i, "mid", rnd.randint(1, 50)) for i in range(300)] + [(20_000 + i, "tiny", 10) for i in range(5)]
    rows += [(30_000, None, 40), (30_001, "unlisted", 60), (30_002, "big", None), (30_003, "mid", 0)]
    targets = targets_frame(spark, [("big", 0.4, 1), ("mid", 0.4, 9), ("tiny", 0.15, 3), ("none", 0.05, 2)])
    sizes = sizes_frame(spark, rows)
    total = sum(r[2] or 0 for r in rows)
    drawn = mixing.mix_sources(sizes, targets, {"mid": [(0, 0), (1, 1)]}).collect()
    by = Counter()
    for r in drawn:
        by[r.source] += r.n_tokens
    assert abs(by["big"] - 0.4 * total) <= 50 and abs(by["mid"] - 0.4 * total) <= 50
    assert by["tiny"] == 3 * 50 and set(by) == {"big", "mid", "tiny"}
    times = Counter((r.source, r.doc_id) for r in drawn)
    for source, most in (("big", 1), ("mid", 9), ("tiny", 3)):
        counts = [n for (s, _), n in times.items() if s == source]
        assert max(counts) <= most and max(counts) - min(counts) <= 1
    assert all((30_000 + i) not in {r.doc_id for r in drawn} for i in (0, 1, 2))
    positions = [r.position for r in drawn]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    # an increasing weight has half of its tokens after sqrt(1/2) of the time, an even one after half
    for source, middle in (("mid", math.sqrt(0.5)), ("big", 0.5)):
        early = sum(r.n_tokens for r in drawn if r.source == source and r.position < middle)
        assert early / by[source] == pytest.approx(0.5, abs=0.02)
    told = {r.source: r for r in mixing.shares(sizes, targets).collect()}
    assert {s: told[s].drawn_tokens for s in ("big", "mid", "tiny", "none")} == {"big": by["big"], "mid": by["mid"], "tiny": 150, "none": 0}
    assert told["tiny"].capped and told["none"].capped and not told["big"].capped
    assert told["mid"].reached_share == pytest.approx(by["mid"] / total, abs=1e-6)


def test_mixture_does_not_depend_on_partitions(spark):
    sizes = sizes_frame(spark, [(i, "s", 1 + i % 9) for i in range(500)])
    targets = targets_frame(spark, [("s", 0.5, 1), ("s", 0.5, 1)])
    a = [tuple(r) for r in mixing.mix_sources(sizes.repartition(1), targets).collect()]
    assert a == [tuple(r) for r in mixing.mix_sources(sizes.repartition(7), targets).collect()] and a


def test_mixture_of_nothing(spark):
    sizes, targets = sizes_frame(spark, [(1, "s", 5)]), targets_frame(spark, [("s", 1.0, 1)])
    assert mixing.mix_sources(sizes.limit(0), targets).count() == 0
    assert mixing.shares(sizes.limit(0), targets).first().drawn_tokens == 0
    assert mixing.mix_sources(sizes, targets.limit(0)).count() == 0
    assert mixing.mix_sources(sizes, targets_frame(spark, [("s", 1.0, 0)])).count() == 0
    for knots in ([(0, 1)], [(0, 0), (1, 0)], [(0, 1), (0.5, 1)], [(0, -1), (1, 1)]):
        with pytest.raises(ValueError):
            mixing.segments(knots)


def brute_repeated(text, run=8):
    words = regex.findall(r"\p{L}+", (text or "").lower())
    seen, hit = set(), set()
    for i in range(len(words) - run + 1):
        key = tuple(words[i : i + run])
        if key in seen:
            hit.update(range(i, i + run))
        seen.add(key)
    return len(words), len(hit)


def test_repetition_of_all_documents(spark):
    docs = table(spark, DATA, "documents")
    want = {r.doc_id: brute_repeated(r.text) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_words, r.n_repeated) for r in repetition.measure_repetition(docs, ["doc_id"]).collect()}
    assert got == want


def test_repetition_edge_cases(spark):
    texts = [None, "", " \n", "1 2 3", "a " * 7, "a " * 8, "a " * 9, "a b c d e f g h " * 2, "x é́y İ ς Σ", "one two three four five six seven eight. " * 20_000]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(8, texts[8], 2.0)], "doc_id bigint, text string, share double")
    got = sorted((r.doc_id, r.n_words, r.n_repeated) for r in repetition.measure_repetition(df, ["doc_id"]).collect())
    assert got == sorted((i, *brute_repeated(texts[i])) for i in [*range(len(texts)), 8])
    assert repetition.measure_repetition(df.limit(0), ["doc_id"]).count() == 0


def test_repetition_against_sql_where_runs_of_documents_look_alike(spark, tmp_path):
    """Equal texts of which every run is new: a word and a document of swapped numbers must not make a repetition. And letters whose lower case is longer or depends on their place."""
    import duckdb
    import pandas as pd

    alike = " ".join(f"a b c d e f g {'n' * (i + 1)}" for i in range(40))
    texts = [alike] * 240 + ["\u0130stanbul D\u0130Z\u0130 " * 9, "\u039f\u0394\u039f\u03a3 \u03bf\u03b4\u03bf\u03c2 \u03bf\u03b4\u03bf\u03c3 " * 9, "\u039f\u03a3 a b c d e f g. \u03bf\u03c3 a b c d e f g", None, ""]
    pd.DataFrame({"doc_id": range(len(texts)), "lang": "en", "text": texts}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = queries.p10_repetition(spark, str(tmp_path))
    assert_same(got, con, queries.oracle_sql()["p10_repetition"])
    assert got.where("doc_id < 240 and (n_words <> 320 or n_repeated <> 0)").count() == 0


def test_repeated_words_are_compared_themselves():
    run, row = [10, 11, 12, 13, 14, 15, 16], np.repeat([1, 2], 8)
    assert repetition.repeated_words(np.array([*run, 2, *run, 1]), row, 3).tolist() == [0, 0, 0]
    # a Thue-Morse sequence and its complement have one hash, whatever odd number it multiplies by
    a = np.array([i.bit_count() % 2 for i in range(2048)])
    apart = np.concatenate([a, [2], 1 - a])
    assert repetition.repeated_words(apart, np.zeros(len(apart), int), 1, run=2048).tolist() == [0]
    twice = np.concatenate([apart, [3], a])
    assert repetition.repeated_words(twice, np.zeros(len(twice), int), 1, run=2048).tolist() == [2048]


def test_binomial_bound():
    for errors, n in ((0, 50), (3, 100), (10, 40)):
        p = repetition.binomial_upper(errors, n, 0.05)
        below = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(errors + 1))
        assert below == pytest.approx(0.05, rel=1e-6)
    assert repetition.binomial_upper(0, 50, 0.05) == pytest.approx(1 - 0.05 ** (1 / 50))
    assert repetition.binomial_upper(0, 0, 0.05) == repetition.binomial_upper(4, 4, 0.05) == 1.0


def test_cutoffs_keep_their_promise(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(s), True) for s in rng.beta(1, 30, 3000)] + [("a", 0.9, False)] * 50 + [("few", 0.0, True)] * 10 + [(None, float(s), True) for s in rng.beta(1, 10, 3000)] + [("a", None, True), ("a", 0.5, None)]
    holdout = spark.createDataFrame(rows, "stratum string, share double, good boolean")
    grid = [0.3, 0.25, 0.2, 0.15, 0.1, 0.05]
    got = {r.stratum: r for r in repetition.risk_cutoffs(holdout, grid, 0.02, 0.05, 0.3).collect()}
    assert set(got) == {"a", "few", None} and not got["few"].proven and got["few"].cutoff == 0.3
    assert got["a"].proven and got["a"].cutoff < 0.3
    for s in ("a", None):
        if got[s].proven:
            scores = [r[1] for r in rows if r[0] == s and r[2] and r[1] is not None]
            assert got[s].false_rejects == sum(x >= got[s].cutoff for x in scores) and got[s].bound <= 0.02
    assert repetition.risk_cutoffs(holdout.limit(0), grid).count() == 0
    # the promise over fresh draws of good documents: the true rate is above the limit in few of them
    broken = 0
    for seed in range(200):
        scores = np.random.default_rng(seed).beta(1, 30, 400)
        best = None
        for c in sorted(grid, reverse=True):
            if repetition.binomial_upper(int((scores >= c).sum()), 400, 0.05) > 0.02:
                break
            best = c
        broken += best is not None and (1 - best) ** 30 > 0.02
    assert broken <= 0.05 * 200 + 10


def exact_upper(errors, n, level):
    """The same bound by exact integer tails and another search."""
    from fractions import Fraction

    def tail(p):
        p = Fraction(p)
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(errors + 1))

    step, at = Fraction(1, 2), Fraction(0)
    for _ in range(24):
        if tail(at + step) > level:
            at += step
        step /= 2
    return float(at)


def test_cutoffs_by_an_independent_computation(spark):
    """The cutoffs of all strata from plain counts and exact tails; they lie on both sides of 0.3."""
    rng = np.random.default_rng(6)
    rows = [("low", float(s), True) for s in rng.beta(1, 40, 400)] + [("high", float(s), True) for s in rng.beta(6, 14, 500)] + [("few", 0.1, True)] * 90 + [("low", 0.8, False)] * 30
    grid = [0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]
    got = {r.stratum: r for r in repetition.risk_cutoffs(spark.createDataFrame(rows, "stratum string, share double, good boolean"), grid, 0.03, 0.05).collect()}
    for stratum in ("low", "high", "few"):
        scores, want = [s for k, s, good in rows if k == stratum and good], (None, None)
        for c in grid:
            errors = sum(s >= c for s in scores)
            if exact_upper(errors, len(scores), 0.05 / 3) > 0.03:
                break
            want = (c, errors)
        r = got[stratum]
        assert (r.cutoff, r.false_rejects if r.proven else None) == want and r.n_good == len(scores)
        if r.proven:
            assert r.bound == pytest.approx(exact_upper(r.false_rejects, r.n_good, 0.05 / 3), abs=1e-6)
    assert got["low"].cutoff < 0.3 < got["high"].cutoff and not got["few"].proven


def test_labels_know_nothing_of_runs():
    s = "the court finds for the plaintiff on all counts"
    assert repetition.repeated_sentences(f"{s}. {s.upper()}!\n another matter was decided yesterday") == pytest.approx(len(s) / (2 * len(s) + 38), abs=0.02)
    assert repetition.repeated_sentences("") == repetition.repeated_sentences("Ja. Ja. Ja.") == 0.0
    assert repetition.repeated_sentences(" ".join(["one two three four five six seven eight nine"] * 5)) == 0.0  # one sentence, though its runs repeat


def test_decisions_follow_the_cutoffs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(700):
        fresh = [word() for _ in range(90)]
        again = fresh[: (i % 9) * 8]
        rows.append((i, " ".join(fresh + again), "aa"))
    rows += [(1000 + i, " ".join([word() for _ in range(20)] * 4), "rare") for i in range(3)] + [(2000, "a b " * 10, "aa"), (2001, None, "aa"), (2002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    told = lambda **k: {r.doc_id: r for r in repetition.find_repetitive(docs, **k)[0].collect()}
    by_risk, by_case, loose = told(), told(least_share=0.3), told(grid=[0.95, 0.9])
    rejected = lambda t: {k for k, r in t.items() if r.rejected}
    cases = {k for k, r in by_case.items() if r.n_words >= 40 and 10 * r.n_repeated >= 3 * r.n_words}
    # all these documents are good by their sentences, so the proven cutoff lies above the case's share and loses cases
    assert by_risk[8].cutoff > 0.3 and not rejected(by_risk) >= cases
    assert rejected(loose) < rejected(told(grid=[0.9, 0.2], most=0.9)) and not rejected(loose)
    assert rejected(by_case) >= cases and {1000, 1001, 1002} <= cases and by_case[1000].cutoff == 0.3
    assert not {2000, 2001, 2002} & rejected(by_case) and len(by_risk) == len(rows)


def test_find_repetitive_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, share double, cutoff double")
    measured, cutoffs = repetition.find_repetitive(none)
    assert measured.count() == cutoffs.count() == 0
