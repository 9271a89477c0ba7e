"""Repetition inside a single document, and cutoffs with a controlled risk.

The measure: words in a run of eight consecutive words that has started before.
The labels: a document is good if hardly any of its text lies in sentences that stood
before, a second measure that knows no words and no runs. The cutoffs: one labelled half of the
documents gives, for each stratum, the lowest cutoff that is proven (exact binomial
bound, corrected for the number of strata) to reject at most a set share of the good
documents; the other half shows what it rejects there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, small, spread

#: Words of a run.
RUN = 8
#: Entries of a worker's table of words.
KEPT = 400_000
#: A good document has less than this share of its text in repeated sentences; shorter sentences (in characters) don't count.
TOLERATED, SENTENCE = 0.05, 20
#: Cutoffs that are tried, on both sides of any target.
GRID = [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05]

_LETTERS = regex.compile(r"\p{L}+")
_ENDS = re.compile(r"[.!?;:\r\n]+")


class _Words(dict):
    """Stretch between white space -> numbers of its words."""

    def __init__(self):
        super().__init__()
        self.number: dict[str, int] = {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        number = self.number
        got = tuple(number.setdefault(w, len(number)) for w in _LETTERS.findall(key))
        if len(key) <= 64:
            self[key] = got
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _lower(text: str) -> str:
    """Lower case letter by letter: a capital sigma ends no word and a dotted capital I stays one letter."""
    return text.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()


def _same_run(words: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, run: int) -> bool:
    """Whether the runs that start at ``a`` are those at ``b``, each in the same document."""
    return bool((doc[a] == doc[b]).all()) and all((words[a + k] == words[b + k]).all() for k in range(run))


def _started_before(words: np.ndarray, doc: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """Those of the ascending starts ``at`` whose run has started before in its document; no hash takes part."""
    number, group = np.unique(words, return_inverse=True)[1], doc[at]
    for k in range(run):  # starts of one group are alike in their document and k words
        group = np.unique(group * (number.max() + 1) + number[at + k], return_inverse=True)[1]
    return np.delete(at, np.unique(group, return_index=True)[1])


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int, run: int = RUN) -> np.ndarray:
    """Repeated words of each document; ``words`` are numbers, ``doc`` is the row of each, ascending.

    A 64-bit hash of their words and their document brings runs together; the words themselves are compared then.
    """
    n = len(words)
    if n <= run:
        return np.zeros(n_docs, np.int64)
    m, h = _mixed(words), np.zeros(n - run + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = h * np.uint64(0xD6E8FEB86659FD93) + m[k : n - run + 1 + k]
        same = np.nonzero(doc[: n - run + 1] == doc[run - 1 :])[0]
        h = _mixed(h[same] * np.uint64(0xD6E8FEB86659FD93) + _mixed(doc[same]))  # the document as one more word: a plain sum lets a word and a document of swapped numbers cancel out
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    before, again = same[order[:-1][equal]], same[order[1:][equal]]
    if not _same_run(words, doc, before, again, run):
        again = _started_before(words, doc, np.union1d(before, again), run)
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + run, -1)
    covered = np.cumsum(mark[:n]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def repeated_sentences(text: str) -> float:
    """Share of the characters of a text's sentences that lie in sentences which stood before (whitespace and case apart)."""
    seen: set[str] = set()
    total = again = 0
    for part in _ENDS.split(text.casefold()):
        sentence = " ".join(part.split())
        if len(sentence) < SENTENCE:
            continue
        total += len(sentence)
        if sentence in seen:
            again += len(sentence)
        seen.add(sentence)
    return again / total if total else 0.0


def measure_repetition(df: DataFrame, keep: list[str], text_col: str = "text", run: int = RUN, sentences: bool = False) -> DataFrame:
    """The columns ``keep``, n_words BIGINT, n_repeated BIGINT, share DOUBLE of every row, over whole texts.

    With ``sentences`` also sentence_share DOUBLE, see :func:`repeated_sentences`. A null, empty or wordless text has 0 words and share 0. Each row is measured on its own, so
    repeated rows repeat. One narrow pass without shuffle; other columns aren't read.
    """
    ship(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words()
        for batch in batches:
            last = batch.num_columns - 1
            texts = batch.column(last).to_pylist()
            n_words, n_repeated = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            flats, first, size = [], 0, 0
            for i, text in enumerate(texts):
                if text:
                    flats.append(np.fromiter(chain.from_iterable(map(table.__getitem__, _lower(text).split())), np.int64))
                else:
                    flats.append(np.empty(0, np.int64))
                n_words[i] = len(flats[-1])
                size += len(flats[-1])
                if size > 1_000_000 or i == len(texts) - 1:  # bounds the arrays of one step
                    part = n_words[first : i + 1]
                    n_repeated[first : i + 1] = repeated_words(np.concatenate(flats), np.repeat(np.arange(len(part)), part), len(part), run)
                    flats, first, size = [], i + 1, 0
                    if len(table) > KEPT or len(table.number) > KEPT:
                        table = _Words()
            share = np.divide(n_repeated, n_words, out=np.zeros(len(texts)), where=n_words > 0)
            more = [pa.array([repeated_sentences(t) if t else 0.0 for t in texts], pa.float64())] if sentences else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(n_words), pa.array(n_repeated), pa.array(share), *more], [*keep, "n_words", "n_repeated", "share", "sentence_share"][: last + 3 + len(more)])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    kinds += ", n_words bigint, n_repeated bigint, share double" + (", sentence_share double" if sentences else "")
    return spread(df.select(*[df[c] for c in keep], df[text_col].alias("__text"))).mapInArrow(rows, kinds)


def binomial_upper(errors: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate, one-sided, that is wrong with probability ``level`` at most."""
    if n <= 0 or errors >= n:
        return 1.0
    ks = np.arange(errors + 1)
    comb = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in ks])

    def below(p: float) -> float:
        logs = comb + ks * math.log(p) + (n - ks) * math.log1p(-p)
        top = logs.max()
        return math.exp(top) * float(np.exp(logs - top).sum())

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) > level else (low, mid)
    return high


def risk_cutoffs(holdout: DataFrame, grid: list[float], most: float = 0.02, level: float = 0.05, fallback: float | None = None) -> DataFrame:
    """stratum, cutoff, n_good, false_rejects, bound, proven, other_good, other_rejects.

    ``holdout``: stratum STRING (null is a stratum of its own), share DOUBLE, good BOOLEAN; rows with
    a null among share and good are left out. Rows whose ``fit`` (if there is such a column) is false take no part
    in the choice; other_good and other_rejects count the good ones among them and those the cutoff rejects. A document
    is rejected if its share reaches the cutoff. Cutoffs are tested from the highest down and the first that fails ends
    the stratum's sequence, which needs no correction within it; the level is divided by the number of strata (Bonferroni).
    A stratum where even the highest isn't proven gets ``fallback`` (None: no cutoff) and proven false.
    Counts are taken by partial aggregation, each stratum's sequence is one small group.
    """
    steps = sorted(set(map(float, grid)), reverse=True)
    holdout = holdout if "fit" in holdout.columns else holdout.withColumn("fit", F.lit(True))
    good = holdout.where("good and share is not null")
    # the number of cutoffs at or below the share, so one count a stratum and number is enough
    rank = sum((F.col("share") >= F.lit(c)).cast("int") for c in steps)
    counts = good.groupBy("stratum", "fit", rank.alias("reached")).agg(F.count("*").alias("n"))
    strata = holdout.agg(F.count_distinct(F.coalesce("stratum", F.lit("\0"))).alias("strata"))
    counts = holdout.select("stratum").distinct().withColumns({"fit": F.lit(True), "reached": F.lit(0), "n": F.lit(0).cast("bigint")}).unionByName(counts).crossJoin(strata)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        fit, other = pdf[pdf["fit"]], pdf[~pdf["fit"]]
        n_good = int(fit["n"].sum())
        at = level / max(1, int(pdf["strata"].iloc[0]))
        best = None
        for i, c in enumerate(steps):
            errors = int(fit.loc[fit["reached"] >= len(steps) - i, "n"].sum())
            bound = binomial_upper(errors, n_good, at)
            if bound > most:
                break
            best = (c, errors, bound)
        cutoff = best[0] if best else fallback
        reached = sum(c <= cutoff for c in steps) if cutoff is not None else len(steps) + 1
        rejects = int(other.loc[other["reached"] >= reached, "n"].sum())
        row = (pdf["stratum"].iloc[0], cutoff, n_good, *(best[1:] if best else (0, 1.0)), best is not None, int(other["n"].sum()), rejects)
        return pd.DataFrame([row], columns=["stratum", "cutoff", "n_good", "false_rejects", "bound", "proven", "other_good", "other_rejects"]).astype({"cutoff": float})

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, cutoff double, n_good bigint, false_rejects bigint, bound double, proven boolean, other_good bigint, other_rejects bigint")


def labelled(measured: DataFrame, id_col: str, least_words: int) -> DataFrame:
    """stratum, share, good, fit of every measured document of at least ``least_words`` words; ``fit`` halves them by hash of the id."""
    half = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("holdout")), 63) == 0
    return measured.where(F.col("n_words") >= least_words).select("stratum", "share", (F.col("sentence_share") < TOLERATED).alias("good"), half.alias("fit"))


def find_repetitive(docs: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", least_words: int = 40, least_share: float | None = None, grid: list[float] | None = None, most: float = 0.02, level: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(measures with the stratum's cutoff and the decision, cutoffs).

    Measures: id, stratum, n_words, n_repeated, share, sentence_share, cutoff, rejected: of every document. Rejected are
    those of at least ``least_words`` words whose share reaches the cutoff of their stratum; in a stratum without a proven
    cutoff none is. ``least_share`` is a share at which documents are to be rejected whatever the risk: no cutoff is then
    above it. Cutoffs: see :func:`risk_cutoffs`. An empty table gives no rows.
    """
    kept = cut(measure_repetition(docs.select(docs[id_col], docs[stratum_col].cast("string").alias("stratum"), docs["text"]), [id_col, "stratum"], sentences=True))
    cutoffs = cut(risk_cutoffs(labelled(kept, id_col, least_words), grid or GRID, most, level))
    limit = F.least("cutoff", F.lit(least_share))  # nulls are skipped
    out = kept.join(small(cutoffs.select(F.col("stratum").alias("s"), limit.alias("cutoff"))), F.col("stratum").eqNullSafe(F.col("s")), "left").drop("s")
    rejected = (F.col("n_words") >= least_words) & F.coalesce(F.col("share") >= F.col("cutoff"), F.lit(False))
    return out.withColumn("rejected", rejected), cutoffs
