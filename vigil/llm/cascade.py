"""Quality rules as a short-circuit cascade.

Each rule is a predicate over lazily computed text features.  A hashed
sample of the documents measures, per rule, the share of documents it
rejects and the time it takes; rules then run in descending order of
rejections per cost and the first rejection ends a document's evaluation.
The verdict (no rule rejects) does not depend on the order, so it is the
same whatever the sample measured.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import release, utf8

#: Characters counted as symbols, white space bytes, window length.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
WINDOW = 8


class Features:
    """Features of one text, each computed when a rule first asks for it."""

    def __init__(self, raw: bytes):
        self._raw = raw
        self._got: dict[str, object] = {}

    def _once(self, name: str, fn: Callable[[], object]):
        if name not in self._got:
            self._got[name] = fn()
        return self._got[name]

    @property
    def words(self) -> list[bytes]:
        return self._once("words", self._raw.split)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        """Code points inside words."""
        return self._once("word_chars", lambda: len(self._raw.decode("utf-8", "replace"))
                          - sum(self._raw.count(bytes([s])) for s in SPACE))

    @property
    def n_symbols(self) -> int:
        return self._once("n_symbols", lambda: sum(self._raw.count(bytes([s])) for s in SYMBOLS))

    def _lines(self) -> tuple[int, int]:
        seen: set[bytes] = set()
        filled = 0
        for line in self._raw.split(b"\n"):
            if line.strip(SPACE):
                filled += 1
                seen.add(line)
        return filled, filled - len(seen)

    @property
    def n_lines(self) -> int:
        """Lines that hold a word."""
        return self._once("lines", self._lines)[0]

    @property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        return self._once("lines", self._lines)[1]

    @property
    def n_repeat_words(self) -> int:
        """Words inside 8-word windows that occur at least twice."""
        return self._once("n_repeat", lambda: repeated_words(self.words))


def repeated_words(words: Sequence[bytes], width: int = WINDOW) -> int:
    """Words covered by ``width``-word windows occurring at least twice in
    the sequence (overlaps and the first occurrence included).  Windows are
    compared by a 64-bit hash first; only windows whose hash repeats are
    compared word by word."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[j:j + n]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    rows = np.stack([codes[at + j] for j in range(width)], axis=1)
    _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[inverse.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    """``rejects(features)`` is true when the document fails the rule."""

    name: str
    rejects: Callable[[Features], bool]


def default_rules() -> list[Rule]:
    """The two base rules and three heuristics on noise: over 0.3 symbols a
    word, more than half of the lines repeated, mean word length outside
    2 to 12 code points."""
    return [
        Rule("too_few_words", lambda f: f.n_words < 20),
        Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
        Rule("symbol_heavy", lambda f: 10 * f.n_symbols > 3 * f.n_words),
        Rule("duplicate_lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
        Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 12 * f.n_words),
    ]


BASE = ("too_few_words", "repeated_words")


def measure(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 2000,
            seed: int = 17) -> dict[str, tuple[float, float]]:
    """Per rule (share of sampled documents rejected, seconds a document).

    The sample is a Bernoulli sample of about ``sample_rows`` documents,
    evaluated where the rows are; one row a rule reaches the driver.  The
    cost of a rule is the time it takes on a text of which nothing is
    computed yet."""
    total = docs.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    picked = docs.select(utf8(text).alias("raw"))
    if share < 1.0:
        picked = picked.sample(withReplacement=False, fraction=share, seed=seed)
    rules = list(rules)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rule in rules:
                began = time.perf_counter()
                rejected = sum(rule.rejects(Features(raw)) for raw in pdf["raw"])
                rows.append((rule.name, len(pdf), rejected, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["rule", "n", "rejected", "seconds"])

    got = picked.mapInPandas(probe, "rule string, n long, rejected long, seconds double") \
        .groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("r"), F.sum("seconds").alias("s"))
    return {x["rule"]: (x["r"] / max(1, x["n"]), x["s"] / max(1, x["n"])) for x in got.collect()}


def order_rules(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Descending rejections per second; unmeasured rules last, in the given order."""
    def gain(rule: Rule) -> float:
        share, seconds = measured.get(rule.name, (0.0, 1.0))
        return share / max(seconds, 1e-9)
    return sorted(rules, key=gain, reverse=True)


def first_rejection(f: Features, rules: Sequence[Rule]) -> str | None:
    for rule in rules:
        if rule.rejects(f):
            return rule.name
    return None


def quality_report(docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id",
                   text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """One row per document: id, the verdict of the cascade, and the features.

    The cascade decides first; features that it did not need are computed
    afterwards for the report.  Null texts count as empty (rejected: too few
    words); repeated rows are judged one by one; an empty table gives no
    rows; other columns are ignored."""
    ranked = _ranked(docs, rules, text, sample_rows)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf["raw"]:
                f = Features(raw)
                kept = first_rejection(f, ranked) is None
                base = any(r.rejects(f) for r in ranked if r.name in BASE)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, base, kept))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines",
                                              "n_repeat_words", "base_failed", "kept"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text).alias("raw")).mapInPandas(
        report, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                "n_repeat_words long, base_failed boolean, kept boolean").withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text",
                   sample_rows: int = 2000) -> DataFrame:
    """The documents that no rule rejects, all columns unchanged.  Same
    treatment of nulls, repeats and empty tables as :func:`quality_report`."""
    ranked = _ranked(docs, rules, text, sample_rows)

    @F.pandas_udf("boolean")
    def passes(raw: pd.Series) -> pd.Series:
        release()
        return pd.Series([first_rejection(Features(x), ranked) is None for x in raw], dtype=bool)

    return docs.filter(passes(utf8(text)))


def _ranked(docs, rules, text, sample_rows) -> list[Rule]:
    rules = list(rules if rules is not None else default_rules())
    if not any(r.name == b for r in rules for b in BASE):
        rules = [r for r in default_rules() if r.name in BASE] + rules
    return order_rules(rules, measure(docs, rules, text, sample_rows))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`quality_report` with the default rules on ``documents``."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
g AS (SELECT rid, i, CASE WHEN i + 7 <= len(ws) THEN array_to_string(ws[i:i + 7], ' ') END AS gram FROM p),
c AS (SELECT rid, i, (gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1)::INT AS twice FROM g),
r AS (SELECT rid, i, max(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM c),
n AS (SELECT rid, sum(hit)::BIGINT AS n_repeat_words FROM r GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM
      (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM w LEFT JOIN n USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
            OR NOT (word_chars BETWEEN 2 * n_words AND 12 * n_words)) AS kept FROM b"""
