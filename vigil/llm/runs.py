"""Periodic run detection: stretches of words that repeat with a period.

The distinct substrings of a text are the states of its suffix automaton, and
the suffixes of a prefix are the path of suffix links from the prefix's state
to the root.  A link-cut access walks that path and recolours it with the
prefix's end.  Its old colours are the last ends of those suffixes: where the
deepest state of colour ``e`` on the path has length ``m``, the prefixes that
end at ``i`` and at ``e`` agree in exactly their last ``m`` words.  If ``i - e
<= m``, a square of period ``i - e`` ends at ``i``, and the repetition it lies
in starts at ``e - m + 1``.  A primitive root cannot occur inside its own
square but at both ends, so every repetition shows its smallest period at
each of its ends from the second period on; it is over when the next word does
not show it again.  Accesses are O(log n) amortised, whatever the text.

Texts are cut first, without loss: in a run of exponent ``e`` each word stands
at least ``e`` times, so a word that is rarer inside a stretch is in no run of
it, and what is left on either side is cut again until nothing is rare.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WORD, fresh, whole

#: Exponent and number of words that a run has at least.
EXPONENT, SHORTEST = 4, 6
FOUND = "struct<runs:array<struct<start:long,length:long,period:long>>,n_words:long,collapsed:string>"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_automaton(items: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, prefix states): states are numbered from 1 (the root,
    whose link is 0)."""
    follow: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last, states = 1, []
    for item in items:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(1)
        at = last
        while at and item not in follow[at]:
            follow[at][item] = new
            at = link[at]
        if at:
            to = follow[at][item]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(follow)
                follow.append(dict(follow[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at and follow[at].get(item) == to:
                    follow[at][item] = copy
                    at = link[at]
        last = new
        states.append(new)
    return link, length, states


class ColouredPaths:
    """The preferred paths of a rooted tree, each a splay tree ordered by depth
    whose root holds the path's colour (-1: none yet)."""

    def __init__(self, parent: list[int], depth: list[int]) -> None:
        self.up, self.depth = list(parent), depth  # of a splay root: the parent of its path's top
        self.left, self.right = [0] * len(parent), [0] * len(parent)
        self.colour = [-1] * len(parent)

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            turns = ((y, z), (x, y)) if inner and (left[z] == y) == (left[y] == x) else ((x, y), (x, z)) if inner else ((x, y),)
            for child, top in turns:
                over = up[top]
                if left[top] == child:
                    moved = left[top] = right[child]
                    right[child] = top
                else:
                    moved = right[top] = left[child]
                    left[child] = top
                if moved:
                    up[moved] = top
                if over:
                    if left[over] == top:
                        left[over] = child
                    elif right[over] == top:
                        right[over] = child
                up[child], up[top] = over, child
                colour[child] = colour[top]

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``node``; (old colour, depth of
        its deepest node) of each of its coloured segments, deepest first."""
        up, right, colours, found = self.up, self.right, self.colour, []
        below, x = 0, node
        while x:
            if up[x]:
                self._splay(x)
            old = colours[x]
            if old >= 0:
                found.append((old, self.depth[x]))
            cut = right[x]
            if cut:
                colours[cut] = old
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return found


def runs_of(items: Sequence[int], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of ``items``."""
    link, length, states = suffix_automaton(items)
    paths = ColouredPaths(link, length)
    open_runs: dict[int, int] = {}
    found = []

    def close(period: int, start: int, end: int) -> None:
        if end - start >= max(shortest, exponent * period):
            found.append((start, end - start, period))

    for i, state in enumerate(states):
        now = {i - e: e - m + 1 for e, m in paths.access(state, i) if i - e <= m}
        for period, start in open_runs.items():
            if period not in now:
                close(period, start, i)
        open_runs = now
    for period, start in open_runs.items():
        close(period, start, len(states))
    return found


def stretches(items: Sequence[int], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """[lo, hi) parts of ``items`` that hold all its runs; inside each no item
    occurs fewer than ``exponent`` times."""
    todo, done = [(0, len(items))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo < shortest:
            continue
        part = items[lo:hi]
        rare = {x for x, n in Counter(part).items() if n < exponent}
        if not rare:
            done.append((lo, hi))
            continue
        at = lo
        for i, x in enumerate(part, lo):
            if x in rare:
                if i - at >= shortest:
                    todo.append((at, i))
                at = i + 1
        if hi - at >= shortest:
            todo.append((at, hi))
    return done


def word_runs(words: Sequence[str], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words``, by start, then period."""
    found = []
    for lo, hi in stretches(words, exponent, shortest):
        number: dict[str, int] = {}
        part = [number.setdefault(w, len(number)) for w in words[lo:hi]]
        found += [(lo + s, n, q) for s, n, q in runs_of(part, exponent, shortest)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[str], runs: Iterable[tuple[int, int, int]]) -> list[str]:
    """The words but those that a run holds after its first period."""
    kept, at = [], 0
    for lo, hi in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:max(at, lo)]
        at = max(at, hi)
    return kept + list(words[at:])


def find_runs(docs: DataFrame, text: str = "text", name: str = "found", exponent: int = EXPONENT,
              shortest: int = SHORTEST) -> DataFrame:
    """All columns and ``name``: (runs, n_words, collapsed) of each whole text.

    A run is a longest stretch of words with smallest period ``period`` that is
    at least ``exponent`` (an integer, 2 or more) periods and ``shortest`` words long; runs
    are listed by start, then period (ties of both cannot be).  ``collapsed``
    is the text's words, joined by a space, without those that a run repeats.
    Null, empty and blank texts have no words, no runs and an empty text;
    a text of any length is read whole, in one task; repeated rows come as
    often as they are; an existing column of that name is replaced; an empty
    table gives no rows."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for body in texts:
            words = _WORDS.findall(body)
            runs = word_runs(words, exponent, shortest)
            rows.append(([dict(zip(("start", "length", "period"), r)) for r in runs], len(words), " ".join(collapsed(words, runs))))
        return pd.DataFrame(rows, columns=["runs", "n_words", "collapsed"])

    return docs.withColumn(name, search(whole(text)))


def collapse(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """All rows, the text of those that hold a run replaced by its collapsed
    words; other texts stay as they are, white space included."""
    name = fresh(docs, "found")
    found = find_runs(docs, text, name, exponent, shortest)
    changed = F.when(F.size(f"{name}.runs") > 0, F.col(f"{name}.collapsed")).otherwise(F.col(text))
    return found.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): each row's words, those of every tenth row (by the CRC-32 of
    its decimal id) periodic from some word on.  Null ids stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = docs.select(F.col(id_col).alias("_id"), whole(text).alias("_text"), F.floor(h / 10).alias("_g"), (h % 10 == 0).alias("_chosen")) \
        .withColumn("_words", F.when(F.col("_chosen"), F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))) \
        .withColumn("_n", F.size("_words")) \
        .withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))) \
        .withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))

    def moved(word: Column, i: Column) -> Column:
        a, p = F.col("_a"), F.col("_p")
        return F.when(i < a, word).otherwise(F.get("_words", (a + (i - a) % p).cast("int")))

    new = F.when(F.col("_n") > 0, F.array_join(F.transform("_words", moved), " ")).otherwise(F.col("_text"))
    return chosen.select(F.col("_id").alias(id_col), new.alias("text"))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256) per row of :func:`with_planted_runs`: the longest run
    (ties: smallest start, then period; null without runs) and digests."""
    runs = F.col("found.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = find_runs(with_planted_runs(docs, id_col, text)).drop("text").withColumn("best", best)
    return found.select(
        id_col, F.size(runs).cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("found.collapsed", 256).alias("collapsed_sha256"))
