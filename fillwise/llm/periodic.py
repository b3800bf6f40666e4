"""Periodic runs of words, found on a grammar: Re-Pair, runs over each rule's boundary, all places of the rule."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fillwise.llm.common import chunks_by_size
from fillwise.llm.hashing import mix

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: One document in so many ends in repeated words, as planted runs.
PLANTED_ONE_IN = 10
#: Bytes of texts whose words share one grammar; a longer text has its own.
CHUNK_BYTES = 1_500_000
ODD = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(2**62)


def planted(doc_id: int | None, words: list) -> list:
    """The words of a document; of some, by a hash of the id, with the tail replaced by repetitions of its start."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % PLANTED_ONE_IN:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


class Grammar:
    """Re-Pair over the word ids of many texts, side by side; rules never reach over the end of a text.

    Re-Pair replaces the most frequent pair of neighbours by a new symbol until no pair repeats. Here
    a round replaces every pair that is more frequent than both that overlap it, so that many
    independent replacements are one pass of numpy. Symbols from `words` on are rules: `left` and
    `right` are their halves, `size` the words under each symbol.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        """`ids` are words of all texts, `ends` where each text ends."""
        self.words = int(ids.max()) + 1 if len(ids) else 0
        self.left, self.right, size = [], [], [np.ones(self.words, np.int64)]
        self.round_first: list[int] = []
        symbols, at = ids.astype(np.int64), np.arange(len(ids))
        last = np.zeros(len(ids), bool)
        last[ends[ends > 0] - 1] = True
        known, live = self.words, np.ones(len(ids), bool)
        while True:
            # A pair seen once never repeats unless a neighbour is replaced: only live places are counted.
            own = np.flatnonzero(live[:-1] & ~last[:-1]) if len(symbols) else np.empty(0, np.int64)
            if not len(own):
                break
            keys = symbols[own] * known + symbols[own + 1]
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
            counts = np.diff(np.append(first, len(keys)))
            pair = np.empty(len(keys), np.int64)
            pair[order] = np.repeat(np.arange(len(first)), counts)
            often = counts[pair] > 1
            live = np.zeros(len(symbols), bool)
            if not often.any():
                break
            rank = np.zeros(len(symbols) + 1, np.int64)  # of the pair that begins here; 0: none to replace
            rank[own[often]] = counts[pair[often]] * len(first) + pair[often] + 1
            here, before, after = rank[:-1], np.concatenate([[0], rank[:-2]]), rank[1:]
            chosen = (here > 0) & (here >= before) & (here >= after)
            # Of equal pairs in a row (a a a a) every second one, counted from the first.
            alike = chosen & (here == before)
            start = np.flatnonzero(chosen & ~alike)
            places = np.flatnonzero(chosen)
            odd = (places - start[np.searchsorted(start, places, "right") - 1]) % 2 == 1
            chosen[places[odd]] = False
            places = places[~odd]
            made, sample, rule = np.unique(here[places], return_index=True, return_inverse=True)
            sample = places[sample]
            self.round_first.append(known)
            self.left.append(symbols[sample])
            self.right.append(symbols[sample + 1])
            sizes = np.concatenate(size)
            size = [sizes, sizes[symbols[sample]] + sizes[symbols[sample + 1]]]
            live = rank[:-1] > 0
            symbols[places] = known + rule
            last[places] = last[places + 1]
            live[places] = True
            live[np.maximum(places - 1, 0)] = True
            known += len(made)
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, at, last, live = symbols[keep], at[keep], last[keep], live[keep]
        self.symbols, self.at, self.size = symbols, at, np.concatenate(size)
        none = [np.empty(0, np.int64)]
        self.left, self.right = np.concatenate(self.left or none), np.concatenate(self.right or none)

    def derivation(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rules of at least `least` words and the places of all their occurrences, in all derivations."""
        big = (self.symbols >= self.words) & (self.size[self.symbols] >= least)
        waiting, places = self.symbols[big], self.at[big]
        rules, found = [], []
        for first in reversed(self.round_first):  # a rule's halves are of earlier rounds
            now = waiting >= first
            own, at = waiting[now], places[now]
            rules.append(own)
            found.append(at)
            a, b = self.left[own - self.words], self.right[own - self.words]
            waiting = np.concatenate([waiting[~now], a, b])
            places = np.concatenate([places[~now], at, at + self.size[a]])
            big = (waiting >= self.words) & (self.size[waiting] >= least)
            waiting, places = waiting[big], places[big]
        if not rules:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rules), np.concatenate(found)


def _distances(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word how far back in its text the same word is; NEVER for the first."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), NEVER)
    a, b = order[:-1], order[1:]
    same = (ids[a] == ids[b]) & (text[a] == text[b])
    out[b[same]] = b[same] - a[same]
    return out


def _possible(back: np.ndarray, longest: int) -> np.ndarray:
    """Words that a run may reach, as far as distances tell.

    All words of a run after its first period q were there at most q words before. So for a q up to Q
    and beyond Q / 2 there are 3 q words or more in a row whose distance is at most Q.
    """
    out = np.zeros(len(back), bool)
    scale = 1
    while LEAST_PERIODS * (scale // 2 + 1) <= longest:
        near = np.concatenate([[False], back <= scale, [False]])
        edges = np.flatnonzero(near[1:] != near[:-1])
        begin, end = edges[::2], edges[1::2]
        least = scale // 2 + 1  # the least period at this scale
        long = end - begin >= max((LEAST_PERIODS - 1) * least, LEAST_WORDS - scale)
        mark = np.zeros(len(back) + 1, np.int64)
        np.add.at(mark, np.maximum(begin[long] - scale, 0), 1)
        np.add.at(mark, end[long], -1)
        out |= np.cumsum(mark[:-1]) > 0
        scale *= 2
    return out


def _squares(ids: np.ndarray, text: np.ndarray, asked: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of an asked place b, q) for which the 2 q words before b are a square of period q, by hashes.

    In a square of period q the last k words are there again q words before, for each k up to q. For every
    power of two k the places with the same k words are chained, and the chain of the k words before b
    is followed from distance k up to 2 k - 1. If it begins with equal steps r < k, these are passed at once: the
    words up to there have the period r, and a q among them is no least period. For each q left the hashes of both
    halves are compared. Few places b and periods pass; what collides is sorted out later.
    """
    n = len(ids)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, ODD)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    owner, period = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    numbers = np.flatnonzero((asked >= 1) & (asked <= n))
    rolled, k = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while LEAST_PERIODS * k <= longest:
        order = np.argsort(rolled, kind="stable")
        gap = np.zeros(n, np.int64)  # to the place before with the same words; 0: none
        gap[1:] = np.where((rolled[order[1:]] == rolled[order[:-1]]) & (text[order[1:]] == text[order[:-1]]), np.diff(order), 0)
        turn = np.arange(n)
        turn[1:][gap[1:] == gap[:-1]] = 0
        turn = np.maximum.accumulate(turn)  # where the equal gaps up to each place begin
        before, lead = np.empty(n, np.int64), np.empty(n, np.int64)
        before[order] = np.where(gap > 0, order - gap, -1)
        lead[order] = np.where((gap > 0) & (gap < k), order[np.maximum(turn - 1, 0)], -1)
        number, place = numbers, asked[numbers] - 1
        jumped = lead[place] >= 0
        place = np.where(jumped, lead[place], before[place])
        while len(number):
            gone = asked[number] - 1 - place
            go = (place >= 0) & (gone < 2 * k)
            number, place, gone, jumped = number[go], place[go], gone[go], jumped[go]
            fits = (gone >= k) & ~jumped & (asked[number] - 2 * gone >= 0)
            o, q = number[fits], gone[fits]
            y, x = asked[o] - q, asked[o] - 2 * q
            true = (sums[y] - sums[x]) * powers[q] == sums[asked[o]] - sums[y]
            owner.append(o[true])
            period.append(q[true])
            place, jumped = before[place], np.zeros(len(number), bool)
        further = np.zeros_like(rolled)
        further[k:] = rolled[:-k]
        rolled = mix(rolled + np.uint64(k)) + further * np.uint64(0xBF58476D1CE4E5B9)
        k *= 2
    return np.concatenate(owner), np.concatenate(period)


def _maximal(text, start, end, period) -> np.ndarray:
    """Numbers of intervals that no other one of their text and period holds, in this order, each once."""
    order = np.lexsort((-end, start, period, text))
    if not len(order):
        return order
    group = np.concatenate([[0], np.cumsum((np.diff(text[order]) != 0) | (np.diff(period[order]) != 0))])
    # Ends so far within a group: groups are shifted apart, so that one running maximum serves all.
    shifted = end[order] + group * (int(end.max()) + 1)
    top = np.maximum.accumulate(shifted)
    return order[np.concatenate([[True], shifted[1:] > top[:-1]])]


def runs_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length and period of all runs of the texts, whose word ids lie one after the other.

    A run that is not inside one symbol of a text goes over a boundary of two; one that is goes
    over the boundary of exactly one rule of that symbol's derivation. So runs are looked for at boundaries of the
    symbols, in the whole text, and at each rule's own boundary, in the rule, once. A rule's runs
    are then carried to all its occurrences. What a wider interval of the same period holds is no run of
    its own; of equal intervals the least period counts.
    """
    none = (np.empty(0, np.int64),) * 4
    if not len(ids):
        return none
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)
    longest = int((ends - starts).max())
    possible = _possible(_distances(ids, text), longest)
    grammar = Grammar(ids, ends)
    rules, places = grammar.derivation(LEAST_WORDS)
    kinds, first = np.unique(rules, return_index=True)
    lead = places[first]
    # Boundaries, each with the rule (or -1) and the window that its runs must lie in.
    root = grammar.at[1:][text[grammar.at[1:]] == text[grammar.at[:-1]]]
    inner = lead + grammar.size[grammar.left[kinds - grammar.words]]
    at = np.concatenate([root, inner])
    rule = np.concatenate([np.full(len(root), -1), kinds])
    low = np.concatenate([starts[text[root]], lead])
    high = np.concatenate([ends[text[root]], lead + grammar.size[kinds]])
    use = possible[at - 1] & possible[at]
    at, rule, low, high = at[use], rule[use], low[use], high[use]
    if not len(at):
        return none
    # Only texts with a boundary left are searched, laid side by side.
    texts = np.unique(text[at])
    part = np.concatenate([np.arange(starts[t], ends[t]) for t in texts.tolist()])
    own, own_text = ids[part], text[part]
    where = np.searchsorted(part, at)
    n = len(own)
    longest = int((ends - starts)[texts].max())
    owner, period = _squares(own, own_text, where, longest)
    mirrored, period_right = _squares(own[::-1], own_text[::-1], n - where, longest)
    # An anchor is a place i whose word is, by the hash, the one `period` before.
    anchor = np.concatenate([at[owner] - 1, at[mirrored] + period_right])
    owner, period = np.concatenate([owner, mirrored]), np.concatenate([period, period_right])
    fits = (anchor < high[owner]) & (anchor - period >= low[owner])
    anchor, owner, period = anchor[fits], owner[fits], period[fits]
    found = [np.empty((0, 4), np.int64)]
    which = text[anchor]
    order = np.lexsort((period, which))
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(which[order]) != 0) | (np.diff(period[order]) != 0)])) if len(order) else []
    for i, j in zip(cut, np.append(cut[1:], len(order)) if len(order) else []):
        own = order[i:j]
        t, q = int(which[own[0]]), int(period[own[0]])
        a, b = int(starts[t]), int(ends[t])
        differs = np.flatnonzero(ids[a + q : b] != ids[a : b - q]) + a + q
        nth = np.searchsorted(differs, anchor[own])
        true = ~np.isin(anchor[own], differs)
        begin = np.concatenate([[a + q], differs + 1])[nth] - q
        stop = np.concatenate([differs, [b]])[nth]
        o = owner[own]
        begin, stop = np.maximum(begin, low[o]), np.minimum(stop, high[o])
        good = true & (stop - begin >= max(LEAST_WORDS, LEAST_PERIODS * q))
        found.append(np.stack([o[good], begin[good], stop[good], np.full(int(good.sum()), q)], axis=1))
    o, begin, stop, period = np.unique(np.concatenate(found), axis=0).T
    # A rule's runs, at every occurrence of the rule.
    of = rule[o]
    inside = of >= 0
    by_rule = np.argsort(rules, kind="stable")
    counts = np.diff(np.append(first_of := np.searchsorted(rules[by_rule], kinds), len(rules)))
    nth = np.searchsorted(kinds, of[inside])
    times = counts[nth]
    index = np.repeat(first_of[nth] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
    moved = places[by_rule[index]] - np.repeat(lead[nth], times)
    begin = np.concatenate([begin[~inside], np.repeat(begin[inside], times) + moved])
    stop = np.concatenate([stop[~inside], np.repeat(stop[inside], times) + moved])
    period = np.concatenate([period[~inside], np.repeat(period[inside], times)])
    keep = _maximal(text[begin], begin, stop, period)
    begin, stop, period = begin[keep], stop[keep], period[keep]
    order = np.lexsort((period, -stop, begin))
    begin, stop, period = begin[order], stop[order], period[order]
    least = np.concatenate([[True], (np.diff(begin) != 0) | (np.diff(stop) != 0)]) if len(begin) else np.empty(0, bool)
    begin, stop, period = begin[least], stop[least], period[least]
    order = np.lexsort((period, begin))
    begin, stop, period = begin[order], stop[order], period[order]
    t = text[begin]
    return t, begin - starts[t], stop - begin, period


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words less those that a run (start, length, period) holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start and period) and the text less repetitions.

    Words are stretches without white space, of texts with planted repetitions (see `planted`; a null
    id has none). A run is a longest stretch whose words equal those one period before, with the least such
    period, of at least LEAST_WORDS words and LEAST_PERIODS periods. Null and empty texts have no
    words; every row of docs gives one, repeated rows as often as they are there; other columns do not matter.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in chunks_by_size([len(t) + 1 for t in texts], CHUNK_BYTES):
                words = [planted(i, t.split()) for i, t in zip(ids[a:b], texts[a:b])]
                numbers: dict[bytes, int] = {}
                flat = np.fromiter((numbers.setdefault(w, len(numbers)) for own in words for w in own), np.int64)
                ends = np.cumsum([len(own) for own in words])
                found: list[list] = [[] for _ in words]
                for t, *own in zip(*(x.tolist() for x in runs_of(flat, ends))):
                    found[t].append(tuple(own))
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
                left = [b" ".join(collapsed_words(w, own)).decode() for w, own in zip(words, found)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(rows, kind), pa.array(left, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of most periods (start, length, period, exponent_milli; null without runs), and digests.

    Of runs with the same length by period, exactly, the first counts, then the one of least period.
    """
    rows = periodic_runs(docs)

    def greater(a, b):
        return (b["length"] * a["period"] > a["length"] * b["period"])

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda a, b: F.when(a.isNull() | greater(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
