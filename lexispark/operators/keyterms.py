"""Ranked key terms of each document: textrank, yake, sgrank and scake.

Each is a column function of annotated tokens that gives an array of (term, score) in order. Parts of speech are optional:
``include_pos=None`` ranks lexical tokens.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Collection
from itertools import combinations
from math import log, log2, prod, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.columns import ColumnOrName, col
from lexispark.operators.extract import filtered_topn, longest_runs, per_doc
from lexispark.operators.network import pagerank

RANKED = "array<struct<term:string,score:double>>"
NOMINAL = ("NOUN", "PROPN", "ADJ")
ALIKE = 0.8


def _form(normalize: str | None):
    if normalize not in (None, "orth", "lower", "norm", "lemma"):
        raise ValueError(f"normalize = {normalize!r}; known are lemma, lower, norm and None")
    name = "text" if normalize in (None, "orth") else normalize
    return lambda t: t[name] or t["lower"]


#: What ranking reads of a token; the rest isn't sent to Python.
_FIELDS = ("i", "text", "lower", "norm", "lemma", "pos", "sent_id", "is_stop", "is_punct", "is_space", "is_upper", "is_title", "is_sent_start")


def _slim(tokens: ColumnOrName) -> Column:
    return F.transform(col(tokens), lambda t: F.struct(*[t[f].alias(f) for f in _FIELDS]))


def _check(topn: int | float) -> None:
    if isinstance(topn, float) and not 0 < topn <= 1:
        raise ValueError(f"topn = {topn}; a share is above 0 and 1 at most")


def _count(topn: int | float, n: int) -> int:
    return round(n * topn) if isinstance(topn, float) else topn


def _result(ranked: list[tuple[str, float]], topn: int) -> list[dict]:
    return [{"term": t, "score": float(s)} for t, s in filtered_topn(ranked, topn, ALIKE)]


def _content(t: dict, pos: tuple[str, ...] | None) -> bool:
    return not (t["is_stop"] or t["is_punct"] or t["is_space"]) and (not pos or t["pos"] in pos)


def _pos(include: str | Collection[str] | None) -> tuple[str, ...] | None:
    return (include,) if isinstance(include, str) else tuple(include) if include else None


def window_counts(n: int, size: int, i: int, j: int) -> int:
    """Windows of ``size`` that slide over ``n`` places and hold both i <= j."""
    size = min(size, n)
    return max(0, min(i, n - size) - max(0, j - size + 1) + 1)


@per_doc(RANKED)
def _textrank(doc, normalize, pos, window_size, edge_weighting, position_bias, topn):
    form = _form(normalize)
    words = [form(t) for t in doc]
    nodes = sorted(set(words))
    place = {w: k for k, w in enumerate(nodes)}
    weights: Counter = Counter()
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + window_size)):
            a, b = sorted((words[i], words[j]))
            weights[place[a], place[b]] += window_counts(len(words), window_size, i, j) if edge_weighting == "count" else 1
    if not weights:
        return []
    bias = np.zeros(len(nodes))
    for i, w in enumerate(words):
        bias[place[w]] += 1 / (i + 1)
    pairs = np.array(list(weights))
    values = np.array(list(weights.values()), float) if edge_weighting == "count" else np.ones(len(pairs))
    ranks = pagerank(nodes, pairs[:, 0], pairs[:, 1], values, personalization=bias if position_bias else None)
    found = {tuple(form(t) for t in run) for run in longest_runs(list(doc), lambda t: _content(t, pos))}
    scores = {" ".join(c): sum(ranks[place[w]] for w in c) for c in found}
    return _result(sorted(scores.items(), key=lambda x: (x[1], x[0]), reverse=True), _count(topn, len(found)))


def textrank(tokens: ColumnOrName, *, normalize: str | None = "lemma", include_pos: str | Collection[str] | None = NOMINAL, window_size: int = 2, edge_weighting: str = "binary", position_bias: bool = False, topn: int | float = 10) -> Column:
    """Sums of the PageRanks of words in the co-occurrence network, for the longest runs of content words."""
    _check(topn)
    _form(normalize)
    if edge_weighting not in ("binary", "count"):
        raise ValueError(f"edge_weighting = {edge_weighting!r}")
    return _textrank(_slim(tokens), normalize=normalize, pos=_pos(include_pos), window_size=window_size, edge_weighting=edge_weighting, position_bias=position_bias, topn=topn)


def _grams(doc: list[dict], ns: tuple[int, ...], pos: tuple[str, ...] | None) -> list[list[dict]]:
    out = []
    for n in ns:
        for i in range(len(doc) - n + 1):
            part = doc[i : i + n]
            if part[0]["is_stop"] or part[-1]["is_stop"] or any(t["is_punct"] or t["is_space"] for t in part):
                continue
            if not pos or all(t["pos"] in pos for t in part):
                out.append(part)
    return out


def yake_word_scores(doc: list[dict], form, window_size: int) -> tuple[dict[str, float], dict[str, int], set[str]]:
    """Lower is better: how a word is written, where, how often, in how many sentences and next to how many others."""
    sentences: dict[int, list[dict]] = {}
    for t in doc:
        sentences.setdefault(t["sent_id"], []).append(t)
    upper, where, left, right = defaultdict(int), defaultdict(list), defaultdict(list), defaultdict(list)
    stops = set()
    for k, sentence in enumerate(sentences.values()):
        for i, t in enumerate(sentence):
            w = form(t)
            if t["is_stop"]:
                stops.add(w)
            upper[w] += bool(t["is_upper"] or t["is_title"] and not t["is_sent_start"])
            where[w].append(k)
            left[w] += [form(x) for x in sentence[max(0, i - window_size) : i] if not (x["is_punct"] or x["is_space"])]
            right[w] += [form(x) for x in sentence[i + 1 : i + 1 + window_size] if not (x["is_punct"] or x["is_space"])]
    freq = {w: len(x) for w, x in where.items()}
    plain = [n for w, n in freq.items() if w not in stops]
    if len(plain) < 2:
        return {}, freq, stops
    base, most = np.mean(plain) + np.std(plain, ddof=1), max(freq.values())
    scores = {}
    for w, n in freq.items():
        unlike = [len(set(x[w])) for x in (left, right)]
        variety = sum(u / len(x[w]) if x[w] else 0.0 for u, x in zip(unlike, (left, right)))
        related = 1 + variety * n / most + sum(unlike) / most
        position = log2(log2(3 + np.mean(where[w])))
        scores[w] = related * position / (upper[w] / log2(1 + n) + n / base / related + len(set(where[w])) / len(sentences) / related)
    return scores, freq, stops


@per_doc(RANKED)
def _yake(doc, normalize, ns, pos, window_size, topn):
    doc, form = list(doc), _form(normalize)
    scores, freq, stops = yake_word_scores(doc, form, window_size)
    if not scores:
        return []
    out: dict[str, float] = {}
    if 1 in ns:
        for t in doc:
            w = form(t)
            if _content(t, pos) and w not in stops and w not in out:
                out[w] = scores[w] / (log2(1 + freq[w]) * (1 + scores[w]))
    grams = [[form(t) for t in g] for g in _grams(doc, tuple(n for n in ns if n > 1), pos)]
    often = Counter(" ".join(g) for g in grams)
    for g in grams:
        text, parts = " ".join(g), [scores[w] for w in g]
        if text not in out:
            out[text] = prod(parts) / (log2(1 + often[text]) * (1 + sum(parts)))
    return _result(sorted(out.items(), key=lambda x: x[1]), _count(topn, len(out)))


def yake(tokens: ColumnOrName, *, normalize: str | None = "lemma", ngrams: int | Collection[int] = (1, 2, 3), include_pos: str | Collection[str] | None = NOMINAL, window_size: int = 2, topn: int | float = 10) -> Column:
    """Terms by the statistics of their words; the lower, the better. Without two words that aren't stop words there is nothing to rank."""
    _check(topn)
    _form(normalize)
    return _yake(_slim(tokens), normalize=normalize, ns=(ngrams,) if isinstance(ngrams, int) else tuple(ngrams), pos=_pos(include_pos), window_size=window_size, topn=topn)


@per_doc(RANKED)
def _sgrank(doc, normalize, ns, pos, window_size, topn, idf):
    doc, form = list(doc), _form(normalize)
    n = len(doc)
    if n < 2:
        return []
    size = min(n, window_size)
    found = [(" ".join(form(t) for t in g), g[0]["i"], len(g)) for g in _grams(doc, ns, pos)]
    count = Counter(text for text, _, _ in found)
    topn = _count(topn, len(count))
    least = min(max(n // 1000, 1), 4)
    found = [c for c in found if count[c[0]] >= least]
    kept = max(3 * topn, 100)
    if idf:
        value = {t: count[t] * idf.get(t, 1) if " " not in t else count[t] for t, _, _ in found}
        chosen = {t for t, _ in sorted(value.items(), key=lambda x: x[1], reverse=True)[:kept]}
    else:
        chosen = {t for t, _ in count.most_common(kept)}
    found = [c for c in found if c[0] in chosen]
    weight: dict[str, float] = {}
    for text, i, length in found:
        if text not in weight:
            inside = sum(count[other] for other in chosen if text in other) - count[text]
            tf = (count[text] - inside) * (idf.get(text, 1) if idf and length == 1 else 1)
            weight[text] = tf * log((n + 1) / (i + 1)) * sqrt(length)
    found = [c for c in found if weight[c[0]] > 0]
    # each two candidates lie together in a number of windows that follows from their places
    together, distance = Counter(), Counter()
    for (a, i, _), (b, j, _) in combinations(found, 2):
        times = window_counts(n, size, min(i, j), max(i, j))
        if times:
            together[a, b] += times
            distance[a, b] += times * log(size / abs(i - j) if i != j else size)
    if not together:
        return []
    edge = {(a, b): (1 + distance[a, b]) / together[a, b] * weight[a] * weight[b] for a, b in together}
    total = Counter()
    for (a, _), w in edge.items():
        total[a] += w
    nodes = sorted({x for e in edge for x in e})
    place = {w: k for k, w in enumerate(nodes)}
    ranks = pagerank(nodes, np.array([place[a] for a, _ in edge]), np.array([place[b] for _, b in edge]), np.array([w / total[a] for (a, _), w in edge.items()]), directed=True)
    return _result(sorted(zip(nodes, ranks), key=lambda x: (x[1], x[0]), reverse=True), topn)


def sgrank(tokens: ColumnOrName, *, normalize: str | None = "lemma", ngrams: int | Collection[int] = (1, 2, 3, 4, 5, 6), include_pos: str | Collection[str] | None = NOMINAL, window_size: int = 1500, topn: int | float = 10, idf: dict[str, float] | None = None) -> Column:
    """PageRanks of n-grams linked by their distance and weighted by frequency, place and length."""
    _check(topn)
    _form(normalize)
    if window_size < 2:
        raise ValueError("window_size is 2 at least")
    return _sgrank(_slim(tokens), normalize=normalize, ns=(ngrams,) if isinstance(ngrams, int) else tuple(ngrams), pos=_pos(include_pos), window_size=window_size, topn=topn, idf=idf)


def truss_levels(edges: Collection[tuple[str, str]]) -> dict[str, int]:
    """The greatest k of each node such that an edge of it lies in k triangles of what remains after peeling."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    key = lambda a, b: (a, b) if a < b else (b, a)
    support = {key(a, b): len(near[a] & near[b]) for a, b in edges}
    level: dict[str, int] = dict.fromkeys(near, 0)
    k = 1
    while support:
        left = {x for e in support for x in e}
        if 2 * len(support) == len(left) * (len(left) - 1):
            # a complete graph peels at once
            level.update((x, max(level[x], len(left) - 2)) for x in left)
            break
        todo = [e for e, s in support.items() if s < k]
        while todo:
            e = todo.pop()
            if e not in support:
                continue
            del support[e]
            a, b = e
            for x in e:
                level[x] = max(level[x], k - 1)
            near[a].discard(b)
            near[b].discard(a)
            for c in near[a] & near[b]:
                for f in (key(a, c), key(b, c)):
                    support[f] -= 1
                    if support[f] == k - 1:
                        todo.append(f)
        k += 1
    return level


@per_doc(RANKED)
def _scake(doc, normalize, pos, topn):
    doc, form = list(doc), _form(normalize)
    sentences: dict[int, list[str]] = {}
    for t in doc:
        part = sentences.setdefault(t["sent_id"], [])
        if _content(t, pos):
            part.append(form(t))
    parts = list(sentences.values())
    weights: Counter = Counter()
    # words of an inner sentence take part in two windows
    for window in [a + b for a, b in zip(parts, parts[1:])] or parts:
        for (a, n), (b, m) in combinations(sorted(Counter(window).items()), 2):
            weights[a, b] += n * m
    if not weights:
        return []
    level = truss_levels(weights)
    most = max(level.values())
    if not most:
        return []
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in weights:
        near[a].add(b)
        near[b].add(a)
    position: Counter = Counter()
    for t in doc:
        position[form(t)] += 1 / (t["i"] + 1)
    score = {w: position[w] * level[w] * sum(weights[min(w, x), max(w, x)] * level[x] for x in near[w]) * len({level[x] for x in near[w]}) / most for w in near}
    found = {tuple(form(t) for t in run) for run in longest_runs(doc, lambda t: _content(t, pos))}
    ranked = {" ".join(c): sum(score.get(w, 0.0) for w in c) for c in found}
    return _result(sorted(ranked.items(), key=lambda x: (x[1], x[0]), reverse=True), _count(topn, len(found)))


def scake(tokens: ColumnOrName, *, normalize: str | None = "lemma", include_pos: str | Collection[str] | None = NOMINAL, topn: int | float = 10) -> Column:
    """Terms whose words stand early, in dense parts of the network of adjacent sentences, with strong and varied neighbours."""
    _check(topn)
    _form(normalize)
    return _scake(_slim(tokens), normalize=normalize, pos=_pos(include_pos), topn=topn)


METHODS = {f.__name__: f for f in (textrank, yake, sgrank, scake)}


def extract_keyterms(tokens: ColumnOrName, method: str, **options) -> Column:
    if method not in METHODS:
        raise ValueError(f"method = {method!r}; known are {sorted(METHODS)}")
    return METHODS[method](tokens, **options)
