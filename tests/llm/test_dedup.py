"""Line, passage and near-duplicate removal against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexispark.llm import line_dedup, simhash, suffix_dedup
from lexispark.llm.common import TOKEN, table
from tests.conftest import same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, run_key string, id string, anchor int"


def frame(spark, rows):
    """Documents with columns whose names also occur inside the operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", "x", 2) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc"), (4, "\n \n\t\n"), (5, "x\nx\nx\nx"), (6, "one line"), (7, "one line"), (8, "q\n\na \n b\nz"), (9, "y " * 30000)]


def brute_lines(rows, n, long_words=None):
    """Each document's text without the lines of runs of ``n``, and single ones of ``long_words`` words, that stood earlier."""
    order = sorted({(i is None, i or 0, hashlib.md5(f"{hashlib.md5(str(i).encode()).hexdigest() if i is not None else ''}|{hashlib.md5(t.encode()).hexdigest()}".encode()).digest(), t) for i, t in rows if t is not None})
    seen, out = set(), {}
    for none, i, _, t in order:
        lines = t.split("\n")
        kept = [(k, x.strip(" \t\r")) for k, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for size in dict.fromkeys((n, 1)):
            for p in range(len(kept) - size + 1):
                run = tuple(x for _, x in kept[p : p + size])
                if size < n and (long_words is None or len(run[0].split()) < long_words):
                    continue
                if run in seen:
                    gone |= set(range(kept[p][0], kept[p + size - 1][0] + 1))
                seen.add(run)
        out[None if none else i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines_by_sql(spark, sf):
    same_rows(spark, line_dedup.op9_line_dedup(spark, sf), line_dedup.SQL, sf)


@pytest.mark.parametrize(("n", "long_words"), [(2, None), (3, None), (2, 2), (4, 3), (1, None)])
def test_lines_by_brute_force(spark, n, long_words):
    rng = random.Random(n)
    rows = ODD + [(100 + k, "\n".join(rng.choice(["u", "v", "w", "", " v ", "u v ", "x y\tz "]) + rng.choice("12") for _ in range(rng.randint(0, 12)))) for k in range(60)]
    expected = brute_lines(rows, n, long_words)
    got = line_dedup.delete_repeated_runs(frame(spark, rows), min_lines=n, long_words=long_words)
    assert got.columns == frame(spark, rows).columns
    found = Counter((r["doc_id"], r["text"]) for r in got.collect())
    want = Counter()
    for i, t in rows:
        rest = expected[i, t] if t is not None else None
        if rest is not None and rest != t and not rest.strip(" \t\r\n"):
            continue
        want[i, rest] += 1
    # a lone repeated run of which the seams touch may hold more than windows do
    assert found == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.where("text is not null").collect())


def test_windows_select_guaranteed_fingerprints():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    for window in (1, 2, 5):
        sel = line_dedup.winnowed(h, window)
        for s, p in enumerate(sel.tolist()):
            part = h[s : s + window].tolist()
            assert s <= p < s + window and h[p] == min(part) and p == s + window - 1 - part[::-1].index(min(part))
    assert len(np.unique(line_dedup.winnowed(rng.permutation(3000).astype(np.uint64), 9))) < 0.3 * 3000
    assert not len(line_dedup.winnowed(h[:3], 4))


def test_the_stage_deletes_runs_and_long_single_lines_by_brute_force(spark, sf):
    rng = random.Random(1)
    rows = [x for x in dict.fromkeys(ODD) if x[1] is not None] + [(100 + k, "\n".join(rng.choice(["u", "v", "w", "", " v ", "p q r "]) + rng.choice("123456789") for _ in range(rng.randint(0, 4)))) for k in range(40)]
    rows += [(200, "a1\nhot line of boilerplate\na2"), (201, "b1\nhot line of boilerplate\nb2"), (202, "hot line of boilerplate")]
    expected = brute_lines(rows, line_dedup.MIN_LINES, line_dedup.LONG_WORDS)
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.line_deduplication(spark, frame(spark, rows), sf).collect()}
    assert got == {(i, rest) for (i, t), rest in expected.items() if rest == t or rest.strip(" \t\r\n")}
    assert {(200, "a1\nhot line of boilerplate\na2"), (201, "b1\nb2")} <= got and not any(i == 202 for i, _ in got)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.delete_repeated_runs(frame(spark, [])).count() == 0
    assert line_dedup.repeated_runs(frame(spark, [])).count() == 0


def brute_windows(rows, n):
    docs = [(i, [w.lower() for w in TOKEN.findall(t or "")]) for i, t in rows]
    count = Counter(tuple(w[p : p + n]) for _, w in docs for p in range(len(w) - n + 1))
    out = []
    for i, w in docs:
        hits = [p for p in range(len(w) - n + 1) if count[tuple(w[p : p + n])] > 1]
        span = None
        for p in hits:
            if span and p <= span[1] + n:
                span[1], span[2] = p, span[2] + 1
            else:
                if span:
                    out.append((i, span[0], span[1] + n, span[2]))
                span = [p, p, 1]
        if span:
            out.append((i, span[0], span[1] + n, span[2]))
    return Counter(out)


def test_passages_by_sql(spark, sf):
    same_rows(spark, suffix_dedup.op5_suffix_dedup(spark, sf), suffix_dedup.SQL, sf)


@pytest.mark.parametrize(("threshold", "anchor"), [(2, 2), (5, 3), (7, 7), (12, 4)])
def test_passages_by_brute_force(spark, threshold, anchor):
    rng = random.Random(threshold)
    passage = [f"p{k}" for k in range(20)]
    rows = ODD[:9] + [(None, "p1 p2 p3 " * 5), (50, "A b, c! a B c")]
    for k in range(50):
        words = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 40))]
        if k % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 5) : rng.randint(12, 20)]
        rows.append((100 + k, " ".join(words)))
    rows += rows[-3:] + [(900, rows[-4][1])]
    got = suffix_dedup.repeated_passages(frame(spark, rows), threshold=threshold, anchor=anchor).collect()
    assert Counter(map(tuple, got)) == brute_windows(rows, threshold)


def test_passages_of_empty_and_long_texts(spark):
    assert suffix_dedup.repeated_passages(frame(spark, [])).count() == 0
    assert [tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, [(1, "y " * 30000)])).collect()] == [(1, 0, 30000, 29951)]
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(frame(spark, []), threshold=4, anchor=5)


def variants(rng, n_groups, per_group):
    rows, groups = [], []
    for g in range(n_groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(per_group[g % len(per_group)]):
            words = [f"w{rng.randint(0, 3000)}" if rng.random() < 0.04 else w for w in base]
            rows.append((len(rows), " ".join(words)))
            groups.append(g)
    return rows, groups


def test_near_duplicates(spark):
    rows, groups = variants(random.Random(1), 60, [1, 2, 5])
    rows += [(1000, rows[1][1]), (1001, None), (1002, ""), (1003, "!!!"), (None, rows[0][1]), (0, rows[0][1])]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    group_of = {r["doc_id"]: r["group_id"] for r in got}
    first = {}
    for i, g in enumerate(groups):
        first.setdefault(g, i)
    expected = {i: first[g] for i, g in enumerate(groups) if groups.count(g) > 1} | {1000: first[groups[1]], None: 0, 0: 0, 1: first[groups[1]]}
    missing = {k for k in expected if group_of.get(k) != expected[k]}
    assert len(missing) <= 0.1 * len(expected)
    assert not set(group_of) - set(expected)
    kept = simhash.remove_near_duplicates(frame(spark, rows))
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert {1001, 1002, 1003} <= set(ids) and ids[0] == 1 and None not in ids and 1000 not in ids
    gone = {r["doc_id"] for r in got if not r["kept"]}
    assert set(ids) == {i for i, _ in rows} - gone
    assert kept.columns == frame(spark, rows).columns


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.remove_near_duplicates(frame(spark, [(1, None), (2, "")])).count() == 2


def test_recall_against_exact_search(spark, sf):
    rows = simhash.signatures(table(spark, sf.replace("0.001", "0.01"), "documents")).select(*simhash._WORDS).toPandas()
    codes = np.unique(rows.to_numpy().view(np.uint64), axis=0)
    assert simhash.audit(codes) >= 0.9  # one graph
    assert simhash.audit(codes, shard_nodes=128) >= 0.9  # graphs of shards


def test_groups_are_those_of_exact_search(spark, sf):
    """The registered query against the components of all pairs within the distance: at least nine in ten members agree."""
    docs = table(spark, sf, "documents")
    rows = simhash.signatures(docs).toPandas().sort_values("id")
    codes = rows[simhash._WORDS].to_numpy().view(np.uint64)
    every = np.array(sorted(simhash.exact_pairs(codes)))
    root = simhash._roots(len(codes), iter([(every[:, 0], every[:, 1])]))
    ids = rows["id"].to_numpy()
    size = Counter(root.tolist())
    want = {int(ids[i]): (int(ids[r]), size[int(r)]) for i, r in enumerate(root) if size[int(r)] > 1}
    for options in ({}, {"shard_nodes": 64, "complete_nodes": 8}):
        got = {r["doc_id"]: (r["group_id"], r["n_docs"]) for r in simhash.near_duplicates(docs, **options).collect()}
        assert set(got) <= set(want) and sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)
    assert Counter(map(tuple, simhash.op7_simhash(spark, sf).select("doc_id", "kept").collect())) == {(k, k == v[0]): 1 for k, v in {r["doc_id"]: (r["group_id"],) for r in simhash.near_duplicates(docs).collect()}.items()}


def test_bands_share_shards_as_promised():
    assert simhash.band_bits(1000).shape == (1, 0) and not simhash.shards_of(np.zeros((3, 4), np.uint64), simhash.band_bits(1000)).any()
    rng = np.random.default_rng(5)
    for n in (30_000, 250_000, 10**7, 10**10):
        bits = simhash.band_bits(n)
        assert len(bits) >= simhash.BANDS and all(len(set(b)) == len(b) for b in bits.tolist()) and n / 2 ** bits.shape[1] <= simhash.SHARD_NODES
        a = rng.integers(0, 2**63, (600, 4), dtype=np.uint64)
        flips = np.zeros((600, 256), np.uint8)
        for row in flips:
            row[rng.permutation(256)[: simhash.MAX_DISTANCE]] = 1
        b = a ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
        shared = (simhash.shards_of(a, bits) == simhash.shards_of(b, bits)).any(1).mean()
        assert shared >= simhash.SHARE - 0.03
        assert len(np.unique(simhash.shards_of(a, bits) >> bits.shape[1])) == len(bits)


def test_graph_against_exact_search():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (800, 4), dtype=np.uint64)
    near = base[:200].copy()
    near[:, 0] ^= np.uint64(0b1011)
    hot = np.repeat(base[:1], 300, 0)
    hot[:, 1] ^= (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    codes = np.unique(np.concatenate([base, near, hot]), axis=0)
    codes = codes[rng.permutation(len(codes))]
    pairs = lambda it: {(min(a, b), max(a, b)) for i, j in it for a, b in zip(i.tolist(), j.tolist()) if a != b}
    exact = pairs(simhash.shard_pairs(codes, 10, len(codes)))
    found = pairs(simhash.shard_pairs(codes, 10, 16, 400))
    # a cluster wider than any beam is found whole
    whole = pairs(simhash.shard_pairs(codes, 10, 16))
    assert whole <= exact and len(whole) >= 0.99 * len(exact)
    assert found <= exact and len(found) >= 0.9 * len(exact) and len(exact) > 20_000


def test_shards_of_thousands_are_compared_exactly_and_without_a_graph(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (3000, 4), dtype=np.uint64)
    near = base[:600].copy()
    near[:, 3] ^= np.uint64(2**48 - 1)  # at the limit, all in a word that is compared last
    near[:300, 2] ^= np.uint64(1)  # one bit beyond it
    codes = np.concatenate([base, near, ~base[:5], ~near[:5]])
    codes = codes[rng.permutation(len(codes))]
    i, j = np.nonzero(simhash.distance(codes[:, None], codes[None]) <= simhash.MAX_DISTANCE)
    want = [(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b]
    monkeypatch.setattr(simhash, "SmallWorld", None)
    for tile in (None, 1000):
        if tile:
            monkeypatch.setattr(simhash, "TILE_CELLS", tile)
        found = [(a, b) for x, y in simhash.shard_pairs(codes, simhash.MAX_DISTANCE) for a, b in zip(x.tolist(), y.tolist())]
        assert sorted(found) == want and len(want) >= 300
    assert not list(simhash.shard_pairs(codes[:0], 48)) and not list(simhash.shard_pairs(codes[:1], 48))


def test_recall_of_graphs_against_exact_search(spark, sf):
    rows = simhash.signatures(table(spark, sf.replace("0.001", "0.01"), "documents")).select(*simhash._WORDS).toPandas()
    codes = np.unique(rows.to_numpy().view(np.uint64), axis=0)
    assert simhash.audit(codes, complete_nodes=64) >= 0.9  # one graph
    assert simhash.audit(codes, shard_nodes=128, complete_nodes=64) >= 0.9  # graphs of shards


def test_distance_and_roots():
    a = np.array([[0, 0, 0, 0], [2**64 - 1, 0, 1, 0]], np.uint64)
    assert simhash.distance(a[:1], a[1:]).tolist() == [65]
    assert simhash._roots(6, iter([(np.array([4, 3]), np.array([5, 4])), (np.array([1]), np.array([2]))])).tolist() == [0, 1, 1, 3, 3, 3]
