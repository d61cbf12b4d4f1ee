"""Archive conversion, top-k search, packing and the pipeline."""

from __future__ import annotations

import gzip
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import packing, topk_search, warc
from lexispark.llm.common import table, tidy
from tests.conftest import same_rows


def test_archives_by_sql(spark, sf):
    same_rows(spark, warc.op2_warc(spark, sf), warc.SQL, sf)


def test_archive_round_trip_and_odd_records(spark):
    pages = [(1, "http://a.example/x y", "<p>é</p>\r\n\r\nrest"), (2, "https://b.example/", ""), (2, "https://b.example/", ""), (3, None, "x"), (4, "http://c.example/", None), (None, "http://d.example/", "x"), (5, "http://e.example/", "z" * 300_000)]
    df = spark.createDataFrame([(*p, "n", b"c") for p in pages], "page_id long, url string, html string, archive string, content binary")
    arcs = warc.pages_to_arc(df, archive_pages=2)
    rows = warc.convert_archives(arcs).collect()
    got = Counter((r["target_uri"], r["arc_version"], bytes(r["record"]).split(b"\r\n\r\n", 2)[2][:-4].decode()) for r in rows if r["warc_type"] == "response")
    assert got == Counter([("http://a.example/x%20y", 2, pages[0][2]), ("https://b.example/", 1, ""), ("https://b.example/", 1, ""), ("http://e.example/", 2, pages[-1][2])])
    assert all(r["error"] is None for r in rows)
    assert {r["warc_type"] for r in rows} == {"warcinfo", "response"}
    assert warc.pages_to_arc(df.limit(0)).count() == 0 and warc.convert_archives(arcs.limit(0)).count() == 0


def test_arc_parsing():
    one = warc.arc_of([(1, "http://a.example/b c", "x\n\ny")], 1, "one.arc")
    two = warc.arc_of([(1, "http://a.example/", "q")], 2, "two.arc")
    kinds = lambda data: [(v, f[0], e) for v, f, _, e in warc.arc_records(data)]
    assert kinds(one) == [(1, "filedesc://one.arc", None), (1, "http://a.example/b c", None)]
    assert kinds(one + b"\n" + two) == [*kinds(one), (2, "filedesc://two.arc", None), (2, "http://a.example/", None)]
    assert kinds(one[:-1])[-1][2] == "truncated"
    assert kinds(one + b"\nnonsense\n")[-1] == (1, "nonsense", "header")
    assert kinds(b"") == []
    dns = b"dns:a.example 1.2.3.4 19990203040506 text/dns 5\n12345"
    (record,) = [warc.to_warc("x", *r) for r in warc.arc_records(dns)]
    assert record[2] == "resource" and record[4] == "1999-02-03T04:05:06Z" and record[9] == 5 and record[10] == warc.sha1(b"12345")
    assert [warc.warc_date(s) for s in ("1999", "199902", "19990230000000", "x", "")] == ["1999-01-01T00:00:00Z", "1999-02-01T00:00:00Z", None, None, None]


def test_damaged_archives_cost_their_damaged_members(spark):
    parts = [warc.arc_of([(k, f"http://a.example/{k}", f"page {k} " * 40)], 1 + k % 2, f"{k}.arc") for k in range(4)]
    packed = [gzip.compress(p) for p in parts]
    broken = packed[1][:60] + bytes(x ^ 0x55 for x in packed[1][60:80]) + packed[1][80:]
    kinds = lambda data: [(r[1][0], r[3]) for r in warc.archive_records(data)]
    of = lambda k: [(f"filedesc://{k}.arc", None), (f"http://a.example/{k}", None)]
    assert kinds(b"".join(packed)) == of(0) + of(1) + of(2) + of(3) and kinds(b"".join(parts)) == kinds(b"".join(packed))
    # a member that begins with a record and no version block follows the version of the one before
    first, second = (gzip.compress(x) for x in (parts[1][: parts[1].index(b"\nhttp://") + 1], parts[1][parts[1].index(b"http://") :]))
    assert kinds(first + second) == of(1)
    found = kinds(packed[0] + broken + packed[2])
    assert found[:2] == of(0) and found[-2:] == of(2) and ("gzip" in [e for _, e in found[2:-2]]) and len(found) <= 7
    assert kinds(packed[0] + packed[1][:-20])[-1][1] == "gzip" and kinds(packed[0][:-20])[-1][1] == "gzip"
    # a wrong length in one member leaves the others
    wrong = gzip.compress(parts[1].replace(b" 0.0.0.0 ", b" 0.0.0.0 x "))
    assert kinds(packed[0] + wrong + packed[2])[-2:] == of(2)
    df = spark.createDataFrame([("a", packed[0] + broken + packed[2]), ("b", b"\x1f\x8b"), ("c", None), ("d", b"")], "archive string, content binary")
    rows = warc.convert_archives(df).collect()
    assert {r["archive"] for r in rows} == {"a", "b"} and [r["error"] for r in rows if r["archive"] == "b"] == ["gzip"]
    assert sum(r["warc_type"] == "response" and r["error"] is None for r in rows) >= 2


VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, length int"


def brute_top(rows, k, asks=lambda i: True):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, v) in enumerate(ok):
        if asks(i):
            near = sorted((-round(float(v @ w), 9) + 0.0, j is None, j or 0) for b, (j, w) in enumerate(ok) if a != b and len(v) == len(w))[:k]
            out.update((i, n + 1, None if none else j, round(-s + 0.0, 6) + 0.0) for n, (s, none, j) in enumerate(near))
    return out


@pytest.mark.parametrize(("spread", "coordinate_from"), [(0.0, 0.5), (1.5, 0.5), (1.5, -1.0), (0.0, 2.0)])
def test_top_k_by_brute_force(spark, spread, coordinate_from):
    rng = np.random.default_rng(int(spread * 10))
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(150):
        v = centres[i % 6] + 0.2 * rng.normal(size=8)
        v *= np.exp(spread * rng.normal()) / np.sqrt((v * v).sum())
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    rows += [rows[3], (200, rows[3][1]), (None, rows[4][1]), (201, [0.0] * 8), (202, None), (203, []), (204, [1.0, None] + [0.0] * 6), (205, [float("nan")] * 8), (206, [float("inf")] * 8), (207, [1.0, 2.0]), (208, [3.0, -2.0]), (209, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0, 1, "v", 2) for i, v in rows], VECTORS)
    plain = lambda out: Counter((r["vec_id"], r["rank"], r["neighbour_id"], round(r["score"], 6) + 0.0) for r in out.collect())
    options = {"k": 5, "bucket_rows": 40, "coordinate_from": coordinate_from}
    assert plain(topk_search.top_k(df, block_bytes=3000, **options)) == brute_top(rows, 5)
    assert plain(topk_search.top_k(df, asks=F.col("vec_id") % 20 == 0, **options)) == brute_top(rows, 5, lambda i: i is not None and i % 20 == 0)


def test_top_k_by_sql_and_of_few_rows(spark, sf):
    same_rows(spark, topk_search.op6_topk_search(spark, sf), topk_search.SQL, sf)
    one = spark.createDataFrame([(1, [1.0], 0, 1, "v", 2)], VECTORS)
    assert topk_search.top_k(one).count() == 0 and topk_search.top_k(one.limit(0)).count() == 0 and topk_search.top_k(one, asks=F.lit(False)).count() == 0


def test_top_k_ships_no_pair_of_block_and_bucket(spark, sf, capsys):
    topk_search.op6_topk_search(spark, sf).explain()
    assert "Cartesian" not in capsys.readouterr().out


def test_pruning_computes_fewer_products():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 16))
    v[1000:] *= 0.01
    v = v[np.argsort(-np.sqrt((v * v).sum(1)))]
    parts = [topk_search.Bucket(n, np.arange(n * 500, n * 500 + 500), v[n * 500 : n * 500 + 500]) for n in range(4)]
    asks = topk_search.Queries(parts[0].ids, parts[0].vectors, np.zeros(500, np.int64), np.arange(500))
    best = topk_search.Best(500, 5)
    assert sum(topk_search.search_bucket(asks, best, b) for b in parts) <= 1000 * 500


def check_packing(rows, docs, size):
    """Every piece whole in one sequence; the pieces of each document together its tokens. ``docs`` counts (id, tokens)."""
    assert sorted(r["seq_id"] for r in rows) == list(range(len(rows)))
    parts = {}
    for r in rows:
        ids, bounds = r["input_ids"], [*r["starts"], r["n_tokens"]]
        assert len(ids) == r["n_tokens"] <= size and bounds[0] == 0 and bounds == sorted(set(bounds)) and len(r["doc_ids"]) == len(r["pieces"]) == len(r["starts"])
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], bounds, bounds[1:]):
            parts.setdefault(doc, []).append((piece, tuple(ids[a:b])))
    want = {}
    for (doc, tokens), n in docs.items():
        for p, at in enumerate(range(0, len(tokens), size)):
            want.setdefault(doc, []).extend([(p, tokens[at : at + size])] * n)
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    return len(rows)


def encoded(text):
    with open(packing.VOCABULARY, "rb") as file:
        return (*packing.encoder(file.read()).encode_ordinary(text), packing.END_OF_TEXT)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(1, 90)) for k in range(400)] + [(1000, None), (1001, ""), (1002, "a, b! <|endoftext|>"), (None, "x y"), (0, None), (7, "same text"), (7, "same text"), (1003, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, "h", 2) for i, t in rows], "doc_id long, text string, n int, ids string, bin int").repartition(3)
    want = Counter((i, encoded(t)) for i, t in rows if t)
    got = packing.pack(df, seq_tokens=64, bins=32).collect()
    assert check_packing(got, want, 64) <= 1.05 * sum(len(t) * n for (_, t), n in want.items()) / 64 + 3
    assert packing.pack(df.limit(0), seq_tokens=64, bins=32).count() == 0
    plain = packing.pack(df.where("doc_id = 1002"), end_token=None).collect()
    assert [tuple(r["input_ids"]) for r in plain] == [encoded("a, b! <|endoftext|>")[:-1]]
    with pytest.raises(ValueError):
        packing.pack(df, seq_tokens=65, bins=32)


def test_packing_of_the_table(spark, sf):
    got = packing.op8_best_fit_packing(spark, sf).collect()
    want = Counter((r["doc_id"], encoded(r["text"])) for r in table(spark, sf, "documents").collect() if r["text"])
    n = check_packing(got, want, packing.SEQ_TOKENS)
    assert sum(r["n_tokens"] for r in got) > 0.95 * n * packing.SEQ_TOKENS


def best_fit(sizes, room):
    open_ = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, o in enumerate(open_) if o + s <= room]
        if fits:
            k = max(fits, key=lambda k: open_[k])
            open_[k] += s
        else:
            open_.append(s)
    return len(open_)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_up_the_histogram_and_is_near_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(32, 1 + rng.geometric(0.02 + 0.1 * rng.random(), 1500)) if seed % 2 else rng.integers(1, 33, 1500)
    histogram = np.bincount(sizes, minlength=33)[1:]
    plan = packing.plan(histogram)
    used = np.zeros(32, int)
    for lengths, n in plan:
        assert sum(lengths) <= 32 and n > 0
        for x in lengths:
            used[x - 1] += n
    assert used.tolist() == histogram.tolist()
    assert sum(n for _, n in plan) <= 1.02 * best_fit(sizes.tolist(), 32) + 2
    assert packing.plan(np.zeros(32, int)) == []
    assert packing.plan(np.bincount([31], minlength=32) * 10**9) == [((32,), 10**9)]


def test_nnls_by_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.normal(size=(12, 20)), rng.normal(size=12)
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-6).all() and np.abs(gradient[x > 1e-9]).max(initial=0) < 1e-6


def test_pipeline(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = table(spark, sf, "documents")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns and [f.dataType for f in step.schema] == [f.dataType for f in docs.schema], name
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in step.collect()}
    assert {i for r in rows for i in r["doc_ids"]} == {r["doc_id"] for r in step.collect() if r["text"]} <= kept <= {r["doc_id"] for r in docs.collect()}
    assert len(kept) > 0.5 * docs.count()


def test_a_worker_gives_back_what_a_task_took():
    held = lambda: int(next(x for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("VmRSS")).split()[1]) // 1024
    pins = []

    def run(batches):
        blocks = []
        for k in range(6000):  # too small to be mapped one by one, with others among them that stay
            blocks.append(np.ones(50_000, np.uint8))
            if k % 50 == 0:
                pins.append(np.ones(2_000, np.uint8))
        yield from ((b, held()) for b in batches)

    before = held()
    assert [b for b, _ in run([1])] == [1]
    kept = held() - before
    pins.clear()
    ((b, most),) = tidy(run)([2])
    assert b == 2 and most - before > 200
    assert held() - before < min(100, 0.5 * kept)


def test_all_python_of_the_pipeline_gives_memory_back(spark, sf, monkeypatch):
    docs, seen = table(spark, sf, "documents").limit(200), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, func, *a, **k: (seen.append(func.__qualname__), plain(df, func, *a, **k))[1])
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf)
    assert len(seen) >= 8 and set(seen) == {"tidy.<locals>.tidied"}


def test_pipeline_stages_with_odd_rows(spark, sf):
    long = "word " * 40_000
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "a\nb", "en", "s", 3), (3, "a\nb", "en", "s", 3), (4, "a\nb", "en", "s", 3), (5, long, "en", "s", 200_000)]
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    twice = [(3, "a\nb")] * 2
    blank = [(None, None), (1, None), (2, "")]
    # nothing is labelled; of equal lines the first documents keep theirs; of near duplicates one row stays; there is no benchmark passage
    want = {
        "toxicity": [(i, t) for i, t, *_ in rows], "line_dedup": [*blank, *twice, (5, long)], "simhash_near_dedup": [*blank, (3, "a\nb"), (5, long)], "benchmark_decontamination": [(i, t) for i, t, *_ in rows],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name in want:
            assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want[name]), name
            assert {r["doc_id"]: r["n_chars"] for r in out.collect()} == {i: n for i, *_, n in rows if i in {x for x, _ in want[name]}}
        else:
            check_packing(out.collect(), Counter((i, encoded(t)) for i, t, *_ in rows if t), packing.SEQ_TOKENS)
        assert stage(spark, docs.limit(0), sf).count() == 0
