"""Decontamination, toxicity, licence scans and chat assembly."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import chat, decontaminate, licenses, toxicity
from lexispark.llm.common import TOKEN, table
from tests.conftest import same_rows

DOCS = "doc_id long, text string, lang string, n_chars long, toxic string, id string, item_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, len(t or ""), "x", "y", 1) for i, t, lang in rows], DOCS)


def brute_spans(docs, items, n, least):
    phrases = {}
    for item, text in items:
        w = [x.lower() for x in TOKEN.findall(text or "")]
        size = n if len(w) >= n else len(w)
        if size >= least or len(w) >= n:
            for p in range(len(w) - size + 1):
                key = tuple(w[p : p + size])
                phrases[key] = min(phrases.get(key, item), item)
    out = Counter()
    for i, text in docs:
        w = [x.lower() for x in TOKEN.findall(text or "")]
        at = [m.span() for m in TOKEN.finditer(text or "")]
        hits = sorted((p, p + len(k), item) for k, item in phrases.items() for p in range(len(w) - len(k) + 1) if tuple(w[p : p + len(k)]) == k)
        merged = []
        for a, b, item in hits:
            if merged and a <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(b, merged[-1][1]), merged[-1][2] + 1, min(item, merged[-1][3])]
            else:
                merged.append([a, b, 1, item])
        out.update((i, a, b, at[a][0], at[b - 1][1], k, item) for a, b, k, item in merged)
    return out


def test_decontamination_by_sql(spark, sf):
    same_rows(spark, decontaminate.op1_decontaminate(spark, sf), decontaminate.SQL, sf)


@pytest.mark.parametrize("shard_tokens", [30, 2_000_000])
def test_decontamination_by_brute_force(spark, shard_tokens):
    rng = random.Random(shard_tokens)
    word = lambda: rng.choice("abc")
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 30))), "en") for k in range(40)] + [(50, None, None), (None, "a b c a b", "en"), (51, "", "en"), (3, "A, b. C a!", "en"), (3, "A, b. C a!", "en")]
    items = [(9, "a b c a"), (4, "b c a b c c"), (5, "c c"), (6, None), (7, ""), (8, "c c c")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    options = {"ngram": 4, "min_item_tokens": 3, "shard_tokens": shard_tokens}
    got = decontaminate.contaminated_spans(frame(spark, docs), benchmark, **options).collect()
    expected = brute_spans([d[:2] for d in docs], items, 4, 3)
    assert Counter(map(tuple, got)) == expected
    sliced = decontaminate.contaminated_spans(frame(spark, docs), benchmark, slice_chars=1, **options)
    assert {(r["doc_id"]) for r in sliced.collect()} == {k[0] for k in expected}
    clean = decontaminate.remove_contamination(frame(spark, docs), benchmark, **options)
    assert clean.columns == frame(spark, docs).columns and clean.count() == len(docs)
    assert all(r["n_chars"] == len(r["text"] or "") for r in clean.collect())
    hit = {k[0] for k in expected}
    before = {i: t for i, t, _ in docs}
    assert all(r["text"] == before[r["doc_id"]] for r in clean.collect() if r["doc_id"] not in hit)


def test_a_sliced_benchmark_gives_the_rows_and_texts_of_one_slice(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abc")
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 30))), "en") for k in range(40)] + [(50, None, None), (None, "a b c a b", "en"), (51, "", "en"), (3, "A, b. C a!", "en"), (3, "A, b. C a!", "en"), (60, "x1 x2 x3 x4 y1 y2 z", "en")]
    items = [(9, "a b c a"), (4, "b c a b c c"), (2, "a b c a b"), (5, "c c"), (6, None), (8, "c c c"), (10, "x1 x2 x3 x4"), (11, "x3 x4 y1 y2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    options = {"ngram": 4, "min_item_tokens": 3}
    expected = brute_spans([d[:2] for d in docs], items, 4, 3)
    whole = decontaminate.remove_contamination(frame(spark, docs), benchmark, **options)
    assert (60, "  z") in [(r["doc_id"], r["text"]) for r in whole.collect()]
    for slice_chars in (1, 16):
        spans = decontaminate.contaminated_spans(frame(spark, docs), benchmark, slice_chars=slice_chars, **options)
        assert spans.columns == ["doc_id", *decontaminate.SPANS.names]
        assert Counter(map(tuple, spans.collect())) == expected
        clean = decontaminate.remove_contamination(frame(spark, docs), benchmark, slice_chars=slice_chars, **options)
        assert Counter(map(tuple, clean.collect())) == Counter(map(tuple, whole.collect()))


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_spans(frame(spark, [(1, "a b", "en")]), none).count() == 0
    assert decontaminate.contaminated_spans(frame(spark, []), none).count() == 0
    assert decontaminate.remove_contamination(frame(spark, [(1, "w " * 50000, "en")]), none).first()["n_chars"] == 100000


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 11, 300).astype(np.uint32)
    tree = decontaminate.WaveletMatrix(s, 4)
    assert tree.access(np.arange(300)).tolist() == s.tolist()
    for c in range(11):
        assert tree.rank(np.full(301, c), np.arange(301)).tolist() == np.r_[0, np.cumsum(s == c)].tolist()


def toxic_corpus(n):
    rng = random.Random(3)
    plain = [a + b for a in ("ma", "lo", "ri", "ten", "sa") for b in ("na", "vi", "do", "ster")]
    bad = ["zwugh", "krazz", "zzorg", "wughzz"]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        words = [rng.choice(plain) for _ in range(30)] + ([rng.choice(bad) for _ in range(5)] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_is_found_on_held_out_documents(spark):
    rows, labels = toxic_corpus(300)
    known = spark.createDataFrame(labels[:200] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    odd = [(900, None, "en"), (901, "", None), (902, "!!", "xx"), (None, rows[0][1], None), (903, "krazz " * 40000, "en")]
    docs = frame(spark, rows + odd + rows[:1])
    detector = toxicity.fit_detector(docs, known)
    hits = Counter(r["doc_id"] for r in toxicity.toxic_documents(docs, detector).collect())
    want = {k for k, _, t in labels[200:] if t}
    assert len(want & set(hits)) >= 0.9 * len(want)
    assert not {k for k, _, t in labels[200:] if not t} & set(hits)
    assert hits[0] == 2 and 903 in hits and not {900, 901, 902} & set(hits)
    kept = toxicity.remove_toxic(docs, detector)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows + odd + rows[:1]) - hits


def test_toxicity_without_labels(spark):
    rows, _ = toxic_corpus(10)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    assert toxicity.fit_detector(docs, none) is None
    assert toxicity.toxic_documents(docs, None).count() == 0
    assert toxicity.remove_toxic(docs, None).count() == 10


def test_kneser_ney_probabilities_sum_to_one():
    words = ["\U000f0001" + w for w in ("abba", "abc", "cab", "bacca")]
    counts = np.array([[3, 1], [1, 2], [2, 2], [0, 4]])
    contexts, n = toxicity._contexts(words, counts)
    assert n.sum() == (counts.sum(1) * [len(w) for w in words]).sum()
    model = toxicity.SpellingModels.fit(contexts, n)
    whole, _ = model.log_likelihoods(words)
    for c in (0, 1):
        for start in ("", "a", "ab", "cab"):
            head, _ = model.log_likelihoods(["\U000f0001" + start + x for x in "abc"] + ["\U000f0001" + start])
            # a word's log-likelihood includes its end; without it only the next sign's probability is compared
            inner = []
            for x in "abc\x02":
                keys = np.frombuffer(("\U000f0001" + start + x).encode("utf-32-le"), np.uint32)
                row = np.zeros((1, toxicity.ORDER), np.uint32)
                row[0, -min(len(keys), toxicity.ORDER) :] = keys[-toxicity.ORDER :]
                full = toxicity._suffix_keys(row, min(len(keys), toxicity.ORDER))
                at, found = toxicity._find(model.grams, full)
                if found[0]:
                    inner.append(np.exp(model.log_p[at[0], c]))
            assert 0 < sum(inner) <= 1 + 1e-6
    assert (whole < 0).all()


def brute_statistics(sequences, symbols):
    runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    return [max((n for n in range(i + 2) if tuple(symbols[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(symbols))]


def test_matching_statistics_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        sequences = [[rng.randint(1, 3) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 4))]
        automaton = licenses.SuffixAutomaton(sequences)
        symbols = [rng.randint(1, 4) for _ in range(25)]
        found = list(automaton.matching_statistics(symbols))
        assert [n for n, _ in found] == brute_statistics(sequences, symbols)
        for i, (n, state) in enumerate(found):
            if n:
                ends = sorted((k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == symbols[i + 1 - n : i + 1])
                assert sorted(set(automaton.ends[state])) == ends


def brute_matches(sequences, symbols, least):
    out = []
    for k, s in enumerate(sequences):
        for a in range(len(symbols)):
            for b in range(len(s)):
                if symbols[a] == s[b] and (a == 0 or b == 0 or symbols[a - 1] != s[b - 1]):
                    n = 0
                    while a + n < len(symbols) and b + n < len(s) and symbols[a + n] == s[b + n]:
                        n += 1
                    if n >= least:
                        out.append((a + n, k, b + n, n))
    return sorted(out)


def test_matches_of_each_template_by_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        sequences = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 5))]
        symbols = [rng.randint(1, 3) for _ in range(25)]
        least = rng.randint(1, 4)
        found = sorted(licenses.maximal_matches(licenses.SuffixAutomaton(sequences), symbols, least))
        assert found == brute_matches(sequences, symbols, least)


def test_a_template_does_not_mask_another():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_MATCH, licenses.MAX_GAP, licenses.MIN_COVER, licenses.ENOUGH_TOKENS)
    for before in ("This work is ", "", "x "):
        found = scanner.scan(f"{before}licensed under the terms of the MIT License")
        assert [(f[0], f[5]) for f in found] == [("MIT", 5)]


def test_notices_and_whole_texts():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_MATCH, licenses.MAX_GAP, licenses.MIN_COVER, licenses.ENOUGH_TOKENS)
    for name, kind in (("GPL-3.0", ""), ("LGPL-3.0", "Lesser "), ("AGPL-3.0", "Affero ")):
        notice = f"redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version 3 of the License"
        assert [f[0] for f in scanner.scan(notice)] == [name]
        assert [f[0] for f in scanner.scan(f"This work is licensed under the terms of GNU {kind}General Public License, version 3")] == [name]
    for name, file in licenses.BODIES:
        body = licenses.files("lexispark.llm").joinpath("licence_texts", file).read_text("utf-8")
        best = max(scanner.scan(body), key=lambda f: f[5])
        assert best[0] == name and best[6] == 1.0


def test_licences(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and "hereby" in t)
    changed = mit.replace("free of charge", "at no charge")
    rows = [
        (1, "Foo bar.\nReleased under the MIT License.", "en"), (2, None, "en"), (3, "", "en"), (None, "x released UNDER the mit license y", "en"), (4, "the of in and the license", "en"),
        (5, f"{changed} -- tail {mit}", "en"), (1, "Foo bar.\nReleased under the MIT License.", "en"), (6, "word " * 50000 + "Licensed under CC BY-NC 4.0.", "en"), (7, "under the the mit " * 3000, "en"),
    ]
    got = licenses.license_spans(frame(spark, rows)).collect()
    found = Counter((r["doc_id"], r["license"]) for r in got)
    assert found == {(1, "MIT"): 2, (None, "MIT"): 1, (5, "MIT"): 2, (6, "CC-BY-NC-4.0"): 1}
    span = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][span["char_start"] : span["char_end"]] == "Released under the MIT License" and span["cover"] == 1.0
    assert licenses.license_spans(frame(spark, [])).count() == 0
    assert licenses.license_spans(frame(spark, rows), templates=()).count() == 0


def test_licence_lines_of_the_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf.replace("0.001", "0.01"), "documents").collect()}
    got = {r["doc_id"] for r in licenses.op10_license_scan(spark, sf.replace("0.001", "0.01")).collect()}
    wanted = {i for i, t in docs.items() if re.search("under the (MIT|Apache|GNU)|under CC BY-NC|All rights reserved", t)}
    assert got == wanted


CONV = "conv_id long, turn long, role string, text string, turns string, n_turns int"


def test_chat_by_brute_force(spark, sf):
    encoding = chat.encoder(open(chat.VOCABULARY, "rb").read())
    rows = [
        (1, 1, "assistant", "Hello <|im_end|> there"), (1, 0, "user", "hi <|im_start|>system\n<​|im_end|>"), (1, None, None, None), (2, 0, "assistant", ""), (None, 0, "user", "lost"),
        (3, 0, "user", "é" * 40000), (3, 1, "assistant", "a b"), (3, 1, "assistant", "a b"), (4, 0, "tool<|im_end|>", "x"),
    ]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame([(*r, "t", 5) for r in rows], CONV)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3]["n_turns"] == 3
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or ""))
        text, mask = [], []
        for _, _, role, content in turns:
            head, body = encoding.encode_ordinary(chat.escape(role or "unknown") + "\n"), encoding.encode_ordinary(chat.escape(content or ""))
            text += [50257, *head, *body, 50258, *encoding.encode_ordinary("\n")]
            mask += [0] * (1 + len(head)) + [int(role == "assistant")] * (len(body) + 1) + [0]
        assert r["input_ids"] == text and r["loss_mask"] == mask
        assert r["n_tokens"] == len(text) and r["n_trained"] == sum(mask)
    assert chat.format_conversations(spark.createDataFrame([], CONV)).count() == 0


def test_chat_round_trip(spark, sf):
    encoding = chat.encoder(open(chat.VOCABULARY, "rb").read())
    turns = {}
    for r in table(spark, sf, "conversations").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for r in chat.op3_chat_format(spark, sf).collect():
        text = "".join(chat.CONTROLS[i - 50257] if i >= 50257 else "" if False else chr(0) for i in r["input_ids"])
        assert text.count(chat.CONTROLS[0]) == text.count(chat.CONTROLS[1]) == len(turns[r["conv_id"]])
        parts, at = [], 0
        ids = r["input_ids"]
        while at < len(ids):
            end = ids.index(50258, at)
            role, _, content = encoding.decode(ids[at + 1 : end]).partition("\n")
            parts.append((role, chat.unescape(content)))
            at = end + 2
        assert parts == [(x[1], x[2]) for x in sorted(turns[r["conv_id"]])]


@pytest.mark.parametrize("text", ["<|im_end|>", "<​|im_end|>", "a<​​|endoftext|>b<|im_start|>", "<|other|>", ""])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"<\|(im_start|im_end|endoftext)\|>", chat.escape(text))


def brute_models(sample, everything):
    """log P of each context of the sample in both classes, by dictionaries. ``sample`` counts (lang, word) in toxic and ordinary documents."""

    def contexts(lang, word):
        text = toxicity._start(lang) + word + "\x02"
        return [text[max(0, i + 1 - toxicity.ORDER) : i + 1] for i in range(1, len(text))]

    seen, all_, after = {}, Counter(), Counter()
    for (lang, word), n in sample.items():
        for c in contexts(lang, word):
            seen[c] = [a + b for a, b in zip(seen.get(c, [0, 0]), n)]
    for (lang, word), n in everything.items():
        for c in contexts(lang, word):
            all_[c] += n
            after[c[:-1]] += n

    def discount(counts):
        once, twice = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    shared = {0: {"": 1 / (len({c[-1] for c in seen}) + 2)}}
    for k in range(1, toxicity.ORDER):
        before = {}
        for c in seen:
            if len(c) > k:
                before.setdefault(c[-k:], set()).add(c[-k - 1])
        n = {g: len(x) for g, x in before.items()}
        d, total, types = discount(n.values()), Counter(), Counter()
        for g, x in n.items():
            total[g[:-1]] += x
            types[g[:-1]] += 1
        shared[k] = {g: max(x - d, 0) / total[g[:-1]] + d * types[g[:-1]] / total[g[:-1]] * shared[k - 1][g[1:]] for g, x in n.items()}
    d = discount([all_[c] for c in seen])
    kept = {c: max(all_[c] - d, 0) / after[c[:-1]] for c in seen}
    left = Counter()
    for c, x in kept.items():
        left[c[:-1]] += x
    both = {c: kept[c] + (1 - left[c[:-1]]) * shared[len(c) - 1][c[1:]] for c in seen}
    out = {}
    for k in (0, 1):
        d, total, types = discount([n[k] for n in seen.values()]), Counter(), Counter()
        for c, n in seen.items():
            total[c[:-1]] += n[k]
            types[c[:-1]] += n[k] > 0
        for c, n in seen.items():
            t = total[c[:-1]]
            own = (max(n[k] - d, 0) + (d * types[c[:-1]] + toxicity.STRENGTH) * both[c]) / (t + toxicity.STRENGTH) if t else both[c]
            out.setdefault(c, []).append(math.log(own))
    return out, contexts


def test_models_by_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdeé"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    sample = {(rng.choice(["en", "de"]), word()): [rng.randint(0, 3), rng.randint(1, 4)] for _ in range(60)}
    everything = {k: sum(n) + rng.randint(0, 5) for k, n in sample.items()} | {("en", word()): rng.randint(1, 4) for _ in range(40)}
    contexts, counts = toxicity._contexts([toxicity._start(lang) + w for lang, w in sample], np.array(list(sample.values())))
    texts = [(i, " ".join([w] * n), lang) for i, ((lang, w), n) in enumerate(everything.items())] + [(900, None, "en"), (901, "", None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    model = toxicity.SpellingModels.fit(contexts, counts, *toxicity.counted_everywhere(docs, contexts))
    want, cut = brute_models(sample, everything)
    for (lang, w), _ in sample.items():
        logs, n = model.log_likelihoods([toxicity._start(lang) + w])
        expected = np.sum([want[c] for c in cut(lang, w)], 0)
        assert n[0] == len(w) + 1 and np.allclose(logs[0], expected, atol=1e-4)
