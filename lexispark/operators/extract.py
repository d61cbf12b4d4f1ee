"""Extraction of words, n-grams, entities, terms, keywords in context, matches and acronyms.

Most are column expressions over the annotated tokens of :func:`lexispark.functions.tokens.annotate`. A span is a struct of
(start, end, text, lower, norm, lemma, label), its end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from lexispark.functions.acronyms import SHAPE, is_acronym
from lexispark.functions.columns import ColumnOrName, col, let, portions

SPANS = "array<struct<start:int,end:int,text:string,lower:string,norm:string,lemma:string,label:string>>"
NUMERIC_ENTITIES = ("ORDINAL", "CARDINAL", "MONEY", "QUANTITY", "PERCENT", "TIME", "DATE")
KEYS = ("text", "lower", "norm", "lemma")


def plain(values: pa.Array) -> list:
    """The values of an array; lists of structs become lists of dicts field by field, which is several times faster than one by one."""
    if not (pa.types.is_list(values.type) and pa.types.is_struct(values.type.value_type)):
        return values.to_pylist()
    offsets = values.offsets.to_pylist()
    inner = values.values.slice(offsets[0], offsets[-1] - offsets[0])  # of a slice, its own alone
    names = [values.type.value_type.field(k).name for k in range(values.type.value_type.num_fields)]
    rows = [dict(zip(names, row)) for row in zip(*(inner.field(k).to_pylist() for k in range(len(names))))]
    if inner.null_count:
        rows = [r if there else None for r, there in zip(rows, inner.is_valid().to_pylist())]
    offsets = [o - offsets[0] for o in offsets]
    return [rows[a:b] if there else None for a, b, there in zip(offsets, offsets[1:], values.is_valid().to_pylist())]


def by_portions(batch: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of a batch by the tokens, or whatever arrays it has."""
    at = next((k for k, a in enumerate(batch) if pa.types.is_list(a.type)), 0)
    order = [at, *(k for k in range(len(batch)) if k != at)]
    for part in portions(*(batch[k] for k in order)):
        yield tuple(part[order.index(k)] for k in range(len(batch)))


def per_doc(returns: str):
    """A function of a document's tokens, as a list of dicts, made a column function."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: ColumnOrName, **options) -> Column:
            kind = to_arrow_type(DataType.fromDDL(returns))

            @F.arrow_udf(returns)
            def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for batch in batches:
                    # one column comes by itself
                    for part in by_portions(batch if isinstance(batch, tuple) else (batch,)):
                        yield pa.array([None if row[0] is None else f(*row, **options) for row in zip(*map(plain, part))], kind)

            return run(*map(col, columns))

        call.__name__, call.__doc__, call.plain = f.__name__, f.__doc__, f
        return call

    return wrap


def _tuple(x) -> tuple:
    return () if x is None else (x,) if isinstance(x, (str, int)) else tuple(x)


def frequent(items: Column, key: Callable[[Column], Column], min_freq: int) -> Column:
    """The items whose key occurs ``min_freq`` times: in sorted order the key stands again that much further on."""
    if min_freq <= 1:
        return items

    def often(ordered: Column) -> Column:
        starts = F.when(F.size(ordered) >= min_freq, F.sequence(F.lit(1), F.size(ordered) - (min_freq - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(F.filter(starts, lambda i: F.element_at(ordered, i) == F.element_at(ordered, i + (min_freq - 1))), lambda i: F.element_at(ordered, i)))

    keep = lambda found: F.filter(items, lambda x: F.array_contains(found, key(x)))
    return let(let(F.array_sort(F.transform(items, key)), often), keep)


def words(tokens: ColumnOrName, *, filter_stops: bool = True, filter_punct: bool = True, filter_nums: bool = False, include_pos: str | Collection[str] | None = None, exclude_pos: str | Collection[str] | None = None, min_freq: int = 1) -> Column:
    """Tokens that pass the filters; ``min_freq`` counts lower-case forms among those."""
    if min_freq < 1:
        raise ValueError("min_freq is 1 at least")

    def passes(t: Column) -> Column:
        out = ~t["is_space"]
        if filter_stops:
            out = out & ~t["is_stop"]
        if filter_punct:
            out = out & ~t["is_punct"]
        if filter_nums:
            out = out & ~t["like_num"]
        if include_pos:
            out = out & t["pos"].isin(*_tuple(include_pos))
        if exclude_pos:
            out = out & ~F.coalesce(t["pos"].isin(*_tuple(exclude_pos)), F.lit(False))
        return F.coalesce(out, F.lit(False))

    return frequent(F.filter(col(tokens), passes), lambda t: t["lower"], min_freq)


def _span(part: Column, label: Column | None = None) -> Column:
    """The span of some tokens in a row."""
    last = F.element_at(part, -1)
    joined = lambda name: F.array_join(F.transform(part, lambda t: F.concat(F.coalesce(t[name], t["lower"]), F.when(t["i"] == last["i"], F.lit("")).otherwise(t["ws"]))), "")
    blanks = lambda name: F.array_join(F.transform(part, lambda t: F.coalesce(t[name], t["lower"])), " ")
    return F.struct(part[0]["i"].alias("start"), (last["i"] + 1).alias("end"), joined("text").alias("text"), joined("lower").alias("lower"), joined("norm").alias("norm"), blanks("lemma").alias("lemma"), (F.lit(None).cast("string") if label is None else label).alias("label"))


def ngrams(tokens: ColumnOrName, n: int | Iterable[int], *, filter_stops: bool = True, filter_punct: bool = True, filter_nums: bool = False, include_pos: str | Collection[str] | None = None, exclude_pos: str | Collection[str] | None = None, min_freq: int = 1) -> Column:
    """Spans of ``n`` tokens in a row that neither begin nor end with a stop word and hold nothing filtered."""
    sizes = _tuple(n)
    if not sizes or min(sizes) < 1 or min_freq < 1:
        raise ValueError("n and min_freq are 1 at least")
    doc = col(tokens)

    def passes(part: Column) -> Column:
        out = ~F.exists(part, lambda t: t["is_space"])
        if filter_stops:
            out = out & ~part[0]["is_stop"] & ~F.element_at(part, -1)["is_stop"]
        if filter_punct:
            out = out & ~F.exists(part, lambda t: t["is_punct"])
        if filter_nums:
            out = out & ~F.exists(part, lambda t: t["like_num"])
        if include_pos:
            out = out & F.forall(part, lambda t: F.coalesce(t["pos"].isin(*_tuple(include_pos)), F.lit(False)))
        if exclude_pos:
            out = out & ~F.exists(part, lambda t: F.coalesce(t["pos"].isin(*_tuple(exclude_pos)), F.lit(False)))
        return out

    def of(size: int) -> Column:
        starts = F.when(F.size(doc) >= size, F.sequence(F.lit(1), F.size(doc) - (size - 1))).when(doc.isNotNull(), F.array().cast("array<int>"))
        parts = F.filter(F.transform(starts, lambda i: F.slice(doc, i, F.lit(size))), passes)
        return frequent(F.transform(parts, lambda part: _span(part)), lambda s: s["lower"], min_freq)

    return F.flatten(F.array(*map(of, sizes)))


def _make_span(part: list[dict], label: str | None = None) -> dict:
    text = lambda k: "".join((t[k] or t["lower"]) + (t["ws"] if t is not part[-1] else "") for t in part)
    return {"start": part[0]["i"], "end": part[-1]["i"] + 1, "text": text("text"), "lower": text("lower"), "norm": text("norm"), "lemma": " ".join(t["lemma"] or t["lower"] for t in part), "label": label}


def _often(spans: list[dict], min_freq: int) -> list[dict]:
    count = Counter(s["lower"] for s in spans)
    return [s for s in spans if count[s["lower"]] >= min_freq]


def _bare(part: list[dict], drop_determiners: bool) -> list[dict]:
    return part[1:] if drop_determiners and part[0]["pos"] == "DET" else part


@per_doc(SPANS)
def _entities(doc, include, exclude, drop_determiners, min_freq):
    out, at = [], 0
    while at < len(doc):
        end = at + 1
        if doc[at]["ent_iob"] == "B":
            while end < len(doc) and doc[end]["ent_iob"] == "I":
                end += 1
            label, part = doc[at]["ent_type"], _bare(list(doc[at:end]), drop_determiners)
            if part and (not include or label in include) and label not in exclude and part[0]["text"].strip():
                out.append(_make_span(part, label))
        at = end
    return _often(out, min_freq)


def entities(tokens: ColumnOrName, *, include_types: str | Collection[str] | None = None, exclude_types: str | Collection[str] | None = None, drop_determiners: bool = True, min_freq: int = 1) -> Column:
    """Spans of entities, from ``ent_iob`` and ``ent_type``; the type NUMERIC stands for seven kinds of numbers."""
    wide = lambda x: {y for t in _tuple(x) for y in (NUMERIC_ENTITIES if t == "NUMERIC" else (t,))}
    return _entities(tokens, include=wide(include_types), exclude=wide(exclude_types), drop_determiners=drop_determiners, min_freq=min_freq)


@per_doc(SPANS)
def _chunks(doc, drop_determiners, min_freq):
    """A nominal head that isn't part of a compound, with what stands before it and hangs on it."""
    out, end = [], 0
    for t in doc:
        if t["pos"] not in ("NOUN", "PROPN", "PRON") or t["dep"] in ("compound", "nmod", None):
            continue
        start = t["i"]
        while start > end and doc[start - 1]["head"] is not None and start <= doc[start - 1]["head"] <= t["i"] and doc[start - 1]["pos"] not in ("VERB", "AUX", "ADP", "PUNCT", "CCONJ"):
            start -= 1
        part = _bare(list(doc[start : t["i"] + 1]), drop_determiners)
        if part:
            out.append(_make_span(part))
        end = t["i"] + 1
    return _often(out, min_freq)


def noun_chunks(tokens: ColumnOrName, *, drop_determiners: bool = True, min_freq: int = 1) -> Column:
    return _chunks(tokens, drop_determiners=drop_determiners, min_freq=min_freq)


def terms(tokens: ColumnOrName, *, ngs: int | Collection[int] | Callable | None = None, ents: bool | Callable | None = None, ncs: bool | Callable | None = None, dedupe: bool = True) -> Column:
    """N-grams, then entities, then noun chunks; of spans with the same place the first stays."""
    parts = []
    if ngs is not None:
        parts.append(ngs(tokens) if callable(ngs) else ngrams(tokens, ngs))
    for wanted, extract in ((ents, entities), (ncs, noun_chunks)):
        if wanted:
            parts.append(wanted(tokens) if callable(wanted) else extract(tokens))
    if not parts:
        raise ValueError("terms need one extractor at least")
    found = F.flatten(F.array(*parts))
    # n-grams alone never share a place
    return unique_spans(found) if dedupe and len(parts) > 1 else found


def unique_spans(spans: Column) -> Column:
    """The first of the spans with the same start and end."""
    place = lambda s: F.shiftleft(s["start"].cast("bigint"), 31) + s["end"]
    return let(spans, lambda all_: let(F.transform(all_, place), lambda p: F.filter(all_, lambda s, i: F.array_position(p, place(s)) == i + 1)))


def terms_to_strings(terms_col: ColumnOrName, by: str | Callable[[Column], Column] = "lower") -> Column:
    """Texts of tokens or spans: by text (``orth``), lower, norm, lemma, or a column function."""
    if callable(by):
        return F.transform(col(terms_col), by)
    name = {"orth": "text"}.get(by.rstrip("_"), by.rstrip("_"))
    if name not in KEYS:
        raise ValueError(f"by = {by!r}; known are {KEYS}")
    return F.transform(col(terms_col), lambda t: F.coalesce(t[name], t["lower"]))


def _weighted(keys: Column, tokens: ColumnOrName, weighting: str) -> Column:
    """Keys to weights: in sorted order a key's count is the distance to the next one's first place."""
    if weighting not in ("count", "freq", "binary"):
        raise ValueError(f"weighting = {weighting!r}; known are count, freq and binary")
    n = F.size(col(tokens))

    def weigh(k: Column) -> Column:
        return {"count": k.cast("double"), "binary": F.lit(1.0), "freq": k / n}[weighting]

    def count(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(places, lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return let(firsts, lambda f: F.map_from_arrays(F.transform(f, lambda i: F.element_at(s, i)), F.transform(f, lambda i, k: weigh(F.coalesce(F.get(f, k + 1), F.size(s) + 1) - i))))

    return let(F.array_sort(F.filter(keys, lambda k: k.isNotNull())), count)


def to_bag_of_words(tokens: ColumnOrName, *, by: str = "lemma", weighting: str = "count", **filters) -> Column:
    """Words to counts; ``freq`` divides by all tokens of the document, filtered ones too."""
    return _weighted(terms_to_strings(words(tokens, **filters), by), tokens, weighting)


def to_bag_of_terms(tokens: ColumnOrName, *, by: str = "lemma", weighting: str = "count", **extractors) -> Column:
    return _weighted(terms_to_strings(terms(tokens, **extractors), by), tokens, weighting)


def bag_rows(df: DataFrame, *, id_col: str = "doc_id", words_col: str = "words", weighting: str = "count") -> DataFrame:
    """(doc_id, term, weight) of arrays of words: the long form of a bag, aggregated where it grows large."""
    found = df.select(F.col(id_col).alias("doc_id"), F.size(words_col).alias("n"), F.explode(words_col).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    weight = {"count": F.col("k").cast("double"), "binary": F.lit(1.0), "freq": F.col("k") / F.col("n")}[weighting]
    return found.select("doc_id", "term", weight.alias("weight"))


def keyword_in_context(text: ColumnOrName, keyword: str, *, ignore_case: bool = True, window_width: int = 50, pad_context: bool = False) -> Column:
    """Matches of a regular expression as an array of (pre, keyword, post).

    The text is split at the matches, so that places follow from the lengths of what lies before; empty matches don't
    count.
    """
    c, pattern = col(text), ("(?i)" if ignore_case else "") + f"(?:{keyword})"
    found = F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: m != "")
    gaps = F.split(c, pattern, -1)
    whole = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m"), m.alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))
    placed = F.aggregate(
        F.filter(whole, lambda x: x["text"].isNotNull()), start,
        lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("at"), x["text"].alias("text")))).alias("out")), lambda a: a["out"],
    )

    def context(x: Column) -> Column:
        low = F.greatest(F.lit(0), x["at"] - window_width)
        pre, post = F.substring(c, low + 1, x["at"] - low), F.substring(c, x["at"] + F.length(x["text"]) + 1, F.lit(window_width))
        if pad_context:
            pre, post = F.lpad(pre, window_width, " "), F.rpad(post, window_width, " ")
        return F.struct(pre.alias("pre"), x["text"].alias("keyword"), post.alias("post"))

    return F.transform(placed, context)


def regex_matches(text: ColumnOrName, tokens: ColumnOrName, pattern: str, *, alignment_mode: str = "strict", flags: int = 0) -> Column:
    """Spans of tokens that a regular expression's matches in the text cover.

    A match within a token is left out (``strict``), gives the tokens that lie in it (``contract``) or those that it touches (``expand``).
    """
    if alignment_mode not in ("strict", "contract", "expand"):
        raise ValueError(f"alignment_mode = {alignment_mode!r}")
    return _regex_matches(text, tokens, pattern=pattern, mode=alignment_mode, flags=flags)


@per_doc(SPANS)
def _regex_matches(text, doc, pattern, mode, flags):
    out = []
    for m in re.finditer(pattern, text, flags):
        a, b = m.span()
        if mode == "expand":
            part = [t for t in doc if t["idx"] < b and t["idx"] + len(t["text"]) > a]
        else:
            part = [t for t in doc if t["idx"] >= a and t["idx"] + len(t["text"]) <= b]
        exact = part and part[0]["idx"] == a and part[-1]["idx"] + len(part[-1]["text"]) == b
        if part and (mode != "strict" or exact):
            out.append(_make_span(part))
    return out


def parse_pattern(text: str) -> list[dict]:
    """``"POS:NOUN:+ IS_STOP:bool(False)"`` as dicts; values of bool() and int() are literals and nothing is evaluated."""
    out = []
    for part in text.split():
        pieces = part.split(":")
        if len(pieces) not in (2, 3):
            raise ValueError(f"pattern {part!r} isn't of the form ATTR:VALUE or ATTR:VALUE:OP")
        attribute, value, op = (*pieces, None)[:3]
        made: dict = {}
        if attribute:
            if m := re.fullmatch(r"bool\((True|False)\)", value):
                made[attribute] = m[1] == "True"
            elif m := re.fullmatch(r"int\((-?\d+)\)", value):
                made[attribute] = int(m[1])
            elif re.match(r"\w+\(", value):
                raise ValueError(f"value {value!r} is neither a string nor a literal of bool() or int()")
            else:
                made[attribute] = value
        if op is not None:
            if op not in ("!", "+", "?", "*"):
                raise ValueError(f"op {op!r} is none of ! + ? *")
            made["OP"] = op
        out.append(made)
    return out


_ATTRIBUTES = {"ORTH": "text", "TEXT": "text", "LOWER": "lower", "NORM": "norm", "LEMMA": "lemma", "POS": "pos", "TAG": "tag", "DEP": "dep", "ENT_TYPE": "ent_type", "IS_PUNCT": "is_punct", "IS_SPACE": "is_space", "IS_STOP": "is_stop", "LIKE_NUM": "like_num", "IS_TITLE": "is_title", "IS_UPPER": "is_upper", "IS_QUOTE": "is_quote", "IS_SENT_START": "is_sent_start"}


def _fits(token: dict, wanted: dict) -> bool:
    for name, value in wanted.items():
        if name == "OP":
            continue
        found = {"IS_DIGIT": token["text"].isdigit(), "IS_ALPHA": token["text"].isalpha(), "IS_LOWER": token["text"].islower(), "LENGTH": len(token["text"])}.get(name)
        if found is None:
            found = token[_ATTRIBUTES[name]]
        if found != value:
            return False
    return True


def _ends(doc: list[dict], at: int, pattern: list[dict], k: int) -> set[int]:
    """Where a match of the pattern's rest from token ``at`` on may end."""
    states, ends = {(at, k)}, set()
    todo = list(states)
    while todo:
        i, j = todo.pop()
        if j == len(pattern):
            ends.add(i)
            continue
        op = pattern[j].get("OP")
        following = []
        fits = i < len(doc) and _fits(doc[i], pattern[j])
        if op == "!":
            if i < len(doc) and not fits:
                following.append((i + 1, j + 1))
        else:
            if op in ("?", "*"):
                following.append((i, j + 1))
            if fits:
                following.append((i + 1, j + 1))
                if op in ("+", "*"):
                    following.append((i + 1, j))
        for s in following:
            if s not in states:
                states.add(s)
                todo.append(s)
    return ends


@per_doc(SPANS)
def _token_matches(doc, patterns):
    doc = list(doc)
    found = sorted({(a, b) for p in patterns for a in range(len(doc)) for b in _ends(doc, a, p, 0) if b > a})
    return [_make_span(doc[a:b]) for a, b in found]


def token_matches(tokens: ColumnOrName, patterns: str | list) -> Column:
    """All spans that match a pattern of token attributes, as strings or lists of dicts, with the operators ! + ? *"""
    if isinstance(patterns, str):
        patterns = [parse_pattern(patterns)]
    elif patterns and isinstance(patterns[0], str):
        patterns = [parse_pattern(p) for p in patterns]
    elif patterns and isinstance(patterns[0], dict):
        patterns = [patterns]
    for name in {n for p in patterns for t in p for n in t} - {"OP", "IS_DIGIT", "IS_ALPHA", "IS_LOWER", "LENGTH"}:
        if name not in _ATTRIBUTES:
            raise ValueError(f"{name!r} is no attribute that patterns know")
    return _token_matches(tokens, patterns=patterns)


def acronyms(tokens: ColumnOrName) -> Column:
    """Tokens that look like acronyms."""
    return F.filter(col(tokens), lambda t: is_acronym(t["text"]))


_ACRONYM = re.compile(r"(?:\d(?:-?[A-Z])+|(?:[A-Z][.]?[-/&\da-z]?)+(?:\ds?|[A-Z][.s]?))(?:\W|$)")


def _like_acronym(t: str) -> bool:
    letters = sum(c.isalnum() for c in t)
    return " " not in t and (len(t) != 2 or t.isupper()) and not t.isdigit() and 2 <= letters <= 10 and (any(c.isupper() for c in t) or t[0].isdigit() or t[-1].isdigit()) and bool(_ACRONYM.match(t))


def find_definition(acronym: str, window: list[dict], threshold: float = 0.8) -> tuple[str, float]:
    """The part of a window whose leading letters spell an acronym best, and how much of it they spell.

    Letters are aligned by a longest common subsequence. Of several alignments that with fewer stop words, then nearer to the window's end, then
    shorter, wins; alignments of one letter and definitions of one word don't count.
    """
    leads, kinds, owner = [], [], []
    for k, t in enumerate(window):
        text = t["text"]
        if "-" in text[1:] and not t["is_stop"] and not _like_acronym(text):
            heads = [x[0] for x in text.split("-") if x]
        else:
            heads = [text[0]]
        for n, h in enumerate(heads):
            leads.append(h.lower())
            kinds.append("s" if t["is_stop"] else "h" if n else "w")
            owner.append(k)
    letters = [c.lower() for c in acronym if c.isalnum()]
    if letters and letters[-1] == "s" and acronym.endswith("s"):
        if len(letters) == 2:
            return "", 0.0
        letters.pop()
    m, n = len(letters), len(leads)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if letters[i] == leads[j] else max(best[i + 1][j], best[i][j + 1])
    confidence = best[0][0] / len(acronym)
    if confidence < threshold or not best[0][0]:
        return "", confidence
    # of all alignments that use the first letter, by rank; the number of them can explode, their ranks can't
    from functools import cache

    @cache
    def ranked(i: int, j: int, need: int) -> tuple | None:
        """(stop words, last place, ...) of the best alignment of ``need`` letters from i and j on."""
        if not need:
            return (0, 0, -1)
        found = None
        for x in range(i, m - need + 1):
            for y in range(j, n):
                if letters[x] == leads[y] and best[x + 1][y + 1] >= need - 1:
                    rest = ranked(x + 1, y + 1, need - 1)
                    if rest is not None:
                        one = (rest[0] + (kinds[y] == "s"), rest[1] if need > 1 else -y, rest[2] if need > 1 else y)
                        found = one if found is None else min(found, one)
        return found

    choice = None
    for y in range(n):
        if letters[0] == leads[y] and best[1][y + 1] >= best[0][0] - 1:
            rest = ranked(1, y + 1, best[0][0] - 1)
            if rest is None:
                continue
            last = rest[2] if best[0][0] > 1 else y
            if last == y:
                continue
            rank = (rest[0] + (kinds[y] == "s"), -last, last - y)
            if choice is None or rank < choice[0]:
                choice = rank, y, last
    if choice is None:
        return "", confidence
    part = window[owner[choice[1]] : owner[choice[2]] + 1]
    text = "".join(t["text"] + (t["ws"] if t is not part[-1] else "") for t in part)
    return ("", confidence) if len(text.split()) == 1 else (text, confidence)


@per_doc("map<string,string>")
def _definitions(doc, known):
    found: dict[str, tuple[str, float]] = {}
    sentences: dict[int, list[dict]] = {}
    for t in doc:
        sentences.setdefault(t["sent_id"], []).append(t)
    for sentence in sentences.values():
        for k, t in enumerate(sentence):
            if t["is_punct"] or not _like_acronym(t["text"]) or t["text"] in known:
                continue
            acronym = t["text"]
            size = sum(c.isalnum() for c in acronym)
            reach = min(2 * size, size + 5)
            found.setdefault(acronym, ("", 0.0))
            # the sentence's last token never belongs to the later window
            for window in ([x for x in sentence[max(0, k - reach) : k] if not x["is_punct"]], [x for x in sentence[k + 1 : min(k + 1 + reach, len(sentence) - 1)] if not x["is_punct"]]):
                if window:
                    text, confidence = find_definition(acronym, window)
                    if text and confidence > found[acronym][1]:
                        found[acronym] = text, confidence
    return known | {a: d for a, (d, _) in found.items()}


def acronyms_and_definitions(tokens: ColumnOrName, known_acro_defs: dict[str, str] | None = None) -> Column:
    """Acronyms to their likeliest definitions in the same sentence, empty where none is found; known ones as given."""
    return _definitions(tokens, known=known_acro_defs or {})


def clean_term_strings(terms_col: ColumnOrName) -> Column:
    """Terms without marks at their edges and doubled blanks; those without a word sign go."""
    steps = ((r"^[^\p{L}\p{N}(\[{]+|[^\p{L}\p{N}.)\]}%+]+$", ""), (r"^[(\[{](?=[^()\[\]{}]*$)|(?<![(\[{][^()\[\]{}]{0,200})[)\]}]$", ""), (r"(?<=\p{L})- +(?=\p{L})", "-"), (r"[ \t]*([,;:])(?=\S)", "$1 "), (r"\s+'s\b", "'s"), (r"\s{2,}", " "), (r"^\s+|\s+$", ""))

    def clean(t: Column) -> Column:
        for pattern, repl in steps:
            t = F.regexp_replace(t, pattern, repl)
        return t

    return F.filter(F.transform(col(terms_col), clean), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def _edit_similarity(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 0.0


def sorted_similarity(a: str, b: str) -> float:
    key = lambda s: " ".join(sorted(re.findall(r"[^\W_]+", s.lower())))
    return _edit_similarity(key(a), key(b))


def term_variants(terms: Iterable[str], acro_defs: dict[str, str] | None = None, fuzzy_dedupe: bool = True) -> list[set[str]]:
    """Terms grouped with their variants, longest first: hyphens or slashes as blanks, acronyms and definitions, a word less at either end,
    ``x of y`` as ``y x``, and one that is nearly equal among those of 13 signs or more."""
    left = set(terms)
    pairs = {}
    for acronym, definition in (acro_defs or {}).items():
        pairs.setdefault(acronym.lower(), definition.lower())
        pairs.setdefault(definition.lower(), acronym.lower())
    done: set[str] = set()
    out = []
    for term in sorted(left, key=lambda t: (-len(t), " " in t, t)):  # a hyphen or slash before the blank that it may stand for
        if term in done:
            continue
        group = {term}
        done.add(term)

        def take(x: str, known: bool = True) -> None:
            if not known or x in left and x not in done:
                group.add(x)
                done.add(x)

        for sign in "-/":
            if sign in term:
                take(term.replace(sign, " ").strip())
        if term.lower() in pairs:
            take(pairs[term.lower()], False)
        parts = term.split()
        if len(parts) > 2:
            take(" ".join(parts[1:]))
            take(" ".join(parts[:-1]))
            if " of " in term:
                head, tail = term.split(" of ")[:2]
                take(f"{tail} {head}")
        if fuzzy_dedupe and len(term) >= 13:
            for other in sorted(left - done, key=lambda t: (-len(t), t)):
                if len(other) < 13:
                    break
                if sorted_similarity(term, other) > 0.93:
                    take(other)
                    break
        out.append(group)
    return out


def aggregate_term_variants(terms_col: ColumnOrName, *, acro_defs: dict[str, str] | None = None, fuzzy_dedupe: bool = True) -> Column:
    """Groups of variants, longest term first, each in alphabetical order."""
    return per_doc("array<array<string>>")(lambda terms: [sorted(g) for g in term_variants(terms, acro_defs, fuzzy_dedupe)])(terms_col)


def filtered_topn(ranked: Iterable[tuple[str, float]], topn: int, match_threshold: float | None = None) -> list[tuple[str, float]]:
    """The first ``topn`` terms that aren't part of one already taken, nor as alike as the threshold."""
    out: list[tuple[str, float]] = []
    for term, score in ranked:
        if len(out) >= topn:
            break
        if any(term in kept for kept, _ in out) or match_threshold and any(sorted_similarity(term, kept) >= match_threshold for kept, _ in out):
            continue
        out.append((term, score))
    return out


def get_filtered_topn_terms(scores: ColumnOrName, topn: int, *, match_threshold: float | None = None) -> Column:
    """:func:`filtered_topn` of an array of (term, score) in order."""
    return per_doc("array<struct<term:string,score:double>>")(lambda x: filtered_topn([(t["term"], t["score"]) for t in x], topn, match_threshold))(scores)


def longest_runs(doc: list[dict], passes: Callable[[dict], bool]) -> list[list[dict]]:
    out, run = [], []
    for t in [*doc, None]:
        if t is not None and passes(t):
            run.append(t)
        elif run:
            out.append(run)
            run = []
    return out


def get_longest_subsequence_candidates(tokens: ColumnOrName, match_func: Callable[[Column], Column]) -> Column:
    """Arrays of tokens: the longest runs that pass a column function."""
    doc = col(tokens)
    marks = F.transform(doc, lambda t: F.coalesce(match_func(t), F.lit(False)))
    runs = let(marks, lambda marked: _runs(doc, marked))
    return F.when(F.size(doc) > 0, runs).otherwise(F.slice(F.array(doc), 1, 0))


def _runs(doc: Column, marked: Column) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.size(doc)), lambda i: F.element_at(marked, i) & ((i == 1) | ~F.element_at(marked, F.greatest(i - 1, F.lit(1)))))
    ends = F.filter(F.sequence(F.lit(1), F.size(doc)), lambda i: F.element_at(marked, i) & ((i == F.size(doc)) | ~F.element_at(marked, F.least(i + 1, F.size(doc)))))
    return F.zip_with(starts, ends, lambda a, b: F.slice(doc, a, b - a + 1))


def get_ngram_candidates(tokens: ColumnOrName, ns: int | Collection[int], *, include_pos: str | Collection[str] | None = ("NOUN", "PROPN", "ADJ")) -> Column:
    """Spans without stop words at the edges or marks inside, of the given parts of speech."""
    return ngrams(tokens, ns, include_pos=include_pos)


def get_pattern_matching_candidates(tokens: ColumnOrName, patterns: str | list) -> Column:
    return token_matches(tokens, patterns)
