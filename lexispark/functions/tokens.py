"""Words, tokens, sentences and character n-grams of a text, and the annotated tokens that extraction works on.

Lexical attributes are computed here; linguistic ones (lemma, part of speech, dependencies, entities) come as columns from
an annotator of the caller's and are null otherwise.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexispark.functions.columns import PORTION, ColumnOrName, col, let, portions
from lexispark.functions.stopwords import stop_words

WORD = r"[\p{L}\p{M}\p{N}]+"
TOKEN = rf"{WORD}|[^\s\p{{L}}\p{{M}}\p{{N}}]"
#: Signs up to a mark that ends a sentence, or to a break.
SENTENCE = r"[^.!?…\n]+[.!?…]*"
_TOKEN_PY = re.compile(r"[^\W_]+(?:[^\W_]|[̀-ͯ])*|[^\w\s]|_")
_ENDS, _QUOTES = frozenset(".!?…"), frozenset("\"'“”‘’«»„‟`")
_NUMBER_PY = re.compile(r"[+-]?\d+(?:[.,/]\d+)*")

TOKEN_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField(n, t) for n, t in (
            *((n, T.IntegerType()) for n in ("i", "idx")), *((n, T.StringType()) for n in ("text", "lower", "norm", "ws")), ("sent_id", T.IntegerType()),
            *((n, T.BooleanType()) for n in ("is_sent_start", "is_punct", "is_space", "is_stop", "like_num", "is_title", "is_upper", "is_quote")),
            *((n, T.StringType()) for n in ("lemma", "pos", "tag", "dep")), ("head", T.IntegerType()), *((n, T.StringType()) for n in ("ent_type", "ent_iob")), ("morph", T.MapType(T.StringType(), T.StringType())),
        )]
    )
)
FIELDS = TOKEN_TYPE.elementType.names
#: Attributes that an annotator supplies.
LINGUISTIC = ("lemma", "pos", "tag", "dep", "head", "ent_type", "ent_iob", "morph")


def words(c: ColumnOrName) -> Column:
    """Runs of letters, marks and digits as they are written; null for null."""
    return F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0))


def lower_words(c: ColumnOrName) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def tokens(c: ColumnOrName) -> Column:
    """Words, and every other sign that isn't white space."""
    return F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0))


def sentences(c: ColumnOrName) -> Column:
    """Stretches up to a final mark or a line break that hold a word."""
    return F.filter(F.regexp_extract_all(col(c), F.lit(SENTENCE), F.lit(0)), lambda s: s.rlike(WORD))


def without_stop_words(c: ColumnOrName, lang: str | None = "en") -> Column:
    """An array of words without those of the language; ``lang`` None: of all languages known."""
    from lexispark.functions.stopwords import STOP_WORDS

    stops = sorted(stop_words(lang) if lang else frozenset().union(*STOP_WORDS.values()))
    return F.filter(col(c), lambda w: ~F.lower(w).isin(stops)) if stops else col(c)


def text_to_char_ngrams(c: ColumnOrName, n: int, *, pad: bool = False) -> Column:
    """All runs of ``n`` characters; with ``pad`` the text has n - 1 underscores at either end."""
    if n < 1:
        raise ValueError(f"n = {n}; the least is 1")
    text = col(c)
    if pad:
        text = F.concat(F.lit("_" * (n - 1)), text, F.lit("_" * (n - 1)))
    # characters are cut out once and joined, for a place within UTF-8 text has to be sought from its start
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def grams(c: Column) -> Column:
        starts = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.element_at(c, i + k) for k in range(n)]))

    return F.when(text.isNotNull(), let(chars, grams))


def char_ngrams(c: ColumnOrName, ns: int | Iterable[int], *, lower: bool = False, pad: bool = False) -> Column:
    """Character n-grams of several lengths, one after the other, each padded for itself."""
    text = F.lower(col(c)) if lower else col(c)
    return F.flatten(F.array(*[text_to_char_ngrams(text, n, pad=pad) for n in ([ns] if isinstance(ns, int) else ns)]))


def _lexical(text: str, lang: str | None, chunk_size: int | None) -> list[dict]:
    stops = stop_words(lang or "")
    out: list[dict] = []
    pieces = [(0, text)] if not chunk_size else [(a, text[a : a + chunk_size]) for a in range(0, len(text), chunk_size)]
    sentence, starts = 0, True
    for offset, piece in pieces:
        end = 0
        for m in _TOKEN_PY.finditer(piece):
            gap = piece[end : m.start()]
            if out:
                out[-1]["ws"] += gap
                if out[-1]["text"] in _ENDS and gap or "\n" in gap:
                    starts = True
            end = m.end()
            t = m.group()
            if starts and out and t not in _ENDS:
                sentence += 1
            punct = not t[0].isalnum()
            out.append({
                "i": len(out), "idx": offset + m.start(), "text": t, "lower": t.lower(), "norm": t.lower(), "ws": "", "sent_id": sentence, "is_sent_start": starts, "is_punct": punct, "is_space": False,
                "is_stop": t.lower() in stops, "like_num": bool(_NUMBER_PY.fullmatch(t)), "is_title": t.istitle(), "is_upper": t.isupper(), "is_quote": t in _QUOTES,
            })
            starts = False
        if out:
            out[-1]["ws"] += piece[end:]
    for token in out:
        token.update(dict.fromkeys(LINGUISTIC))
    return out


def _lexical_array(texts: list[str | None], langs: list[str | None], chunk_size: int | None, kind: pa.DataType) -> pa.Array:
    """What :func:`_lexical` gives of each text, as one Arrow array made column by column."""
    offsets, n = [0], 0
    i, idx, text, lower, ws, sent = [], [], [], [], [], []
    first, punct, stop, num, title, upper, quote = [], [], [], [], [], [], []
    for t, lang in zip(texts, langs):
        if t is not None:
            stops, begin, sentence, starts = stop_words(lang or ""), n, 0, True
            for offset, piece in [(0, t)] if not chunk_size else [(a, t[a : a + chunk_size]) for a in range(0, len(t), chunk_size)]:
                end = 0
                for m in _TOKEN_PY.finditer(piece):
                    at, x = m.start(), m.group()
                    if n > begin:
                        gap = piece[end:at]
                        if gap:
                            ws[-1] += gap
                            if text[-1] in _ENDS or "\n" in gap:
                                starts = True
                    end = m.end()
                    if starts and n > begin and x not in _ENDS:
                        sentence += 1
                    low = x.lower()
                    i.append(n - begin)
                    idx.append(offset + at)
                    text.append(x)
                    lower.append(low)
                    ws.append("")
                    sent.append(sentence)
                    first.append(starts)
                    punct.append(not x[0].isalnum())
                    stop.append(low in stops)
                    num.append(x[0].isdigit() and _NUMBER_PY.fullmatch(x) is not None)
                    title.append(x.istitle())
                    upper.append(x.isupper())
                    quote.append(x in _QUOTES)
                    starts = False
                    n += 1
                if n > begin:
                    ws[-1] += piece[end:]
        offsets.append(n)
    made = {"i": i, "idx": idx, "text": text, "lower": lower, "norm": lower, "ws": ws, "sent_id": sent, "is_sent_start": first, "is_punct": punct, "is_space": [False] * n, "is_stop": stop, "like_num": num, "is_title": title, "is_upper": upper, "is_quote": quote}
    fields = [kind.value_type.field(k) for k in range(kind.value_type.num_fields)]
    columns = [pa.array(made[f.name], f.type) if f.name in made else pa.nulls(n, f.type) for f in fields]
    missing = pa.array([t is None for t in texts])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields), type=kind, mask=missing)


Annotator = Callable[[list[dict], str], list[dict]]
_ANNOTATORS: dict[str, Annotator] = {}


def register_annotator(name: str, annotator: Annotator, *, force: bool = True) -> None:
    """Makes an annotator known by a name."""
    if name in _ANNOTATORS and not force:
        raise ValueError(f"{name!r} is registered already")
    _ANNOTATORS[name] = annotator


def load_annotator(annotator: str | Annotator | None) -> Annotator | None:
    """An annotator by its registered name or as ``module:function``; a function, or none, is itself."""
    if annotator is None or callable(annotator):
        return annotator
    if annotator in _ANNOTATORS:
        return _ANNOTATORS[annotator]
    module, _, name = annotator.partition(":")
    if not name:
        raise ValueError(f"{annotator!r} is neither registered, {sorted(_ANNOTATORS)} are, nor of the form module:function")
    return getattr(importlib.import_module(module), name)


def resolve_lang(lang: str | Callable[[Column], Column], text: ColumnOrName) -> Column:
    """The language of texts as a column: one for all, or what a function of the text gives."""
    return lang(col(text)) if callable(lang) else F.lit(lang)


def annotate(df: DataFrame, *, text_col: str = "text", lang_col: str | None = None, lang: str | Callable[[Column], Column] = "en", chunk_size: int | None = None, annotator: str | Annotator | None = None, out_col: str = "tokens") -> DataFrame:
    """``df`` with the annotated tokens of a text; null for null.

    The language decides the stop words, row by row if ``lang_col`` names it or ``lang`` is a function of the text. ``chunk_size`` cuts a text first, wherever
    that falls. ``annotator``, a function or what :func:`load_annotator` knows, gets a text's tokens and its language and returns them with linguistic attributes.
    """
    annotator = load_annotator(annotator)

    # a token takes a hundred times its text in Python: a batch, of thousands of texts, is annotated and sent back bit by bit
    @F.arrow_udf(TOKEN_TYPE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = to_arrow_type(TOKEN_TYPE)
        for batch in batches:
            for part in portions(*batch, most=8 * PORTION):
                texts, langs = (x.to_pylist() for x in part)
                if annotator is None:
                    yield _lexical_array(texts, langs, chunk_size, kind)
                else:
                    yield pa.array([None if t is None else annotator(_lexical(t, x, chunk_size), x or "") for t, x in zip(texts, langs)], kind)

    # as it may not be repeated, no later expression takes it into itself, where it would run for every element
    return df.withColumn(out_col, run.asNondeterministic()(F.col(text_col), F.col(lang_col) if lang_col else resolve_lang(lang, text_col)))


def attach(tokens_col: ColumnOrName, **values: ColumnOrName) -> Column:
    """Tokens with linguistic attributes from arrays of the same length, such as ``pos=F.col("pos_tags")``."""
    out = col(tokens_col)
    for name, c in values.items():
        if name not in FIELDS:
            raise ValueError(f"{name!r} is no attribute of a token")
        out = F.zip_with(out, col(c), lambda t, v, name=name: t.withField(name, v))
    return out


def text_of(tokens_col: ColumnOrName) -> Column:
    """The text that tokens were made of, from the first token on."""
    return F.array_join(F.transform(col(tokens_col), lambda t: F.concat(t["text"], t["ws"])), "")


def doc_preview(tokens_col: ColumnOrName) -> Column:
    """``Doc(N tokens: "the first fifty characters...")``"""
    text = F.regexp_replace(text_of(tokens_col), "\n", " ")
    short = F.when(F.length(text) >= 50, F.concat(F.substring(text, 1, 47), F.lit("..."))).otherwise(text)
    return F.format_string('Doc(%d tokens: "%s")', F.size(col(tokens_col)), short)


def preserve_case(token: Column) -> Column:
    """Whether a token's case means something: a proper noun or an acronym."""
    from lexispark.functions.acronyms import is_acronym

    return F.coalesce(token["pos"] == "PROPN", F.lit(False)) | is_acronym(token["text"])


def normalized_text(token: Column) -> Column:
    """The text where case means something, else the lemma, else the lower case."""
    return F.when(preserve_case(token), token["text"]).otherwise(F.coalesce(token["lemma"], token["lower"]))


def main_verbs(tokens_col: ColumnOrName) -> Column:
    """Verbs that aren't auxiliaries."""
    return F.filter(col(tokens_col), lambda t: (t["pos"] == "VERB") & ~F.coalesce(t["dep"].isin("aux", "auxpass"), F.lit(False)))


def merge_spans(tokens_col: ColumnOrName, spans_col: ColumnOrName) -> Column:
    """Tokens with each span of (start, end) made one token; of spans that overlap the earlier, then the longer, holds."""

    @F.pandas_udf(TOKEN_TYPE)
    def run(docs: pd.Series, spans: pd.Series) -> pd.Series:
        def one(doc, wanted):
            if doc is None:
                return None
            out, at = [], 0
            doc = [dict(t) for t in doc]
            for s in sorted(wanted if wanted is not None else [], key=lambda s: (s["start"], -s["end"])):
                if s["start"] < at or s["end"] <= s["start"]:
                    continue
                out += doc[at : s["start"]]
                part = doc[s["start"] : s["end"]]
                text = "".join(t["text"] + t["ws"] for t in part)[: -len(part[-1]["ws"]) or None]
                out.append(part[0] | {"text": text, "lower": text.lower(), "norm": text.lower(), "ws": part[-1]["ws"]})
                at = s["end"]
            out += doc[at:]
            for i, t in enumerate(out):
                t["i"] = i
                t["morph"] = dict(t["morph"]) if t["morph"] is not None else None
            return out

        return pd.Series([one(d, s) for d, s in zip(docs, spans)], dtype=object)

    return run(col(tokens_col), col(spans_col))


def morph_labels(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(label): the morphological features that the tokens of a table have, each once."""
    keys = F.flatten(F.transform(F.filter(tokens_col, lambda t: t["morph"].isNotNull()), lambda t: F.map_keys(t["morph"])))
    return df.select(F.explode(F.array_distinct(keys)).alias("label")).distinct()
