"""Texts varied at random: words replaced, added, moved or left out, and characters likewise.

The random numbers of a row depend on its id and a seed, so that a run can be repeated wherever its rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from functools import partial
from random import Random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.columns import ColumnOrName, col
from lexispark.operators.extract import by_portions, plain

AUG_TOKENS = "array<struct<text:string,ws:string,pos:string,is_word:boolean,syns:array<string>,sent_id:int>>"
Tokens = list[dict]
DEFAULT_CHARS = [(c, 1) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]


def to_aug_toks(tokens: ColumnOrName, synonyms: Column | None = None) -> Column:
    """Tokens as (text, ws, pos, is_word, syns, sent_id); ``synonyms`` is a map from lower-case words to arrays."""

    def one(t: Column) -> Column:
        known = F.array().cast("array<string>") if synonyms is None else F.coalesce(synonyms[t["lower"]], F.array().cast("array<string>"))
        word = ~(t["is_punct"] | t["is_space"])
        return F.struct(t["text"].alias("text"), t["ws"].alias("ws"), t["pos"].alias("pos"), word.alias("is_word"), F.when(word & ~t["is_stop"], known).otherwise(F.array().cast("array<string>")).alias("syns"), t["sent_id"].alias("sent_id"))

    return F.transform(col(tokens), one)


def get_char_weights(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, char, weight): how often each letter and digit occurs in each language."""
    return df.select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"[\p{L}\p{N}]"), F.lit(0))).alias("char")).groupBy("lang", "char").agg(F.count("*").alias("weight"))


def select_random(rng: Random, candidates: list, num: int | float) -> list:
    """So many of the candidates, or each with a probability."""
    if isinstance(num, int) and num >= 0:
        return rng.sample(candidates, min(num, len(candidates)))
    if isinstance(num, float) and 0 <= num <= 1:
        return [c for c in candidates if rng.random() < num]
    raise ValueError(f"num = {num}; it is a count or a probability")


def _pos(pos: str | Collection[str] | None) -> set[str] | None:
    return {pos} if isinstance(pos, str) else set(pos) if pos is not None else None


def _words(toks: Tokens, least: int = 1) -> list[int]:
    return [i for i, t in enumerate(toks) if t["is_word"] and len(t["text"]) >= least]


def _with_synonyms(toks: Tokens, pos) -> list[int]:
    wanted = _pos(pos)
    return [i for i, t in enumerate(toks) if len(t["syns"]) and (wanted is None or t["pos"] in wanted)]


def substitute_word_synonyms(toks: Tokens, rng: Random, *, num: int | float = 1, pos=None) -> Tokens:
    """Some words become one of their synonyms."""
    out = [dict(t) for t in toks]
    for i in select_random(rng, _with_synonyms(toks, pos), num):
        out[i]["text"] = rng.choice(list(toks[i]["syns"]))
    return out


def insert_word_synonyms(toks: Tokens, rng: Random, *, num: int | float = 1, pos=None) -> Tokens:
    """Synonyms of some words are added anywhere; fewer than three tokens stay as they are."""
    if len(toks) < 3:
        return list(toks)
    chosen = [toks[i] for i in select_random(rng, _with_synonyms(toks, pos), num)]
    places = dict(zip(rng.sample(range(len(toks)), len(chosen)), chosen))
    out: Tokens = []
    for i, t in enumerate(toks):
        if i in places:
            ws = " "
            if out:
                ws = out[-1]["ws"]
                if out[-1]["is_word"] and not ws:
                    out[-1] = out[-1] | {"ws": " "}
            out.append(places[i] | {"text": rng.choice(list(places[i]["syns"])), "ws": ws, "sent_id": t["sent_id"]})
        out.append(dict(t))
    return out


def swap_words(toks: Tokens, rng: Random, *, num: int | float = 1, pos=None) -> Tokens:
    """Adjacent words change places; the white space stays where it was."""
    wanted = _pos(pos)
    words = [i for i in _words(toks) if wanted is None or toks[i]["pos"] in wanted]
    out = [dict(t) for t in toks]
    for a, b in select_random(rng, [(a, b) for a, b in zip(words, words[1:]) if b - a == 1], num):
        out[a], out[b] = out[b] | {"ws": out[a]["ws"]}, out[a] | {"ws": out[b]["ws"]}
    return out


def delete_words(toks: Tokens, rng: Random, *, num: int | float = 1, pos=None) -> Tokens:
    """Some words go, never the first; fewer than three tokens stay as they are."""
    if len(toks) < 3:
        return list(toks)
    wanted = _pos(pos)
    gone = set(select_random(rng, [i for i in _words(toks) if i and (wanted is None or toks[i]["pos"] in wanted)], num))
    out: Tokens = []
    for i, t in enumerate(toks):
        if i not in gone:
            out.append(dict(t))
        elif out and i + 1 < len(toks) and toks[i - 1]["is_word"] and not toks[i + 1]["is_word"]:
            out[-1]["ws"] = t["ws"]
    return out


def _change(toks: Tokens, rng: Random, num: int | float, edit: Callable[[str], str]) -> Tokens:
    out = [dict(t) for t in toks]
    for i in sorted(select_random(rng, _words(toks, 3), num)):
        out[i]["text"] = edit(out[i]["text"])
    return out


def _letter(rng: Random, weights) -> str:
    chars, w = zip(*(weights or DEFAULT_CHARS))
    return rng.choices(chars, weights=w)[0]


def substitute_chars(toks: Tokens, rng: Random, *, num: int | float = 1, char_weights=None) -> Tokens:
    """In some words of three characters or more one becomes another, by the language's frequencies."""

    def edit(x: str) -> str:
        k = rng.randrange(len(x))
        return x[:k] + _letter(rng, char_weights) + x[k + 1 :]

    return _change(toks, rng, num, edit)


def insert_chars(toks: Tokens, rng: Random, *, num: int | float = 1, char_weights=None) -> Tokens:
    def edit(x: str) -> str:
        k = rng.randrange(len(x))
        return x[:k] + _letter(rng, char_weights) + x[k:]

    return _change(toks, rng, num, edit)


def swap_chars(toks: Tokens, rng: Random, *, num: int | float = 1) -> Tokens:
    def edit(x: str) -> str:
        k = rng.randrange(1, len(x))
        return x[: k - 1] + x[k] + x[k - 1] + x[k + 1 :]

    return _change(toks, rng, num, edit)


def delete_chars(toks: Tokens, rng: Random, *, num: int | float = 1) -> Tokens:
    def edit(x: str) -> str:
        k = rng.randrange(len(x))
        return x[:k] + x[k + 1 :]

    return _change(toks, rng, num, edit)


TRANSFORMS = {f.__name__: f for f in (substitute_word_synonyms, insert_word_synonyms, swap_words, delete_words, substitute_chars, insert_chars, swap_chars, delete_chars)}


class Augmenter:
    """Transforms applied sentence by sentence: all of them, ``num`` at random, or each with a probability (one or a list)."""

    def __init__(self, transforms: Collection[str | Callable], *, num: int | float | list[float] | None = None):
        self.transforms = [TRANSFORMS[t] if isinstance(t, str) else t for t in transforms]
        if not self.transforms:
            raise ValueError("an augmenter has one transform at least")
        if isinstance(num, list) and (len(num) != len(self.transforms) or not all(0 <= x <= 1 for x in num)):
            raise ValueError("a probability for each transform is needed")
        if isinstance(num, int) and num < 0 or isinstance(num, float) and not 0 <= num <= 1:
            raise ValueError(f"num = {num}; it is a count or a probability")
        self.num = num

    def _chosen(self, rng: Random) -> list[Callable]:
        n = self.num
        if n is None:
            return self.transforms
        if isinstance(n, int):
            return [self.transforms[i] for i in sorted(rng.sample(range(len(self.transforms)), min(n, len(self.transforms))))]
        odds = n if isinstance(n, list) else [n] * len(self.transforms)
        return [t for t, p in zip(self.transforms, odds) if rng.random() < p]

    def apply_transforms(self, df: DataFrame, *, id_col: str = "doc_id", aug_col: str = "aug_toks", seed: int = 0, out_col: str = "augmented", char_weights: list[tuple[str, int]] | None = None) -> DataFrame:
        """``df`` with the varied text; null tokens give null."""
        weighted = {substitute_chars, insert_chars}

        @F.arrow_udf("string")
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            def one(s: int, doc) -> str | None:
                if doc is None:
                    return None
                rng, out = Random(int(s)), []
                for sentence in sentences(doc):
                    for t in self._chosen(rng):
                        sentence = t(sentence, rng, **({"char_weights": char_weights} if t in weighted else {})) if sentence else sentence
                    out += sentence
                return "".join(t["text"] + t["ws"] for t in out)

            for batch in batches:
                for seeds, docs in by_portions(batch):
                    yield pa.array([one(s, d) for s, d in zip(seeds.to_pylist(), plain(docs))], pa.string())

        return df.withColumn(out_col, run(F.xxhash64(id_col, F.lit(seed)), F.col(aug_col)))


def sentences(doc) -> Iterator[Tokens]:
    part: Tokens = []
    for t in doc:
        if part and t["sent_id"] != part[-1]["sent_id"]:
            yield part
            part = []
        part.append(dict(t))
    if part:
        yield part


def fixed(transform: str | Callable, **options) -> Callable:
    """A transform with its options set."""
    return partial(TRANSFORMS[transform] if isinstance(transform, str) else transform, **options)
