"""Checks of arguments, a registry of document extensions, and the cache."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Collection
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def to_collection(value: Any, kind: type | tuple, collection: type) -> Any:
    """A value of a kind, or several, as a collection; None stays None."""
    if value is None:
        return None
    if isinstance(value, kind):
        return collection([value])
    if isinstance(value, (tuple, list, set, frozenset)):
        if not all(isinstance(x, kind) for x in value):
            raise TypeError(f"{value!r} holds others than {kind}")
        return collection(value)
    raise TypeError(f"{value!r} is neither of {kind} nor a collection of such")


def validate_set_members(values: Any, kind: type | tuple, known: Collection | None = None) -> set:
    out = to_collection(values, kind, set)
    if known is not None and not out <= set(known):
        raise ValueError(f"{sorted(out - set(known), key=str)} aren't among {sorted(known, key=str)}")
    return out


def validate_and_clip_range(bounds: tuple, full: tuple, kind: type | tuple | None = None) -> tuple:
    """[low, high) with open bounds filled from the full range and others clipped to it."""
    for r in (bounds, full):
        if not isinstance(r, (list, tuple)):
            raise TypeError(f"{r!r} is no pair")
        if len(r) != 2:
            raise ValueError(f"{r!r} has not two members")
    if kind is not None and not all(x is None or isinstance(x, kind) for x in bounds):
        raise TypeError(f"{bounds!r} isn't of {kind}")
    low = full[0] if bounds[0] is None else max(bounds[0], full[0])
    high = full[1] if bounds[1] is None else min(bounds[1], full[1])
    if bounds[0] is not None and bounds[1] is not None and bounds[0] > bounds[1]:
        raise ValueError(f"{bounds!r} ends before it begins")
    return low, high


def is_record(schema: T.StructType) -> bool:
    """Whether rows are records: a text, and metadata as a struct or a map."""
    kinds = {f.name: f.dataType for f in schema.fields}
    return set(kinds) == {"text", "meta"} and isinstance(kinds["text"], T.StringType) and isinstance(kinds["meta"], (T.StructType, T.MapType))


def get_kwargs_for_func(func: Callable, kwargs: dict[str, Any]) -> dict[str, Any]:
    """The arguments that a function takes."""
    known = inspect.signature(func).parameters
    return {k: v for k, v in kwargs.items() if k in known}


_EXTENSIONS: dict[str, dict[str, Callable[..., Column]]] = {}


def _defaults(name: str) -> dict[str, Callable[..., Column]]:
    from lexispark.functions import stats, tokens
    from lexispark.operators import extract, keyterms

    found = {
        "tokens": {f.__name__: f for f in (tokens.doc_preview, tokens.text_of, tokens.main_verbs)},
        "extract": {f.__name__: f for f in (extract.words, extract.ngrams, extract.entities, extract.noun_chunks, extract.terms, extract.token_matches, extract.acronyms, extract.acronyms_and_definitions, extract.to_bag_of_words, extract.to_bag_of_terms, keyterms.extract_keyterms)},
        "text_stats": {**stats.READABILITY, **stats.DIVERSITY, **{f.__name__: f for f in (stats.n_words, stats.n_unique_words, stats.n_chars, stats.n_syllables, stats.entropy, stats.value_counts)}},
    }
    if name not in found:
        raise ValueError(f"name = {name!r}; known are {sorted(found)}")
    return found[name]


def get_doc_extensions(name: str) -> dict[str, Callable[..., Column]]:
    """Column functions by name, of ``tokens``, ``extract`` or ``text_stats``."""
    return _defaults(name)


def set_doc_extensions(name: str, force: bool = True) -> None:
    """Registers them, so that :func:`extend` finds them."""
    for key, f in _defaults(name).items():
        if key in _EXTENSIONS.get(name, {}) and not force:
            raise ValueError(f"{key!r} is registered already")
        _EXTENSIONS.setdefault(name, {})[key] = f


def remove_doc_extensions(name: str) -> None:
    _EXTENSIONS.pop(name, None)


def extend(df: DataFrame, extension: str, column: str, out_col: str | None = None, **options: Any) -> DataFrame:
    """``df`` with the result of a registered extension."""
    for functions in _EXTENSIONS.values():
        if extension in functions:
            return df.withColumn(out_col or extension, functions[extension](column, **options))
    raise AttributeError(f"no extension {extension!r} is registered")


def get_size(df: DataFrame) -> int:
    """Bytes of a table as the optimiser estimates them, from files or what is cached; nothing is computed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def clear_cache(spark: SparkSession) -> None:
    spark.catalog.clearCache()
