"""Parts of a text taken out. A null stays null."""

from __future__ import annotations

import unicodedata
from collections.abc import Collection
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.columns import ColumnOrName, by_text, col

BRACKETS = {"curly": r"\{[^{}]*\}", "square": r"\[[^\[\]]*\]", "round": r"\([^()]*\)"}


def accents(c: ColumnOrName, *, fast: bool = False) -> Column:
    """Letters without their accents; ``fast`` drops every sign that isn't ASCII after decomposition."""

    @by_text
    def plain(x: str) -> str:
        apart = unicodedata.normalize("NFKD", x)
        return apart.encode("ascii", "ignore").decode() if fast else "".join(y for y in apart if not unicodedata.combining(y))

    return F.when(col(c).rlike(r"^\p{ASCII}*$"), col(c)).otherwise(plain(col(c)))


def brackets(c: ColumnOrName, *, only: str | Collection[str] | None = None) -> Column:
    """Brackets without others inside go with their content: curly, then square, then round; or those named."""
    chosen = set(BRACKETS) if only is None else {only} if isinstance(only, str) else set(only)
    if chosen - set(BRACKETS):
        raise ValueError(f"only = {only!r}; known are {sorted(BRACKETS)}")
    out = col(c)
    for name, pattern in BRACKETS.items():
        if name in chosen:
            out = F.regexp_replace(out, pattern, "")
    return out


class _Data(HTMLParser):
    def __init__(self, visible: bool):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden, self.visible = 0, visible

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += self.visible and tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= bool(self.hidden) and tag in ("script", "style")


def _text_of(html: str, visible: bool) -> str:
    parser = _Data(visible)
    parser.feed(html)
    parser.close()
    return "".join(parser.parts).strip()


def html_tags(c: ColumnOrName) -> Column:
    """The text between tags, entities resolved; scripts and styles count as text, comments don't."""
    return by_text(lambda x: _text_of(x, False))(col(c))


def visible_text(c: ColumnOrName) -> Column:
    """As :func:`html_tags`, without scripts and styles."""
    return by_text(lambda x: _text_of(x, True))(col(c))


def punctuation(c: ColumnOrName, *, only: str | Collection[str] | None = None) -> Column:
    """Each punctuation mark becomes a blank; with ``only``, each run of those marks."""
    if only is None:
        return F.regexp_replace(col(c), r"\p{P}", " ")
    marks = only if isinstance(only, str) else "".join(only)
    return F.regexp_replace(col(c), "[" + "".join("\\" + x if not x.isalnum() else x for x in marks) + "]+", " ")
