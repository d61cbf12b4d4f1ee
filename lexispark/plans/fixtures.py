"""Annotated sentences made of the words of every benchmark item, for what needs a parse.

No tagger or parser is at hand, so the parse is given: each item's first words fill the gaps of some sentences whose
parts of speech, dependencies and entities are written down here, place by place. The SQL of the queries writes down what
is to be extracted, from the same words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.tokens import annotate, register_annotator

#: Words of an item that the sentences use; each gets an ending of its own, so that no two are alike.
N_WORDS = 12
LETTERS = "abcdefghijkl"
PARSE = (
    # gap or word, pos, dep, head, lemma, entity
    ("{a}", "NOUN", "compound", 1, None, "B-ORG"), ("{b}", "NOUN", "nsubj", 2, None, "I-ORG"), ("likes", "VERB", "ROOT", 2, "like", ""), ("{c}", "ADJ", "amod", 4, None, ""), ("{d}", "NOUN", "dobj", 2, None, "B-DATE"), (".", "PUNCT", "punct", 2, None, ""),
    ("{e}", "NOUN", "nsubjpass", 8, None, ""), ("was", "AUX", "auxpass", 8, "be", ""), ("seen", "VERB", "ROOT", 8, "see", ""), ("by", "ADP", "agent", 8, None, ""), ("{f}", "NOUN", "pobj", 9, None, ""), ("and", "CCONJ", "cc", 10, None, ""), ("{g}", "NOUN", "conj", 10, None, ""), (".", "PUNCT", "punct", 8, None, ""),
    ("{h}", "PROPN", "nsubj", 15, None, ""), ("is", "AUX", "ROOT", 15, "be", ""), ("the", "DET", "det", 17, None, "B-GPE"), ("{i}", "NOUN", "attr", 15, None, "I-GPE"), (".", "PUNCT", "punct", 15, None, ""),
    ('"', "PUNCT", "punct", 25, None, ""), ("{j}", "NOUN", "nsubj", 22, None, ""), ("never", "ADV", "neg", 22, None, ""), ("sleeps", "VERB", "ccomp", 25, "sleep", ""), ("well", "ADV", "advmod", 22, None, ""), ('"', "PUNCT", "punct", 25, None, ""), ("said", "VERB", "ROOT", 25, "say", ""), ("{k}", "PROPN", "nsubj", 25, None, ""), (".", "PUNCT", "punct", 25, None, ""),
)
TEMPLATE = " ".join(x[0] for x in PARSE)
#: The same words in SQL: (item_id, a, b, ...).
WORDS_SQL = f"f AS (SELECT item_id, {', '.join(f'''w[{k}] || 'q{x}' AS {x}''' for k, x in enumerate(LETTERS, 1))} FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM benchmark) WHERE len(w) >= {N_WORDS})"


def as_sql(template: str) -> str:
    """A string with gaps as an SQL expression over WORDS_SQL."""
    parts = []
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        if piece:
            parts.append(piece if k % 2 else "'" + piece.replace("'", "''") + "'")
    return " || ".join(parts) or "''"


def rows_sql(columns: str, *rows: tuple, order: bool = False) -> str:
    """Rows of templates for each item, as SQL: strings become expressions over the words, other values stay."""
    names = [c.strip() for c in columns.split(",")]
    cell = lambda x: as_sql(x) if isinstance(x, str) else "NULL" if x is None else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    selects = [f"SELECT item_id, {', '.join(f'{cell(x)} AS {n}' for x, n in zip(r, names))} FROM f" for r in rows]
    return f"WITH {WORDS_SQL} " + " UNION ALL ".join(selects)


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, a, b, ...): the words of each item that has enough, with their endings."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w")).where(F.size("w") >= N_WORDS)
    return items.select("item_id", *[F.concat(F.col("w")[k], F.lit(f"q{x}")).alias(x) for k, x in enumerate(LETTERS)])


def filled(words: DataFrame, template: str, out_col: str = "text") -> DataFrame:
    """``words`` with a template's gaps filled."""
    parts = [F.col(p) if k % 2 else F.lit(p) for k, p in enumerate(template.replace("}", "{").split("{"))]
    return words.withColumn(out_col, F.concat(*parts))


def _given(tokens: list[dict], lang: str) -> list[dict]:
    out = []
    for t, (_, pos, dep, head, lemma, entity) in zip(tokens, PARSE):
        iob, _, kind = entity.partition("-")
        number = {"Number": "Sing"} if pos in ("NOUN", "PROPN") else {"Tense": "Past"} if t["text"] in ("was", "seen", "said") else None
        out.append(t | {"pos": pos, "tag": pos[:2], "dep": dep, "head": head, "lemma": lemma, "ent_iob": iob or "O", "ent_type": kind or None, "morph": number})
    return out


register_annotator("given_parse", _given)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text, tokens) of the sentences."""
    return annotate(filled(words_of(spark, sf_dir), TEMPLATE).select("item_id", "text"), annotator="given_parse")
