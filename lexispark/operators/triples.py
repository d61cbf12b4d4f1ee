"""Triples of tokens that dependencies connect: subject, verb and object; entity, cue and fragment; speaker, cue and quotation.

Tokens need pos, dep, head and lemma. A triple holds arrays of texts in the order of the sentence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

from lexispark.functions.columns import ColumnOrName
from lexispark.operators.extract import per_doc

SUBJECTS, CLAUSES, MODIFIERS = {"nsubj", "nsubjpass"}, {"csubj", "csubjpass"}, {"aux", "auxpass", "neg"}
OBJECTS = {"attr", "dobj", "dative", "oprd"}
AUXILIARIES = MODIFIERS
ALL_SUBJECTS = SUBJECTS | CLAUSES | {"agent", "expl"}
#: Lemmas of verbs that report speech.
REPORTING = {
    "en": "accuse acknowledge add admit advise agree allege announce answer argue ask assert believe blame charge cite claim complain concede conclude confess confirm contend continue criticize declare decline deny describe disagree disclose estimate explain fear hope insist maintain mention note observe order predict promise recall recommend remark reply report reveal say state stress suggest tell testify think urge warn worry write".split(),
    "es": "afirmar agregar anunciar añadir asegurar comentar confesar contestar decir declarar escribir exclamar explicar gritar indicar preguntar prometer quejar recordar responder".split(),
    "fr": "affirmer ajouter annoncer assurer conclure confier crier demander dire déclarer exclamer expliquer insister lancer mentionner proclamer prononcer proposer prétendre remarquer répliquer répondre rétorquer soutenir suggérer écrire".split(),
}


class Tree:
    """Children, subtrees and conjuncts of a document's tokens."""

    def __init__(self, doc):
        self.doc = list(doc)
        self.below: dict[int, list[int]] = {}
        for t in self.doc:
            if t["head"] is not None and t["head"] != t["i"]:
                self.below.setdefault(t["head"], []).append(t["i"])

    def children(self, i: int) -> list[int]:
        return self.below.get(i, [])

    def lefts(self, i: int) -> list[int]:
        return [c for c in self.children(i) if c < i]

    def rights(self, i: int) -> list[int]:
        return [c for c in self.children(i) if c > i]

    def subtree(self, i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            out.append(todo.pop())
            todo += self.children(out[-1])
        return sorted(out)

    def conjuncts(self, i: int) -> list[int]:
        """All that are coordinated with a token, without itself."""
        first = i
        while self.doc[first]["dep"] == "conj" and self.doc[first]["head"] is not None and self.doc[first]["head"] != first:
            first = self.doc[first]["head"]
        found, todo = [], [first]
        while todo:
            found.append(todo.pop())
            todo += [c for c in self.children(found[-1]) if self.doc[c]["dep"] == "conj"]
        return sorted(x for x in found if x != i)

    def expand_noun(self, i: int) -> set[int]:
        """With conjuncts and the compound parts of all of them."""
        together = [i, *self.conjuncts(i)]
        return {*together, *(c for t in together for c in self.children(t) if self.doc[c]["dep"] == "compound")}

    def expand_verb(self, i: int) -> set[int]:
        """With auxiliaries and negations."""
        return {i, *(c for c in self.children(i) if self.doc[c]["dep"] in MODIFIERS)}

    def texts(self, places) -> list[str]:
        return [self.doc[i]["text"] for i in sorted(places)]

    def subjects_of(self, verb: int) -> list[int]:
        found = [c for c in self.lefts(verb) if self.doc[c]["dep"] in ALL_SUBJECTS]
        return found + [c for s in found for c in self.rights(s) if self.doc[c]["dep"] == "conj"]

    def objects_of(self, verb: int) -> list[int]:
        found = [c for c in self.rights(verb) if self.doc[c]["dep"] in OBJECTS | {"xcomp"}]
        return found + [c for o in found for c in self.rights(o) if self.doc[c]["dep"] == "conj"]

    def compound_span(self, noun: int) -> tuple[int, int]:
        start = noun
        while start - 1 in self.lefts(noun) and self.doc[start - 1]["dep"] == "compound":
            start -= 1
        return start, noun

    def auxiliary_span(self, verb: int) -> tuple[int, int]:
        start, end = verb, verb
        for c in reversed(self.lefts(verb)):
            if self.doc[c]["dep"] not in AUXILIARIES:
                break
            start = c
        for c in self.rights(verb):
            if self.doc[c]["dep"] not in AUXILIARIES:
                break
            end = c
        return start, end


@per_doc("array<struct<subject:array<string>,verb:array<string>,object:array<string>>>")
def _svo(doc):
    tree = Tree(doc)
    doc = tree.doc
    verb = lambda i: i is not None and doc[i]["pos"] == "VERB"
    found: dict[int, tuple[set[int], set[int]]] = {}
    for t in doc:
        i, head, dep = t["i"], t["head"], t["dep"]
        if verb(i):
            found.setdefault(i, (set(), set()))
        if dep in SUBJECTS and verb(head):
            found.setdefault(head, (set(), set()))[0].update(tree.expand_noun(i))
        elif dep in CLAUSES and verb(head):
            found.setdefault(head, (set(), set()))[0].update(tree.subtree(i))
        elif dep == "dobj" and verb(head):
            found.setdefault(head, (set(), set()))[1].update(tree.expand_noun(i))
        elif dep == "pobj" and head is not None and doc[head]["dep"] == "agent" and verb(doc[head]["head"]):
            found.setdefault(doc[head]["head"], (set(), set()))[1].update(tree.expand_noun(i))
        elif dep == "xcomp" and verb(head) and not any(doc[c]["dep"] == "dobj" for c in tree.children(head)):
            found.setdefault(head, (set(), set()))[1].update(tree.subtree(i))
    for i, (subjects, objects) in found.items():
        together = [found[c] for c in tree.conjuncts(i) if c in found]
        if subjects:
            for other, _ in together:
                if not other:
                    other.update(subjects)
        if not objects:
            objects.update(*(o for _, o in together))
    return [{"subject": tree.texts(s), "verb": tree.texts(tree.expand_verb(i)), "object": tree.texts(o)} for i, (s, o) in sorted(found.items(), key=lambda x: doc[x[0]]["sent_id"]) if s and o]


def subject_verb_object_triples(tokens: ColumnOrName) -> Column:
    """Subjects and objects of each verb, shared along coordinated verbs."""
    return _svo(tokens)


@per_doc("array<struct<entity:array<string>,cue:array<string>,fragment:array<string>>>")
def _statements(doc, entity, cue, low, high):
    tree = Tree(doc)
    doc = tree.doc
    text = "".join(t["text"] + t["ws"] for t in doc)
    begins, ends, at = {}, {}, 0
    for t in doc:
        begins[at] = t["i"]
        ends[at + len(t["text"])] = t["i"] + 1
        at += len(t["text"]) + len(t["ws"])
    out = []
    for m in re.finditer(entity, text):
        if m.start() not in begins or m.end() not in ends:
            continue
        part = range(begins[m.start()], ends[m.end()])
        root = next((i for i in part if doc[i]["head"] not in part or doc[i]["head"] == i), None)
        if root is None or doc[root]["dep"] not in SUBJECTS:
            continue
        verb = doc[root]["head"]
        if verb is None or doc[verb]["pos"] not in ("VERB", "AUX") or doc[verb]["lemma"] != cue:
            continue
        below = tree.children(verb)
        direct = any(doc[c]["dep"] == "dobj" for c in below)
        for c in below:
            dep = doc[c]["dep"]
            if dep in ("attr", "dobj", "obj", "dative") or dep == "xcomp" and not direct:
                fragment = tree.subtree(c)
                if low <= len(fragment) < high:
                    out.append({"entity": tree.texts(part), "cue": tree.texts(tree.expand_verb(verb)), "fragment": tree.texts(fragment)})
                    break
    return out


def semistructured_statements(tokens: ColumnOrName, *, entity: str, cue: str, fragment_len_range: tuple[int | None, int | None] | None = None) -> Column:
    """What is said of an entity, a regular expression, by a verb with the lemma ``cue``; fragments of [low, high) tokens."""
    low, high = fragment_len_range or (None, None)
    unbounded = fragment_len_range is None
    return _statements(tokens, entity=entity, cue=cue, low=max(low or 1, 1), high=10**9 if unbounded else min(high or 1000, 1000))


@per_doc("array<struct<speaker:array<string>,cue:array<string>,content:string>>")
def _quotations(doc, verbs):
    tree = Tree(doc)
    doc = tree.doc
    marks = [t["i"] for t in doc if t["is_quote"]]
    if len(marks) % 2:
        return None
    pairs = list(zip(marks[::2], marks[1::2]))
    sentences: dict[int, list[int]] = {}
    for t in doc:
        sentences.setdefault(t["sent_id"], []).append(t["i"])
    out = []
    for a, b in pairs:
        content = doc[a : b + 1]
        named = [t for t in content if not (t["is_punct"] or t["is_stop"])]
        if len(content) < 4 or all(t["is_title"] for t in named):
            continue
        near = [s for s in sentences.values() if s[0] < a <= s[-1] + 2 or s[0] <= b + 1 and s[-1] + 1 > b]
        cues = [i for s in near for i in s if doc[i]["pos"] == "VERB" and doc[i]["lemma"] in verbs and not any(x <= i <= y for x, y in pairs)]
        for cue in sorted(cues, key=lambda i: min(abs(i - a), abs(i - b))):
            speaker = next((c for c in tree.children(cue) if doc[c]["dep"] in ("nsubj", "csubj")), None)
            if speaker is not None:
                text = "".join(t["text"] + t["ws"] for t in content[:-1]) + content[-1]["text"]
                out.append({"speaker": tree.texts(tree.expand_noun(speaker)), "cue": tree.texts(tree.expand_verb(cue)), "content": text})
                break
    return out


def direct_quotations(tokens: ColumnOrName, *, lang: str = "en") -> Column:
    """Quotations of four tokens or more with who says them; null where a mark has no partner."""
    if lang not in REPORTING:
        raise ValueError(f"lang = {lang!r}; known are {sorted(REPORTING)}")
    return _quotations(tokens, verbs=set(REPORTING[lang]))


def _lists(name: str, returns: str):
    return per_doc(returns)(lambda doc: [getattr(Tree(doc), name)(t["i"]) for t in doc if t["pos"] == "VERB"])


def subjects_of_verbs(tokens: ColumnOrName) -> Column:
    """For each verb, the places of its subjects."""
    return _lists("subjects_of", "array<array<int>>")(tokens)


def objects_of_verbs(tokens: ColumnOrName) -> Column:
    """For each verb, the places of its objects."""
    return _lists("objects_of", "array<array<int>>")(tokens)


def auxiliary_spans(tokens: ColumnOrName) -> Column:
    """For each verb, the first and last place with its auxiliaries."""
    return per_doc("array<struct<start:int,end:int>>")(lambda doc: [dict(zip(("start", "end"), Tree(doc).auxiliary_span(t["i"]))) for t in doc if t["pos"] == "VERB"])(tokens)


def compound_spans(tokens: ColumnOrName) -> Column:
    """For each noun, the first and last place with its compound parts."""
    return per_doc("array<struct<start:int,end:int>>")(lambda doc: [dict(zip(("start", "end"), Tree(doc).compound_span(t["i"]))) for t in doc if t["pos"] in ("NOUN", "PROPN")])(tokens)
