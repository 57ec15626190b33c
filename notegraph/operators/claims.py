"""Claims from sentences: gate, clauses, subject-verb-object, attribution, degradation, ids.

A dependency parse is an input column: an array of tokens (i, text, lemma, pos, dep, head, start),
head being the index of the governing token (its own for the root) and start the offset in
the sentence.  Any parser can fill it; a null parse makes a sentence one claim as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions import lexicon as L
from notegraph.functions import text as T

TOKEN = "struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,start:int>"
#: Dependency labels, attribution verbs and warning codes.
SUBJECTS = ("nsubj", "nsubjpass", "csubj", "expl")
CLAUSE_SUBJECTS = ("nsubj", "nsubjpass", "csubj")
OBJECTS = ("dobj", "pobj", "attr", "acomp")
SHARED_OBJECTS = ("dobj", "obj", "attr", "dative", "oprd", "pobj")
AUXILIARIES = ("aux", "auxpass")
VERBS = ("VERB", "AUX")
ATTRIBUTION_VERBS = (
    "say", "says", "said", "claim", "claims", "claimed", "argue", "argues", "argued", "believe", "believes", "believed", "state", "states", "stated", "report", "reports",
    "reported", "suggest", "suggests", "suggested", "note", "notes", "noted", "assert", "asserts", "asserted", "propose", "proposes", "proposed", "write", "writes", "wrote",
    "show", "shows", "showed", "shown", "find", "finds", "found",
)
PARSER_FAILURE, STRUCTURE_UNAVAILABLE, FALLBACK, EMPTY, TOO_MANY = "CLM001", "CLM003", "CLM004", "CLM005", "CLM009"
MAX_CLAIMS = 10


@dataclass(frozen=True)
class Token:
    i: int
    text: str
    lemma: str
    pos: str
    dep: str
    head: int
    start: int


@dataclass(frozen=True)
class Clause:
    """Tokens of one assertion with the token that governs them and why it was cut there."""

    tokens: tuple[Token, ...]
    root: int
    reason: str
    start: int = 0

    @property
    def spans(self) -> list[tuple[int, int]]:
        """Runs of neighbouring tokens as (start, end) offsets."""
        out: list[tuple[int, int]] = []
        before = None
        for t in self.tokens:
            end = t.start + len(t.text)
            if before is not None and t.i == before + 1:
                out[-1] = (out[-1][0], end)
            else:
                out.append((t.start, end))
            before = t.i
        return out


class Tree:
    """Children and subtrees of a parse; tokens whose heads form a cycle belong to no subtree but their own."""

    def __init__(self, tokens: list[Token]):
        self.at = {t.i: t for t in tokens}
        self.below: dict[int, list[int]] = {}
        for t in tokens:
            if t.head != t.i:
                self.below.setdefault(t.head, []).append(t.i)
        roots = [t.i for t in tokens if t.dep == "ROOT"]
        self.root = roots[0] if roots else None

    def children(self, i: int, *deps: str) -> list[int]:
        return [c for c in self.below.get(i, ()) if not deps or self.at[c].dep in deps]

    def subtree(self, i: int) -> set[int]:
        seen, todo = {i}, [i]
        while todo:
            for c in self.below.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    def clause(self, ids: set[int], root: int, reason: str, first: int | None = None) -> Clause:
        return Clause(tuple(self.at[i] for i in sorted(ids)), root, reason, 0 if first is None else self.at[first].start)


def clauses(tree: Tree) -> list[Clause]:
    """The assertions of a sentence: one, or one for the main clause and one for each verb, else object, joined to the root.

    A joined verb without a subject of its own takes over the root's subject and auxiliaries, a
    joined object the root as well.
    """
    whole = set(tree.at)
    if tree.root is None:
        return [tree.clause(whole, -1, "single_assertion")] if whole else []
    root = tree.root
    joined, shared = tree.children(root, "conj"), False
    if not joined:
        for o in (c for c in tree.children(root, *SHARED_OBJECTS) if c > root):
            if joined := tree.children(o, "conj"):
                shared = True
                break
    if not joined:
        return [tree.clause(whole, root, "single_assertion")]
    own = {j: not shared and any(c < j for c in tree.children(j, *CLAUSE_SUBJECTS)) for j in joined}
    independent = all(own.values())
    reason = "independent_clause" if independent else "coordinated_predicate"
    subject = [c for c in tree.children(root, *CLAUSE_SUBJECTS) if c < root]
    kept = tree.subtree(subject[0]) if subject else set()
    kept |= {c for c in tree.children(root, *AUXILIARIES) if c < root}
    taken = set().union(*(tree.subtree(j) for j in joined))
    out = [tree.clause(whole - taken, root, reason)]
    for j in joined:
        over = set() if own[j] else kept | {root} if shared else kept
        out.append(tree.clause(over | tree.subtree(j), root if shared else j, reason, j))
    return out


def clause_text(clause: Clause, sentence: str) -> str:
    """The clause's tokens with the blanks that follow them in the sentence."""
    out = ""
    for t in clause.tokens:
        end = t.start + len(t.text)
        out += sentence[t.start : end] + (" " if sentence[end : end + 1].isspace() else "")
    return out.strip()


def structure(clause: Clause) -> dict[str, str | None] | None:
    """subject, predicate, object, negation and modality marker of a clause; None where a verb does not govern it."""
    ids = {t.i for t in clause.tokens}
    verb = next((t for t in clause.tokens if t.i == clause.root), None)
    if verb is None or verb.pos not in VERBS:
        return None
    # what the joined verb takes over from the main clause hangs on it here
    inside = [Token(t.i, t.text, t.lemma, t.pos, t.dep, t.head if t.head in ids else verb.i, t.start) for t in clause.tokens]
    tree = Tree(inside)
    phrase = lambda deps: next((" ".join(tree.at[x].text for x in sorted(tree.subtree(c))) for c in tree.children(verb.i, *deps)), None)
    first = lambda *deps: next((tree.at[c].text for c in tree.children(verb.i, *deps)), None)
    # a joined object stands in the place of the one it is joined to
    return {"subject": phrase(SUBJECTS), "predicate": verb.text, "object": phrase((*OBJECTS, "conj")), "negation_marker": first("neg"), "modality_marker": first(*AUXILIARIES)}


def attribution(tree: Tree) -> str | None:
    """The subject of the first verb of saying or finding."""
    for i in sorted(tree.at):
        if tree.at[i].lemma.lower() in ATTRIBUTION_VERBS and (s := tree.children(i, "nsubj", "nsubjpass")):
            return tree.at[s[0]].text
    return None


def sentence_claims(text: str, parse: list[Token] | None, most: int = MAX_CLAIMS) -> list[dict]:
    """Clauses of one sentence with text, span_start, spans, reason, mode, structure, attribution and warning codes."""
    if parse is None:
        return [{"text": text, "span_start": 0, "spans": [(0, len(text))], "reason": "parse_failed", "mode": "whole_sentence", "svo": None, "to": None, "warnings": [STRUCTURE_UNAVAILABLE, PARSER_FAILURE, FALLBACK]}]
    tree = Tree(parse)
    found = clauses(tree)
    extra = [TOO_MANY] if len(found) > most else []
    out = []
    for c in found[:most]:
        svo = structure(c)
        full = svo is not None and all(svo[x] for x in ("subject", "predicate", "object"))
        mode = "structured" if full else "lexical" if svo is None else "partial"
        warnings = {"structured": [], "partial": [STRUCTURE_UNAVAILABLE], "lexical": [FALLBACK]}[mode]
        out.append({"text": text if len(found) == 1 else clause_text(c, text), "span_start": c.start, "spans": c.spans, "reason": c.reason, "mode": mode, "svo": svo, "to": attribution(tree), "warnings": warnings + extra})
    return out


_SVO = "struct<subject:string,predicate:string,object:string,negation_marker:string,modality_marker:string>"
_SCHEMA = f"sentence_id string, claim_text string, span_start int, spans array<struct<start:int,end:int>>, boundary_reason string, extraction_mode string, svo {_SVO}, attributed_to string, warnings array<string>, error string"


def extract(sentences: DataFrame, most: int = MAX_CLAIMS) -> DataFrame:
    """claim_id, sentence_id, document_id, claim_text, content_hash, span_start, spans, boundary_reason, extraction_mode, svo, annotations, warnings, error.

    sentences: sentence_id, document_id, text, origin_block_type and, if there is one, parse.  What the
    gate takes for no declarative assertion gives one row without a claim, with its type in
    `discarded_as`; null and empty texts are discarded as empty.  A sentence that fails gives a
    row with the error.  Repeated claim ids count once.
    """
    s = sentences if "parse" in sentences.columns else sentences.withColumn("parse", F.lit(None).cast(f"array<{TOKEN}>"))
    s = s.select("sentence_id", "document_id", "text", "origin_block_type", "parse").withColumn("discarded_as", T.assertion_type(F.col("text"), F.col("origin_block_type")))
    s = s.withColumn("discarded_as", F.when(F.col("discarded_as") != "declarative_assertion", F.col("discarded_as")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["sentence_id", "claim_text", "span_start", "spans", "boundary_reason", "extraction_mode", "svo", "attributed_to", "warnings", "error"]
        for b in batches:
            out: list[tuple] = []
            for i, text, parse in zip(b["sentence_id"], b["text"], b["parse"], strict=True):
                try:
                    tokens = None if parse is None else [Token(**{k: t[k] for k in ("i", "text", "lemma", "pos", "dep", "head", "start")}) for t in parse]
                    for c in sentence_claims(text, tokens, most):
                        spans = [{"start": x, "end": y} for x, y in c["spans"]]
                        out.append((i, c["text"], c["span_start"], spans, c["reason"], c["mode"], c["svo"], c["to"], c["warnings"], None))
                except Exception as x:  # noqa: BLE001
                    out.append((i, None, None, None, None, None, None, None, [], f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=names)

    made = s.where("discarded_as is null").select("sentence_id", "text", "parse").mapInPandas(run, _SCHEMA)
    made = made.where("error is not null or trim(claim_text) != ''").dropDuplicates(["sentence_id", "claim_text", "span_start"])
    gone = s.where("discarded_as is not null").select("sentence_id", "discarded_as")
    rows = made.unionByName(gone, allowMissingColumns=True).join(s.select("sentence_id", "document_id").distinct(), "sentence_id")
    t = F.col("claim_text")
    has = t.isNotNull()
    return rows.withColumns({
        "claim_id": F.when(has, T.short_id(F.col("sentence_id"), t, F.col("span_start"))), "content_hash": F.when(has, F.substring(F.sha2(t, 256), 1, 16)),
        "is_negated": F.when(has, L.is_negated(t)), "modality": F.when(has, L.modality(t)), "is_conditional": F.when(has, L.is_conditional(t)), "is_comparative": F.when(has, L.is_comparative(t)),
        "is_quoted": F.when(has, L.is_quoted(t)), "is_attributed": F.when(has, F.col("attributed_to").isNotNull()),
    })


def counts(extracted: DataFrame) -> DataFrame:
    """kind, n: claims by mode, negated, modal and attributed ones, discarded sentences by type, failures."""
    mode = extracted.where("claim_id is not null").groupBy(F.concat(F.lit("mode:"), "extraction_mode").alias("kind")).agg(F.count("*").alias("n"))
    gone = extracted.where("discarded_as is not null").groupBy(F.concat(F.lit("discarded:"), "discarded_as").alias("kind")).agg(F.count("*").alias("n"))
    flags = {"negated": F.col("is_negated"), "modal": F.col("modality") != "certain", "attributed": F.col("is_attributed"), "failed": F.col("error").isNotNull()}
    one = extracted.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    one = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in flags])).alias("x")).select("x.*")
    return mode.unionByName(gone).unionByName(one)


def problems(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """claim_id, problem of claim rows: no_id, empty, unknown_document, repeated_id, no_context; several rows where several hold."""
    known = documents.select("document_id").distinct().withColumn("known_", F.lit(True))
    times = claims.where("claim_id is not null").groupBy("claim_id").agg(F.count("*").alias("times_"))
    rows = claims.join(known, "document_id", "left").join(times, "claim_id", "left")
    found = F.array_compact(F.array(
        F.when(F.col("claim_id").isNull(), "no_id"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty"), F.when(F.col("known_").isNull(), "unknown_document"),
        F.when(F.col("times_") > 1, "repeated_id"), F.when(F.col("context").isNull(), "no_context"),
    ))
    return rows.select("claim_id", F.explode(found).alias("problem"))
