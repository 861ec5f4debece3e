"""From a question to an answer: intent, links, schema, candidate queries, repair, ranking.

The language model is any object with ``complete(prompt) -> str``; ``Scripted``
replays answers, ``HttpModel`` posts to a chat endpoint.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import functions as F

from ..plans import sparql as S
from ..terms import from_nt
from .linking import Linker, citations, schema_context, subgraph


class Model(Protocol):
    def complete(self, prompt: str) -> str: ...


class Scripted:
    """Answers in order, for tests; the last one is repeated."""

    def __init__(self, *answers: str):
        self.answers, self.prompts = list(answers), []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


@dataclass
class HttpModel:
    """A chat-completions endpoint."""

    url: str
    model: str
    key: str = ""
    timeout: float = 60.0

    def complete(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]


# --- intent and language


@dataclass
class Intent:
    qtype: str = "select"
    mentions: list = field(default_factory=list)
    relations: list = field(default_factory=list)
    aggregation: str | None = None
    target: str | None = None
    language: str | None = None


def extract_intent(model: Model, question: str) -> Intent:
    """JSON from the model; whatever is missing or odd takes its default."""
    text = model.complete(f"Return JSON with qtype, mentions, relations, aggregation, target, language for the question: {question}")
    try:
        data = json.loads(re.search(r"\{.*\}", text, re.S)[0])
    except (TypeError, ValueError):
        return Intent()
    words = lambda v: [str(x) for x in v] if isinstance(v, list) else []
    plain = lambda v: v if isinstance(v, str) and v else None
    return Intent(str(data.get("qtype") or "select").lower(), words(data.get("mentions")), words(data.get("relations")), plain(data.get("aggregation")), plain(data.get("target")), plain(data.get("language")))


#: Script ranges that tell a language by themselves.
RANGES = [("ja", "぀", "ヿ"), ("ko", "가", "힯"), ("zh", "一", "鿿"), ("ru", "Ѐ", "ӿ"), ("ar", "؀", "ۿ"), ("el", "Ͱ", "Ͽ"), ("he", "֐", "׿"), ("hi", "ऀ", "ॿ"), ("th", "฀", "๿")]


def language_of(question: str, stated: str | None = None) -> str:
    """The stated language, else by script, else English."""
    return stated or next((lang for lang, lo, hi in RANGES if any(lo <= c <= hi for c in question)), "en")


# --- candidates


def read_only(text: str) -> bool:
    """Whether a text is a SELECT or ASK of the grammar."""
    try:
        return isinstance(S.parse(text), (S.Select, S.Ask))
    except S.SparqlError:
        return False


def strip_fences(text: str) -> str:
    m = re.search(r"```(?:sparql)?\s*(.*?)```", text, re.S | re.I)
    return (m[1] if m else text).strip()


def valid_candidates(raw: list[str], n: int, known: set[str] | None = None) -> list[str]:
    """Distinct, read-only candidates whose IRIs are known, at most n."""
    out: list[str] = []
    for text in map(strip_fences, raw):
        if text in out or not read_only(text):
            continue
        if known is not None and not set(re.findall(r"<([^<>\s]*)>", re.sub(r"(?i)prefix\s+\w*:\s*<[^>]*>", "", text))) <= known:
            continue
        out.append(text)
        if len(out) == n:
            break
    return out


@dataclass
class Outcome:
    query: str
    answers: list
    rounds: int
    error: str | None = None

    def score(self) -> float:
        """1.0 at once, less for every repair; 0.1 without answers."""
        if not self.answers:
            return 0.1
        return 1.0 if not self.rounds else min(0.89, 1.0 - 0.05 * self.rounds - 0.06)


def run_query(store, text: str, limit: int = 1000) -> list:
    answer = store.query(text, "ntriples")
    return [answer.value] if answer.kind == "ask" else [tuple(r) for r in answer.value.limit(limit).collect()]


def solve_with_repair(model: Model, store, question: str, context: str, query: str, max_rounds: int = 3) -> Outcome:
    """Runs a query; on an error or no answer asks for a better one. The first answers win."""
    tried, error, answers = [], None, []
    for rounds in range(max_rounds + 1):
        tried.append(query)
        try:
            if not read_only(query):
                raise S.SparqlError("not a SELECT or ASK")
            answers = run_query(store, query)
            error = None
            if answers:
                return Outcome(query, answers, rounds)
        except Exception as x:
            error = str(x)[:300]
        if rounds < max_rounds:
            query = strip_fences(model.complete(f"Question: {question}\n{context}\nThese queries failed or found nothing ({error or 'no rows'}):\n" + "\n".join(tried) + "\nWrite a better SPARQL query."))
    return Outcome(query, answers, max_rounds, error)


# --- analytics questions

#: Keyword -> operation.
OPERATIONS = [("shortest path", "path"), ("path between", "path"), ("connected to", "path"), ("most important", "pagerank"), ("pagerank", "pagerank"), ("influential", "pagerank"), ("degree", "degree"), ("most connected", "degree"), ("components", "components"), ("triangle", "triangles")]


def classify_operation(question: str) -> str | None:
    low = question.lower()
    return next((op for word, op in OPERATIONS if word in low), None)


def run_analytics(store, question: str, seeds: list[str], k: int = 10, max_edges: int = 50_000):
    """Rows of a graph operation; a path looks at the undirected neighbourhood of its seeds, of at most ``max_edges`` edges."""
    from ..operators.graph import Graph

    op, graph = classify_operation(question), store.graph()
    if op == "path" and len(seeds) >= 2:
        near = subgraph(store.quads.where("g is null").select("s", "p", "o"), [f"<{s}>" for s in seeds[:2]], 3, 200, max_edges)
        both = near.select(F.col("s").alias("a"), F.col("o").alias("b")).unionAll(near.select("o", "s"))
        path = Graph(both).shortest_path(f"<{seeds[0]}>", f"<{seeds[1]}>")
        return op, path or []
    if op == "pagerank":
        return op, [tuple(r) for r in graph.pagerank().orderBy(F.desc("rank"), "node").limit(k).collect()]
    if op == "degree":
        return op, [tuple(r) for r in graph.degrees().orderBy(F.desc(F.col("out_degree") + F.col("in_degree")), "node").limit(k).collect()]
    if op == "components":
        return op, [graph.weak_components().select("component").distinct().count()]
    if op == "triangles":
        return op, [graph.triangle_count()]
    return None, []


# --- answers


@dataclass
class Answer:
    question: str
    text: str
    answers: list
    query: str | None = None
    confidence: float = 0.0
    mode: str = "structured"
    citations: list = field(default_factory=list)
    language: str = "en"

    @property
    def abstained(self) -> bool:
        return not self.answers


class Solver:
    """Modes: structured (queries), graphrag (text from a subgraph), open (the model alone), auto."""

    def __init__(self, store, model: Model, linker: Linker | None = None, candidates: int = 3, max_rounds: int = 2, cache: int = 128, threshold: float = 0.2):
        self.store, self.model, self.linker = store, model, linker or Linker(store.quads)
        self.candidates, self.max_rounds, self.threshold = candidates, max_rounds, threshold
        self.cache: OrderedDict = OrderedDict()
        self.cache_size = cache

    def ask(self, question: str, mode: str = "auto") -> Answer:
        key = (mode, question.strip())
        if key in self.cache:
            return self.cache[key]
        out = self._solve(question, mode)
        if not out.abstained:
            self.cache[key] = out
            if len(self.cache) > self.cache_size:
                self.cache.popitem(last=False)
        return out

    def _solve(self, question: str, mode: str) -> Answer:
        if mode == "open":
            text = self.model.complete(question)
            return Answer(question, text, [text] if text.strip() else [], mode="open", confidence=0.3)
        intent = extract_intent(self.model, question)
        lang = language_of(question, intent.language)
        entities = [c for m in intent.mentions for c in self.linker.link_mention(m, 3)]
        relations = [c for r in intent.relations for c in self.linker.link_predicate(r, 3)]
        if mode in ("auto", "structured") and classify_operation(question):
            op, rows = run_analytics(self.store, question, [c.uri for c in entities])
            if rows:
                return Answer(question, str(rows), rows, mode=f"analytics:{op}", confidence=0.9, language=lang)
        triples = self.store.quads.where("g is null").select("s", "p", "o")
        if mode == "graphrag":
            return self._graphrag(question, entities, triples, lang)
        context = "Links:\n" + "\n".join(f"{c.text} = <{c.uri}> ({c.score:.2f})" for c in [*entities, *relations]) + "\nSchema:\n" + schema_context(self.store.quads, [c.uri for c in entities[:5]], [c.uri for c in relations[:5]]).text()
        raw = [self.model.complete(f"Question: {question}\n{context}\nWrite a SPARQL SELECT or ASK query.") for _ in range(self.candidates)]
        outcomes = [solve_with_repair(self.model, self.store, question, context, q, self.max_rounds) for q in valid_candidates(raw, self.candidates) or raw[:1]]
        best = max(outcomes, key=Outcome.score)
        if best.answers and best.score() >= self.threshold:
            uris = [from_nt(c)[1] for row in best.answers if isinstance(row, tuple) for c in row if c and c.startswith("<")]
            cited = [tuple(r) for r in citations(triples, list(dict.fromkeys(uris))).collect()] if uris else []
            return Answer(question, str(best.answers[:10]), best.answers, best.query, best.score(), "structured", cited, lang)
        if mode == "auto" and entities:
            return self._graphrag(question, entities, triples, lang)
        return Answer(question, "", [], best.query, best.score(), mode, language=lang)

    def _graphrag(self, question, entities, triples, lang) -> Answer:
        if not entities:
            return Answer(question, "", [], mode="graphrag", language=lang)
        near = [tuple(r) for r in subgraph(triples, [f"<{c.uri}>" for c in entities[:5]]).collect()]
        text = self.model.complete(f"Answer in {lang} from these statements only.\n" + "\n".join(" ".join(t) for t in near) + f"\nQuestion: {question}") if near else ""
        return Answer(question, text, [text] if text.strip() else [], mode="graphrag", confidence=0.5 if text.strip() else 0.0, citations=near[:30], language=lang)


class Session:
    """Turns of a conversation: follow-ups are rewritten with the last six."""

    KEEP, SHOWN, LONGEST = 64, 6, 240

    def __init__(self, solver: Solver):
        self.solver, self.turns = solver, []

    def ask(self, question: str, mode: str = "auto") -> Answer:
        whole = question
        if self.turns:
            history = "\n".join(f"Q: {q}\nA: {a}" for q, a in self.turns[-self.SHOWN :])
            whole = self.solver.model.complete(f"Rewrite the last question so that it stands alone.\n{history}\nQ: {question}").strip() or question
        answer = self.solver.ask(whole, mode)
        self.turns = [*self.turns, (whole, "" if answer.abstained else answer.text[: self.LONGEST])][-self.KEEP :]
        return answer
