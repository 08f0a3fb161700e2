"""Why an event is in a group: the predicates that hold on it, with what they matched."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F

from strideq.functions import text as T
from strideq.plans.ir import Leaf, Link, Row, Stages
from strideq.plans.predicates import Predicates
from strideq.plans.validate import leaves


@dataclass(frozen=True)
class Reason:
    """A predicate that holds on an event, and where: (field, start, end) of each hit."""

    position: int
    predicate: Leaf
    spans: tuple[tuple[str, int, int], ...] = ()
    similarity: float | None = None


def asserted(q) -> list[Leaf]:
    """The predicates of a query whose truth matters; excluded sides are left out."""

    def of(e) -> list[Leaf]:
        if isinstance(e, Link):
            return of(e.left) + ([] if e.negative else of(e.right))
        return leaves(e)

    if isinstance(q.source, Stages):
        found = asserted(q.source.head)
        for n in q.source.rest:
            found += [] if n.link and n.link.negative else asserted(n.query)
    else:
        found = [x for i in q.source.items for x in of(i.body)] if isinstance(q.source, Row) else []
    return list(dict.fromkeys(found))


def slots(q) -> list[int]:
    """For a chain, the leg (in writing order) that stands in each slot."""

    def of(e, nth: int) -> tuple[list[int], int]:
        if not isinstance(e, Link):
            return [nth], nth + 1
        own, nth = of(e.left, nth)
        if e.negative:
            return own, nth
        return ([*own, nth] if e.forward else [nth, *own]), nth + 1

    return of(q.source.items[0].body, 0)[0]


def explain(engine, query: str, positions: list[int]) -> list[Reason]:
    """Reasons for the events at some positions (those of results that are looked at)."""
    q = engine.to_ir(query)
    p = Predicates(engine.corpus, engine.dictionaries)
    own = asserted(q)
    spec = engine.corpus.spec
    texts = [c for c in spec.text_fields if engine.corpus.has(c)]
    df = engine.corpus.df.filter(F.col("position").isin(positions))
    score = []
    for i, e in enumerate(own):
        if e.kind == "similar_to":
            from strideq.functions.vectors import cosine

            score.append(cosine(F.col(f"`{spec.embedding}`"), [float(x) for x in spec.embedder([e.args[0]])[0]]).alias(f"s{i}"))
    rows = df.select("position", *[F.coalesce(p.leaf(e), F.lit(False)).alias(f"h{i}") for i, e in enumerate(own)], *score, *texts).orderBy("position").collect()
    found = []
    for r in rows:
        for i, e in enumerate(own):
            if r[f"h{i}"]:
                found.append(Reason(r["position"], e, tuple(_spans(e, {c: r[c] for c in texts}, p)), r[f"s{i}"] if e.kind == "similar_to" else None))
    return found


def _spans(e: Leaf, texts: dict[str, Any], p: Predicates) -> list[tuple[str, int, int]]:
    """Where a text predicate matched."""
    if e.kind in ("contains", "contains_tokens") and isinstance(e.args[0], str):
        terms, mode = p.terms(e.args[0])
        mode = "token" if e.kind == "contains_tokens" else mode
    elif e.kind == "contains_phrase":
        terms, mode = [e.args[0]], "token"
    elif e.kind == "entity" and e.args[0] == "URL":
        return [(c, m.start(), m.end()) for c, t in texts.items() if t for m in re.finditer(T.URL_SHAPE, t, re.I)]
    else:
        return []
    found = []
    for c, t in texts.items():
        if not t:
            continue
        at = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(T.SHAPES[p.spec.tokenizer], t, re.I)]
        for term in terms:
            words = T.tokens_of(term, p.spec.tokenizer)
            stem = T.stem_words(p.spec.language) if mode == "stem" and len(words) == 1 else (lambda w: w)
            if mode == "substring" and len(words) <= 1:
                found += [(c, m.start(), m.end()) for m in re.finditer(re.escape(term.lower()), t.lower())]
                continue
            want = [stem(w) for w in words]
            for i in range(len(at) - len(want) + 1):
                if want and [stem(x[2]) for x in at[i : i + len(want)]] == want:
                    found.append((c, at[i][0], at[i + len(want) - 1][1]))
    return sorted(set(found))
