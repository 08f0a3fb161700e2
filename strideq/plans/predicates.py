"""Leaves and boolean expressions as null-safe boolean columns over the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FractionalType

from strideq.errors import QueryError
from strideq.functions import text as T
from strideq.functions.vectors import cosine
from strideq.plans.ir import And, Anything, Leaf, Link, Not, Or, Run, Var
from strideq.sources.corpus import Corpus, is_annotation


#: Stands for the list of names that an event's texts address.
MENTIONED = "mentioned_"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


class Predicates:
    """Builds columns for one corpus; the variables met on the way are listed."""

    def __init__(self, corpus: Corpus, dictionaries: dict):
        self.corpus, self.spec, self.dictionaries = corpus, corpus.spec, dictionaries

    # -- variables ------------------------------------------------------------
    def variables(self, e, under_not: bool = False, under_or: bool = False) -> list[tuple[str, str, bool]]:
        """(variable, field, negated) of an expression, in order."""
        if isinstance(e, Not):
            return self.variables(e.body, True, under_or)
        if isinstance(e, And | Or):
            own = under_or or isinstance(e, Or)
            return self.variables(e.left, under_not, own) + self.variables(e.right, under_not, own)
        if isinstance(e, Leaf):
            value = e.args[1] if e.kind == "field" else e.args[0] if e.kind == "mentions_user" else None
            if isinstance(value, Var):
                if under_not:
                    raise QueryError(f"${value.name} under NOT binds nothing; bind it outside")
                if under_or and value.negated:
                    raise QueryError(f"!${value.name} stands under AND only")
                return [(value.name, self.corpus.field(e.args[0]) if e.kind == "field" else MENTIONED, value.negated)]
        return []

    # -- booleans -------------------------------------------------------------
    def column(self, e) -> Column:
        """True exactly for the events that match."""
        if isinstance(e, Not):
            return ~self.column(e.body)
        if isinstance(e, And):
            return self.column(e.left) & self.column(e.right)
        if isinstance(e, Or):
            return self.column(e.left) | self.column(e.right)
        if isinstance(e, Link | Run):
            raise QueryError("a sequence can't stand under AND, OR, NOT or on the right of a link")
        return F.coalesce(self.leaf(e), F.lit(False))

    def leaf(self, e: Leaf) -> Column:
        """One predicate; null counts as no match."""
        return getattr(self, "_" + e.kind)(*e.args)

    # -- fields ---------------------------------------------------------------
    def shown(self, c: Column, kind) -> Column:
        """A value as text, as it is compared: lower case."""
        if isinstance(kind, FractionalType):
            return F.lower(c.cast("double").cast("string"))
        return F.lower(c.cast("string"))

    def _field(self, name: str, value, mode: str) -> Column:
        if isinstance(value, Var):
            return F.lit(True)
        name = self.corpus.field(name)
        if not self.corpus.has(name):
            return F.lit(False)
        c, kind = F.col(f"`{name}`"), self.corpus.schema[name].dataType
        if isinstance(value, Anything):
            if isinstance(kind, ArrayType):
                return F.size(c) > 0
            return c.isNotNull() & (c.cast("string") != "")
        low = value.lower()
        if isinstance(kind, ArrayType):
            own = kind.elementType
            return F.exists(c, lambda x: self.shown(x, own) == low if mode == "exact" else self.shown(x, own).contains(low))
        if isinstance(kind, BooleanType) and mode == "exact":
            return c if low == "true" else ~c if low == "false" else F.lit(False)
        return self.shown(c, kind) == low if mode == "exact" else self.shown(c, kind).contains(low)

    # -- texts ----------------------------------------------------------------
    def terms(self, name) -> tuple[list[str], str]:
        """The terms of a dictionary and how its single words match."""
        if not isinstance(name, str):
            raise QueryError("a dictionary is named by a plain word")
        if name not in self.dictionaries:
            known = ", ".join(sorted(self.dictionaries)) or "none"
            raise QueryError(f"no dictionary {name!r}; there are: {known}")
        own = self.dictionaries[name]
        if isinstance(own, dict):
            return list(own["terms"]), own.get("match") or self.spec.text_match
        return list(own), self.spec.text_match

    def index(self, field: str, what: str) -> Column | None:
        """The column of a field's tokens or stems, if ingest wrote it for this tokenizer and
        language (its stamp says so); a column that only has the name is none."""
        name, spec = f"{field}_{what}", self.spec
        if not self.corpus.is_list(name) or callable(spec.tokenizer):
            return None
        stamp = self.corpus.schema[name].metadata
        fits = stamp.get(what + "_of") == field and stamp.get("tokenizer") == spec.tokenizer and (what == "tokens" or stamp.get("language") == spec.language.lower())
        return F.col(f"`{name}`") if fits else None

    def tokens(self, field: str) -> Column:
        """Tokens of a text field."""
        own = self.index(field, "tokens")
        return own if own is not None else T.tokens(F.col(f"`{field}`"), self.spec.tokenizer)

    def stems(self, field: str) -> Column:
        """Stems of a text field."""
        own = self.index(field, "stems")
        return own if own is not None else T.stems(self.tokens(field), self.spec.language)

    def words(self, term: str, what: str) -> list[str]:
        """The tokens of a term; none is an error, not an empty answer."""
        found = T.tokens_of(term, self.spec.tokenizer)
        if not found:
            raise QueryError(f"{what}: the term {term!r} has no letters or digits")
        return found

    def adjacent(self, words: Column, run: list[str]) -> Column:
        """Whether these tokens are next to each other, in order. Tokens of the built-in
        tokenizers have no spaces, and others no null character, so joined text says it."""
        sep = "\0" if callable(self.spec.tokenizer) else " "
        return F.contains(F.concat(F.lit(sep), F.array_join(words, sep), F.lit(sep)), F.lit(sep + sep.join(run) + sep))

    def _contains(self, name) -> Column:
        if isinstance(name, Anything):
            return F.lit(True)
        terms, mode = self.terms(name)
        found = [self._contains_phrase(t) for t in terms if " " in t.strip()]
        single = [t for t in terms if " " not in t.strip()]
        if single:
            found.append({"stem": self._stemmed, "token": self._whole, "substring": self._within}[mode](single, f"contains({name})"))
        return _any(found)

    def _contains_tokens(self, name) -> Column:
        return F.lit(True) if isinstance(name, Anything) else self._whole(self.terms(name)[0], f"contains_tokens({name})")

    def _matching(self, of, terms: list[list[str]], what: str) -> Column:
        found = []
        for field in self.corpus.text_columns(what):
            words = of(field)
            one = [t[0] for t in terms if len(t) == 1]
            if one:
                found.append(F.arrays_overlap(words, F.array(*[F.lit(x) for x in one])))
            found += [self.adjacent(words, t) for t in terms if len(t) > 1]
        return _any([F.coalesce(c, F.lit(False)) for c in found])

    def _whole(self, terms: list[str], what: str) -> Column:
        return self._matching(self.tokens, [self.words(t, what) for t in terms], what)

    def _stemmed(self, terms: list[str], what: str) -> Column:
        stem = T.stem_words(self.spec.language)
        wanted = [[stem(w) for w in self.words(t, what)] for t in terms]
        if any(len(t) > 1 for t in wanted):
            return self._matching(self.stems, wanted, what)
        # An English word and its stem begin alike, so few words need stemming at all; other
        # languages take accents away.
        letters = sorted({t[0][0] for t in wanted}) if self.spec.language.lower() in ("english", "en") else None

        def likely(field: str) -> Column:
            own = self.index(field, "stems")
            if own is not None:
                return own
            words = self.tokens(field)
            return T.stems(F.array_distinct(F.filter(words, lambda w: F.substring(w, 1, 1).isin(letters)) if letters else words), self.spec.language)

        return self._matching(likely, wanted, what)

    def _within(self, terms: list[str], what: str) -> Column:
        fields = self.corpus.text_columns(what)
        found = []
        for t in terms:
            low = t.lower()
            if self.corpus.has("text"):
                found.append(F.lower(F.col("text")).contains(low))
            if T.tokens_of(low, self.spec.tokenizer) == [low]:
                found += [F.array_contains(self.tokens(f), low) for f in fields]
        return _any([F.coalesce(c, F.lit(False)) for c in found])

    def _contains_phrase(self, phrase: str) -> Column:
        if not self.corpus.has("text"):
            raise QueryError("contains_phrase reads the text field, and the corpus has none")
        return self.adjacent(self.tokens("text"), self.words(phrase, "contains_phrase"))

    # -- annotations ----------------------------------------------------------
    def rule(self, what: str, of) -> Column:
        """A rule over all text fields."""
        return _any([F.coalesce(of(F.col(f"`{c}`")), F.lit(False)) for c in self.corpus.text_columns(what)])

    def annotated(self, name: str) -> bool:
        """Whether an annotation wrote this column; a field of that name is none."""
        return self.corpus.has(name) and is_annotation(self.corpus.schema[name])

    def _is_question(self) -> Column:
        return F.col("is_question") if self.annotated("is_question") else self.rule("is_question()", T.is_question)

    def _entity(self, label: str) -> Column:
        if label == "URL":
            if self.annotated("has_link"):
                return F.col("has_link")
            own = F.array_contains("entities", "URL") if self.annotated("entities") else F.lit(False)
            return F.coalesce(own, F.lit(False)) | self.rule("contains_link()", T.has_link)
        if not self.annotated("entities"):
            raise QueryError(f"mentions of {label} need an entities column; annotate the corpus first")
        return F.array_contains("entities", label)

    def _has_feature(self, name: str) -> Column:
        if self.corpus.has(name) and isinstance(self.corpus.schema[name].dataType, BooleanType):
            return F.col(f"`{name}`")
        if self.corpus.is_list("features") and name in self.spec.feature_names:
            return F.array_contains("features", name)
        known = [*self.spec.feature_names, *[f.name for f in self.corpus.schema if isinstance(f.dataType, BooleanType)]]
        raise QueryError(f"no feature {name!r}; there are: {', '.join(known) or 'none'}")

    def mentions(self) -> Column:
        """The names that an event's texts address."""
        if self.annotated("mentions"):
            return F.col("mentions")
        names = self.corpus.names()
        own = [T.mentions(F.col(f"`{c}`"), names) for c in self.corpus.text_columns("mentions_user")]
        return F.array_distinct(F.concat(*own)) if len(own) > 1 else own[0]

    def _mentions_user(self, who) -> Column:
        if isinstance(who, Anything | Var):
            return F.size(self.mentions()) > 0
        return F.exists(self.mentions(), lambda m: F.lower(m) == who.lower())

    def _similar_to(self, text: str, threshold: float) -> Column:
        if not 0 <= threshold <= 1:
            raise QueryError("similar_to takes a threshold from 0 to 1")
        if not self.corpus.has(self.spec.embedding) or self.spec.embedder is None:
            raise QueryError("similar_to needs an embedding column and an embedder")
        query = [float(x) for x in self.spec.embedder([text])[0]]
        return cosine(F.col(f"`{self.spec.embedding}`"), query) >= threshold
