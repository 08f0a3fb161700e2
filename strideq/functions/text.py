"""Tokens, n-grams, stems, and the rules on texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from strideq.errors import ConfigError
from strideq.functions.stemming import STEMMERS

#: Token shapes; the first that fits wins.
URL_SHAPE = r"https?://\S+"
SHAPES = {
    "unicode": "|".join([URL_SHAPE, r"\w+@\w+(?:\.\w+)+", r"\w[+#]+", r"\w+(?:'\w+)*", r"\w+"]),
    "word": r"\w+",
}
#: Words that open a question, and what may follow its mark.
QUESTION_WORDS = ("what", "who", "when", "where", "why", "how", "which", "can", "could", "would", "should", "do", "does", "did", "is", "are", "was", "were", "will")
AFTER_QUESTION_MARK = "[\\s)\\]}\"'»”’.,;:!?]"


def _shape(tokenizer: str) -> str:
    if tokenizer not in SHAPES:
        raise ConfigError(f"unknown tokenizer {tokenizer!r}; there are {', '.join(SHAPES)}, or give a function from a text to its tokens")
    return SHAPES[tokenizer]


def tokens(text: Column, tokenizer: str | Callable[[str], list[str]] = "unicode") -> Column:
    """Lower-case tokens of a text; none of a null. A tokenizer of one's own is a function
    from a text to a list, and runs in Arrow batches."""
    if callable(tokenizer):

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda t: list(tokenizer(t)) if t is not None else [])

        return F.pandas_udf(run, "array<string>")(text)
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?U){_shape(tokenizer)}"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def tokens_of(text: str, tokenizer: str | Callable[[str], list[str]] = "unicode") -> list[str]:
    """The same on the driver, for a query's own words."""
    return list(tokenizer(text)) if callable(tokenizer) else re.findall(_shape(tokenizer), text.lower())


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def stem_words(language: str) -> Callable[[str], str]:
    """A stemmer by language; where there is none, no other stands in for it."""
    found = STEMMERS.get(language.lower())
    if found is None:
        raise ConfigError(f"no stemmer for {language!r}; there are {', '.join(sorted(STEMMERS))}: use text_match token or substring")
    return found


def _stemmed(words: pa.Array, stem: Callable[[str], str]) -> pa.Array:
    """Stems of an Arrow array of token lists. Only a batch's distinct words become Python
    strings; tokens and stems stay Arrow buffers."""
    lengths = pc.fill_null(pc.list_value_length(words), 0)
    ends = pc.cumulative_sum(lengths).cast(pa.int32())
    flat = pc.dictionary_encode(words.flatten())
    own = pa.array([None if w is None else stem(w) for w in flat.dictionary.to_pylist()], flat.dictionary.type)
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), own.take(flat.indices)).cast(words.type)


def stems(words: Column, language: str = "english") -> Column:
    """Stems of a token array, in Arrow batches."""
    stem = stem_words(language)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _stemmed(batch, stem)

    return F.arrow_udf(run, "array<string>")(words)


def is_question(text: Column) -> Column:
    """A question mark that ends a clause, or an opening question word."""
    low = F.trim(F.lower(text))
    return text.rlike(rf"\?(?=$|{AFTER_QUESTION_MARK})") | low.rlike(rf"^({'|'.join(QUESTION_WORDS)}) ")


def has_link(text: Column) -> Column:
    """A scheme and what follows up to white space."""
    return text.rlike("(?i)" + URL_SHAPE)


def mentions(text: Column, names: list[str]) -> Column:
    """The known names that a text addresses with @, longest first, spelled as known."""
    own = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
    if not own:
        return F.array().cast("array<string>")
    java = "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in own)
    found = F.regexp_extract_all(text, F.lit(rf"(?iU)(?<![\w.])@({java})(?![\w-]|\.\w)"), F.lit(1))
    spelled = F.create_map(*[x for n in own for x in (F.lit(n.lower()), F.lit(n))]) if len({n.lower() for n in own}) == len(own) else F.create_map(*[x for k, n in {n.lower(): n for n in reversed(own)}.items() for x in (F.lit(k), F.lit(n))])
    return F.coalesce(F.array_distinct(F.transform(found, lambda m: F.coalesce(F.element_at(spelled, F.lower(m)), m))), F.array().cast("array<string>"))
