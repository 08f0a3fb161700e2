"""BPE encoding by dynamic programming over prefixes, and decoding.

A word's encoding is found without replaying merges. An automaton over the
vocabulary reads the word once; its suffix links name, for every prefix, the tokens
that are suffixes of it. Exactly one of them is the last token of the prefix's own
encoding: the one that is compatible with the last token of the prefix before it.
Two tokens are compatible if the merges leave their joined text as these two tokens.
That last token is stored for every prefix, and following the stored tokens back from
the end of the word gives the ids.

Defined results: a null text is an empty one and has no ids; an empty text likewise.
Rows with null or repeated ids are encoded like any other. An added token written out
in a text is that token, as in the library. Long texts are handled word by word, so
memory is bounded by the longest row. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strideq.llm.common import table, trimmed

#: Texts of these characters need no normalisation but lower case, and ``str.split``
#: agrees with the vocabulary's idea of white space on them.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
#: Unicode's White_Space.
_SPACE = regex.compile(r"[\t-\r \x85\xA0  -     　]+")
_CACHED = 250_000


class _Memo(dict):
    """A bounded memo of a function."""

    def __init__(self, of, most: int):
        super().__init__()
        self._of, self._most = of, most

    def __missing__(self, key):
        if len(self) >= self._most:
            self.clear()
        found = self[key] = self._of(key)
        return found


class PrefixBpe:
    """The encoder of one ``tokenizers`` BPE file with lower-casing and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of.update({i: t for t, i in self.added.items()})
        self._split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"])
        end = model["end_of_word_suffix"]
        # A symbol is a byte, or a byte that ends a word (256 more): one character each.
        shown = _byte_letters()
        symbols = {c: chr(b) for b, c in shown.items()} | {c + end: chr(256 + b) for b, c in shown.items()}
        self.key = {self.vocab[t]: s for t, s in symbols.items() if t in self.vocab}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for at, pair in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in pair)
            made = self.vocab[pair[0] + pair[1]]
            self.rank[a, b] = (at, made)
            self.key.setdefault(made, self.key[a] + self.key[b])
        self._symbol = {s: i for i, s in self.key.items() if len(s) == 1}
        self._length = [len(self.key.get(i, "")) for i in range(1 + max(self.key))]
        split_of = {made: pair for pair, (_, made) in reversed(self.rank.items())}
        # Only tokens that are their own encoding can be in an encoding.
        whole = [i for i, s in self.key.items() if len(s) == 1 or self.merged(s) == [i]]
        never = len(self.rank)
        self._right = {i: self._edge(i, 1, split_of, never) for i in whole}
        self._left = {i: self._edge(i, 0, split_of, never) for i in whole}
        self._pair_rank = {a << 20 | b: at for (a, b), (at, _) in self.rank.items()}
        self._matches = ahocorasick.Automaton()
        for i in whole:
            self._matches.add_word(self.key[i], i)
        self._matches.make_automaton()
        self._fits = _Memo(lambda pair: self._test(pair >> 20, pair & 0xFFFFF), 1_000_000)
        self._words: dict[str, list[int]] = {}
        self._chunks: dict[str, tuple[bytes, str]] = {}

    def merged(self, symbols: str) -> list[int]:
        """The encoding by replaying merges: only to tell which tokens encode as themselves."""
        ids = [self._symbol[s] for s in symbols]
        while len(ids) > 1:
            at, best = min(((i, self.rank.get((ids[i], ids[i + 1]), (1 << 60, 0))) for i in range(len(ids) - 1)), key=lambda x: (x[1][0], x[0]))
            if best[0] == 1 << 60:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _edge(self, token: int, side: int, split_of: dict, never: int) -> list[tuple[int, int]]:
        """The tokens that stand at an edge of ``token`` while it is built, each with the
        rank of the merge that ends its time there."""
        edge, until = [], never
        while True:
            edge.append((token, until))
            pair = split_of.get(token)
            if pair is None:
                return edge
            until = self.rank[pair][0]
            token = pair[side]

    def _test(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border while both tokens are built.

        A crossing pair merges if its rank comes before the merges that would take
        either part away; of equal ranks the leftmost pair merges first.
        """
        rank = self._pair_rank.get
        for x, x_until in self._right[left]:
            for y, y_until in self._left[right]:
                at = rank(x << 20 | y)
                if at is not None and at < x_until and at <= y_until:
                    return False
        return True

    def word(self, word: str) -> list[int]:
        """The ids of one word by the last tokens of its prefixes."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        symbols = raw[:-1] + chr(256 + ord(raw[-1]))
        length, fits = self._length, self._fits
        last = [0] * len(symbols)
        done = -1
        for end, token in self._matches.iter(symbols):
            if end != done:
                before = end - length[token]
                if before < 0 or fits[last[before] << 20 | token]:
                    last[end] = token
                    done = end
        ids, at = [], len(symbols) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """ids (little-endian) of a lower-case run without white space."""
        return self._pieces_of(chunk, (chunk,) if chunk.isascii() and chunk.isalpha() else self._pieces.findall(chunk))

    def _pieces_of(self, chunk: str, words) -> bytes:
        ids: list[int] = []
        for w in words:
            got = self._words.get(w)
            if got is None:
                got = self.word(w)
                if len(w) < 40:
                    if len(self._words) >= _CACHED:
                        self._words.clear()
                    self._words[w] = got
            ids += got
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) < 60:
            if len(self._chunks) >= _CACHED:
                self._chunks.clear()
            self._chunks[chunk] = out
        return out

    def _by_library(self, part: str) -> bytes:
        """For letters newer than this Python's tables: the library says where words end."""
        letters = {c: b for b, c in _byte_letters().items()}
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part))
        words = [bytes(letters[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in split]
        return self._pieces_of(" " * 60, words)

    def encode(self, text: str) -> bytes:
        """ids of a text as little-endian 32-bit integers."""
        ids: list[bytes] = []
        for part in self._split_added.split(text) if self._split_added else [text]:
            if part in self.added:
                ids.append(self.added[part].to_bytes(4, "little"))
                continue
            if _PLAIN.fullmatch(part):
                chunks = part.lower().split()
            else:
                # Letter by letter: a final sigma has no lower case of its own here.
                if any(unicodedata.category(c) == "Cn" for c in set(part)):
                    ids.append(self._by_library(part))
                    continue
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                chunks = [c for c in _SPACE.split(part) if c]
            get, new = self._chunks.get, self._chunk
            ids += [get(c) or new(c) for c in chunks]
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        of = self.text_of
        return " ".join([of[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])

    def forget(self) -> None:
        """Drop what is kept of words and pairs."""
        self._words, self._chunks = {}, {}
        self._fits.clear()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBpe:
    """One encoder per worker and file."""
    return PrefixBpe(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``, the text that
    these ids decode to, of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 256):
                ids = [bpe.encode(t) for t in texts.slice(lo, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, 256), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )
        bpe.forget()
        trimmed()

    return d.mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; digests of both."""
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
