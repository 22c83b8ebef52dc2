"""Token counts of whole texts under a byte-level BPE vocabulary file.

A text is cut at the special string, which counts as one token, and then into
pre-tokens; a pre-token's tokens don't depend on what stands around it. Lengths of the
corpus' frequent pre-tokens are broadcast as a hash table of at most TABLE_ROWS rows.
Other pre-tokens are encoded by the library once per worker, which keeps up to
CACHE_ROWS of their lengths; those of over LONGEST characters are in neither. No
pre-token is shuffled but for a summary of counts from each task, which together choose
the table over all texts, and that choice changes no result.

The library and the pattern here know characters by different versions of Unicode. Each
worker tries every character that it meets in both once; a text with one that they cut
differently goes to the library whole.

Null text: empty, 0 tokens. Null doc_id: handled as any row. Repeated rows: each is
counted. Ties for the table go by code points. Very long texts: whole, a bounded number
of pre-tokens at once. Empty table: empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import documents

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Rows of the table, and characters of a pre-token that table or cache holds, at most.
TABLE_ROWS, LONGEST = 1 << 15, 64
#: Characters that are counted at once; a pre-token across the edge counts as two, for the table only.
PIECE = 1 << 20
#: Lengths that one worker keeps; beyond that it begins anew.
CACHE_ROWS = 1 << 19
#: Fixed values of the vocabulary: its pre-token pattern and its special string.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
_CONTROL = regex.compile(r"[\x1c-\x1f]")
_PRE_TOKENS = regex.compile(PATTERN)
_state: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def _library(path: str):
    if path not in _state:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _state[path] = Tokenizer.from_file(path)
    return _state[path]


def doubtful(library, characters: set[str]) -> set[str]:
    """Those that the library may cut in another way than PATTERN.

    Each stands between a letter, a digit, a mark and a space, which shows its kind by
    what it is joined with.
    """
    held = sorted(characters)
    text = "".join(f"a{c}1{c}.{c} " for c in held)
    here = {m.start() for m in _PRE_TOKENS.finditer(text)}
    there = {start for _, (start, _) in library.pre_tokenizer.pre_tokenize_str(text)}
    return {held[at // 7] for at in here ^ there}


class Lengths:
    """Lengths of pre-tokens: the broadcast table, this worker's cache, then the library."""

    def __init__(self, path: str, table: dict[str, int]):
        self.library, self.table, self.kept = _library(path), table, {}
        self.tried, self.doubtful = set(map(chr, range(128))), set("\x1c\x1d\x1e\x1f")

    def beyond(self, text: str) -> bool:
        """Whether the text has a character that the library may cut differently."""
        if text.isascii():
            return _CONTROL.search(text) is not None
        held = set(text)
        if new := held - self.tried:
            self.tried |= new
            self.doubtful |= doubtful(self.library, new)
        return not held.isdisjoint(self.doubtful)

    def lengths(self, found: set[str]) -> dict[str, int]:
        out = {x: n for x in found if (n := self.table.get(x) or self.kept.get(x))}
        new = [x for x in found if x not in out]
        if len(self.kept) + len(new) > CACHE_ROWS:
            self.kept = {}
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            got = dict(zip(part, map(len, self.library.encode_batch(part, add_special_tokens=False)), strict=True))
            out |= got
            self.kept |= {x: n for x, n in got.items() if len(x) <= LONGEST}
        return out

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole, cut = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.beyond(text):
                whole.append(i)
                continue
            parts = text.split(SPECIAL)
            out[i] = len(parts) - 1
            cut.extend((i, part) for part in parts if part)
        for i in whole:
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False))
        # a bounded number of pre-tokens at once
        at, held, size = [], [], 0
        for k, (i, part) in enumerate(cut):
            at.append(i)
            held.append(_PRE_TOKENS.findall(part))
            size += len(part)
            if size > 1 << 19 or k == len(cut) - 1:
                lengths = self.lengths(set().union(*held))
                for i_, tokens in zip(at, held, strict=True):
                    out[i_] += sum(map(lengths.__getitem__, tokens))
                at, held, size = [], [], 0
        return out


def _summary(seen: Counter, rows: int) -> Counter:
    """Counts of at most so many: the largest, less the first that is left out, as Misra and Gries bound a stream."""
    if len(seen) <= rows:
        return seen
    n = np.fromiter(seen.values(), np.int64, len(seen))
    out = int(np.partition(n, -rows - 1)[-rows - 1])
    return Counter({t: n - out for t, n in seen.items() if n > out})


def frequent(docs: DataFrame, path: str, top: int = TABLE_ROWS) -> dict[str, int]:
    """Token lengths of the most frequent short pre-tokens of all texts.

    A task sends one summary of at most `top` counts, so what is shuffled grows with the
    tasks, not with the pre-tokens.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in (text or "").split(SPECIAL):
                    for i in range(0, len(part), PIECE):
                        seen.update(_PRE_TOKENS.findall(part, i, i + PIECE))
                        if len(seen) > CACHE_ROWS:
                            seen = _summary(seen, CACHE_ROWS // 2)
        seen = _summary(Counter({t: n for t, n in seen.items() if len(t) <= LONGEST}), top)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])

    counts = docs.select("text").mapInArrow(of, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
    best = [r.t for r in counts.where("n > 1").orderBy(F.desc("n"), "t").limit(top).collect()]
    library = _library(path)
    return {t: len(e) for t, e in zip(best, library.encode_batch(best, add_special_tokens=False), strict=True)}


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row."""
    path = path or vocabulary_path()
    # at most TABLE_ROWS strings of LONGEST characters
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, table.id if hasattr(table, "id") else 0)
        if key not in _state:
            _state[key] = Lengths(path, table.value)
        counter = _state[key]
        for batch in batches:
            texts = batch.column("text__").to_pylist()
            tokens = np.array(counter(texts), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias("text__"))
    return narrow.mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(documents(spark, sf_dir))
