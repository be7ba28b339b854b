"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens; pre-tokens not met before by this worker are merged together as
one ragged numpy array (``ragged.merge_all``) and the surviving symbols counted. The counts stay
in a table of the worker that is emptied when it holds ``MEMO`` entries.

Defined results: a null text is empty and has no tokens; very long texts are counted whole, cut into parts at pre-tokens; rows are independent, so ties, repeated
rows and empty tables need no rule; columns other than those named are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memo, table
from .ragged import PairTable, merge_all, merge_one

MEMO = 500_000
#: Texts of more code points are cut lazily, so that their pre-tokens are never all held.
LONG = 1 << 20
CHUNK_BYTES = 1 << 18
#: Pre-tokens that may wait to be merged together.
MISSED = 200_000
#: The vocabulary's pre-token pattern, as its format defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose class is the same in every Unicode version since 9.0. Texts with others are
#: cut by the library's own pre-tokenizer, whose Unicode tables may be of another version.
SETTLED = "\x00-՗Ḁ-₎₠-₽℀-⮹　-〿ぁ-ゖ゙-ヿ一-鿕가-힣！-ﾾ\U0001f300-\U0001f64f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Counter(dict):
    """Pre-token -> number of tokens; what is missing is noted and counts 0 for now."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.table = PairTable({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pattern, self.odd = regex.compile(PATTERN), regex.compile(f"[^{SETTLED}]")
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.missed: list[str] = []

    def __missing__(self, token: str) -> int:
        self.missed.append(token)
        return 0

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if self.odd.search(text):
            yield [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        elif len(text) < LONG:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while part := list(islice(found, 100_000)):
                yield part

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        owners: list[tuple[int, int]] = []  # text, and how many missed pre-tokens there are up to it
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self.cut_special.split(text)
            total = len(parts) - 1
            for part in parts:
                for tokens in self._pieces(part):
                    total += sum(map(self.__getitem__, tokens))
            out[i] += total
            if len(self.missed) > (owners[-1][1] if owners else 0):
                owners.append((i, len(self.missed)))
            if len(self.missed) > MISSED:
                self._learn(out, owners)
        self._learn(out, owners)
        return out

    def _learn(self, out: np.ndarray, owners: list[tuple[int, int]]) -> None:
        """Counts what was missed, keeps it, and adds it to the totals of the texts it is from."""
        missed, self.missed = self.missed, []
        if not missed:
            return
        if len(self) > MEMO:
            self.clear()
        fresh = list({t for t in missed if t not in self})
        at = 0
        while at < len(fresh):
            took, size = at, 0
            words = []
            while took < len(fresh) and size < CHUNK_BYTES:
                words.append(fresh[took].encode())
                size += len(words[-1])
                took += 1
            self.update(zip(fresh[at:took], self.merged(words).tolist(), strict=True))
            at = took
        sums = np.append(0, np.cumsum(np.fromiter(map(self.__getitem__, missed), np.int64, len(missed))))
        texts, ends = np.array(owners, np.int64).T
        np.add.at(out, texts, sums[ends] - sums[np.append(0, ends[:-1])])
        owners.clear()

    def merged(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        _, counts, odd = merge_all(symbols, lengths, self.table)
        for i in np.flatnonzero(odd):
            counts[i] = len(merge_one(self.byte_ids[np.frombuffer(words[i], np.uint8)].tolist(), self.table))
        return counts


def counter(path: str) -> Counter:
    return memo(f"tokens of {path}", lambda: Counter(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_bytes and n_tokens of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = count.counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
