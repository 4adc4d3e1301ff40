"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.session import spread

#: Where the rank file of the tokenizer lies; every executor must be able to read it.
TOKENIZER = os.environ.get("SEAMARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the splitting pattern that belongs to the rank file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of one kind of character longer than this are split before encoding, which bounds the time a text takes.
LONGEST_RUN = 20_000

_LOADED: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of the whole text; 0 for null and empty ones."""
    if not text:
        return 0
    enc = encoder(path)
    if len(text) <= LONGEST_RUN:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + LONGEST_RUN)
        if end < len(text):
            # a space between two letters begins a token of its own: cutting there changes no count
            cut = end
            while cut > at and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
                cut -= 1
            end = cut if cut > at else end
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def with_token_counts(docs: DataFrame, text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Replaces ``text_col`` by ``n_tokens`` and ``text_hash`` (SHA-256; null texts hash as empty ones)."""
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "text_hash")]
    kinds = dict(docs.dtypes)
    # whole numbers pass as text: in batches with nulls, pandas would turn them into floats
    whole = [c for c in rest if kinds[c] in ("bigint", "int", "smallint", "tinyint")]
    cols = [F.col(f"`{c}`").cast("string").alias(c) if c in whole else F.col(f"`{c}`") for c in rest]
    src = docs.select(*cols, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_h"), F.col(text_col).alias("_t"))
    schema = src.select(*rest).withColumn("n_tokens", F.lit(0).cast("long")).withColumn("text_hash", F.lit(b"")).schema

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["n_tokens"] = [count_tokens(t, path) for t in b.pop("_t")]
            b["text_hash"] = [bytes.fromhex(h) for h in b.pop("_h")]
            yield b

    return spread(src).mapInPandas(sized, schema).withColumns({c: F.col(c).cast(kinds[c]) for c in whole})
