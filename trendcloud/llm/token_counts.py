"""Token counts without token ids, for a byte-level BPE tokenizer in the tokenizers library's format.

Most pre-tokens of a text are a single token. Which strings of the vocabulary
encode alone as that one token is proved once, on the driver, by encoding all of
them (the vocabulary bounds the work). Tasks count matching pre-tokens directly
and merge only the rest; a task remembers what it has merged, within a bound.
Nothing is shuffled and the texts are read once.

Texts are cut into pre-tokens here, and the library's own tables of characters may
be of another Unicode version. Every character that the two cut differently is found
once, on the driver; a text that holds one is counted by the library as a whole.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from trendcloud.llm.common import bounded_batches, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Merged pre-tokens that a task remembers before it forgets all of them.
REMEMBERED = 1 << 20

#: Fixed: how a byte-level pre-tokenizer splits text (the public pattern of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


def special_strings(spec: dict) -> list[str]:
    """Strings that are one token wherever they stand in a text."""
    added = spec.get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that strip or normalise their surroundings are not supported")
    return [t["content"] for t in added]


def whole_tokens(tokenizer_json: str) -> list[str]:
    """Strings of the vocabulary that, as a pre-token, encode to themselves alone."""
    spec = json.loads(tokenizer_json)
    split = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
        raise ValueError("only byte-level tokenizers without normalizer and prefix space")
    tokenizer = Tokenizer.from_str(tokenizer_json)
    special = set(special_strings(spec))
    byte_of = {letter: b for b, letter in byte_letters().items()}
    texts = []
    for token in spec["model"]["vocab"]:
        try:
            text = bytes(byte_of[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: no pre-token can be this
        if not any(s in text for s in special):
            texts.append((token, text))
    pattern, vocab = regex.compile(PATTERN), spec["model"]["vocab"]
    encoded = tokenizer.encode_batch([text for _, text in texts], add_special_tokens=False)
    return [
        text
        for (token, text), e in zip(texts, encoded, strict=True)
        if e.ids == [vocab[token]] and pattern.fullmatch(text)
    ]


@lru_cache(maxsize=4)
def odd_characters(tokenizer_json: str) -> str:
    """All characters that the library's pre-tokenizer and `PATTERN` do not treat alike.

    The pattern tells letters, numbers, white space and others apart and nothing
    else, so it is enough to see each character between letters, numbers and others.
    """
    split = Tokenizer.from_str(tokenizer_json).pre_tokenizer.pre_tokenize_str
    find = regex.compile(PATTERN).finditer
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd: set[str] = set()
    for at in range(0, len(every), 1 << 14):
        chars = list(map(chr, every[at : at + (1 << 14)]))
        for kind in ("a", "1", "!"):
            text = kind + kind.join(chars) + kind
            ours, theirs = np.zeros(len(text) + 1, bool), np.zeros(len(text) + 1, bool)
            ours[[m.start() for m in find(text)]] = True
            theirs[[begin for _, (begin, _) in split(text)]] = True
            differ = np.flatnonzero(ours != theirs)
            # A character stands at every odd place; a cut before or behind it is due to it.
            for place in np.unique(np.concatenate([differ, differ - 1])).tolist():
                if place % 2 == 1 and place < len(text):
                    odd.add(text[place])
    return "".join(sorted(odd))


def token_counts(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row.

    Special strings inside a text are one token each, as is the library's
    default; none is added. Null and empty texts have 0 bytes and 0 tokens, null
    ids and repeated rows are kept, other columns are left out. Texts of any
    length are read whole.
    """
    bounded_batches(docs.sparkSession)
    whole = whole_tokens(tokenizer_json)
    odd = odd_characters(tokenizer_json)
    special = sorted(special_strings(json.loads(tokenizer_json)), key=len, reverse=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(tokenizer_json)
        find = regex.compile(PATTERN).findall
        cut = regex.compile("|".join(map(regex.escape, special))).split if special else None
        is_odd = np.zeros(0x110000, bool)
        is_odd[[ord(c) for c in odd]] = True
        tokens = dict.fromkeys(whole, 1)
        for batch in pieces(batches, 128):
            if len(tokens) > len(whole) + REMEMBERED:
                tokens = dict.fromkeys(whole, 1)
            bytes_, specials, words = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                if not text.isascii() and is_odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
                    specials.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
                    words.append([])
                    continue
                parts = cut(text) if cut else [text]
                specials.append(len(parts) - 1)
                words.append([w for p in parts for w in find(p)] if len(parts) > 1 else find(text))
            rest = list(set().union(*words) - tokens.keys())
            merged = tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            tokens.update(zip(rest, map(len, merged), strict=True))
            totals = [s + sum(map(tokens.__getitem__, w)) for s, w in zip(specials, words, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(totals, np.int64))],
                names=["id", "n_bytes", "n_tokens"],
            )

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), n_bytes.alias("n_bytes"))
    schema = T.StructType(
        [chosen.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    return chosen.mapInArrow(count, schema).withColumnRenamed("id", id_col)
