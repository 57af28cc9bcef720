"""Reads public vocabulary files; the files stay where they are, their place is a parameter."""

from __future__ import annotations

import json
from functools import lru_cache

import regex


@lru_cache(maxsize=1)
def byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if b not in set(visible)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_level_encoding(path: str):
    """A tiktoken encoding with the ids of a byte-level BPE file whose ids follow its merge order, which holds for
    the file used here; the file's special tokens are recognised inside texts, as the file's own library does."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    chars = byte_chars()
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    ranks = {bytes(chars[c] for c in word): i for word, i in said["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def word_vocabulary(path: str):
    """Of a BPE file with word ends: symbols of a byte inside and at the end of a word, the merges' pair keys in
    order with rank and result, the base of the keys, the special strings, the pattern of pre-tokens."""
    import numpy as np

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab, end = said["model"]["vocab"], said["model"]["end_of_word_suffix"]
    inner, final = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for c, b in byte_chars().items():
        inner[b], final[b] = vocab[c], vocab[c + end]
    base = max(vocab.values()) + 1
    left = np.array([vocab[a] for a, _ in said["model"]["merges"]], np.int64)
    right = np.array([vocab[b] for _, b in said["model"]["merges"]], np.int64)
    made = np.array([vocab[a + b] for a, b in said["model"]["merges"]], np.int64)
    keys = left * base + right
    order = np.argsort(keys, kind="stable")
    special = [t["content"] for t in said["added_tokens"]]
    pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
    return inner, final, keys[order], order.astype(np.int64), made[order], base, special, regex.compile(pattern)
