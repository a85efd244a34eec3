"""Tokenizer helpers for tasks: each splits a text where no token can cross, and keeps what it found for frequent parts.

The parts repeat (most words do), so the tokenizer itself sees each part once until the store is full. A store is
bounded by its number of entries and starts anew when full, which bounds memory whatever the corpus holds.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache

KEEP = 150_000
#: White space for Python's str.split() and re, but not for the tokenizers.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Store(dict):
    """part -> what ``make`` finds for it, with at most ``keep`` entries. Long parts are not kept."""

    def __init__(self, make, keep: int = KEEP) -> None:
        self.make, self.keep = make, keep

    def __missing__(self, part):
        found = self.make(part)
        if len(part) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[part] = found
        return found


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is printable, else one
    from 256 on, in the order of the bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


def merges_by_rank(vocabulary: dict[str, int], merges: list, suffix: str):
    """word -> ids, by the vocabulary's own merges. A NUL stands for the end of a word: joining it to the last byte ranks
    before all merges, which is what the suffix means; a merge's rank is its place in the list."""
    import tiktoken

    byte = {letter: bytes([b]) for b, letter in byte_letters().items()}
    raw = lambda token: b"".join(byte[x] for x in token.removesuffix(suffix)) + b"\0" * token.endswith(suffix)
    letters = byte_letters()
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
    ids = [vocabulary[letters[b]] for b in range(256)] + [vocabulary[letters[b] + suffix] for b in range(256)]
    for pair in merges:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if ranks.setdefault(raw(a + b), len(ids)) == len(ids):
            ids.append(vocabulary[a + b])
    encode, find = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, ids.__getitem__
    return lambda word: map(find, encode(word + "\0"))


@lru_cache(maxsize=2)
def word_bpe(path: str):
    """text -> little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The vocabulary lower-cases, drops white space before it looks for tokens and never joins letters with other signs, so
    the ids of a text are those of its parts between white space in turn, and those of a word with a comma or full stop
    are the word's and the sign's. Texts where that reading could differ - special tokens, letters whose lower case
    depends on their neighbours, characters to compose - go to the library whole.
    """
    import array
    import json
    import os

    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    with open(path) as file:
        model = json.load(file)
    words = regex.compile(next(x["pattern"]["Regex"] for x in model["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")).findall
    special = ["\0", "\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", "\u0130", *(x["content"] for x in model["added_tokens"])]
    merge = merges_by_rank(model["model"]["vocab"], model["model"]["merges"], model["model"]["end_of_word_suffix"])

    def ids(part: str) -> bytes:
        if part.isalpha():
            return array.array("I", merge(part)).tobytes()
        if part[-1] in ",." and part[:-1].isalpha():
            return find(part[:-1]) + find(part[-1])
        return b"".join(array.array("I", merge(x)).tobytes() for x in words(part))

    find = Store(ids).__getitem__

    def encode(text: str) -> bytes:
        if not (text.isascii() or unicodedata.is_normalized("NFC", text)) or any(x in text for x in special):
            return array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(find, text.lower().split()))

    return encode


@lru_cache(maxsize=4)
def byte_bpe_counter(path: str):
    """text -> number of tokens under the byte-level BPE ranks in ``path``. Parts are a run of white space with what
    follows it; the pre-tokenizer's pattern never joins a part's end with the next one's start."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    store = Store(lambda part: len(encode(part)))
    find, parts = store.__getitem__, re.compile(r"\s*\S+|\s+").findall

    def count(text: str) -> int:
        if ODD_SPACE.search(text):
            return len(encode(text))
        return sum(map(find, parts(text)))

    return count
