"""Token ids by the public vocabularies, one array for each text."""

from __future__ import annotations

import base64
import json
import re
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Id behind each document of the byte vocabulary; the ranks leave it free.
BYTE_BPE_END = 50_256


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for
    themselves, the others take the code points from 256 on, in order."""
    prints = [b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """The word vocabulary's ids.

    The library's model merges within words that end in a marker. The same merges run several
    times faster in a byte-pair engine when each word is given with a space behind it and the
    space takes the marker's place (no word holds one). That way is taken for texts of ASCII
    and Latin letters, where lower-casing and splitting are plain; all others, and those that spell
    one of the vocabulary's added tokens, go through the library with its defaults. A test holds
    both to the same ids.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-įıĲ-ɏ]*")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\sa-zß-öø-ɏ0-9]+")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = special = {t["content"] for t in spec["added_tokens"]}
        byte, ranks = _byte_of(), {}
        for entry, rank in spec["model"]["vocab"].items():
            if entry not in special:
                word = entry.removesuffix("</w>")
                ranks[bytes(byte[c] for c in word) + b" " * (word != entry)] = rank
        self.engine = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added) or not self.PLAIN.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        words = self.WORDS.findall(text.lower())
        if not words:
            return np.empty(0, np.uint32)
        return self.engine.encode_to_numpy(" ".join(words) + " ", disallowed_special=())


class ByteBpe:
    """The byte vocabulary's ids. It has no added tokens: a text that spells one is plain text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.engine = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


@cache
def tokenizer(name: str):
    """The tokenizer of a vocabulary file's name or path; loaded once in a process."""
    path = name if "/" in name else public_tokenizers.path(name)
    return (WordBpe if str(path).endswith(".json") else ByteBpe)(str(path))
