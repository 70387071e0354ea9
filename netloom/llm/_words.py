"""Splitting text into the pretokens of a word-level BPE file, with the library's own normaliser where the fast rule does not reach."""

from __future__ import annotations

import os
from functools import lru_cache

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: The tokenizer file's two special strings, and its split pattern restricted to code points below U+0250.
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
BEYOND = regex.compile(r"[^\x00-ɏ]")
HARD = regex.compile(r"[^\x00-\x1b\x20-ɏ]|<\|")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_pieces(text: str, path: str) -> list[str]:
    """Pretokens of text without special strings."""
    if BEYOND.search(text) is None:
        return SPLIT.findall(text.lower())
    t = library(path)
    chars = byte_of_char()
    split = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
    return [bytes(chars[c] for c in piece).decode("utf-8") for piece, _ in split]


def pieces(text: str, path: str) -> list[str]:
    """Pretokens in order; a special string is one piece, with its mark <|...|> kept."""
    if "<|" not in text:
        return plain_pieces(text, path)
    out, at = [], 0
    for m in SPECIAL.finditer(text):
        out += plain_pieces(text[at : m.start()], path)
        out.append(m.group())
        at = m.end()
    return out + plain_pieces(text[at:], path)


def units(text: str) -> list[str] | None:
    """Lower-cased runs between white space, which no pretoken crosses; None for a text that needs the library's normaliser,
    holds a special string's mark, or a separator that only Python takes for white space."""
    return None if HARD.search(text) else text.lower().split()
