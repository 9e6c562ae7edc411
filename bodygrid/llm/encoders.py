"""Token ids of whole texts with public tokenizer files, inside Python tasks.

The path of the file is a parameter. Word-level vocabularies that drop white space are encoded once per distinct word and
process: a text is then a concatenation of remembered id strings, which is exact because no token spans white space.
"""

from __future__ import annotations

import os
import re
import struct

#: Distinct words a process remembers before it starts afresh; bounds memory, never changes a result.
MEMORY = 1_000_000
#: Latin words and ASCII signs: lower case and composition act on each character alone, so a word can be cut before it is encoded.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The cutting rule of the vocabulary file, for such words after lower-casing.
CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_signs() -> dict[int, str]:
    """Byte-level alphabets write visible Latin-1 bytes as themselves and the others as the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids, as little-endian unsigned 32-bit integers, of a text under a word-level vocabulary with word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.signs = _byte_signs()
        outer = self

        class Words(dict):
            def __missing__(self, word):
                v = self[word] = outer._word(word)
                return v

        class Pieces(dict):
            def __missing__(self, piece):
                mapped = "".join([outer.signs[b] for b in piece.encode()])
                ids = [t.id for t in outer.tokenizer.model.tokenize(mapped)]
                v = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
                return v

        self.words, self.pieces = Words(), Pieces()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self.pieces[p] for p in CUTS.findall(word.lower())])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.words) > MEMORY:
            self.words.clear()
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        words = self.words
        return b"".join([words[w] for w in text.replace("\n", " ").split(" ")])


def counter(path: str):
    """A function text -> number of ids, for any of the public file kinds (.json, .tiktoken, .model)."""
    name = os.path.basename(path)
    if name.startswith("word_bpe"):
        encode = WordEncoder(path)
        return lambda text: len(encode(text)) // 4
    if name.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)
    if name.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(e.encode_ordinary(text or ""))
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(p.encode(text or "", num_threads=1))
    raise ValueError(f"unknown tokenizer file {name}")
