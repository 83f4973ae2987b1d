"""Token ids of whole texts with a vocabulary file of a public tokenizer."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import regex

#: Texts of these characters keep their code points under NFC and lower-casing, and white space
#: means the same to Python as to the tokenizer. Others go through the tokenizer itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-įı-ɏ]*")
#: Memory for remembered words, per worker process.
KEPT_BYTES = 48 << 20
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PRE_TOKENIZERS = ["Split", "ByteLevel"]


def vocabulary_path(name: str) -> str:
    """The file of a public vocabulary, or the path itself where one is given."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes that an entry of a dictionary takes besides its text and ids: slot, headers, rounding.
_ENTRY = 200


class _Kept(dict):
    """Remembers what it has made, up to a number of bytes; what is met first is met often."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.left = make, limit

    def __missing__(self, key):
        value = self.make(key)
        size = _ENTRY + 2 * len(key) + len(value)
        if size <= self.left:
            self.left -= size
            self[key] = value
        return value


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode``.

    A vocabulary whose words never cross white space is encoded word by word, each distinct word
    once as long as ``kept`` bytes last. Any other vocabulary or unusual text is encoded whole.
    """

    def __init__(self, vocabulary: str, kept: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        told = json.loads(self.tokenizer.to_str())
        names = [
            [step["type"] for step in (told.get(part) or {}).get(key, [])]
            for part, key in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
        ]
        self.by_word = names == [_NORMALIZERS, _PRE_TOKENIZERS]
        self.special = [token["content"] for token in told.get("added_tokens", [])]
        if self.by_word:
            self.pattern = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.bytes = self._byte_table()
            self.words = _Kept(self._word, kept // 3)
            self.chunks = _Kept(self._chunk, kept - kept // 3)

    @staticmethod
    def _byte_table() -> dict[int, str]:
        """Byte-level vocabularies write printable bytes as themselves, the rest from 256 on."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        return {code: "".join(byte[b] for b in chr(code).encode()) for code in range(0x250)}

    def _word(self, word: str) -> bytes:
        return array("I", [token.id for token in self.tokenizer.model.tokenize(word.translate(self.bytes))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        return b"".join([self.words[word] for word in self.pattern.findall(chunk)])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_word and _PLAIN.fullmatch(text) and not any(token in text for token in self.special):
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process; its tasks share what it remembers."""
    return Encoder(vocabulary)
