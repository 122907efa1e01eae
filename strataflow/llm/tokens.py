"""Token ids by the tokenizers library, with a cache of white-space separated parts.

A byte-pair encoder never merges across its pre-tokens, and in both public vocabularies a pre-token begins at each
space that follows a character other than white space.  So a text is cut there, each part is encoded once per worker,
and a text's ids are its parts' ids in a row.  Texts in which white space follows white space are cut by a regular
expression, so that runs of white space stay with the part after them.  A part of common characters is cut into
pre-tokens here; those not in the cache go straight to the library's merge model.  Any other part goes through the
whole library.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from collections.abc import Callable
from struct import pack

import numpy as np

from strataflow.llm.common import tokenizer_path, worker_state

#: Parts begin at white space after another character; the characters are white space to every library concerned.
_CUT = re.compile(r"(?<=\S)(?=[ \n\t])")
#: Characters that this module, the regex library and the tokenizers library class alike.
_COMMON = re.compile(r"[\t\n\r -~¡-įĲ-ſ]*")
#: Marks that often end a word.
_MARKS = ".,;:!?)\"'"
#: The pre-token pattern of the byte-level vocabulary; the other vocabulary's stands in its file.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Irregular(ValueError):
    """White space follows white space here, or ends the text."""


#: Bytes that an entry of a table costs beside its part and ids.
_ENTRY = 200


class Parts(dict):
    """Ids by part, found as they are asked for.  Once about most bytes are held, what was met since the last turn stays
    at hand, the rest goes; parts of more than longest characters aren't kept."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 64 << 20, longest: int = 256):
        super().__init__()
        self.encode, self.most, self.longest = encode, most, longest
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, part: str) -> bytes:
        if (known := self.older.pop(part, None)) is None:
            known = self.encode(part)
        if len(part) <= self.longest:
            if self.held >= self.most:
                self.older, self.held = dict(self), 0
                self.clear()
            self[part] = known
            self.held += _ENTRY + len(part) + len(known)
        return known


class Encoder:
    """ids(texts) gives each text's ids as an array of little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, most: int = 64 << 20, longest: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path) as f:
            parsed = json.load(f)
        pre = parsed["pre_tokenizer"]
        #: A text that holds the name of an added token, in capitals or not, goes through the library as a whole.
        self.added = re.compile("|".join(re.escape(x["content"]) for x in parsed["added_tokens"]) or "(?!)", re.IGNORECASE)
        self.lower = pre["type"] == "Sequence"
        self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"] if self.lower else _BYTE_LEVEL)
        #: The letters of all bytes as a decoding table, and that of the space before a part, which the other vocabulary drops.
        self.letters = "".join(byte_letters()[b] for b in range(256))
        self.space = "" if self.lower else self.letters[32]
        #: What every added token's name holds, in capitals or not: a text without it needs no search.
        self.sign = "<|" if all("<|" in x["content"] for x in parsed["added_tokens"]) else ""
        #: Parts that follow a space, without it; and parts as they are.
        self.after = Parts(self._after_space, most, longest)
        self.first = Parts(self._encode, most, longest)

    def _after_space(self, part: str) -> bytes:
        if part.isalpha():
            if (word := self._word(part)) is not None:  # one pre-token with its space
                return self._merge(self.space + word)
        elif not part or part[-1].isspace():
            raise Irregular(part)
        elif (cut := self._cut(part)) is not None:
            return self.after[cut[0]] + b"".join(map(self.first.__getitem__, cut[1:]))
        return self._mixed(" " + part)

    def _encode(self, part: str) -> bytes:
        if part.isalpha():
            if (word := self._word(part)) is not None:
                return self._merge(word)
        elif part[:1] == " " and part[1:].isalpha():
            return self.after[part[1:]]
        elif (cut := self._cut(part)) is not None:
            return b"".join(map(self.first.__getitem__, cut))
        return self._mixed(part)

    def _word(self, part: str) -> str | None:
        """The byte letters of a part of common letters, in the vocabulary's case."""
        if part.isascii():
            return part.lower() if self.lower else part
        if _COMMON.fullmatch(part):
            return charmap_decode((part.lower() if self.lower else part).encode(), "strict", self.letters)[0]

    @staticmethod
    def _cut(part: str) -> tuple[str, ...] | None:
        """What stands before, at and after a line break with no white space beside it, or a word of common letters and the
        marks that end it: pre-tokens never reach across (lower case turns some other letters into a letter and a mark)."""
        if "\n" in part:
            head, _, tail = part.partition("\n")
            if head and tail and not head[-1].isspace() and not tail[0].isspace():
                return head, "\n", tail
        elif (word := part.rstrip(_MARKS)).isalpha() and (word.isascii() or _COMMON.fullmatch(word)):
            return word, part[len(word) :]

    def _mixed(self, part: str) -> bytes:
        if _COMMON.fullmatch(part):
            return b"".join(map(self._piece, self.pattern.findall(part.lower() if self.lower else part)))
        return self._whole(part)

    def _merge(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters)]
        return pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """A pre-token's ids; a word's are looked up and kept."""
        if piece.isalpha():
            return self.first[piece]
        if piece[0] == " " and piece[1:].isalpha():
            return self.after[piece[1:]]
        return self._merge(charmap_decode(piece.encode(), "strict", self.letters)[0])

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _ids(self, text: str) -> bytes:
        if self.sign in text and self.added.search(text):
            return self._whole(text)
        if self.lower and (text.isascii() or _COMMON.fullmatch(text)):
            text = text.lower()
        head, *tail = text.split(" ")
        try:
            if tail and (not head or head[-1].isspace()):
                raise Irregular(text)
            return self.first[head] + b"".join(map(self.after.__getitem__, tail))
        except Irregular:
            return b"".join(map(self.first.__getitem__, _CUT.split(text)))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self._ids(x), "<u4") for x in texts]


def encoder(name: str) -> Encoder:
    """The encoder of this worker process: a later task finds the parts that earlier ones met."""
    return worker_state(("encoder", name), lambda: Encoder(name))
