"""Token ids by the tokenizers library, with each distinct piece between spaces encoded once.

Both vocabularies split a text into pre-tokens before BPE, and BPE never
crosses a pre-token. A text may hence be cut at a space and the parts encoded
apart, where the cut can't change the pre-tokens:

* byte-level vocabulary: a single space between two non-white characters
  starts the pre-token that follows it. Where white space meets white space,
  the parts are joined again before they are encoded.
* word vocabulary: white space never belongs to a pre-token, so every space is
  a cut.

Added tokens (such as an end mark written out in a text) are found in the raw
text before all else, and what is between them is encoded apart, as the library
does; a vocabulary whose added tokens have other rules (normalised, stripped or
single words) goes through the library's whole encode.

A part of plain Latin letters, digits and ASCII signs is split by the
vocabulary's own pattern and its pre-tokens go to the library's BPE model; any
other part goes through the library's whole encode. Memos are of bounded size.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

from fieldlens.llm.support import keeps

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose class, case and normal form are the same in every Unicode version; on these, the patterns with their letters spelled out say the same.
PLAIN = re.compile(r"[ \n!-~À-ÖØ-Ýß-öø-ÿ]*")
LETTERS = "A-Za-zÀ-ÖØ-Ýß-öø-ÿ"
#: Entries of the memos of parts and of pre-tokens; a full memo is emptied.
MEMO, TOKEN_MEMO = 650_000, 100_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Memo from a part of a text to its ids as little-endian 32-bit words."""

    def __init__(self, path: str, lead: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = self.tokenizer.normalizer is not None
        self.pattern = re.compile((WORD_PATTERN if self.words else BYTE_PATTERN).replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}0-9]").replace(r"[\p{L}]", f"[{LETTERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "[0-9]"))
        self.letters = [byte_letters()[b] for b in range(256)]
        self.ascii = {b: self.letters[b] for b in range(128)}
        self.lead = lead
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text):
            return self.whole(text)
        out = []
        for t in self.pattern.findall(text.lower() if self.words else text):
            if (b := self.memo.get(t)) is None:
                if len(self.memo) >= TOKEN_MEMO:
                    self.memo.clear()
                self.memo[t] = b = self.bpe(t)
            out.append(b)
        return b"".join(out)

    def bpe(self, token: str) -> bytes:
        """By the library's BPE model, for one pre-token."""
        units = token.translate(self.ascii) if token.isascii() else "".join([self.letters[x] for x in token.encode()])
        return array("I", [x.id for x in self.model.tokenize(units)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not self.words and (not piece or edge(piece[0]) or edge(piece[-1])):
            raise KeyError(piece)
        if len(self) >= MEMO:
            self.clear()
        if piece.isalpha() and (piece.isascii() or PLAIN.fullmatch(piece)):  # one pre-token
            out = self.bpe(piece.lower() if self.words else self.lead + piece)
        else:
            out = self.part(self.lead + piece)
        self[piece] = out
        return out


def edge(c: str) -> bool:
    """Whether a character may count as white space."""
    return c.isspace() or c == "᠎"


@functools.lru_cache(2)
def text_encoder(path: str, added: bool = True) -> TextEncoder:
    """The encoder of a worker process, which its later tasks use again."""
    return TextEncoder(path, added)


keeps("tokenize", text_encoder.cache_clear)


class TextEncoder:
    """Ids of whole texts, as 32-bit words in the machine's (little-endian) order.

    added: whether added tokens that a text spells out get their ids, which is
    the library's default; otherwise they are ordinary text.
    """

    def __init__(self, path: str, added: bool = True):
        self.rest = Pieces(path, " ")
        self.words = self.rest.words
        self.rest.lead = "" if self.words else " "
        self.rest.tokenizer.encode_special_tokens = not added
        known = self.rest.tokenizer.get_added_tokens_decoder() if added else {}
        self.usual = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in known.values())
        self.added = {t.content: Pieces.pack([i]) for i, t in known.items()}
        self.border = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))

    def encode(self, text: str) -> bytes:
        if not any(map(text.__contains__, self.added)):
            return self.between(text)
        if not self.usual:
            return self.rest.whole(text)
        out, at = [], 0
        for m in self.border.finditer(text):
            out += [self.between(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self.between(text[at:])])

    def between(self, text: str) -> bytes:
        """Of a text without added tokens."""
        if not text:
            return b""
        head, _, tail = text.partition(" ")
        try:
            if self.words:
                if text.isascii():  # of one case, its words are fewer
                    text = text.lower()
                return b"".join(map(self.rest.__getitem__, text.split(" ")))
            if head and not edge(head[-1]):
                first = self.rest.part(head)
                return first + b"".join(map(self.rest.__getitem__, tail.split(" "))) if tail or text[-1] == " " else first
        except KeyError:
            pass
        return self.joined(text)

    def joined(self, text: str) -> bytes:
        """Parts between safe cuts: a space with non-white characters on both sides."""
        out, pieces, start = [], text.split(" "), 0
        for i in range(1, len(pieces) + 1):
            a = pieces[i - 1]
            if i < len(pieces) and (not a or edge(a[-1]) or not pieces[i] or edge(pieces[i][0])):
                continue
            part = " ".join(pieces[start:i])
            out.append(self.rest.part(f" {part}" if start else part))
            start = i
        return b"".join(out)
