"""Token ids of whole texts, with a memory of pieces.

A byte-level BPE never merges across a blank that stands alone between two words (the blank
starts the next piece), across a line feed that does, or between letters and the signs after
them.  So a text is cut at such places, each distinct piece goes through the tokenizers
library once per worker while it is remembered, and the ids of a text are its pieces' ids in
a row.  A text that holds the content of an added token goes through the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import regex
from tokenizers import Tokenizer

#: A blank between two characters that are no white space.
_CUT = regex.compile(r" (?<=\S )(?=\S)")
#: Letters below this are letters in every version of the tables of characters.
_LATIN_END = "\u0250"
#: Letters, and signs after them.
_SIGNED = regex.compile(r"(\n?\p{L}+)([^\s\p{L}\p{N}]+)")
#: Pieces of a generation of the memory, and letters of a piece worth keeping.
REMEMBERED = 500_000
LONG = 100


def _byte_letters() -> dict[str, str]:
    """How a byte-level BPE writes bytes: printable ones as they are, the others as the letters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(others)})


def _latin(piece: str) -> bool:
    return piece.isalpha() and (piece.isascii() or max(piece) < _LATIN_END)


class Memory(dict):
    """Ids by piece, learnt when first asked for; those of the generation before are taken over."""

    def __init__(self, learn, before: dict[str, bytes]):
        super().__init__()
        self.learn, self.before = learn, before

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids; one per Python worker.

    ``of`` gives the ids of the library at its defaults, where the content of an added token is that
    token; with ``as_text`` it is read like other text.  A remembered piece has a blank before it unless it starts with a line feed.
    """

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str, as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        added = [] if as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.library = Tokenizer.from_file(path) if added else self.tokenizer
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = [i.to_bytes(4, "little") for i in range(self.size)]
        self.line = self.plain("\n")
        self.memory = Memory(self._piece, {})
        self.signs: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path, as_text=False)
        return cls._own[path]

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, lead: str, word: str) -> bytes:
        """The ids of Latin letters after a blank or none: one piece to the merges, which it is given to at once."""
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        own = self.bytes
        return b"".join([own[t.id] for t in self.model.tokenize(lead + written)])

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece between blanks; a KeyError for one that may depend on what stands around it."""
        if _latin(piece):
            return self._word("Ġ", piece)
        if m := _SIGNED.fullmatch(piece):
            return self.memory[m[1]] + self._signs(m[2])
        if piece[:1] != "\n":
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise KeyError(piece)
            return self.plain(" " + piece)
        body = piece[1:]
        if not body or body[0].isspace() or body[-1].isspace():
            raise KeyError(piece)
        return self.line + self._word("", body) if _latin(body) else self.plain(piece)

    def _signs(self, signs: str) -> bytes:
        if signs not in self.signs:
            if len(self.signs) > REMEMBERED:
                self.signs.clear()
            self.signs[signs] = self.plain(signs)
        return self.signs[signs]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.added is None:
            return self._encode(texts)
        whole = [self.added.search(t) is not None for t in texts]
        others = iter(self._encode([t for t, w in zip(texts, whole) if not w]))
        return [self._whole(t) if w else next(others) for t, w in zip(texts, whole)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memory) > REMEMBERED:
            self.memory.before = {}
            self.memory = Memory(self._piece, self.memory)
        ids, out = self.memory.__getitem__, []
        for text in texts:
            first, *pieces = text.replace("\n", " \n").split(" ")
            try:
                if first[-1:].isspace() or (not first and pieces):
                    out.append(self._loose(text))
                else:
                    out.append((self.plain(first) if first else b"") + b"".join(map(ids, pieces)))
            except KeyError:
                out.append(self._loose(text))
        return out

    def _loose(self, text: str) -> bytes:
        first, *rest = _CUT.split(text)
        return self.plain(first) + b"".join([
            (None if p.startswith("\n") else self.memory.get(p)) or self.plain(" " + p) for p in rest
        ])
