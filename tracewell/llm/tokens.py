"""Token ids of whole texts, by the tokenizers library, inside tasks.

Both vocabularies cut a text into pieces before they merge anything, so the ids of a text are those of its pieces in a
row. Pieces are coded by the library's model once and remembered in a bounded table per Python worker. A text of Latin-1
characters is cut as the vocabulary cuts it; any other at white space, and the library cuts the rest. A text that may hold
a special token, or control characters on which Python's and the library's idea of white space differ, goes to the library
whole, so ids are always those of `encode(text, add_special_tokens=False)` of the unchanged tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Most pieces that a worker remembers of each kind; it starts afresh beyond.
REMEMBER = 400_000
_CONTROL = re.compile(r"[\x1c-\x1f]")
_WHOLE = re.compile(r"[\x1c-\x1f]|<\|")  # both vocabularies' special tokens begin with <|
# Letters and numbers of Latin-1, and the contractions that both vocabularies keep apart.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_PIECE = re.compile(rf"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_BYTE_PIECE = re.compile(rf"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_BYTE_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_encoders: dict[tuple[str, str], "Encoder | PieceEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 256)} - {173}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Coded(dict):
    """Ids of pieces, as bytes; a piece is coded when it is first asked for."""

    def __init__(self, code: Callable[[str], list[int]]):
        self.code = code

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = array("I", self.code(piece)).tobytes()
        return ids


class Encoder:
    """Encodes lists of texts to arrays of uint32 ids."""

    def __init__(self, path: str, plain: bool = False):
        """plain: strings of special tokens inside texts are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.lengths = None
        self.by_word = self.library.normalizer is not None  # lower case, white space dropped
        letters, model = byte_letters(), self.library.model
        self.whole = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self.pieces = Coded(lambda piece: [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))])
        self.chunks = Coded(self.whole)

    def _coded(self, text: str) -> bytes:
        if (_CONTROL if self.library.encode_special_tokens else _WHOLE).search(text):
            return np.array(self.whole(text), "<u4").tobytes()
        if text.isascii() or _latin(text):
            cut = _WORD_PIECE.findall(text.lower()) if self.by_word else _BYTE_PIECE.findall(text)
            return b"".join(map(self.pieces.__getitem__, cut))
        return b"".join(map(self.chunks.__getitem__, text.split() if self.by_word else _BYTE_CHUNK.findall(text)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        for table in (self.pieces, self.chunks):
            if len(table) > REMEMBER:
                table.clear()
        return [np.frombuffer(self._coded(t), "<u4") for t in texts]

    def forget(self) -> None:
        """Drop all remembered pieces: a worker that waits for its next task need not hold the last one's."""
        self.pieces.clear()
        self.chunks.clear()

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id, of a byte-level vocabulary."""
        back = {letter: byte for byte, letter in byte_letters().items()}
        return [bytes(map(back.__getitem__, self.library.id_to_token(k))) for k in range(self.library.get_vocab_size())]

    def keeps(self, text: str, ids: np.ndarray) -> bool:
        """Whether the tokens' bytes are the text: a byte-level vocabulary only joins bytes, so none is lost if lengths agree."""
        if self.lengths is None:
            self.lengths = np.array(list(map(len, self.token_bytes())))
        return int(self.lengths[ids].sum()) == len(text.encode())


class PieceEncoder:
    """Ids of texts by a sentencepiece model that adds a space in front.

    Where no piece of the vocabulary has a space after another character, nothing is merged over the beginning of a run of
    spaces, so the ids of a text are those of its parts, cut there; parts are coded by the library once and remembered. With
    any other vocabulary, texts are coded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.vocab_size())]
        self.apart = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.space = pieces.index("\u2581")
        self.cut = re.compile("[ \u2581]+[^ \u2581]*").findall  # both are spaces to the model
        self.parts: dict[str, bytes] = {}
        self.bytes = self.token_bytes()
        self.odd: set[str] = set()  # remembered parts that aren't kept byte for byte

    def _learn(self, parts: set[str]) -> None:
        """Code parts in one call."""
        parts = sorted(parts)
        for part, ids in zip(parts, self.library.encode([p[1:] for p in parts], num_threads=1), strict=True):
            ids = ids or [self.space]  # the model has no id for the space in front of nothing
            self.parts[part] = array("I", ids).tobytes()
            if b"".join(map(self.bytes.__getitem__, ids)) != part.encode():
                self.odd.add(part)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(self.library.encode(t), "<u4") for t in texts]
        if len(self.parts) > REMEMBER:
            self.parts.clear()
            self.odd.clear()
        cuts = [self.cut(" " + t) if t else [] for t in texts]
        self._learn(set().union(*cuts).difference(self.parts))
        return [np.frombuffer(b"".join(map(self.parts.__getitem__, cut)), "<u4") for cut in cuts]

    def keeps(self, text: str, ids: np.ndarray) -> bool:
        """Whether the tokens' bytes are a space and the text. To be asked right after `encode`."""
        if self.apart and (not self.odd or self.odd.isdisjoint(self.cut(" " + text))):
            return True
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == b" " + text.encode()

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: a piece's text, or the byte that it stands for."""
        one = lambda k, piece: bytes([int(piece[3:-1], 16)]) if self.library.is_byte(k) else piece.replace("\u2581", " ").encode()
        return [one(k, self.library.id_to_piece(k)) for k in range(self.library.vocab_size())]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str) -> Encoder:
    return _kept(("", path), lambda: Encoder(path))


def plain_encoder(path: str) -> Encoder | PieceEncoder:
    """The encoder of a vocabulary file, for which special tokens' strings are ordinary text."""
    return _kept(("plain", path), lambda: PieceEncoder(path) if path.endswith(".model") else Encoder(path, plain=True))


def _kept(name: tuple[str, str], make: Callable):
    if name not in _encoders:
        _encoders[name] = make()
    return _encoders[name]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
