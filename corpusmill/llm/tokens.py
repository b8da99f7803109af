"""Token ids of a public `tokenizers` vocabulary, with the pieces of words kept in a bounded memory.

`WordEncoder` gives the same ids as `Tokenizer.encode(text, add_special_tokens=False)`. For the vocabulary with word
ends (lower case, white space dropped, pieces by a regular expression) texts of plain Latin characters are split
here and each distinct piece meets the model once; any other text goes through the library, word by word.
"""

from __future__ import annotations

import re

import numpy as np

#: Characters whose normal form, lower case and class (letter, digit, other) this module and the library agree on.
_LETTERS = r"a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = re.compile(r"[\x21-\x7e \t\n\rÀ-ÖØ-öø-įı-ɏ]*")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_chars() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordEncoder:
    def __init__(self, vocabulary: str = "word_bpe_49k.json", most: int = 400_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.most, self.pieces, self.chunks = most, {}, {}
        self.split_here = vocabulary.rpartition("/")[2] == "word_bpe_49k.json"
        self.bytes = _byte_chars()

    def _model(self, piece: str) -> bytes:
        tokens = self.tokenizer.model.tokenize("".join(map(self.bytes.__getitem__, piece.encode())))
        return np.array([t.id for t in tokens], self.kind).tobytes()

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _joined(self, parts: list[str], known: dict[str, bytes], encode) -> bytes:
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for p in set(parts).difference(known):
                known[p] = encode(p)
            return b"".join(map(known.__getitem__, parts))

    def encode(self, text: str) -> np.ndarray:
        if not self.split_here or _ODD_SPACE.search(text):
            return np.frombuffer(self._library(text), self.kind)
        if "<|" not in text and _PLAIN.fullmatch(text):
            return np.frombuffer(self._joined(_PIECES.findall(text.lower()), self.pieces, self._model), self.kind)
        return np.frombuffer(self._joined(text.split(), self.chunks, self._library), self.kind)
