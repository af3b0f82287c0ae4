"""Token ids of whole texts by a public word tokenizer, at the speed of its distinct words."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers at most; beyond that it starts afresh.
REMEMBERED = 300_000

_LETTERS = "a-zß-öø-įı-ſ"
#: Words in which lower case, composition and classes of letters can't be in doubt; the others go through the whole tokenizer.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
#: The tokenizer's own split rule, for plain words in lower case.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable bytes as they are, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordIds:
    """Ids of texts. White space always ends a word for this kind of tokenizer, so a text's ids are its words' ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.letters = _byte_letters()
        self.known: dict[str, tuple[int, ...]] = {}

    def _part(self, part: str) -> tuple[int, ...]:
        if (found := self.known.get(part)) is None:
            spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = self.known[part] = tuple(t.id for t in self.merge(spelled))
        return found

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word without ASCII white space."""
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return tuple(self.whole.encode(word, add_special_tokens=False).ids)
        parts = _PARTS.findall(word.lower())
        return self._part(parts[0]) if len(parts) == 1 else tuple(chain.from_iterable(map(self._part, parts)))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (unsigned 32 bits), and the n+1 offsets of the texts in them; null is empty."""
        words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = [self.word(w) if w else () for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = size[which]
        ends = np.cumsum(n)
        at = np.repeat(first[which] - (ends - n), n) + np.arange(int(n.sum()))
        bounds = words.offsets.to_numpy()
        bounds = bounds - bounds[0]
        return flat[at], np.concatenate([[0], ends])[bounds]
