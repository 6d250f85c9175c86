"""Token ids of texts by the ``tokenizers`` library, with repeated words encoded once a worker.

Byte-level BPE merges never cross the borders that its splitting pattern sets,
so the ids of a text are those of its words in a row. Words follow a steep
frequency law: a bounded cache holds the ids of the common ones, and only
unseen words reach the tokenizer's model.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: The splitting pattern of byte-level BPE, for texts of the letters below only.
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters for which the classes of ``re`` and those of the tokenizer's pattern are alike.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0\xa1\xa7-\xb1\xb4-\xb8\xbb\xbf-ɏ]")
#: Marks and white space beyond ASCII: such texts are split by the pattern.
_MARKS = re.compile("[\xa0-\xbf\xd7\xf7]")
#: Bytes by kind: a for letters and digits, ! for marks, . for stops and commas, white space as it is or as a tab.
_KINDS = bytes(
    ord("a") if chr(b).isalnum() or b > 127 else b if b in b" \n." else ord(".") if b == ord(",") else ord("\t") if b < 33 else ord("!")
    for b in range(256)
)
#: White space in a row, or stops and commas that touch other marks or follow white space: likewise.
_RUNS = (b"\t", b"  ", b" \n", b"\n ", b"\n\n", b"..", b"!.", b".!", b" .", b"\n.")
#: Entries of a cache generation; two generations live at once.
CACHE_WORDS = 400_000


def _byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}


class _Cache(dict):
    """Two generations: a word found in the old one moves to the young one, the rest goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """``encode(text)`` equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code, self.dtype = ("I", np.uint32) if wide else ("H", np.uint16)
        self.plain = (
            isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
            and not self.tokenizer.pre_tokenizer.add_prefix_space
            and self.tokenizer.normalizer is None
            and self.tokenizer.post_processor is None
        )
        self.alphabet = _byte_alphabet()
        self.words = _Cache(self._ids)

    def _ids(self, chunk: str) -> bytes:
        words = _WORDS.findall(chunk)
        if len(words) > 1:
            return b"".join(map(self.words.__getitem__, words))
        spelled = chunk if chunk.isascii() else chunk.encode().decode("latin1")
        return array(self.code, [t.id for t in self.model.tokenize(spelled.translate(self.alphabet))]).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return np.empty(0, np.uint32)
        if not self.plain or _OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        kinds = text.encode().translate(_KINDS)
        if any(run in kinds for run in _RUNS) or text[-1] in " \n" or not text.isascii() and _MARKS.search(text):
            parts = _WORDS.findall(text)
        else:  # a lone space starts a word, a lone line end is a word, a lone stop or comma is a word
            for mark, split in ((" ", "\0 "), ("\n", "\0\n\0"), (".", "\0."), (",", "\0,")):
                text = text.replace(mark, split)
            parts = text.split("\0")
        return np.frombuffer(b"".join(map(self.words.__getitem__, parts)), self.dtype).astype(np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder a worker process; the default vocabulary is found on the executor itself."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
