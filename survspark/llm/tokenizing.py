"""Token ids from the tokenizers library with a bounded cache of pieces.

A text is cut where the tokenizer always cuts, so the ids of a text are the ids of its pieces one
after the other.  Frequent pieces come from the cache.  New pieces made of Latin letters and simple
punctuation go to the library's BPE model directly, all others through its whole pipeline.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Letters whose class, case and normal form no Unicode version disputes.
_L = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(rf" ?[{_L}]+[.,;:]?(?:\n[{_L}]+[.,;:]?)*")
_PART = re.compile(rf" ?[{_L}]+|[.,;:]|\n")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceCache:
    """``keep_blank``: the tokenizer joins one blank to the word after it (byte-level BPE); otherwise it
    drops white space and lower-cases.  Texts with odd blanks or special-token strings are encoded whole."""

    def __init__(self, path: str, keep_blank: bool, entries: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep_blank, self.entries = keep_blank, entries
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _part(self, part: str) -> bytes:
        part = part if self.keep_blank else part.lower()
        word = part.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def _new(self, piece: str) -> bytes | None:
        """Ids of a piece; None where blanks meet other white space or an edge, as a cut there could change ids."""
        if not _PLAIN.fullmatch(piece):
            word = piece[1:] if piece[:1] == " " else piece
            if self.keep_blank and (not word or word[0].isspace() or word[-1].isspace()):
                return None
            return self._whole(piece)
        out, known = [], self.known
        parts = _PART.findall(piece)
        if len(parts) == 1:
            return self._part(piece)
        for p in parts:
            if p == "\n" and not self.keep_blank:
                continue
            got = known.get(p)
            if got is None:
                known[p] = got = self._part(p)
            out.append(got)
        return b"".join(out)

    def _pieces(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        if not self.keep_blank:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for Python only
                return [p for p in text.replace("\n", " ").split(" ") if p]
            try:  # up to U+00FF lower-casing first changes nothing, and fewer pieces are new
                text.encode("latin-1")
                return text.lower().split()
            except UnicodeEncodeError:
                return text.split()
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without special tokens."""
        pieces = self._pieces(text) if text else []
        if pieces is None:
            return np.frombuffer(self._whole(text), np.uint32)
        known = self.known
        if len(known) >= self.entries:
            self.known = known = dict(list(known.items())[: self.entries // 2])  # the oldest are the frequent ones
        out = list(map(known.get, pieces))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    p = pieces[i]
                    got = known.get(p)
                    if got is None:
                        got = self._new(p)
                        if got is None:
                            return np.frombuffer(self._whole(text), np.uint32)
                        if "\n" not in p:
                            known[p] = got
                    out[i] = got
        return np.frombuffer(b"".join(out), np.uint32)


_caches: dict[tuple[str, bool], PieceCache] = {}


def piece_cache(path: str, keep_blank: bool) -> PieceCache:
    """One cache for each Python worker, kept from task to task."""
    if (path, keep_blank) not in _caches:
        _caches[path, keep_blank] = PieceCache(path, keep_blank)
    return _caches[path, keep_blank]
