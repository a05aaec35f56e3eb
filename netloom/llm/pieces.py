"""BPE of single pieces of text, for the operators that compile tokenizers.

A tokenizers file is a normaliser, a pre-tokenizer and BPE.  All of it is local
to a piece that the caller has cut at white space, so a text is the
concatenation of its pieces' encodings.  Pieces of ASCII and Latin-1 letters are
pre-tokenized here and each pre-token goes to the library's BPE model; every
other piece goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

# The two pre-tokenizer patterns for which a piece is cut here.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACES = " \\t-\\r"
_LIKE_LEADING_SPACE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACES}{_LETTERS}0-9]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LIKE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_SPACES}{_LETTERS}0-9]+")
_PLAIN = re.compile(f"[\\x00-\\x7f{_LETTERS}]*\\Z")
_VISIBLE = re.compile(r"[!-~]*\Z")


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for
    itself, the other bytes take the code points from 256 on, in order."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(itself)]
    return {b: chr(b) for b in itself} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceBPE:
    """Ids of pieces; pre-tokens met before are held, ``max_held`` at most."""

    def __init__(self, path: str, max_held: int = 1_200_000, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        norm, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
        parts = pre.get("pretokenizers", [pre])
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [norm] if norm else [])]
        self.lower = "Lowercase" in kinds
        self.pattern = None
        if not kinds and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not parts[0].get("add_prefix_space"):
            self.pattern = _LIKE_LEADING_SPACE
        elif kinds == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("pattern") == {"Regex": _SPLIT} and parts[0].get("invert") and not parts[1].get("use_regex"):
            self.pattern = _LIKE_WORDS
        self.letters = byte_alphabet()
        self.model = self.tokenizer.model
        self.width, self.code = width, {2: "H", 4: "I"}[width]
        self.max_held = max_held
        self.held: dict[str, bytes] = {}

    def _token(self, word: str) -> bytes:
        if not _VISIBLE.match(word):
            word = word.encode("utf-8").decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def words(self, piece: str) -> list[str] | None:
        """The piece's pre-tokens; None where the library has to find them."""
        if self.pattern is None or not _PLAIN.match(piece) or ("<|" in piece and any(s in piece for s in self.specials)):
            return None
        return self.pattern.findall(piece.lower() if self.lower else piece)

    def ids(self, piece: str) -> bytes:
        """The piece's ids, little-endian, each of ``width`` bytes."""
        if self.pattern is _LIKE_WORDS and piece.isascii() and piece[:-1].isalpha():  # a word, often with a stop
            low = piece.lower()
            words = [low] if piece[-1].isalpha() else [low[:-1], low[-1]]
        else:
            words = self.words(piece)
            if words is None:
                return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        out = []
        for word in words:
            got = self.held.get(word)
            if got is None:
                if len(self.held) >= self.max_held:
                    self.held.clear()
                got = self.held[word] = self._token(word)
            out.append(got)
        return b"".join(out)
