"""Whole texts to token ids with the tokenizers library, frequent pieces encoded once per worker.

The pre-tokenisers of the supported files never join characters across the pieces found here, so encoding the
pieces apart gives the ids of the whole text. Texts with characters outside ``PLAIN`` (where Unicode tables of the
libraries might differ) go to the library whole, as do texts that hold an added token's content, which has an id of its
own, and all texts under other tokeniser files.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſА-яぁ-ゖァ-ヺ一-龥"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = r"\t\n\r "
#: Characters whose classes and lower case are the same in every library.
PLAIN = re.compile(r"[\t\n\r -~¡-¬®-įı-ſ‐-‧А-яぁ-ゖァ-ヺ一-龥]*")
BYTE_LEVEL = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
LOWERED = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Bytes of the pieces that a worker keeps, twice: a bound on its memory, not on what is encoded.
MOST_KEPT = 32 << 20

#: The characters by which byte-level models write bytes: printable ones as they are, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class _Kept(dict):
    """Ids of pieces as bytes; a piece that is missing is encoded. Full, it becomes the elder half, from which pieces
    in use come back."""

    def __init__(self, model) -> None:
        self.tokenize, self.elder, self.room = model.tokenize, {}, MOST_KEPT

    def __missing__(self, piece: str) -> bytes:
        out = self.elder.get(piece)
        if out is None:
            # what the byte-level step makes of a piece of PLAIN characters, in lower case already where that is asked
            if piece.isascii() and piece.isprintable():
                piece_bytes = piece.replace(" ", _BYTE_CHARS[32])
            else:
                piece_bytes = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            out = array("I", [x.id for x in self.tokenize(piece_bytes)]).tobytes()
        self.room -= 250 + 4 * len(piece) + len(out)  # both objects and their place in the table, at most
        if self.room < 0:
            self.elder, self.room = dict(self), MOST_KEPT
            self.clear()
        self[piece] = out
        return out


class Encoder:
    """Ids of texts, and the end id after them, as little-endian unsigned 32-bit bytes; a null text is empty.

    A worker keeps one from task to task, see ``encoder``.
    """

    def __init__(self, path: str, end: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, normal, self.find, self.lower = spec["pre_tokenizer"], spec.get("normalizer"), None, False
        if before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and normal is None:
            self.find = BYTE_LEVEL.findall
        elif normal and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and "[\\p{N}]|" in json.dumps(before).replace("\\\\", "\\"):
            self.find, self.lower = LOWERED.findall, True
        added = spec.get("added_tokens") or []
        self.added = [x["content"] for x in added]
        if any(x.get("normalized") for x in added):  # found in the normalised text only
            self.find = None
        self.kept, self.end = _Kept(self.tokenizer.model), np.asarray([end], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if self.find is None or not PLAIN.fullmatch(text) or any(x in text for x in self.added):
            return self.whole(text) + self.end
        return b"".join(map(self.kept.__getitem__, self.find(text.lower() if self.lower else text))) + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """The worker's encoder for a file: one, which tasks of other operators drop when they begin."""
    if (path, end) not in _encoders:
        _encoders.clear()
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def drop_encoder() -> None:
    """Frees the encoder that an earlier task of this reused worker has left."""
    _encoders.clear()
