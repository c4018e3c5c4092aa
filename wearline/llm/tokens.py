"""Token ids of whole texts by the tokenizers library, with the ids of chunks kept per worker.

A text is cut before spaces where no token can cross. The ids of each new chunk
are those of its pre-tokens, each of which the library's model encodes once;
``word`` and ``word,`` share one. The text's ids are the chunks' ids in order. A
text in which a cut could matter is encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from wearline.llm.common import per_worker

#: Chunks and pre-tokens that stay in memory together.
KEPT_CHUNKS = 800_000
#: Up to this letter the pattern classes of all Unicode versions agree.
LAST_SIMPLE = "\u024f"
#: Characters whose runs are pre-tokens of their own after letters, whatever the letters.
_MARKS = '.,;:!?)]}"%&*#$'
#: A space inside white space, where the byte-level pattern looks at the whole run.
_RUN = re.compile(r"\s (?:\s|\Z)")
#: White space besides space and line end; finding one character is much faster than the pattern.
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: The byte-level pre-tokenizer's pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The visible character of each byte: itself if printable, else one counted up from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkEncoder:
    """ids(texts) as ``encode(text, add_special_tokens=False).ids``; about ``KEPT_CHUNKS`` entries stay in memory."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = [t["content"] for t in content["added_tokens"]]
        self.keeps_space = content["pre_tokenizer"]["type"] == "ByteLevel"
        #: Of the known files' NFC, white space and lower case, what acts on characters up to ``LAST_SIMPLE``.
        self.lowers = content["normalizer"] is not None
        split = BYTE_LEVEL if self.keeps_space else content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pretokens = regex.compile(split).findall
        self.alphabet = byte_alphabet()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.space = self.alphabet[0x20]
        self.bare = _Chunks(self, "")
        #: Chunks that follow a space in their text; where spaces are dropped they are as the bare ones.
        self.known = _Chunks(self, " ") if self.keeps_space else self.bare
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _cuttable(self, text: str) -> bool:
        """False if the text has to be encoded whole."""
        if any(s in text for s in self.special):
            return False
        if not self.keeps_space or not ("  " in text or "\n " in text or any(map(text.__contains__, _OTHER_SPACES))):
            return True
        return not _RUN.search(text)

    def encoded(self, chunk: str, like: _Chunks) -> bytes:
        """The ids of ``like.before`` and the chunk. ``word``, ``word,``, ``word***`` and the first of two lines share their words' ids."""
        simple = chunk.isascii() or max(chunk) <= LAST_SIMPLE
        if simple:
            # composition leaves these characters alone, so lower case is all that changes them
            if self.lowers and (lower := chunk.lower()) != chunk:
                return like[lower]
            if chunk.isalpha():
                return self._piece(like.before + chunk)
            word = chunk.rstrip(_MARKS)
            if word.isalpha():
                return like[word] + self.bare[chunk[len(word) :]]
            if self.keeps_space and "\n" in chunk:
                # single line ends between characters that are no white space are pre-tokens
                first, *rest = chunk.split("\n")
                if first and all(rest) and all(map(str.isprintable, (first, *rest))):
                    return like[first] + b"".join([self._kept("\n") + self.bare[line] for line in rest])
        return self._one(like.before + chunk)

    def _one(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not chunk.isascii() and max(chunk) > LAST_SIMPLE:
            return self._whole(chunk)
        return b"".join(map(self._kept, self.pretokens(chunk)))

    def _kept(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = self._piece(piece)
        return found

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token, written in the byte alphabet (printable ASCII stands for itself)."""
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.space)
        else:
            shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, of ``dtype``."""
        held = [self.known, self.pieces] + [self.bare] * self.keeps_space
        if sum(map(len, held)) > KEPT_CHUNKS:
            for kept in held:
                kept.clear()
        found = []
        for text in texts:
            if not self._cuttable(text):
                found.append(self._whole(text))
            elif self.keeps_space:
                first, *rest = text.split(" ")
                found.append((self.bare[first] if first else b"") + b"".join(map(self.known.__getitem__, rest)))
            else:
                # white space is dropped, so a line's end cuts as a space does
                found.append(b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" "))))
        return found


class _Chunks(dict):
    """Ids by chunk, encoded when first asked for; ``before`` is what stands before each chunk in its text."""

    def __init__(self, encoder: ChunkEncoder, before: str):
        super().__init__()
        self.encode, self.before = encoder.encoded, before

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = self.encode(chunk, self)
        return found


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of the vocabulary file."""
    return per_worker(f"encoder:{path}", lambda: ChunkEncoder(path))
