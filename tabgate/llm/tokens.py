"""Token ids of whole texts with a public tokenizer, word by word.

The tokenizer cuts a text into pieces before it merges bytes, and no piece reaches over a single space between two
non-space characters: the space starts the next piece. So a text is cut there, each word (with its space) is encoded
once in a batch, and the texts' ids are put together from those of their words. Words are kept from batch to batch, up
to a bound. This gives the ids of encoding the whole text (tests compare them), at a fifth of the time.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: An id after each document.
END = 0
#: Texts are encoded in blocks of about this many bytes: each different word of a block is looked up once.
ENCODED_BYTES = 4 << 20
#: So many different words are kept by a worker; then it starts anew.
KEPT_WORDS = 250_000
#: The pattern that byte-level tokenizers of this kind cut a text by.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words of these characters alone are cut by PIECES here; all others are left to the tokenizer.
PLAIN = re.compile(r" ?[\n\x21-\x7eÀ-ſ]+")
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = r"(^ )|( $)|( \s)|(\s )|[\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def byte_letters() -> list[str]:
    """Byte-level tokenizers write each byte as a letter: printable ones as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256]
    letters, more = [""] * 256, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + more)
            more += 1
    return letters


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.space, self.line = letters[0x20], letters[0x0A]
        most = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        flat = np.arange(most + 1, dtype=np.int32).tobytes()
        self.ids = [flat[at : at + 4] for at in range(0, len(flat), 4)]  # one object for each id, whatever words hold it
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(specials) or r"(?!)")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """At the end of a task: its worker may stand idle beside others from now on."""
        self.words.clear()
        self.pieces.clear()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if piece.isascii():  # then only the space and the line feed are written as other letters
                shown = piece.replace(" ", self.space).replace("\n", self.line)
            else:
                shown = piece.encode().decode("latin-1").translate(self.letters)
            tokens, of = self.model.tokenize(shown), self.ids
            ids = of[tokens[0].id] if len(tokens) == 1 else b"".join([of[t.id] for t in tokens])
            self.pieces[piece] = ids
        return ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as 32-bit numbers."""
        for kept in (self.words, self.pieces):
            if len(kept) > KEPT_WORDS:
                kept.clear()
        found = [self.words.get(w) for w in words]
        strange = []
        unseen = [i for i, ids in enumerate(found) if ids is None]
        # Most blocks hold no special text at all; one search tells.
        special = self.special.search("\n".join([words[i] for i in unseen])) is not None
        for i in unseen:
            word = words[i]
            if not special and word.isascii() and word[1:].isalpha() and word[0] == " ":
                found[i] = self.words[word] = self._piece(word)
            elif not PLAIN.fullmatch(word) or (special and self.special.search(word)):
                strange.append(i)
            elif word[0] == " " and word[1:].isalpha():
                found[i] = self.words[word] = self._piece(word)
            else:
                found[i] = self.words[word] = b"".join([self._piece(p) for p in PIECES.findall(word)])
        if strange:
            for i, e in zip(strange, self.tokenizer.encode_batch([words[i] for i in strange], add_special_tokens=False)):
                found[i] = self.words[words[i]] = np.array(e.ids, np.int32).tobytes()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other and each with END, and their offsets (one more than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = []
            for text, is_odd in zip(texts.to_pylist(), odd.tolist()):
                parts.append(SAFE_CUT.split(text) if is_odd else text.split(" "))
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            words = pa.array([w for p in parts for w in p], pa.string())
        else:
            lists = pc.split_pattern(texts, " ")
            sizes = np.diff(lists.offsets.to_numpy())
            words = lists.flatten()
        first = np.concatenate([[0], np.cumsum(sizes)])
        table = words.dictionary_encode()
        unique = table.dictionary.to_pylist()
        of = table.indices.to_numpy().astype(np.int64)
        # A text's first word stands without a space; it is a word of its own.
        leading, place = np.unique(of[first[:-1]], return_inverse=True)
        of[first[:-1]] = len(unique) + place
        encoded = self.encode_words([" " + w for w in unique] + [unique[i] for i in leading.tolist()])
        encoded.append(np.int32(END).tobytes())
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), np.int32)
        starts = np.cumsum(lengths) - lengths
        # END is one more word of each text.
        of = np.insert(of, first[1:], len(encoded) - 1)
        n = lengths[of]
        sums = np.concatenate([[0], np.cumsum(n)])
        offsets = sums[first + np.arange(len(first))]
        # Places fit 32 bits unless one text alone is far larger than a block.
        kind = np.int32 if max(int(sums[-1]), len(flat)) < 1 << 31 else np.int64
        source = np.repeat((starts[of] - sums[:-1]).astype(kind), n)
        source += np.arange(int(sums[-1]), dtype=kind)
        return flat[source], offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
