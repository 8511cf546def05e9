"""Whole-text encoding with a public tokenizer, memoised by word.

A text made only of Latin letters, ASCII digits and punctuation, single spaces
and line ends is cut here into the vocabulary's own pre-tokens, whose merges
the library's model does.  Any other text is cut before every single space
that stands between two characters that are not white space, where this
pre-tokenizer always splits, and the pieces go through the whole tokenizer.
Both equal encoding the text at once.  A text that holds an added token of the
vocabulary (such as an end mark), and every text of a vocabulary that is not
byte-level, goes through the library whole.  Words recur, so each Python
worker keeps the ids of the first ``CACHE_WORDS`` distinct pieces it meets;
other pieces are encoded once per batch.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: Bound of a worker's memory for chunks; about 80 MB.
CACHE_WORDS = 300_000
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_BATCH_WORDS = 200_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"
#: Latin-1 bytes of the letters, digits, marks, spaces and line ends above.
_PLAIN = bytes(c for c in range(256) if re.fullmatch(rf"[{_LETTER}0-9{_MARK} \n]", chr(c)))
_RUNS = (b"  ", b" \n", b"\n ", b"\n\n\n")
_PRETOKEN = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the others as U+0100 and up in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(256 + k) for k, b in enumerate(rest)}


def _is_plain(text: str) -> bool:
    """Whether a text is one that ``_PRETOKEN`` cuts as the library does."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not (data.translate(None, _PLAIN) or any(x in data for x in _RUNS) or data.endswith((b"\n\n", b" ")))


def _splits_as_here(tokenizer) -> bool:
    """Whether the vocabulary's texts are cut by the byte-level rule alone: no
    normalizer, no space put in front, the library's own pattern, plain merges."""
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return False
    rule = json.loads(tokenizer.pre_tokenizer.__getstate__())
    merges = type(tokenizer.model).__name__ == "BPE" and not (tokenizer.model.dropout or tokenizer.model.continuing_subword_prefix or tokenizer.model.end_of_word_suffix)
    return merges and rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and bool(rule.get("use_regex"))


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary (a parameter everywhere)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to arrays of little-endian ids."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self._tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._letters = _byte_letters()
        self._byte_level = _splits_as_here(self._tokenizer)
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values() if t.content]
        self._added = added
        self._kept: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _merged(self, pieces: set[str]) -> dict[str, bytes]:
        merge, table, code = self._tokenizer.model.tokenize, self._letters, self._code
        space, line = table[32], table[10]
        out = {}
        for p in pieces:
            if p.isascii():
                letters = p.replace(" ", space).replace("\n", line)
            else:
                letters = p.encode().decode("latin-1").translate(table)
            out[p] = array(code, [x.id for x in merge(letters)]).tobytes()
        return out

    def _whole(self, pieces: set[str]) -> dict[str, bytes]:
        order = list(pieces)
        got = self._tokenizer.encode_batch_fast(order, add_special_tokens=False)
        return {p: array(self._code, x.ids).tobytes() for p, x in zip(order, got, strict=True)}

    def _is_whole(self, text: str) -> bool:
        return not self._byte_level or any(a in text for a in self._added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text (``self.dtype``); an empty text has none."""
        out: list[bytes] = [b""] * len(texts)
        waiting: tuple[list, list] = ([], [])
        words = [0, 0]
        for i, text in enumerate(texts):
            if self._is_whole(text):
                out[i] = self._whole({text})[text]
                continue
            k = int(not _is_plain(text))
            pieces = _SAFE.split(text) if k else _PRETOKEN.findall(text)
            waiting[k].append((i, pieces))
            words[k] += len(pieces)
            if words[k] >= _BATCH_WORDS:
                self._join(waiting[k], k, out)
                waiting[k].clear()
                words[k] = 0
        for k in (0, 1):
            self._join(waiting[k], k, out)
        return out

    def _join(self, waiting: list[tuple[int, list[str]]], k: int, out: list[bytes]) -> None:
        kept = self._kept[k]
        new = set().union(*(p for _, p in waiting)).difference(kept)
        ids = (self._whole if k else self._merged)(new)
        room = CACHE_WORDS - len(kept)
        kept.update(ids)
        for i, pieces in waiting:
            out[i] = b"".join(map(kept.__getitem__, pieces))
        for p in list(ids)[max(0, room) :]:
            del kept[p]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)
