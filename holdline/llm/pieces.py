"""Token ids of whole texts through remembered pieces.

Byte-level tokenizers, and those that drop white space, split a text at white space
before they merge, so the ids of a text are those of its pieces in order. A worker
encodes each piece once and remembers it; texts in which a cut at a space could change
the result are encoded whole, as are all texts of tokenizers with other rules.

A tokenizer that drops white space also cuts words at the borders of letters, digits and
marks. Texts of characters whose class and lower case are beyond doubt are cut there, which
leaves far fewer different pieces, and these skip its normaliser and pattern.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np

# Pieces a worker remembers; beyond it, those not met since half as many others go. Only
# speed depends on it. Longer pieces are not remembered. Workers outlive their tasks and
# keep it while they do other work: some 50 MB.
MEMORY, LONGEST = 300_000, 48
# Texts whose pieces are held at once.
GROUP = 64
# Pieces encoded as one text.
_TOGETHER = 1000

# A space inside or at the end of a longer run of white space belongs to that run.
_RUN = re.compile(r"\s \s|\s \Z")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile(r" ?\S+")
# Special tokens begin so; the library looks for them in the whole text.
_SPECIAL = "<|"


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@contextmanager
def for_atoms(tokenizer):
    """``tokenizer`` set for atoms (see there) with white space between them: each is lower
    case and one token of its pattern, so that both steps can be left out. Set back
    afterwards, as a second one would hold vocabulary and merges once more."""
    from tokenizers import normalizers, pre_tokenizers

    rules = tokenizer.normalizer, tokenizer.pre_tokenizer
    bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    try:
        tokenizer.normalizer = normalizers.Sequence([])
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_])
        yield tokenizer
    finally:
        tokenizer.normalizer, tokenizer.pre_tokenizer = rules


# Letters whose lower case is one letter, and marks that no rule changes, beside ASCII.
_LETTERS, _MARKS = "a-zß-öø-ÿ", "‘-”–—…«»§€©®"
_DOUBTFUL = re.compile(rf"[^\t-\r -~À-ÖØ-öø-ÿ{_MARKS}]")
_SAFE_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F)])
# What the word pattern (below) finds in them once they are lower case.
_ATOMS = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^{_LETTERS}0-9\t-\r ]+")


def atoms(text: str) -> list[str] | None:
    """The pieces that a tokenizer with the word pattern makes of ``text``, lower case;
    None if it has characters that this does not know enough of."""
    rest = text.encode().translate(None, _SAFE_BYTES)
    if _SPECIAL in text or rest and _DOUBTFUL.search(rest.decode()):
        return None
    return _ATOMS.findall(text.lower())


class Memo:
    """Values of pieces, made of their ids by ``of`` and put together with ``+``.

    New pieces are encoded together, with a separator between them that is a token of
    its own and that none of them holds. A comma or stop after a letter is a token
    apart in both tokenizers, so the word before it is looked up without it.
    """

    def __init__(self, path: str, separator: str, of: Callable, fold: bool):
        self.tokenizer, self.separator, self.of, self.fold = load(path), separator, of, fold
        if fold:
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.mark = separator.strip(" ")
        (self.mark_id,) = self._ids(separator)
        self.known, self.old = {}, {}

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def _parts(self, piece: str) -> tuple[str, ...]:
        if self.fold and piece.isascii():
            piece = piece.lower()
        # A letter that becomes a mark when the tokenizer normalises it joins the stop.
        if len(piece) > 1 and piece[-1] in ".," and unicodedata.normalize("NFC", piece[-2]).lower().isalpha():
            return piece[:-1], piece[-1]
        return (piece,)

    def _encode(self, pieces: list[str]) -> dict:
        out = {}
        plain = [p for p in pieces if _PLAIN.fullmatch(p) and self.mark not in p and _SPECIAL not in p]
        for i in range(0, len(plain), _TOGETHER):
            some = plain[i : i + _TOGETHER]
            ids = self._ids(self.separator.join(some))
            ends = np.append(np.nonzero(ids == self.mark_id)[0], len(ids))
            if len(ends) == len(some):
                starts = np.append(0, ends[:-1] + 1)
                out.update((p, self.of(ids[a:b])) for p, a, b in zip(some, starts.tolist(), ends.tolist()))
        out.update((p, self.of(self._ids(p))) for p in pieces if p not in out)
        return out

    def _encode_atoms(self, pieces: list[str]) -> dict:
        """The last token of every word is one that ends words, so they need no mark."""
        out = {}
        for i in range(0, len(pieces), _TOGETHER):
            some = pieces[i : i + _TOGETHER]
            with for_atoms(self.tokenizer):
                ids = self._ids(" ".join(some))
            ends = (np.nonzero(self.ends_word[ids])[0] + 1).tolist()
            if len(ends) != len(some):
                raise ValueError("a word without an end")
            out.update((p, self.of(ids[a:b])) for p, a, b in zip(some, [0, *ends], ends))
        return out

    def _learn(self, pieces: set[str]) -> None:
        known, old = self.known, self.old
        known.update((p, old[p]) for p in pieces if p in old)
        parts = {p: self._parts(p) for p in pieces if p not in known}
        wanted = {x for xs in parts.values() for x in xs if x not in known}
        known.update((x, old[x]) for x in wanted if x in old)
        known.update(self._encode([x for x in wanted if x not in known]))
        for p, (x, *more) in parts.items():
            known[p] = known[x] + known[more[0]] if more else known[x]

    def values(self, texts: list[list[str]], of_atoms: list[list[str]] = []) -> tuple[list[list], list[list]]:
        """The value of every piece of every text, and of every atom of those that
        consist of atoms."""
        if len(self.known) > MEMORY // 2:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        single = set().union(*of_atoms).difference(known)
        if single:
            known.update((p, old[p]) for p in single if p in old)
            known.update(self._encode_atoms([p for p in single if p not in known]))
        fresh = set().union(*texts).difference(known)
        if fresh:
            self._learn(fresh)
        out = tuple([list(map(known.__getitem__, text)) for text in some] for some in (texts, of_atoms))
        for p in single:
            if len(p) > LONGEST:
                known.pop(p, None)
        for p in fresh:
            if len(p) > LONGEST:
                for x in {p, *self._parts(p)}:
                    known.pop(x, None)
        return out


def leading_space_pieces(text: str) -> list[str]:
    """Pieces for byte-level BPE, in which a word carries the space before it."""
    if _SPECIAL in text or _RUN.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def bare_pieces(text: str) -> list[str]:
    """Pieces for a tokenizer that drops white space."""
    if _SPECIAL in text:
        return [text]
    if _SEPARATORS.search(text):  # white space to Python alone
        return [x.decode() for x in text.encode().split()]
    return text.split()


# The rules of the two kinds whose texts can be cut.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_RULES = ["NFC", "Replace", "Lowercase"]
_WORD_END = "</w>"


@lru_cache(maxsize=4)
def kind(path: str) -> str:
    """How texts can be cut for a tokenizer: ``spaced``, ``bare`` or ``whole``."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normal, cut = rules.get("normalizer"), rules.get("pre_tokenizer") or {}
    if rules.get("truncation") or rules.get("padding"):
        return "whole"
    if not all(t["content"].startswith(_SPECIAL) for t in rules.get("added_tokens", [])):
        return "whole"
    if normal is None and all(cut.get(k) == v for k, v in _BYTE_LEVEL.items()):
        return "spaced"
    first = (cut.get("pretokenizers") or [{}])[0]
    if (
        [n["type"] for n in (normal or {}).get("normalizers", [])] == _WORD_RULES
        and (first.get("pattern") or {}).get("Regex") == _WORD_PATTERN
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and rules["model"].get("end_of_word_suffix") == _WORD_END
    ):
        return "bare"
    return "whole"


@lru_cache(maxsize=4)
def _memo(path: str, of: Callable) -> Memo:
    return Memo(path, "\n", of, fold=False) if kind(path) == "spaced" else Memo(path, " | ", of, fold=True)


def _values(path: str, of: Callable, texts: list[str]) -> Iterator[list]:
    """The values of each text's pieces, worked out for some texts at a time."""
    for i in range(0, len(texts), GROUP):
        yield from _values_of_some(path, of, texts[i : i + GROUP])


def _values_of_some(path: str, of: Callable, texts: list[str]) -> list[list]:
    if kind(path) == "whole":
        found = load(path).encode_batch_fast(texts, add_special_tokens=False)
        return [[of(np.array(e.ids, "<u4"))] for e in found]
    memo = _memo(path, of)
    if kind(path) == "spaced":
        return memo.values([leading_space_pieces(t) for t in texts])[0]
    found = [atoms(t) for t in texts]
    rest = [bare_pieces(t) for t, cut in zip(texts, found) if cut is None]
    by_space, by_atom = (iter(x) for x in memo.values(rest, [cut for cut in found if cut is not None]))
    return [next(by_space if cut is None else by_atom) for cut in found]


def count_all(path: str, texts: list[str]) -> list[int]:
    return [sum(v) for v in _values(path, len, texts)]


def ids_all(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text, 32 bits each, little-endian."""
    return [b"".join(v) for v in _values(path, np.ndarray.tobytes, texts)]
