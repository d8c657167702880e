"""Exact, fast document encoders over public tokenizer files.

Both classes give the ids that the ``tokenizers`` library gives for the same JSON file with
``add_special_tokens=False`` (special strings in a text are ordinary text); tests compare them.
One encoder is made per Python worker and file.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Pre-tokenizer pattern of byte-level BPE. Fixed value.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE's letters for the 256 bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Byte-level BPE by rank. Ids are ranks when each merge makes the next id, which is checked."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.vocab_size = len(model["vocab"])
        to_bytes = lambda t: bytes(letters[c] for c in t)
        ranks = {to_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [ranks[to_bytes(a + b)] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        self._encoding = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def joined(self, texts: list[str] | list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text followed by the end id, and the texts' lengths with it."""
        found = [[*self._encoding.encode_ordinary(t if isinstance(t, str) else t.decode("utf-8")), end_id] for t in texts]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)

    def many(self, texts: list[str] | list[bytes]) -> list[np.ndarray]:
        return [np.asarray(self._encoding.encode_ordinary(t if isinstance(t, str) else t.decode("utf-8")), dtype=np.uint32) for t in texts]


class WordEncoder:
    """BPE with word ends, whose pre-tokenizer drops white space and whose normalizer lower-cases.

    A text's ids are the ids of its chunks between ASCII white space in a row, and a chunk that ends in
    ASCII punctuation after a letter is its letters and its punctuation. So chunks and their parts are
    encoded by the library once and remembered, at most ``remember`` of each per worker. Parts made of
    letters alone are one word each, so many are handed over at a time and ids that end a word tell them
    apart again; all others (which can be no word, or several) are encoded one by one.
    """

    #: ASCII punctuation but the apostrophe, which can begin a suffix.
    _MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")

    def __init__(self, path: str, remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only wait
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocab.values()) + 1
        suffix = self._tokenizer.model.end_of_word_suffix
        self._ends = np.zeros(self.vocab_size, bool)
        if suffix:
            self._ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}  # what was known before the last time that room was made
        self._parts: dict[bytes, bytes] = {}
        self._letters: dict[str, bool] = {}
        self._remember = remember

    def _one_word(self, part: bytes) -> bool:
        """Whether the part is one word to the library: it is of ASCII letters, or of characters that each go on a word without ending it."""
        if part.isalpha():
            return True
        letters, text = self._letters, part.decode("utf-8")
        for c in text:
            if c not in letters:
                # alone and after a letter it is one word: a letter to the library too, lower-cased to letters
                ends = [int(self._ends[e.ids].sum()) for e in self._tokenizer.encode_batch_fast([c, "a" + c + "a"], add_special_tokens=False)]
                letters[c] = c.isalpha() and ends == [1, 1]
            if not letters[c]:
                return False
        return True

    def _learn_parts(self, parts: list[bytes], alone: list[bytes]) -> None:
        """Encode ``parts``, which are one word each, many at a time, and those of ``alone`` one by one."""
        known, alone = self._parts, list(alone)
        groups = [parts[k : k + 256] for k in range(0, len(parts), 256)]
        for some, e in zip(groups, self._tokenizer.encode_batch_fast([b"\n".join(g).decode("utf-8") for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, np.uint32)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(some):
                data, at = ids.tobytes(), 0
                for w, end in zip(some, (4 * ends).tolist(), strict=True):
                    known[w] = data[at:end]
                    at = end
            else:
                alone += some
        for w, e in zip(alone, self._tokenizer.encode_batch_fast([w.decode("utf-8") for w in alone], add_special_tokens=False), strict=True):
            known[w] = np.asarray(e.ids, np.uint32).tobytes()

    def _learn(self, chunks: set[bytes]) -> None:
        known, marks = self._known, self._MARKS
        whole, marked = [], []
        for w in chunks:
            if 97 <= w[-1] <= 122:
                whole.append(w)
                continue
            core = w.rstrip(marks)
            k = len(core)
            # punctuation at the end stands apart if a letter is before it
            if k < len(w) and k and (97 <= core[-1] <= 122 or core[-1] >= 128 and unicodedata.normalize("NFC", core.decode("utf-8")).lower()[-1].isalpha()):
                marked.append((w, core, w[k:]))
            else:
                whole.append(w)
        if len(self._parts) + len(chunks) > self._remember:
            self._parts = {}
        parts = self._parts
        todo = set(whole)
        for _, core, tail in marked:
            todo.add(core)
            todo.add(tail)
        todo = {w for w in todo if w not in parts}
        words = {w for w in todo if self._one_word(w)}
        self._learn_parts(list(words), list(todo - words))
        for w in whole:
            known[w] = parts[w]
        for w, core, tail in marked:
            known[w] = parts[core] + parts[tail]

    def _bytes(self, texts: list[str] | list[bytes]) -> list[bytes]:
        """Per text its ids as bytes."""
        split = [(t if isinstance(t, bytes) else t.encode("utf-8")).lower().split() for t in texts]
        met = set(itertools.chain.from_iterable(split))
        new = met.difference(self._known)
        if new:
            if len(self._known) + len(new) > self._remember:
                self._older, self._known, new = self._known, {}, met
            again = self._older.keys() & new
            self._known.update((w, self._older[w]) for w in again)
            self._learn(new - again)
        known = self._known
        return [b"".join(map(known.__getitem__, c)) for c in split]

    def joined(self, texts: list[str] | list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text followed by the end id, and the texts' lengths with it."""
        rows, end = self._bytes(texts), np.uint32(end_id).tobytes()
        return np.frombuffer(end.join([*rows, b""]), np.uint32), np.array([len(r) // 4 + 1 for r in rows], np.int64)

    def many(self, texts: list[str] | list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(r, np.uint32) for r in self._bytes(texts)]


def in_runs(texts: list[str], chars: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in runs of about so many characters, which bounds what a worker holds at once."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder for a tokenizer file, by what its pre-tokenizer does."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)["pre_tokenizer"]["type"]
    return ByteEncoder(path) if kind == "ByteLevel" else WordEncoder(path)
