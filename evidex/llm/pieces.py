"""Whole-text tokenization by space-separated pieces, for the tokenizers library's files.

In the two kinds of file that are known here (byte-level with its own pattern; a split
that drops white space, after NFC and lower case) no token spans the step from a
character that is no white space to the space after it, so the ids of a text are those
of its pieces (cut before each such space) in a row.  Most pieces repeat: Arrow's
dictionary encoding finds the distinct ones of a batch, a bounded table per worker
remembers their ids, and only new ones go to the library, words of plain Latin letters
many at a time.  Files of any other kind are read without cuts, text by text.

Strings of special tokens in a text are what the library makes of them by default: the
special token.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Letters that stay single letters in NFC and in lower case.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Lines of visible ASCII: the line ends between them stand for themselves.
_LINES = re.compile(r"[!-~]+(?:\n[!-~]+)+")
#: Marks that begin a token of their own after a letter.
_MARKS = frozenset(".,;:!?")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OWN: dict[str, Pieces] = {}
#: Characters encoded at once.
AT_ONCE = 4_000_000
#: Words joined into one text for the library.
JOINED = 250


def kind_of(spec: dict) -> str | None:
    """``bytes`` (spaces are kept), ``words`` (white space is dropped) or None, from a tokenizer file's content."""
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or []):
        return None
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        return None
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
        split, level = parts
        plain = split["pattern"] == {"Regex": _WORD_SPLIT} and split["invert"] and split["behavior"] == "Removed" and not level["use_regex"] and not level["add_prefix_space"]
        return "words" if plain and spec["model"].get("end_of_word_suffix") == "</w>" else None
    return None


class Pieces:
    def __init__(self, path: str, limit: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.kind = kind_of(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.space = limit, " " if self.kind == "bytes" else ""
        # ids that begin (bytes) or end (words) a word
        self.border = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.border[i] = token.startswith("Ġ") if self.kind == "bytes" else token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # of pieces with the space before them, which is left out of the key
        self.bare: dict[str, int] = {} if self.kind == "bytes" else self.place  # of pieces without
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used, self.filled = np.zeros(1 << 16, np.uint32), 0, 0
        self.uses = np.zeros(0, np.int64)

    def make_room(self) -> None:
        """Forgets the pieces that were used least, more than half of the table."""
        middle = len(self.uses) * 3 // 5
        kept = np.flatnonzero(self.uses >= max(2, int(np.partition(self.uses, middle)[middle]) + 1))
        tables, ids, length, uses = [self.place, self.bare], self._gather(kept), self.length[kept], self.uses[kept]
        at = np.full(self.used, -1, np.int64)
        at[kept] = np.arange(len(kept))
        where = at.tolist()
        self.clear()
        self._keep(None, None, ids, length)
        for new, old in zip([self.place, self.bare][: 2 if self.kind == "bytes" else 1], tables, strict=False):
            new.update((k, where[i]) for k, i in old.items() if i < len(where) and where[i] >= 0)
        self.uses = uses // 2

    def _keep(self, keys: list[str] | None, table: dict[str, int] | None, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.used + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        end = self.used + len(lengths)
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.start[self.used : end] = self.filled + np.cumsum(lengths) - lengths
        self.length[self.used : end] = lengths
        if keys is not None:
            table.update(zip(keys, range(self.used, end), strict=True))
        self.used, self.filled = end, self.filled + len(ids)

    def _by_library(self, keys: list[str], table: dict[str, int], space: str) -> None:
        for at in range(0, len(keys), 20_000):
            some = keys[at : at + 20_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([space + k for k in some], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(some, table, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def _learn_words(self, words: list[str], table: dict[str, int], space: str) -> None:
        """Words of Latin letters, many to a text; their ids are told apart by those that begin or end a word."""
        if self.kind == "bytes" and not space:
            return self._by_library(words, table, space)
        for at in range(0, len(words), 40 * JOINED):
            some = words[at : at + 40 * JOINED]
            texts = [space + " ".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            border = np.flatnonzero(self.border[ids])
            if len(border) != len(some):
                raise ValueError("the vocabulary's word borders are not those of its pieces")
            self._keep(some, table, ids, np.diff(np.append(border, len(ids))) if space else np.diff(border, prepend=-1))
        return None

    def _learn(self, keys: list[str], table: dict[str, int], space: str) -> None:
        """``keys`` are new and distinct."""
        words, marked, lines, other = [], [], [], []
        for k in keys:
            if k.isalpha() and (k.isascii() or _LATIN.fullmatch(k)):
                words.append(k)
            elif k[-1:] in _MARKS and k[:-1].isalpha() and (k.isascii() or _LATIN.fullmatch(k, 0, len(k) - 1)):
                marked.append(k)
            elif "\n" in k and _LINES.fullmatch(k):
                lines.append(k)
            else:
                other.append(k)
        if self.kind is None:
            other, words, marked, lines = keys, [], [], []
        self._by_library(other, table, space)
        # the words of marked pieces may be new too
        own = set(words)
        words += [b for b in dict.fromkeys(k[:-1] for k in marked) if b not in table and b not in own]
        self._learn_words(words, table, space)
        if marked:
            self._join(marked, table, [(k[:-1] for k in marked), (k[-1] for k in marked)], [(table, space), (self.bare, "")])
        if lines:
            parts = [k.split("\n") for k in lines]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) * 2 - 1  # with the line ends between
            begin = np.cumsum(sizes) - sizes
            codes = np.full(int(sizes.sum()), self._places(["\n"], self.bare, "")[0])
            later = (np.arange(len(codes)) - np.repeat(begin, sizes)) % 2 == 0
            later[begin] = False
            codes[begin] = self._places([p[0] for p in parts], table, space)
            codes[later] = self._places([x for p in parts for x in p[1:]], self.bare, "")
            self._keep(lines, table, self._gather(codes), np.add.reduceat(self.length[codes], begin))

    def _join(self, keys: list[str], table: dict[str, int], parts: list[Iterator[str]], tables: list) -> None:
        codes = np.stack([self._places(list(p), t, s) for p, (t, s) in zip(parts, tables, strict=True)], axis=1).reshape(-1)
        lengths = self.length[codes].reshape(len(keys), -1).sum(axis=1)
        self._keep(keys, table, self._gather(codes), lengths)

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        length = self.length[codes]
        ends = np.cumsum(length)
        return self.ids[np.repeat(self.start[codes] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _places(self, keys: list[str], table: dict[str, int], space: str, distinct: bool = False) -> np.ndarray:
        found = np.array(list(map(table.get, keys, repeat(-1))), np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = keys if len(missing) == len(keys) else [keys[i] for i in missing.tolist()]
            self._learn(new if distinct else list(dict.fromkeys(new)), table, space)
            found[missing] = list(map(table.__getitem__, new))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin, and the end)."""
        if self.kind is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), np.concatenate(([0], np.cumsum(sizes)))
        if self.used > self.limit:
            self.make_room()
        odd = [i for i, t in enumerate(texts) if _RUN.search(t)] if self.space else []
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        flat, begin = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        codes = self._places(flat.dictionary.to_numpy(zero_copy_only=False).tolist(), self.place, self.space, distinct=True)[flat.indices.to_numpy()]
        if self.space and texts:
            codes[begin[:-1]] = self._places([t.split(" ", 1)[0] for t in plain], self.bare, "")
        if odd:
            parts = np.split(codes, begin[1:-1])
            for i in odd:  # runs of white space: cut only where a space follows something else
                parts[i] = np.concatenate([self._places([p[1:]], self.place, " ") if p.startswith(" ") else self._places([p], self.bare, "") for p in _CUT.split(texts[i]) if p])
            codes, begin = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        seen = np.bincount(codes, minlength=self.used)
        seen[: len(self.uses)] += self.uses
        self.uses = seen
        return self._gather(codes), np.concatenate(([0], np.cumsum(self.length[codes])))[begin]


def pieces(path: str) -> Pieces:
    """The worker's own instance; kept between tasks."""
    if path not in _OWN:
        _OWN[path] = Pieces(path)
    return _OWN[path]


def in_runs(texts: list[str | None], most: int = AT_ONCE) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) of runs of bounded size; a null is empty."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield at, run
            at, run, size = i + 1, [], 0
    if run:
        yield at, run
