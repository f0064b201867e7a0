"""Exact ids of a tokenizers-library BPE file at corpus speed.

The ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids``. Texts
are cut where the file's own pre-tokenizer always cuts, and each distinct
piece is encoded once per worker (``PieceTable``). Its words are cut by the
file's pattern and merged by the file's merge table, many words at a time.
Texts and pieces on which a cut could differ from the pre-tokenizer (adjacent
white space, special-token strings, rare white space, scripts whose case or
composition looks at its surroundings) are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from lexora.llm.common import spread
from lexora.llm.pieces import HashIndex, PieceTable, held

_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NEVER = 1 << 30
MERGED = 4_000  # words that are merged at once
_START = "\x00"
_NEVER_IN = (_START, *"\x0b\x0c\x1c\x1d\x1e\x1f\x85")
_BETWEEN = ("  ", " \n", "\n ", "\n\n", *map(chr, [9, 13, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_EDGES = (" ", "\n")


def byte_table() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The merge table of a byte-level BPE file, applied to many words at once: in each round every word merges its first pair of least rank."""

    def __init__(self, model: dict, longest: int = 32) -> None:
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        alphabet = byte_table()
        plain = [vocabulary.get(alphabet[b]) for b in range(256)]
        last = [vocabulary.get(alphabet[b] + suffix) for b in range(256)]
        self.usable = None not in plain and None not in last and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        self.longest = longest
        if not self.usable:
            return
        self.plain, self.last = np.array(plain, np.int32), np.array(last, np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.index = HashIndex()
        self.index.add(self._key(left, right))

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """One to one: an odd factor has an inverse."""
        return ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.index.find(self._key(left, right))
        return np.where(found < 0, np.int32(_NEVER), found)

    def apply(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each); words are bytes of data, none longer than `longest`."""
        out_sizes = np.zeros(len(sizes), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (2, 4, 6, 8, 10, 12, 16, 20, 24, self.longest):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(own), MERGED):
                some = own[at : at + MERGED]
                ids, n = self._merged(data, starts[some], sizes[some], high)
                out_sizes[some] = n
                parts.append((some, ids))
        ends = np.cumsum(out_sizes)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for some, ids in parts:
            flat[spread(ends[some] - out_sizes[some], out_sizes[some])] = ids
        return flat, out_sizes

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        columns = np.arange(width)
        held = columns < sizes[:, None]
        symbols = self.plain[data[np.where(held, starts[:, None] + columns, 0)]]
        rows = np.arange(len(sizes))
        symbols[rows, sizes - 1] = self.last[data[starts + sizes - 1]]
        n = sizes.copy()
        if width > 1:
            ranks = np.full((len(sizes), width), _NEVER, np.int32)
            both = held[:, 1:]
            ranks[:, :-1][both] = self._ranks(symbols[:, :-1][both], symbols[:, 1:][both])
            live, s, r, m = rows, symbols, ranks, n
            while True:
                at = r.argmin(1)
                best = r[np.arange(len(live)), at]
                go = best < _NEVER
                if not go.all():
                    symbols[live], n[live] = s, m
                    live, s, r, m, at, best = live[go], s[go], r[go], m[go], at[go], best[go]
                    if not len(live):
                        break
                k = np.arange(len(live))
                s[k, at] = self.made[best]
                move = np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), width - 1)
                s[:, :-1] = np.take_along_axis(s, move, 1)
                # the rank of the pair that begins at `at` goes with the second symbol
                shift = np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), width - 1)
                r[:, :-1] = np.take_along_axis(r, shift, 1)
                r[:, -1] = _NEVER
                m = m - 1
                right = at + 1 < m
                r[k, at] = _NEVER
                r[k[right], at[right]] = self._ranks(s[k[right], at[right]], s[k[right], at[right] + 1])
                left = at > 0
                r[k[left], at[left] - 1] = self._ranks(s[k[left], at[left] - 1], s[k[left], at[left]])
        return symbols[columns < n[:, None]], n


class Encoder:
    """max_pieces bounds the table of a worker: it is emptied when full. frugal: as in PieceTable."""

    def __init__(self, path: str, max_pieces: int = 700_000, frugal: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.lowers = self.library.normalizer is not None
        self.pattern = regex.compile(_WORD_PATTERN if self.lowers else _BYTE_PATTERN)
        self.special = re.compile("[^\x01-\x9f\xa1-ɏ]")
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.alphabet = byte_table()
        self.table = PieceTable(self._learn, np.uint32, b" \t\n\r" if self.lowers else b" ", max_pieces, frugal)

    def _words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """(the words of all pieces, how many each has)."""
        findall = self.pattern.findall
        if self.lowers:
            if not all(map(str.isascii, pieces)):
                pieces = [p if p.isascii() else unicodedata.normalize("NFC", p) for p in pieces]
            split = [[p] if p.isalpha() else findall(p) for p in map(str.lower, pieces)]
            return [w for words in split for w in words], np.array([len(words) for words in split], np.int64)
        # a space begins one word of each piece, its first
        words = findall(" " + " ".join(pieces)) if pieces else []
        return words, np.diff(np.flatnonzero(np.array([w[0] == " " for w in words], bool)), append=len(words))

    def _learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [p.decode("utf-8") for p in raw]
        whole = [k for k, p in enumerate(pieces) if self.special.search(p)] if self.lowers else []
        for k in whole:
            pieces[k] = ""
        order = np.arange(len(pieces))
        if not self.lowers and (first := [k for k, p in enumerate(pieces) if p[:1] == _START]):  # no space before these
            order = np.concatenate([np.setdiff1d(order, first), first])
            words, counts = self._words([pieces[k] for k in order[: -len(first)].tolist()])
            split = [self.pattern.findall(pieces[k][1:]) for k in first]
            words, counts = words + [w for own in split for w in own], np.concatenate([counts, [len(own) for own in split]])
        else:
            words, counts = self._words(pieces)
        numbers = dict.fromkeys(words)
        for k, w in enumerate(numbers):
            numbers[w] = k
        flat, sizes = self._ids(list(numbers))
        begin = np.cumsum(sizes) - sizes
        own = np.array([numbers[w] for w in words], np.int64)
        ids, of_word = flat[spread(begin[own], sizes[own])], sizes[own]
        total = np.concatenate([[0], np.cumsum(of_word)])
        ends = np.cumsum(counts)
        of_piece = total[ends] - total[ends - counts]
        back = np.argsort(order)
        ids, of_piece = ids[spread((np.cumsum(of_piece) - of_piece)[back], of_piece[back])], of_piece[back]
        if whole:
            bounds = np.concatenate([[0], np.cumsum(of_piece)])
            parts = [ids[bounds[k] : bounds[k + 1]] for k in range(len(raw))]
            for k in whole:
                parts[k] = np.array(self.library.encode(raw[k].decode("utf-8"), add_special_tokens=False).ids, np.int64)
            ids, of_piece = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids.astype(np.uint32), of_piece

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each a whole pre-token."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(w) for w in raw], np.int64)
        starts = np.cumsum(lengths) - lengths
        if not self.merges.usable:
            short = np.zeros(0, np.int64)
        else:
            short = np.flatnonzero((lengths > 0) & (lengths <= self.merges.longest))
        flat, n = self.merges.apply(np.frombuffer(b"".join(raw), np.uint8), starts[short], lengths[short]) if len(short) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(short) == len(words):
            return flat, n
        sizes, others = np.zeros(len(words), np.int64), {}
        sizes[short] = n
        for k in np.setdiff1d(np.arange(len(words)), short).tolist():
            others[k] = [t.id for t in self.library.model.tokenize(raw[k].decode("latin1").translate(self.alphabet))] if raw[k] else []
            sizes[k] = len(others[k])
        begin = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        out[spread(begin[short], n)] = flat
        for k, ids in others.items():
            out[begin[k] : begin[k] + len(ids)] = ids
        return out, sizes

    def _sure(self, text: str) -> bool:
        """Whether the pre-tokenizer cuts at every separator of the text."""
        if "<|" in text or any(map(text.__contains__, _NEVER_IN)):
            return False
        if self.lowers:
            return True
        # single spaces and line feeds between words only: else white space may join in other ways
        return not (any(map(text.__contains__, _BETWEEN)) or text[:1] in _EDGES or text[-1:] in _EDGES)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        distinct = dict.fromkeys(texts)
        if len(distinct) < len(texts):
            flat, sizes = self._encode(list(distinct))
            for k, text in enumerate(distinct):
                distinct[text] = k
            own = np.array([distinct[t] for t in texts], np.int64)
            begin = np.cumsum(sizes) - sizes
            return flat[spread(begin[own], sizes[own])], sizes[own]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sure = [self._sure(t) for t in texts]
        mark = "" if self.lowers else _START
        flat, sizes = self.table.encode([(mark + t).encode("utf-8") if ok else b"" for t, ok in zip(texts, sure)])
        whole = [k for k, ok in enumerate(sure) if not ok]
        if whole:
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            parts = [flat[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
            for k in whole:
                parts[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat, sizes


def encoder(path: str, frugal: bool = False) -> Encoder:
    return held(("encoder", path, frugal), lambda: Encoder(path, frugal=frugal))


def batched(texts: list[str], most: int = 4_000_000):
    """Slices of texts of about `most` characters, at least one text each; bounds a batch's memory."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)
