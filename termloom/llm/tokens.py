"""Exact, cached byte-level BPE encoding with the ``tokenizers`` library.

The pre-tokenizer of this vocabulary never joins text across a single space
between two non-space characters, nor across a single line break between two
non-space characters.  Text is cut there, each distinct piece is encoded by
the library once and the ids are gathered with numpy.  Pieces are known by
128-bit hashes in an open-addressing table, so a batch is cut, hashed and
looked up by vector operations.  Any text with another arrangement of white
space, or with an added token in it, goes to the library whole, so the ids are
always the library's own.
"""

from __future__ import annotations

import re

import numpy as np
import regex

from termloom.llm.shingles import mix, powers

_PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_LATIN = re.compile("[ !-~\u00a1-\u024f][!-~\u00a1-\u024f]*")
_ADJACENT = re.compile(r"\s\s")
_BYTES = np.random.RandomState(11).randint(0, 1 << 63, (2, 256)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SLOTS = 1 << 21


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode_many(texts)`` gives (ids uint32, lengths int64); null is empty.

    The string of an added token inside a text becomes that token, as the
    library has it.  At most ``cache_entries`` pieces are remembered, then the
    memory starts anew.
    """

    def __init__(self, path: str, cache_entries: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.cache_entries = cache_entries
        self.newline = self._encode("\n")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.latin = all([t.id for p in _PRETOKEN.findall(x) for t in self.tokenizer.model.tokenize(p.encode().decode("latin-1").translate(self.byte_chars))] == self._encode(x) for x in (" thé", "Don't,", "a-1.5", " ñandú!!", "x\u00ad\u007f"))
        self._reset()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.keys = np.zeros((2, _SLOTS), dtype=np.uint64)
        self.place = np.full(_SLOTS, -1, dtype=np.int32)
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 18, dtype=np.int64)
        self.n, self.used = 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes (2 rows), -1 for unknown ones."""
        out = np.full(h.shape[1], -1, dtype=np.int64)
        slot = (h[0] & np.uint64(_SLOTS - 1)).astype(np.int64)
        at = np.arange(h.shape[1])
        while len(at):
            got = self.place[slot]
            same = (self.keys[0][slot] == h[0][at]) & (self.keys[1][slot] == h[1][at]) & (got >= 0)
            out[at[same]] = got[same]
            on = ~same & (got >= 0)
            at, slot = at[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _store(self, h: np.ndarray, first: int) -> None:
        """Remembers new distinct hashes as pieces ``first``, ``first`` + 1, ..."""
        slot = (h[0] & np.uint64(_SLOTS - 1)).astype(np.int64)
        at = np.arange(h.shape[1])
        while len(at):
            free = self.place[slot] < 0
            here, one = np.unique(slot[free], return_index=True)
            mine = at[free][one]
            self.keys[:, here] = h[:, mine]
            self.place[here] = first + mine
            on = np.ones(len(at), dtype=bool)
            on[np.flatnonzero(free)[one]] = False
            at, slot = at[on], (slot[on] + 1) & (_SLOTS - 1)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Adds pieces; returns the index of the first."""
        first, n, used = self.n, self.n + len(lengths), self.used + len(ids)
        while n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : used] = ids
        self.starts[first + 1 : n + 1] = self.used + np.cumsum(lengths)
        self.n, self.used = n, used
        return first

    def _learn(self, pieces: list[str]) -> int:
        """Encodes new pieces; returns the first's number.  Latin ones without inner white space are cut
        into pre-tokens here and merged by the library's model; any other
        piece goes through the whole tokenizer."""
        ids: list[int] = []
        lengths: list[int] = []
        merge, table, parts = self.tokenizer.model.tokenize, self.byte_chars, _PRETOKEN.findall
        for piece in pieces:
            if self.latin and _LATIN.fullmatch(piece):
                own = [t.id for part in parts(piece) for t in merge(part.encode().decode("latin-1").translate(table))]
            else:
                own = self._encode(piece)
            ids += own
            lengths.append(len(own))
        return self._append(np.array(ids, dtype=np.uint32), np.array(lengths, dtype=np.int64))

    def encode_many(self, texts: list[str | None], slice_chars: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths, part, chars = [], [], [], 0
        for text in texts:
            part.append(text or "")
            chars += len(part[-1])
            if chars >= slice_chars:
                self._slice(part, ids, lengths)
                part, chars = [], 0
        if part:
            self._slice(part, ids, lengths)
        if not ids:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        return np.concatenate(ids), np.concatenate(lengths)

    def _slice(self, texts: list[str], ids: list, lengths: list) -> None:
        if self.n > self.cache_entries:
            self._reset()
        whole = np.array([bool(t) and bool(_ADJACENT.search(t) or t[0] == " " or t[-1] == " " or any(a in t for a in self.added)) for t in texts])
        raw = [b"" if w else t.encode() for t, w in zip(texts, whole.tolist(), strict=True)]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        heads = np.cumsum(sizes) - sizes
        joined = b"".join(raw)
        data = np.frombuffer(joined, dtype=np.uint8)
        line = data == 10
        cut = (data == 32) | line
        cut[1:] |= line[:-1]
        cut[heads[sizes > 0]] = True
        begin = np.flatnonzero(cut)
        index = np.zeros(0, dtype=np.int64)
        if len(begin):
            end = np.append(begin[1:], len(data))
            power, inverse = powers(len(data))
            h = np.empty((2, len(begin)), dtype=np.uint64)
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            for k in (0, 1):
                np.cumsum(_BYTES[k][data] * power, out=total[1:])
                h[k] = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
            index = self._find(h)
            while len(missing := np.flatnonzero(index < 0)):
                new = missing[np.unique(h[0][missing] ^ (h[1][missing] << np.uint64(1)), return_index=True)[1]]
                first = self._learn([joined[a:b].decode() for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
                self._store(h[:, new], first)
                index[missing] = self._find(h[:, missing])
        counts = np.diff(np.searchsorted(begin, np.append(heads, len(data))))
        if whole.any():
            at = np.cumsum(counts)
            own = [self._encode(t) for t, w in zip(texts, whole.tolist(), strict=True) if w]
            first = self._append(np.array([x for o in own for x in o], dtype=np.uint32), np.array([len(o) for o in own], dtype=np.int64))
            index = np.insert(index, at[whole], first + np.arange(len(own)))
            counts = counts + whole
        start, size = self.starts[index], self.starts[index + 1] - self.starts[index]
        ends = np.cumsum(size)
        gather = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(start - (ends - size), size)
        ids.append(self.flat[gather])
        lengths.append(np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
