"""BPE by the tokenizers library with a cache of chunks.

A text's pretokens never cross the place before a single space between two
non-space characters, so a text splits there into chunks whose ids do not
depend on what stands beside them. A batch of texts is split at once by Arrow, each of its
distinct chunks is looked up once, and the texts' ids are gathered from the chunks' ids as whole
arrays. Chunks repeat from batch to batch, so their ids are kept in two generations of bounded size.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: White space as the tokenizers' patterns mean it (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ODD_SPACE = re.compile("[\\x1c-\\x1f]")
#: Letters whose class no Unicode version disputes: a run of them is one pretoken.
LETTERS = re.compile("[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u017f]+")
#: Such a run and the signs behind it, which are a pretoken of their own; an apostrophe may begin one with letters.
STOPPED = re.compile("([A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u017f]+)([!-&(-/:-@\\[-`{-~]+)")
#: Chunks of a generation; the older one goes when the younger is full.
CACHE_CHUNKS = 400_000
LONG_CHUNK = 64


def byte_alphabet() -> str:
    """The printable character that byte-level BPE writes for each byte: printable Latin-1 stays, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


class Odd(Exception):
    """A chunk that white space makes depend on what stands beside it."""


class Chunks(dict):
    """Ids by chunk: what lead and the chunk encode to. An unknown chunk is encoded when it is asked for."""

    def __init__(self, of: ChunkEncoder, lead: str, old: dict[str, bytes]):
        super().__init__()
        self.of, self.lead, self.old = of, lead, old

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk[:1] == "\n" and len(chunk.split()) == 1 and not chunk[1].isspace():
                ids = self.of.mark("\n") + self.of.alone[chunk[1:]]
            elif LETTERS.fullmatch(chunk):
                ids = self.of.word(self.lead + chunk)
            elif m := STOPPED.fullmatch(chunk):
                ids = self[m[1]] + self.of.mark(m[2])
            elif chunk.split() != [chunk]:
                return self.of.lines(self, chunk)
            else:
                ids = self.of.direct(self.lead + chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of texts as little-endian unsigned integers of width bytes; equal to the tokenizer's own encode(..., add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.lower = self.tok.normalizer is not None
        self.size = self.tok.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.raw = [i.to_bytes(self.width, "little") for i in range(self.size)]
        self.tokenize = self.tok.model.tokenize
        self.map = byte_alphabet()
        self.marks: dict[str, bytes] = {}
        self.after = Chunks(self, "" if self.lower else " ", {})  # after a space
        self.alone = Chunks(self, "", {})  # after nothing or other white space

    def direct(self, text: str) -> bytes:
        return b"".join([self.raw[i] for i in self.tok.encode(text, add_special_tokens=False).ids])

    def word(self, letters: str) -> bytes:
        """Ids of one pretoken: a run of letters, perhaps after a space."""
        if self.lower:
            letters = letters.lower()
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenize(charmap_decode(letters.encode(), "strict", self.map)[0])])

    def mark(self, sign: str) -> bytes:
        if sign not in self.marks:
            self.marks[sign] = self.direct(sign)
        return self.marks[sign]

    def lines(self, chunks: Chunks, chunk: str) -> bytes:
        """Ids of a chunk with white space inside, by the chunks within it."""
        if chunk == "\n" and chunks is self.after:  # only the last chunk of a text can be one
            return self.mark(chunk)
        if not chunk or (ODD_SPACE.search(chunk) and CHUNK.fullmatch(chunk)):
            if not chunk:
                raise Odd
            return self.direct(chunks.lead + chunk)
        parts = CHUNK.findall(chunk)
        if parts[0].isspace() or parts[-1].isspace():
            raise Odd
        return chunks[parts[0]] + b"".join(map(self.part, parts[1:]))

    def part(self, chunk: str) -> bytes:
        """Ids of a chunk that CHUNK found: white space, or other characters after one space or none."""
        if chunk.isspace() or ODD_SPACE.search(chunk):
            return self.space(chunk)
        return self.after[chunk[1:]] if chunk[0] == " " else self.alone[chunk]

    def space(self, chunk: str) -> bytes:
        if chunk not in self.marks and len(chunk) > LONG_CHUNK:
            return self.direct(chunk)
        return self.mark(chunk)

    def slow(self, text: str) -> bytes:
        """Ids of a text chunk by chunk, whatever white space it has."""
        if any(s in text for s in self.special) or (self.lower and ODD_SPACE.search(text)):
            return self.direct(text)
        if self.lower:
            return b"".join(map(self.after.__getitem__, text.split()))
        return b"".join(map(self.part, CHUNK.findall(text)))

    def split(self, text: str) -> tuple[bytes, str | None]:
        """The ids of a text's start, and the rest of it, chunks that a single space parts and that follow one."""
        whole = text
        if any(s in text for s in self.special):
            return self.direct(text), None
        if self.lower:
            return (self.direct(text), None) if ODD_SPACE.search(text) else (b"", " ".join(text.split()) or None)
        if " \n" in text:
            return self.slow(text), None
        if "\n" in text and not ("\n\n" in text or "\n " in text or text[0] == "\n"):
            text = text.replace("\n", " \n")  # a line break alone goes with the chunk behind it
        first, space, rest = text.partition(" ")
        try:
            return (self.alone[first] if first else self.lines(self.alone, first)) if text else b"", rest if space else None
        except Odd:
            return self.slow(whole), None

    def known(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of each chunk, and which of them depend on their neighbours."""
        odd = np.zeros(len(chunks), bool)
        try:
            return list(map(self.after.__getitem__, chunks)), odd
        except Odd:
            out = []
            for i, c in enumerate(chunks):
                try:
                    out.append(self.after[c])
                except Odd:
                    odd[i] = True
                    out.append(b"")
            return out, odd

    def flat(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the end id if there is one, and how many each text has."""
        if not texts:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        parts = [self.split(t) for t in texts]
        rests = pa.array([r for _, r in parts], pa.string())
        words = pc.split_pattern(rests, " ")
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        ids, odd = self.known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        of = np.repeat(np.arange(len(texts)), size)
        again = np.unique(of[odd[at]]) if odd.any() else np.zeros(0, np.int64)
        if len(again):
            parts = list(parts)
            for i in again.tolist():
                parts[i] = self.slow(texts[i]), None
            at = at[~np.isin(of, again)]
            size[again] = 0
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = np.insert(at, bounds[:-1], len(ids) + np.arange(len(texts)))
        ids += [h for h, _ in parts]
        if end is not None:
            at = np.insert(at, bounds[1:] + np.arange(1, len(texts) + 1), len(ids))
            ids.append(end.to_bytes(self.width, "little"))
            size = size + 1
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        start = np.cumsum(n) - n
        raw = np.frombuffer(b"".join(ids), self.dtype)
        each = n[at]
        upto = np.cumsum(each)
        out = raw[np.arange(upto[-1]) + np.repeat(start[at] - upto + each, each)]
        last = np.cumsum(size + 1) - 1
        self.age()
        return out, np.diff(upto[last], prepend=0)

    def age(self) -> None:
        """Start a generation where one is full."""
        if len(self.after) > CACHE_CHUNKS:
            self.after = Chunks(self, self.after.lead, dict(self.after))
        if len(self.alone) > CACHE_CHUNKS // 4:
            self.alone = Chunks(self, "", dict(self.alone))
        if len(self.marks) > CACHE_CHUNKS // 4:
            self.marks.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, n = self.flat(texts)
        return np.split(ids, np.cumsum(n)[:-1]) if texts else []


_ENCODERS: dict[str, ChunkEncoder] = kept({})


def encoder(path: str) -> ChunkEncoder:
    """One encoder for a worker process; the cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
