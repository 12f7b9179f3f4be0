"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on Arrow string columns inside a worker: tokens are cut and hashed with a
few numpy passes over the UTF-8 bytes of a batch, so no Python object is made per token.  Batches
are walked in slices of bounded size; a single document is never split.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text handled at once by the vectorised passes.
SLICE_BYTES = 1 << 20

_STEP = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The low k bytes of a lane.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Bytes of a span that are hashed lane by lane; longer ones go to xxh3.
_LANES = 32
#: Chunks of text that an encoder remembers, unless told otherwise; about 170 bytes each.
KEEP = 800_000
#: Everything in ASCII but letters and digits.
NOT_WORD = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[starts:ends] for many spans of one byte array, with A-Z lower-cased if asked.

    Spans are read eight bytes at a time, and every lane goes through the finaliser before the next
    one, so no linear relation between texts carries over; spans of one length up to eight bytes
    never collide.  Each `seed` gives another function.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    sizes = ends - starts
    out = mix64(sizes.astype(U) * _STEP + U(seed))
    out = mix64(out ^ (lanes[starts] & _LOW[np.minimum(sizes, 8)]))
    at = np.flatnonzero(sizes > 8)
    for k in range(8, _LANES, 8):
        if not len(at):
            break
        rest = sizes[at] - k
        out[at] = mix64(out[at] * _STEP ^ (lanes[starts[at] + k] & _LOW[np.minimum(rest, 8)]))
        at = at[rest > 8]
    for i in at.tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded.data[starts[i] : ends[i]], seed)
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `budget` bytes each, or of a single longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def cut_tokens(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts consecutive texts into maximal runs of bytes that are no separators.

    Returns the bytes of the texts, starts and ends of the runs in them, and the number of runs of
    each text; no run crosses the border of two texts.
    """
    first, last = int(offsets[0]), int(offsets[-1])
    part, at = data[first:last], offsets - first
    if not len(part):
        return part, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    word = ~separator[part]
    before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    borders = at[(at > 0) & (at < len(part))]
    before[borders], after[borders - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return part, starts, ends, np.diff(np.searchsorted(starts, at))


def hash_tokens(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and the number of words of each text.

    A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
    """
    part, starts, ends, counts = cut_tokens(data, offsets)
    return span_hashes(part, starts, ends, True, seed), counts


def sorted_unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def sorted_counts(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values ascending, with the number (or the summed weight) of each."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    if weight is None:
        x = np.sort(x)
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        return x[at], np.diff(np.append(at, len(x)))
    order = np.argsort(x, kind="stable")
    x = x[order]
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[at], np.add.reduceat(weight[order], at)


# White space as the byte-level pre-tokeniser sees it (Unicode White_Space).
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHUNK = re.compile(f" ?[{_LATIN}]++(?=[.,]*(?:[{_WS}]|\\Z))|[.,]+(?=[{_WS}]|\\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_LETTERS = re.compile(f" ?[{_LATIN}]+")
_WORD = re.compile(f" ?[^{_WS}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(shifted)) for b in range(256)}


class CachedEncoder:
    """Byte-level BPE ids by the tokenizers library, remembered per chunk of text.

    A chunk is a run of Latin letters with at most one space before it, the full stops and commas
    after one, another run of non-spaces, or the white space left over; the pre-tokeniser always
    cuts between these, so the ids of a text are those of its chunks in order.  What is not
    remembered goes to the library a thousand chunks at a time: letters, which are one pre-token
    each and skip the pre-tokeniser, are told apart by the bytes that each id stands for, others by
    newlines, whose id occurs in no chunk of non-spaces.
    The first `keep` chunks of at most 64 characters are remembered, others for the length of a call only.
    Texts that hold an added token's string, and vocabularies of another kind, are encoded whole.
    """

    def __init__(self, path: str, keep: int = KEEP):
        import json

        # a task has a core; the library's pool of threads would only spin on others
        os.environ.update(RAYON_NUM_THREADS="1", TOKENIZERS_PARALLELISM="false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.largest = max(self.tokenizer.get_vocab().values(), default=0)
        self.special = [t["content"] for t in config["added_tokens"]]
        splits = config["pre_tokenizer"] or {}
        self.by_chunk = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space") and not config["normalizer"]
        self.newline = self._ids("\n")
        self.letters = _byte_letters()
        self.letters[ord("\n")] = " "
        # bytes of each id: in the byte-level alphabet a character is a byte
        self.sizes = np.zeros(self.largest + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        # a cheaper splitter, for pre-tokens that are in the byte-level alphabet already
        self.splitters = self.tokenizer.pre_tokenizer, pre_tokenizers.WhitespaceSplit()
        self.tokenizer.model._resize_cache(0)
        self.known: dict[str, bytes] = {}
        self.keep = keep

    def remember(self, keep: int) -> None:
        """From now on the first `keep` chunks are remembered; those beyond are forgotten."""
        if len(self.known) > keep:
            self.known = dict(itertools.islice(self.known.items(), keep))
        self.keep = keep

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        letters, others = [], []
        if len(self.newline) == 4:
            for c in chunks:
                if _LETTERS.fullmatch(c):
                    letters.append(c)
                elif _WORD.fullmatch(c):
                    others.append(c)
        self.tokenizer.pre_tokenizer = self.splitters[True]
        for at in range(0, len(letters), 1000):
            part = letters[at : at + 1000]
            joined = "\n".join(part).encode()
            raw = self._ids(joined.decode("latin-1").translate(self.letters))
            breaks = np.flatnonzero(np.frombuffer(joined + b"\n", np.uint8) == ord("\n"))
            ends = np.searchsorted(np.cumsum(self.sizes[np.frombuffer(raw, "<u4")]), breaks - np.arange(len(part))) + 1
            if ends[-1] == len(raw) // 4:
                self._remember(part, raw, (4 * ends).tolist(), 0)
        self.tokenizer.pre_tokenizer = self.splitters[False]
        for at in range(0, len(others), 1000):
            part = others[at : at + 1000]
            raw = self._ids("\n".join(part))
            cuts = np.flatnonzero(np.frombuffer(raw, "<u4") == np.frombuffer(self.newline, "<u4"))
            if len(cuts) == len(part) - 1:
                self._remember(part, raw, [*(4 * cuts).tolist(), len(raw)], 4)
        for chunk in chunks:
            if chunk not in self.known:
                self.known[chunk] = self._ids(chunk)

    def _remember(self, chunks: list[str], raw: bytes, ends: list[int], apart: int) -> None:
        """Cuts the ids of consecutive chunks, `apart` bytes from each other, at their ends."""
        lo = 0
        for chunk, end in zip(chunks, ends, strict=True):
            self.known[chunk] = raw[lo:end]
            lo = end + apart

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            return [self._ids(t) if t else b"" for t in texts]
        cut = [_CHUNK.findall(t) if t else () for t in texts]
        new = list(set().union(*cut).difference(self.known))
        self._learn(new)
        get = self.known.__getitem__
        out = [self._ids(t) if t and any(s in t for s in self.special) else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]
        spare = max(0, self.keep - len(self.known) + len(new))
        for chunk in {*new[spare:], *(c for c in new if len(c) > 64)}:
            del self.known[chunk]
        return out


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str, keep: int = KEEP) -> CachedEncoder:
    """The worker's encoder of a vocabulary file; it lives as long as the worker, and remembers as many
    chunks as its last caller allows."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path, keep)
    _encoders[path].remember(keep)
    return _encoders[path]
