"""Operator 2: SentencePiece encoding and decoding by Viterbi over an Aho-Corasick automaton.

All pieces of a model file form one automaton.  A text is read once; at each character the output
links give every piece that ends there, from longest to shortest, and each relaxes the best score
at that position.  Characters that no piece covers cost the unknown penalty and become byte pieces.

A piece never holds a space mark after another character, so the best path of a text is made of the
best paths of its words (space marks, then other characters); a worker remembers these.

A unigram model's scores are used as they are.  A BPE model's are merge ranks r, no log
probabilities, and adding ranks would favour many short pieces; they count as -ln(1 + r), Zipf's law.
Viterbi over these is the best-scoring cut, which is not always the one that BPE's merges reach, so
the ids that the public library gives by the model's own algorithm are at hand beside it
(`PieceModel.encode_both`, `library` columns); they too are remembered by word, as no piece and so no
merge crosses the start of a word.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import others, tidy, with_field
from .textops import slices, text_buffers

MARK = "▁"
#: Below the least score of a piece, for a character without one; as in the public library.
UNKNOWN_PENALTY = 10.0
#: Longer words are not remembered.
KEEP_CHARACTERS = 64
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Kinds of piece in the public model format.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


class PieceModel:
    """Pieces and scores of a model file without normalisation rules."""

    def __init__(self, path: str, keep: int = 500_000):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with normalisation rules or suffix marks are not supported")
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.decoded = [
            bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() if p.type in (_NORMAL, _USER) else b""
            for p in model.pieces
        ]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown_id = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        ranks = model.trainer_spec.model_type == proto.TrainerSpec.BPE
        normal = [(i, p.piece, -math.log1p(-p.score) if ranks else p.score) for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER)]
        if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("a piece holds a space mark inside")
        self.unknown_score = min(s for _, _, s in normal) - UNKNOWN_PENALTY
        self.singles = {p for _, p, _ in normal if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, piece, score in normal:
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.library_known: dict[str, bytes] = {}
        self.keep = keep

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best-scoring cut of a word; of equal scores the one with the longer last piece."""
        if not self.singles.issuperset(word):
            return self._viterbi_with_unknown(word)
        # every character is a piece, so every position is reached
        n, none = len(word), -float("inf")
        best, back = [0.0] + [none] * n, [None] * (n + 1)
        for last, found in self.automaton.iter(word):
            end = last + 1
            total = best[end - found[1]] + found[2]
            if total > best[end]:
                best[end], back[end] = total, found
        out: list[int] = []
        while n:
            out.append(back[n][0])
            n -= back[n][1]
        return out[::-1]

    def _viterbi_with_unknown(self, word: str) -> list[int]:
        n, none = len(word), -float("inf")
        best, back = [none] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        at = 0  # positions before this one are final
        unknown = self.unknown_score

        def close(upto: int) -> None:
            nonlocal at
            while at < upto:
                at += 1
                if single[at] is False and best[at - 1] + unknown > best[at]:
                    best[at], back[at] = best[at - 1] + unknown, (-1, 1)

        single = [False] * (n + 1)
        for end, (piece, length, score) in self.automaton.iter(word):
            end += 1
            close(end - 1)
            if length == 1:
                single[end] = True
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (piece, length)
        close(n)
        out: list[int] = []
        while n:
            piece, length = back[n]
            if piece < 0:
                out.extend(self.bytes.get(b, self.unknown_id) for b in reversed(word[n - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(piece)
            n -= length
        return out[::-1]

    def _cut(self, text: str | None) -> list[str]:
        return _WORD.findall((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def _library_many(self, words: list[str]) -> list[list[int]]:
        found = self.library.encode([w[self.prefix :].replace(MARK, " ") for w in words], num_threads=1)
        # without a text the library adds no mark either
        return [[self.library.piece_to_id(MARK)] if self.prefix and w == MARK else ids for w, ids in zip(words, found, strict=True)]

    def _joined(self, cut: list[list[str]], unique: set[str], known: dict[str, bytes], ids_of: Callable[[list[str]], Iterable[list[int]]]) -> list[bytes]:
        """The ids of texts cut into the words in `unique`; the first `keep` short words are remembered."""
        new = list(unique.difference(known))
        spare = max(0, self.keep - len(known))
        known.update((w, array("I", ids).tobytes()) for w, ids in zip(new, ids_of(new), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in {*new[spare:], *(w for w in new if len(w) > KEEP_CHARACTERS)}:
            del known[w]
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty texts have none."""
        cut = [self._cut(t) for t in texts]
        return self._joined(cut, set().union(*cut), self.known, lambda words: map(self.viterbi, words))

    def encode_both(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """encode_many() and, in the same form, the ids of each text by the public library."""
        cut = [self._cut(t) for t in texts]
        unique = set().union(*cut)
        own = self._joined(cut, unique, self.known, lambda words: map(self.viterbi, words))
        return own, self._joined(cut, unique, self.library_known, self._library_many)

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, control and unknown ids nothing."""
        text = b"".join(map(self.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """Every document with `ids` (array of int): the pieces of its whole text, null for a null text.

    Keeps the input's columns; `ids` replaces a column of that name.  Nothing is shuffled.
    """
    names = others(docs, "ids")

    def encode(batches):
        for b in batches:
            model = piece_model(model_path)
            texts = b.column("text")
            _, offsets = text_buffers(texts)
            for lo, hi in slices(offsets):
                part = texts.slice(lo, hi - lo).to_pylist()
                got = [None if t is None else ids for t, ids in zip(part, model.encode_many(part), strict=True)]
                sizes = np.cumsum([0, *[len(g) // 4 if g else 0 for g in got]])
                flat = np.frombuffer(b"".join(g for g in got if g), "<i4")
                mask = pa.array([g is None for g in got])
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()), mask=mask)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in names], ids], [*names, "ids"])

    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    return kept.mapInArrow(tidy(encode), with_field(kept.schema, "ids", "array<int>"))


def decode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """Rows with `ids`, and `decoded`: their text, null for null ids."""
    names = others(docs, "decoded")

    def decode(batches):
        for b in batches:
            model, ids = piece_model(model_path), b.column("ids")
            texts = []
            for k in range(len(ids)):
                v = ids[k].values
                texts.append(None if v is None else model.decode(v.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(texts, pa.string())], [*names, "decoded"])

    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    return kept.mapInArrow(tidy(decode), with_field(kept.schema, "decoded", "string"))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit integers),
    decoded_crc32 (UTF-8 of the decoded ids), whether the decoded text equals the source, and
    n_library and library_crc32 of the public library's ids.

    A null text counts as empty.  Encodes and decodes in one pass over each batch, without shuffle.
    """

    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip", "n_library", "library_crc32"]

    def digest(batches):
        for b in batches:
            model = piece_model(model_path)
            ids, texts = b.column("doc_id"), b.column("text")
            _, offsets = text_buffers(texts)
            for lo, hi in slices(offsets):
                part = texts.slice(lo, hi - lo).to_pylist()
                own, given = model.encode_both(part)
                decoded = [model.decode(np.frombuffer(got, "<u4")) for got in own]
                n, library_n = ([len(x) // 4 for x in got] for got in (own, given))
                crc, library_crc = (list(map(zlib.crc32, got)) for got in (own, given))
                back = [zlib.crc32(x.encode()) for x in decoded]
                same = [x == (t or "") for x, t in zip(decoded, part, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in (n, crc, back)], pa.array(same), *[pa.array(c, pa.int64()) for c in (library_n, library_crc)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(digest), "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean, n_library long, library_crc32 long")
