"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

The encoder knows the model's pieces and scores only. A segment starts as its characters; the agenda holds each
adjacent pair that is a piece, best score first, leftmost among equals; the best is merged and its new neighbours
enter. What is no piece at the end becomes byte pieces. No piece has the word mark after another character, so
merging never passes from one word to the next and words are cached. Words that are new in an Arrow batch are
checked, encoded and decoded, against the sentencepiece library; a difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import as_text, batch_of, rows_of
from panelnet.llm.words import Ragged, WordTable, hash_words, separators

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_SEP = separators(b" \n")
#: Stands for a segment that is one mark and nothing else; a noncharacter, see Pieces._parted.
_NOTHING = "\uffff\ufdd0\uffff"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_held: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        norm, pieces = model.normalizer_spec, list(model.pieces)
        plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if not plain or any(p.type in (USER_DEFINED, UNUSED) for p in pieces) or any(MARK in p.piece.lstrip(MARK) for p in pieces if p.type == NORMAL):
            raise ValueError("this encoder is for merge-type models with plain text and word marks in front")
        self.score = {p.piece: p.score for p in pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.surface = {i: bytes([b]) for b, i in self.byte.items()} | {i: p.replace(MARK, " ").encode() for p, i in self.id.items()}
        self.decimal = [str(i) for i in range(len(pieces))]
        self.most, self.cores = most, {}
        self.table, self.rows = WordTable(22), Ragged(np.uint16 if len(pieces) <= 1 << 16 else np.uint32)

    def merge(self, text: str) -> list[str]:
        """The symbols of a segment after all merges."""
        n, score = len(text), self.score.get
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            pair = text[i : i + 2]
            s = score(pair)
            if s is not None:
                agenda.append((-s, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != len(pair):
                continue
            symbols[left], symbols[right] = pair, None
            after[left] = r = after[right]
            if r >= 0:
                before[r] = left
                s = score(p := pair + symbols[r])
                if s is not None:
                    heapq.heappush(agenda, (-s, left, r, p))
            q = before[left]
            if q >= 0:
                s = score(p := symbols[q] + pair)
                if s is not None:
                    heapq.heappush(agenda, (-s, q, left, p))
        return [s for s in symbols if s is not None]

    def core(self, part: str) -> list[int]:
        """The ids of a part that no merge leaves."""
        ids = self.cores.get(part)
        if ids is None:
            ids = []
            for s in self.merge(part):
                i = self.id.get(s)
                ids.extend([self.byte[b] for b in s.encode()] if i is None else [i])
            if len(self.cores) < self.most and len(part) < 40:
                self.cores[part] = ids
        return ids

    def word(self, text: str) -> list[int]:
        """The ids of a segment, word marks included: its parts between characters that no piece holds side by side."""
        joined = self.joined
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined), len(text)]
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.core(text[a:b])]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the decoded text: pieces and bytes in a row, word marks as spaces, the first mark dropped."""
        return b"".join(map(self.surface.__getitem__, ids))[1:]

    def _check(self, words: list[str], ours: list[list[int]]) -> None:
        """Hold new words against the library, encoded and decoded; the library gives the empty text no mark."""
        theirs = self.library.encode(words, num_threads=1)
        for w, a, b, d in zip(words, ours, theirs, self.library.decode(theirs)):
            if w and (a != b or self.decode(a) != d.encode()):
                raise ValueError(f"the agenda and the library differ on {w!r}")

    def learn(self, words: list[str]) -> list[list[int]]:
        ids = [self.word(MARK + w.replace(" ", MARK)) for w in words]
        self._check(words, ids)
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text: those of its segments, each a run of word marks and what follows up to the next."""
        if len(self.cores) >= self.most:
            self.cores = {}
        if self.table.room() < 1 << 18:
            self.table.clear()
            self.rows = Ragged(self.rows.flat.dtype)
        #: Marks become spaces. A segment with more than one mark in front keeps the others as marks, so that
        #: single spaces part the segments; line feeds are taken for a byte that UTF-8 never has, and back.
        raw = [self._parted(t).encode().replace(b"\n", b"\xff") if t else b"" for t in texts]
        buf, starts, ends, h, first = hash_words(raw, _SEP)
        number = self.table.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, at = np.unique(h[new], return_index=True)
            at = new[at]
            words = [buf[a:b].replace(b"\xff", b"\n").decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            self.table.reserve(len(distinct))
            self.table.add(distinct)
            self.rows.extend(self.learn([w.removesuffix(_NOTHING) for w in words]))
            number[new] = self.table.find(h[new])
        flat, n = self.rows.gather(number)
        total = np.concatenate([[0], np.cumsum(n)])
        return np.split(flat, total[first[1:-1]])

    def _parted(self, text: str) -> str:
        """Segments without their first mark, parted by single spaces; an empty one is _NOTHING."""
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text
        found = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return " ".join([w[1:] or _NOTHING for w in found])


def pieces(path: str) -> Pieces:
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]


def _run(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(path)
        decimal = coder.decimal.__getitem__
        for part in rows_of(batches, "doc_id", "text"):
            out = []
            for (doc_id, _), ids in zip(part, coder.encode([t for _, t in part])):
                ids = ids.tolist()
                shown = ",".join(map(decimal, ids)).encode()
                out.append((doc_id, len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            yield batch_of(schema, list(zip(*out)))

    return run


def encode_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for a row.

    A null text counts as empty and has no id. Null or repeated ids and repeated rows pass through; other columns
    are ignored; an empty table gives an empty result. Texts are read whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    return docs.mapInArrow(_run(model or public_tokenizers.path(MODEL)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
