"""Token ids of whole texts by the tokenizers library, word by word through a bounded table.

For a tokenizer that drops white space and never merges across it, a text's ids are its words' ids in a
row. Words are split at spaces and line feeds only, which every such tokenizer treats as white space; what a
word holds besides goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import public_tokenizers

from panelnet.llm.common import release
from panelnet.llm.words import Ragged, WordTable, hash_words, separators

if TYPE_CHECKING:
    from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
_SEP = separators(b" \n")
#: A tokenizer that splits words into runs of letters, single digits and runs of other marks, in lower case.
_PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Words that such a tokenizer splits at most once: letters that have one lower case and no other form, then marks.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ĭ", r"!-&(-/:-@\[-`{-~"
_SIMPLE = re.compile(f"[{_LETTERS}]+[{_MARKS}]*")
_TAIL = re.compile(f"(?<=[{_LETTERS}])(?=[{_MARKS}])")
_held: dict[tuple[str, int], WordIds] = {}


class WordIds:
    def __init__(self, path: str, bits: int = 21):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.mark = self._mark()
        self.plain, self.ends = self._plain(path)
        self.table = WordTable(bits)
        self.rows = Ragged(np.uint16 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32)
        release()  # what reading the vocabulary took besides it

    def clear(self) -> None:
        self.table.clear()
        self.rows = Ragged(self.rows.flat.dtype)

    def full(self) -> bool:
        return self.table.room() < 1 << 18

    def _mark(self) -> tuple[str, int] | None:
        """A special token that stays whole between two words and has an id of its own; None: words go one by one."""
        for i, token in self.library.get_added_tokens_decoder().items():
            plain = token.special and not (token.normalized or token.single_word or token.lstrip or token.rstrip)
            t = token.content
            if plain and not any(t.startswith(t[k:]) for k in range(1, len(t))) and self.library.encode(f"a{t}{t}b", add_special_tokens=False).ids.count(i) == 2:
                return t, i
        return None

    def _plain(self, path: str) -> tuple[Tokenizer | None, np.ndarray]:
        """(the vocabulary behind a split at blanks alone, which ids end a part of a word), if that does for simple words."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        suffix = made["model"].get("end_of_word_suffix")
        if not suffix or made["model"].get("type") != "BPE" or any(made[k] != v for k, v in _PLAIN.items()):
            return None, np.zeros(0, bool)
        vocabulary = made["model"]["vocab"]
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        made.update(normalizer=None, post_processor=None, added_tokens=[])
        made["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(made)), ends

    def _encode_simple(self, words: list[str]) -> None:
        """Append the ids of words that _SIMPLE matches; marks behind a word are a part of their own."""
        texts = [_TAIL.sub(" ", " ".join(words[i : i + 256]).lower()) for i in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)])
        tails = np.fromiter((not w[-1].isalpha() for w in words), np.int64, len(words))
        ends = np.flatnonzero(self.ends[ids])[np.cumsum(1 + tails) - 1]
        self.rows.add(ids, np.diff(np.append(-1, ends)))

    def _encode(self, words: list[str]) -> None:
        """Append the ids of words to the rows: many at once with a mark between them, which their ids show again."""
        if self.mark is None or any(self.mark[0] in w for w in words):
            self.rows.extend([e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)])
            return
        token, number = self.mark
        for e in self.library.encode_batch_fast([token.join(words[i : i + 64]) for i in range(0, len(words), 64)], add_special_tokens=False):
            ids = np.array(e.ids, np.int64)
            at = np.flatnonzero(ids == number)
            ends = np.append(at, len(ids))
            self.rows.add(ids[ids != number], np.diff(np.append(-1, ends)) - 1)

    def _learn(self, buf: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        new, at = np.unique(h, return_index=True)
        self.table.reserve(len(new))
        words = [buf[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        simple = np.fromiter((self.plain is not None and _SIMPLE.fullmatch(w) is not None for w in words), bool, len(words))
        for take, encode in ((simple, self._encode_simple), (~simple, self._encode)):
            some = np.flatnonzero(take)
            self.table.add(new[some])
            for i in range(0, len(some), 4096):
                encode([words[k] for k in some[i : i + 4096].tolist()])

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(numbers of all words, their hashes, for each text the place of its first word and the total, its bytes)."""
        raw = [(t or "").encode() for t in texts]
        buf, starts, ends, h, first = hash_words(raw, _SEP)
        number = self.table.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn(buf, starts[new], ends[new], h[new])
            number[new] = self.table.find(h[new])
        return number, h, first, list(map(len, raw))

    def words(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the numbers of its words; they hold until clear()."""
        number, _, first, _ = self.numbers(texts)
        return np.split(number, first[1:-1])

    def ids(self, words: np.ndarray, end: int) -> np.ndarray:
        """The ids of a text by its word numbers, and the end id."""
        flat, _ = self.rows.gather(words)
        out = np.empty(len(flat) + 1, np.uint32)
        out[:-1], out[-1] = flat, end
        return out


def word_ids(path: str, bits: int = 21) -> WordIds:
    """One table for each worker process, vocabulary and size; a larger one encodes fewer words again."""
    if (path, bits) not in _held:
        _held[path, bits] = WordIds(path, bits)
    return _held[path, bits]


def forget() -> None:
    """Free this worker's tables: for tasks that number no words and need the room."""
    if _held:
        _held.clear()
        release()


@lru_cache(8)
def id_type(path: str, end: int) -> str:
    """Unsigned integers of two bytes where the vocabulary and the end id allow, else of four."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4"


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
