"""Byte-level BPE over many texts with the tokenizers library, each different word once.

The pre-tokenizer's pattern starts a piece at every space or line end that stands
between two non-spaces, so a text may be cut there without changing its ids. The words
of a group of texts become numbers in one pass of Arrow; the library sees only those
that a table of bounded size lacks, and ids are gathered by number.

This holds for plain byte-level BPE alone, which the tokenizer's own file tells; texts
of any other tokenizer go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in each of the two tables of a Python worker. When the newer one is full it takes
#: the place of the older one, so words that are still in use stay.
CACHE_WORDS = 100_000
#: Words that the library's model takes as one string.
JOINED_WORDS = 200
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: White space other than single spaces and line ends between words.
_UNEVEN = r"[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: Latin letters and then marks but the apostrophe: pieces that no token runs across.
_JOINED = rf"\A[{_LETTER}]+[{_MARK}]*\z"
_JOINED_LINE = rf"\A\n[{_LETTER}]+[{_MARK}]*\z"
#: Marks that end a word are words of their own where they follow a letter or digit, as they
#: do in all texts without ``_ODD_MARK``. ``_CUT_OFF`` stands before them; texts with that
#: character go to the library whole.
_ENDS, _CUT_OFF = ".,;:!?", "\x01"
_ODD_MARK = rf"[^{_LETTER}0-9][{_ENDS}][ \n]"
#: How a byte-level vocabulary spells the bytes that aren't printable in Latin-1.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPELLING = np.array([ord(_LETTERS.get(b, chr(b))) for b in range(256)], dtype="<u4")


def spelled(raw: bytes) -> str:
    """Bytes as the letters that a byte-level vocabulary is written in."""
    return _SPELLING[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-32-le")


def kept_in_process() -> dict:
    """A dict of this Python process: workers are used again for further tasks."""
    return sys.__dict__.setdefault("_lexivane_kept", {})


def is_plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer's file describes byte-level BPE that may be cut at white space."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and not spec.get("truncation")
        and not spec.get("padding")
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        and not any(re.search(r"\s", t["content"]) for t in added)
    )


def may_join(spec: dict) -> bool:
    """Whether words of ``_JOINED`` may go to the model as one string without a merge across them.

    Of the tokens that are made of such words' bytes alone, none may have a space or line
    end after anything else, a letter after a line end, or an ASCII mark after a letter;
    no added token may be such a word.
    """
    space, end = spelled(b" "), spelled(b"\n")
    tails = "A-Za-z" + "".join(re.escape(spelled(bytes([b]))) for b in range(0x80, 0xC0))  # an ASCII letter, or the last byte of another
    leads = "".join(spelled(bytes([b])) for b in range(0xC3, 0xCA))
    within = re.compile(f"[{tails}{leads}{_MARK}{space}{end}]+")
    across = re.compile(f"[^{space}{end}][{space}{end}]|{end}[^{space}{end}]|[{tails}][{_MARK}]")
    words = f"[{_LETTER}]*[{_MARK}]*"
    return (
        not spec["model"].get("ignore_merges")
        and not any(within.fullmatch(t) and across.search(t) for t in spec["model"]["vocab"])
        and not any(re.fullmatch(words, t["content"]) for t in spec.get("added_tokens") or [])
    )


class _Table:
    """Words and their ids: ``number`` by word, ids from ``start`` to ``start + count`` by number."""

    def __init__(self, kind):
        self.number: dict[str, int] = {}
        self.used, self.ids = 0, np.empty(1 << 16, dtype=kind)
        self.start, self.count = (np.zeros(1 << 14, dtype=np.int32) for _ in range(2))

    def add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.number), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + m > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        ends = np.cumsum(counts)
        self.start[n : n + m], self.count[n : n + m] = self.used + ends - counts, counts
        self.used += len(ids)
        self.number.update(zip(words, range(n, n + m), strict=True))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers, -1 of those that aren't here."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int32, count=len(words))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the numbered words, one after the other, and how many each has."""
        counts = self.count[numbers]
        ends = np.cumsum(counts, dtype=np.int32)
        at = np.repeat(self.start[numbers] - ends + counts, counts)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], counts


class Encoder:
    """ids of texts as little-endian bytes of ``width`` each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = Tokenizer.from_file(path)
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.by_words = is_plain_byte_level(spec)
        self.joins = False
        special = {x.content for x in self.model.get_added_tokens_decoder().values()}
        self.length, self.begins = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            self.length[i] = len(token.encode()) if token in special else len(token)
            self.begins[i] = token[0] in (spelled(b" "), spelled(b"\n")) if token else False
        self.joins = self.by_words and may_join(spec)
        self.words, self.older = self._table(), None

    def _table(self) -> _Table:
        table = _Table(self.kind)
        marks = self._whole(list(_ENDS))
        table.add(["", *(_CUT_OFF + c for c in _ENDS)], np.concatenate(marks), np.array([0, *map(len, marks)]))
        return table

    @classmethod
    def of(cls, path: str) -> Encoder:
        kept = kept_in_process()
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        return [np.asarray(e.ids, dtype=self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bytes:
        return self._whole([text])[0].tobytes()

    def _learn_joined(self, words: list[str], first: str) -> list[str]:
        """Add words of Latin letters, many in one string; gives back what the ids can't be dealt out to.

        ``first`` is what stands before each word that doesn't bring its own line end.
        """
        parts = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        # The model alone, without its pre-tokenizer.
        cutter = self.model.pre_tokenizer
        self.model.pre_tokenizer = None
        try:
            found = self.model.encode_batch_fast([spelled((first + first.join(p)).encode()) for p in parts], add_special_tokens=False)
        finally:
            self.model.pre_tokenizer = cutter
        left, ids, counts, added = [], [], [], []
        for part, e in zip(parts, found, strict=True):
            own = np.asarray(e.ids, dtype=self.kind)
            at = np.flatnonzero(self.begins[own])
            if len(at) != len(part):
                left += part
                continue
            ids.append(own)
            counts.append(np.diff(at, append=len(own)))
            added += part
        if added:
            self.words.add(added, np.concatenate(ids), np.concatenate(counts))
        return left

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            spaced = list(map(_spaced, part))
            ids = self._whole(["".join(spaced)])[0]
            ends, at = np.cumsum([len(x.encode()) for x in spaced]), np.cumsum(self.length[ids])
            stop = np.searchsorted(at, ends) + 1
            if len(at) == 0 or at[-1] != ends[-1] or (at[stop - 1] != ends).any():
                each = self._whole(spaced)
                ids, stop = np.concatenate(each), np.cumsum([len(x) for x in each])
            self.words.add(part, ids, np.diff(stop, prepend=0))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers in the newer table of different words, learnt where it lacks them."""
        numbers = self.words.numbers(words)
        lacking = np.flatnonzero(numbers < 0)
        if not len(lacking):
            return numbers
        names = lambda at: [words[i] for i in at.tolist()]
        next_, order = len(self.words.number), []
        if self.older:
            at = self.older.numbers(names(lacking))
            known = at >= 0
            if known.any():
                order.append(lacking[known])
                self.words.add(names(lacking[known]), *self.older.gather(at[known]))
                lacking = lacking[~known]
        left: list[str] = []
        if self.joins and len(lacking):
            column = pa.array(names(lacking), pa.string())
            for pattern, first in ((_JOINED, " "), (_JOINED_LINE, "")):
                like = pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
                back = self._learn_joined(names(lacking[like]), first) if like.any() else []
                left += back
                if not back:
                    order.append(lacking[like])
                lacking, column = lacking[~like], column.filter(pa.array(~like))
        self._learn(names(lacking) + left)
        if left:
            return self.words.numbers(words)
        # Words were added in the order of ``order``.
        order = np.concatenate([*order, lacking])
        numbers[order] = next_ + np.arange(len(order))
        return numbers

    def _even(self, texts: pa.Array, cut_marks: bool) -> list[bytes]:
        """Texts with single spaces and line ends only. Each gets a line end in front, whose id is dropped.

        With ``cut_marks`` no text may hold an ``_ODD_MARK``.
        """
        lined = pc.binary_join_element_wise("\n", texts, "")
        if cut_marks:
            for c in _ENDS:
                for after in " \n":
                    lined = pc.replace_substring(lined, c + after, f" {_CUT_OFF}{c}{after}")
        # An empty string in front of the first word has no ids.
        parts = pc.split_pattern(pc.replace_substring(lined, "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        # Words hold no space: one string, cut again, is far less work than an object from Arrow each.
        different = coded.dictionary
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(different)], pa.int32()), different), " ")[0].as_py().split(" ")
        ids, counts = self.words.gather(self._numbers(names)[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(counts)])[parts.offsets.to_numpy()]
        raw, w = ids.tobytes(), self.width
        return [raw[(a + 1) * w : b * w] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _uneven(self, texts: list[str]) -> list[bytes]:
        """Any other texts, cut where their white space allows."""
        parts = [[t] if _CUT_OFF in t else _CUT.split(t) for t in texts]
        ids, ends = np.empty(0, self.kind), np.cumsum([0, *(len(p) - 1 for p in parts)])
        if ends[-1]:
            coded = pa.array([w for p in parts for w in p[1:]], pa.string()).dictionary_encode()
            ids, counts = self.words.gather(self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
            ends = np.concatenate([[0], np.cumsum(counts)])[ends]
        raw, w = ids.tobytes(), self.width
        return [f.tobytes() + raw[a * w : b * w] for f, a, b in zip(self._whole([p[0] for p in parts]), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, as of the library's ``encode`` without special tokens; none of a null."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not len(column):
            return []
        if not self.by_words:
            return [x.tobytes() for x in self._whole(column.to_pylist())]
        if len(self.words.number) > CACHE_WORDS:
            self.older, self.words = self.words, self._table()
        has = lambda pattern: pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
        uneven, odd_mark = has(_UNEVEN), has(_ODD_MARK)
        out: list[bytes] = [b""] * len(texts)
        for at, how in ((~uneven & ~odd_mark, lambda x: self._even(x, True)), (~uneven & odd_mark, lambda x: self._even(x, False)), (uneven, lambda x: self._uneven(x.to_pylist()))):
            if at.any():
                for i, ids in zip(np.flatnonzero(at).tolist(), how(column.filter(pa.array(at))), strict=True):
                    out[i] = ids
        return out


def _spaced(word: str) -> str:
    """A word as it stands in its text: after a space, but for one that begins a line."""
    return word if word[0] == "\n" else " " + word
