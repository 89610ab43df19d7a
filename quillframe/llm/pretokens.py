"""Byte-level BPE over word-sized pieces, each looked up in a worker's cache or encoded once.

A text is cut before each single space and newline, where byte-level pre-tokenisation always has a
boundary, so the pieces' ids, laid end to end, are the text's ids.

Ids (``encode_texts``) are found for many texts at once. Their pieces, also cut before punctuation after an
ASCII letter or digit, are offsets into the texts' own bytes; each different piece is looked up once among those that the
worker keeps, and the new ones go to the library laid end to end, which cuts them apart again as it does in a text.
Texts with special strings, or with white space that could join across a cut, go to the library whole.

Counts (``count``) are found piece by piece, where letters outside the Latin blocks (whose Unicode versions differ) and texts
with a NUL, which marks a text's first piece there, go to the library whole as well. That look-up has two
tiers in one hash table: the frequent pre-tokens, which stay, and what the worker has encoded, up to a bound.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pattern of byte-level pre-tokenisation.
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Entries of a worker's caches.
PRETOKENS_KEPT = 120_000
PIECES_KEPT = 700_000
#: Pieces whose ids a worker keeps from one group of texts to the next, bytes of the longest of them, and bytes of new pieces that go to the library at once.
LISTS_KEPT = 300_000
LONGEST_KEPT = 64
RUN = 1 << 18
#: White space besides space and newline, by any version of Unicode, and pieces that may not be taken alone: they end in
#: white space, where a cut may be no boundary, or begin with other white space than the cuts' own.
_WHITE = r"\t\x0B-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
JOINS = rf"[ \n{_WHITE}]\z|\A[{_WHITE}]"
#: Kinds of bytes: 1 ASCII letters and digits, 2 ASCII punctuation.
_KIND = np.array([(1 if chr(b).isalnum() else 2) if 32 < b < 127 else 0 for b in range(256)], np.uint8)


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = byte_letters()


def vocabulary_pretokens(tokenizer_json: str) -> dict[str, int]:
    """Vocabulary entries that are one whole pre-token of Latin text, with their ids.

    Merges are ranked by frequency, so these are the frequent pre-tokens; the table has no more entries
    than the vocabulary, whatever the corpus.
    """
    back = {c: b for b, c in _LETTERS.items()}
    table = {}
    for entry, number in json.loads(tokenizer_json)["model"]["vocab"].items():
        try:
            text = bytes(back[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text < "ɐ" and max(text) < "ɐ" and PRETOKEN.findall(text) == [text]:
            table[text] = number
    return table


_NEW = object()


class _Memo(dict):
    """A bounded cache: ``make`` computes what is missing. Half of it is filled anew each time, from the entries it was given; what the
    half before holds moves there as it is asked for again, so frequent entries stay and those that came once go."""

    def __init__(self, make: Callable, most: int, given: dict | None = None):
        super().__init__(given or {})
        self.make, self.most, self.given, self.before = make, most // 2 + len(self), dict(self), {}

    def __missing__(self, key: str):
        value = self.before.get(key, _NEW)
        if value is _NEW:
            value = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
            self.update(self.given)
        self[key] = value
        return value


class Library:
    """A worker's tokenizer with its caches: ids of pre-tokens, and ids and counts of pieces of text."""

    def __init__(self, tokenizer_json: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # cores are dealt to tasks
        made = json.loads(tokenizer_json)
        kind = made.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words are kept here
        self.by_piece = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not made.get("normalizer")
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        self.joins = re.compile("|".join([r"\s\s", r"\s\Z", "\0", *map(re.escape, self.special)]))
        self.table = {p: int(n).to_bytes(4, "little") for p, n in table.items()}
        self.pretokens = _Memo(self._pretoken, PRETOKENS_KEPT)
        # the first tier, as pieces after a space
        first = {p[1:]: n for p, n in self.table.items() if p[0] == " " and len(p) > 1 and not any(map(str.isspace, p[1:]))}
        self.counts = _Memo(self._count, PIECES_KEPT, {p: len(n) // 4 for p, n in first.items()})
        # pieces that are kept, their ids, and how often of late a group of texts had them
        self.kept, self.lists, self.uses = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), np.zeros(0)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens with a space or newline: the first ones of pieces
        self.opens[[n for entry, n in vocab.items() if _LETTERS[32] in entry or _LETTERS[10] in entry]] = True
        self.by_lists = self.by_piece and not any(" " in t or "\n" in t for t in self.special)

    def whole(self, text: str) -> bytes:
        """Ids of a whole text, by the library alone, as little-endian 32-bit integers."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, p: str) -> bytes:
        """Ids of one pre-token: the frequent ones from the table, the others by the model."""
        return self.table.get(p) or array("I", [t.id for t in self.model.tokenize(p.encode().decode("latin1").translate(_LETTERS))]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space, which no cache holds: most such words come once, so they are kept as pieces only."""
        letters = f"\u0120{word}" if word.isascii() else f" {word}".encode().decode("latin1").translate(_LETTERS)
        return self.table.get(f" {word}") or array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, key: str) -> bytes | None:
        """Ids of a piece, None if it can't be taken alone. A key begins with NUL at a text's start, with its newline, or stands after a space."""
        if not key:
            return None
        stem = key[:-1] if key[-1] in ".,!" else key
        if stem.isalpha() and (stem.isascii() or max(stem) < "ɐ"):
            if len(stem) == len(key):
                return self._word(stem)
            return self._word(stem) + self.pretokens[key[-1]]
        text = key[1:] if key[0] == "\0" else key if key[0] == "\n" else f" {key}"
        if self.joins.search(text):
            return None
        if text.isascii() or max(text) < "ɐ":
            return b"".join([self.pretokens[p] for p in PRETOKEN.findall(text)])
        return self.whole(text)

    def _count(self, key: str) -> int | None:
        ids = self._piece(key)
        return None if ids is None else len(ids) // 4

    def _new_lists(self, new: pa.StringArray) -> pa.ListArray:
        """Ids of pieces that ``JOINS`` does not match, encoded end to end: a piece without a space or newline of its own is put after
        one, whose id is left out, so that each piece has one token that opens it."""
        led = pc.match_substring_regex(new, r"\A[ \n]")
        joined = pc.binary_join_element_wise(pc.if_else(led, "", "\n"), new, "")
        bounds, data = _bytes(joined)
        led = led.to_numpy(zero_copy_only=False)
        ids, opens, a, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0, 0
        while a < len(new):
            b = max(int(np.searchsorted(bounds, bounds[a] + RUN, "right")) - 1, a + 1)
            text = data[bounds[a] : bounds[b]].tobytes().decode()
            run = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            first = np.flatnonzero(self.opens[run])
            if len(first) != b - a:  # a vocabulary without spaces or newlines: one by one, as if opened
                found = [np.frombuffer(b"\0" * (0 if has else 4) + self.whole(p), np.int32) for p, has in zip(new.slice(a, b - a).to_pylist(), led[a:b], strict=True)]
                run, first = np.concatenate(found), np.cumsum([0, *map(len, found)])[:-1]
            ids.append(run)
            opens.append(size + first)
            a, size = b, size + len(run)
        ids, opens = np.concatenate(ids), np.concatenate(opens)
        sizes = np.diff(opens, append=len(ids)) - ~led
        return pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), np.delete(ids, opens[~led]))

    def _places(self, found: pa.StringArray) -> np.ndarray:
        """Where in ``lists`` the ids of different pieces are, after new ones were added; -1 for pieces that may not be taken alone."""
        at = pc.index_in(found, value_set=self.kept)
        missing = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        places = at.fill_null(-1).to_numpy().copy()
        self.uses[places[places >= 0]] += 1
        new = found.take(pa.array(missing))
        alone = pc.invert(pc.match_substring_regex(new, JOINS)).to_numpy(zero_copy_only=False)
        new = new.filter(pa.array(alone))
        places[missing[alone]] = len(self.kept) + np.arange(len(new))
        if len(new):
            self.kept, self.lists = pa.concat_arrays([self.kept, new]), pa.concat_arrays([self.lists, self._new_lists(new)])
            self.uses = np.concatenate([self.uses, np.ones(len(new))])
        return places

    def _forget(self) -> None:
        """Long pieces go. Above the bound, two thirds of it stay: the most used pieces, of those the latest; older use counts half."""
        stay = np.flatnonzero(pc.binary_length(self.kept).to_numpy() <= LONGEST_KEPT)
        if len(stay) > LISTS_KEPT:
            self.uses /= 2
            stay = np.sort(stay[np.argsort(self.uses[stay], kind="stable")[-(LISTS_KEPT * 2 // 3) :]])
        if len(stay) < len(self.kept):
            self.kept, self.lists, self.uses = self.kept.take(pa.array(stay)), self.lists.take(pa.array(stay)), self.uses[stay]

    def encode_texts(self, texts: pa.StringArray, after: Sequence[int] = ()) -> pa.ListArray:
        """Ids of each text (null: empty), with those of ``after`` at its end."""
        texts, after = texts.fill_null("").cast(pa.string()), np.array(after, np.int32)
        alone = np.full(len(texts), not self.by_lists)
        for special in self.special:
            alone |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        cuts, first = cut(pc.if_else(pa.array(alone), "", texts))
        coded = cuts.dictionary_encode()
        order = self._places(coded.dictionary)[coded.indices.to_numpy()]
        joins = np.concatenate([[0], np.cumsum(order < 0)])[first]
        alone |= joins[1:] > joins[:-1]
        whole = [np.append(np.frombuffer(self.whole(t), np.int32), after) for t in texts.filter(pa.array(alone)).to_pylist()]
        ends = pa.ListArray.from_arrays(np.cumsum([0, len(after), *map(len, whole)], dtype=np.int32), np.concatenate([after, *whole]))
        lists = pa.concat_arrays([self.lists, ends])
        # of each text its pieces and then ``after``, or all that the library gave
        last = np.full(len(texts), len(self.lists))
        last[alone] += 1 + np.arange(len(whole))
        sizes = np.where(alone, 0, np.diff(first))
        order = order[np.repeat(~alone, np.diff(first))]
        stops = np.cumsum(sizes)
        picked = lists.take(pa.array(np.insert(order, stops, last.astype(np.int32))))
        self._forget()
        return pa.ListArray.from_arrays(picked.offsets.take(pa.array(np.concatenate([[0], stops + 1 + np.arange(len(texts))]))), picked.values)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return self.encode_texts(pa.array([text])).values.to_numpy().tobytes()

    def count(self, text: str) -> int:
        """Number of ids of a text."""
        if self.by_piece and "\0" not in text:
            with contextlib.suppress(TypeError):
                return sum(map(self.counts.__getitem__, pieces(text)))
        return len(self.whole(text)) // 4


def pieces(text: str) -> list[str]:
    """A text's pieces as keys: the first is marked by NUL, the others follow a space or begin with their newline."""
    return f"\0{text}".replace("\n", " \n").split(" ")


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and each text's bounds in them; nothing is copied."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return bounds - bounds[0], data


def cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The texts' pieces, each with the space or newline before it, and the index of each text's first piece (and of the end)."""
    bounds, data = _bytes(texts)
    at, kind = (data == 32) | (data == 10), _KIND[data]
    at[1:] |= (kind[:-1] == 1) & (kind[1:] == 2)
    at[bounds[bounds < len(data)]] = True
    starts = np.append(np.flatnonzero(at), len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)), np.searchsorted(starts, bounds)


_workers: dict[int, Library] = {}


def library(shared: tuple[str, dict[str, int]]) -> Library:
    """This worker's library for a broadcast (tokenizer file, table), made once."""
    key = hash(shared[0])
    if key not in _workers:
        _workers.clear()
        _workers[key] = Library(*shared)
    return _workers[key]


def load(path: str) -> tuple[str, dict[str, int]]:
    """A tokenizer file and its table of frequent pre-tokens, to be broadcast (bounded by the vocabulary)."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return text, vocabulary_pretokens(text)
