"""Splitting texts into the pieces that a tokenizer encodes one by one, and a bounded memory of what they encode to."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from sys import getsizeof

import public_tokenizers

WORD = re.compile(r"[^ \t-\r]+")
#: White space outside ASCII, in any library's sense.
ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Characters that every Unicode version and normal form treats alike.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[\t-\r -~{_LETTERS}]*")
#: The two tokenizers' patterns over those characters.
BYTE_LEVEL = re.compile(f" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")


class ByteLevel:
    """Matches of the byte-level pattern (public_tokenizers.PATTERN) in a text."""

    def __init__(self):
        import public_tokenizers
        import regex

        self.any = regex.compile(public_tokenizers.PATTERN)

    def __call__(self, text: str) -> list[str]:
        return (BYTE_LEVEL if PLAIN.fullmatch(text) else self.any).findall(text)


def words(text: str) -> list[str]:
    """Runs without ASCII white space. A tokenizer that drops white space encodes a text as its words, one after the other."""
    return WORD.findall(text) if ODD_SPACE.search(text) else text.split()


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte, by the rule of byte-level vocabularies: printable Latin-1 keeps its
    place, the others follow from 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(other)}


#: Bytes of pieces that a worker remembers where nothing else is said.
REMEMBERED = 160 << 20


class Memory:
    """Results by piece, of about `most` bytes; beyond, it starts afresh. It outlives a task in a reused worker. What a
    piece of more than LONGEST characters gives is kept for its batch only, as such pieces seldom come again."""

    LONGEST = 64

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int):
        self.compute, self.most, self.known, self.size, self.brief = compute, most, {}, 0, []

    def learn(self, lists: Iterable[list[str]]) -> dict:
        """The results of all pieces in these lists, at least."""
        for x in self.brief:
            self.known.pop(x, None)
        self.brief = []
        if self.size > self.most:
            self.known, self.size = {}, 0
        new: set[str] = set()
        for x in lists:
            new.update(x)
        fresh = sorted(x for x in new if x not in self.known)
        got = list(self.compute(fresh))
        self.known.update(zip(fresh, got))
        self.brief = [x for x in fresh if len(x) > self.LONGEST]
        self.size += sum(map(getsizeof, fresh)) + sum(map(getsizeof, got)) + 100 * len(fresh)  # what a dictionary takes for an entry
        self.size -= sum(getsizeof(x) + getsizeof(self.known[x]) + 100 for x in self.brief)
        return self.known


_MEMORIES: dict[tuple, Memory] = {}


def memory(key: tuple, make: Callable[[], Callable], most: int) -> Memory:
    key = (*key, most)
    if key not in _MEMORIES:
        _MEMORIES[key] = Memory(make(), most)
    return _MEMORIES[key]


def forget() -> None:
    """Drop what this worker remembers."""
    _MEMORIES.clear()


def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str) -> str:
    """Where the file is on this machine; an absolute path stays as it is."""
    return name if name.startswith("/") else public_tokenizers.path(name)


def library_ids(path: str, level: re.Pattern, lower: bool) -> Callable[[list[str]], list[list[int]]]:
    """Ids of chunks by the tokenizers library: its model alone for pieces of plain characters, else its whole encode."""
    tok = tokenizer(path)
    model, table = tok.model, byte_letters()
    special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)")

    def compute(items: list[str]) -> list[list[int]]:
        by_piece: dict[str, list[int]] = {}
        out: list = [None] * len(items)
        rest: list[int] = []
        for i, x in enumerate(items):
            if PLAIN.fullmatch(x) and not special.search(x):
                ids: list[int] = []
                for p in level.findall(x.lower() if lower else x):
                    got = by_piece.get(p)
                    if got is None:
                        got = by_piece[p] = [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(table))]
                    ids += got
                out[i] = ids
            else:
                rest.append(i)
        for s in range(0, len(rest), 256):
            part = rest[s : s + 256]
            for i, e in zip(part, tok.encode_batch_fast([items[j] for j in part], add_special_tokens=False)):
                out[i] = e.ids
        return out

    return compute
