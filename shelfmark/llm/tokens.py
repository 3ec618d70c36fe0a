"""Encoding whole texts with a file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

from shelfmark.llm.common import LONG_WORD, LOWER_BYTES, hash_words, own_bytes, stretches

# Words remembered in a worker, some 60 bytes each; words beyond are encoded anew in each group.
KEPT_WORDS = 1 << 20
# Bytes of text encoded at once; longer texts are cut at white space.
AT_ONCE = 4_000_000
# New words that go through the tokenizer in one call.
IN_A_CALL = 500

# White space that ends a word (as in bytes.split).
SPACE = b" \t\n\x0b\x0c\r"
# Lower-case Latin letters that are one precomposed letter each, ASCII marks.
LETTERS = "a-zß-öø-ÿ"
MARKS = r"!-/:-@\[-`{-~"
_SIMPLE = re.compile(rf"[{LETTERS}]+|[{MARKS}]+")
_SPLIT = re.compile(rf"[a-z0-9][{MARKS}]")
_IS_MARK, _IS_ALNUM = (
    np.array([bool(re.match(f"[{kind}]", chr(i))) for i in range(256)]) for kind in (MARKS, "a-z0-9")
)


def _drops_space(spec: dict) -> bool:
    """Whether white space only separates: then a text is encoded word by word."""
    steps = [*_steps(spec.get("normalizer"), "normalizers"), *_steps(spec.get("pre_tokenizer"), "pretokenizers")]
    kinds = [s["type"] for s in steps]
    split = next((s for s in steps if s["type"] == "Split"), {})
    return (
        kinds == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and split["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and spec["model"].get("end_of_word_suffix") == "</w>"
        # Cut in words, a text never holds an added token by chance.
        and all(_SPLIT.search(t["content"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


def _steps(part: dict | None, inner: str) -> list[dict]:
    return [] if part is None else part.get(inner, [part])


class _Grown:
    """An array that grows at its end; its memory doubles when it is full."""

    def __init__(self, kind: type):
        self.data, self.used = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            grown = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        self.data[self.used : need] = values
        self.used = need


class _Words:
    """Known words by number: an open hash table; a hit counts if all bytes are equal.

    A slot holds 31 bits of the hash and the number, or -1.
    """

    def __init__(self):
        self.slots = np.full(1 << 12, -1, np.int64)
        self.hashes, self.bytes = _Grown(np.uint64), _Grown(np.uint8)
        # Begin in the bytes and length, in one number; the first 8 bytes.
        self.places, self.firsts = _Grown(np.int64), _Grown(np.uint64)

    def __len__(self) -> int:
        return self.hashes.used

    def find(self, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for unknown ones and those over LONG_WORD bytes."""
        if not len(self):
            return np.full(len(hashes), -1, np.int64)
        last = len(self.slots) - 1
        slot = (hashes & np.uint64(last)).astype(np.int64)
        tag = (hashes >> np.uint64(33)).astype(np.int64)
        entry = self.slots[slot]
        those = np.flatnonzero(((entry >> 32) != tag) & (entry >= 0))
        while len(those):
            slot[those] = (slot[those] + 1) & last
            entry[those] = some = self.slots[slot[those]]
            those = those[((some >> 32) != tag[those]) & (some >= 0)]
        number = entry & 0xFFFFFFFF
        number[entry < 0] = 0
        place = self.places.data[number]
        same = (entry >= 0) & ((place & 0xFFFF) == lengths)
        same &= self.firsts.data[number] == own_bytes(chunks[starts], lengths)
        those = np.flatnonzero(same & (lengths > 8))
        known = np.ndarray(len(self.bytes.data) - 7, "<u8", self.bytes.data, strides=(1,))
        done = 8
        while len(those):
            theirs = known[(place[those] >> 16) + done]
            differs = own_bytes(theirs ^ chunks[starts[those] + done], lengths[those] - done) != 0
            same[those[differs]] = False
            done += 8
            those = those[lengths[those] > done]
        number[~same] = -1
        return number

    def add(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Words of at most LONG_WORD bytes that are not there yet get the next numbers."""
        sizes = np.array([len(w) for w in words], np.int64)
        first, begins = len(self), self.bytes.used + np.cumsum(sizes) - sizes
        self.bytes.add(np.frombuffer(b"".join(words) + bytes(8), np.uint8))
        self.bytes.used -= 8
        known = np.ndarray(len(self.bytes.data) - 7, "<u8", self.bytes.data, strides=(1,))
        self.firsts.add(own_bytes(known[begins], sizes))
        self.places.add((begins << 16) | sizes)
        self.hashes.add(hashes)
        if 2 * len(self) > len(self.slots):
            self.slots = np.full(1 << (4 * len(self)).bit_length(), -1, np.int64)
            first = 0
        last = len(self.slots) - 1
        left = np.arange(first, len(self))
        slot = (self.hashes.data[left] & np.uint64(last)).astype(np.int64)
        entry = ((self.hashes.data[left] >> np.uint64(33)).astype(np.int64) << 32) | left
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]  # of several for a slot one stays
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & last


def _cut(text: bytes) -> Iterator[bytes]:
    """The text in parts of about AT_ONCE bytes that end between words."""
    start = 0
    while len(text) - start > AT_ONCE:
        end = start + AT_ONCE
        last = max(text.rfind(SPACE[i : i + 1], start, end) for i in range(len(SPACE)))
        if last < 0:
            ends = [text.find(SPACE[i : i + 1], end) for i in range(len(SPACE))]
            last = min((i for i in ends if i >= 0), default=len(text))
        yield text[start : last + 1]
        start = last + 1
    yield text[start:]


class Encoder:
    """Ids of texts. A word seen before, byte by byte, is looked up; new ones are encoded together.

    Files whose splitting is not known to end words at white space encode text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            self.by_word = _drops_space(json.load(file))
        self.whole = Tokenizer.from_file(path)
        if self.by_word:
            self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
            self.simple = Tokenizer.from_file(path)
            self.simple.normalizer = None
            self.simple.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.ends = np.zeros(self.whole.get_vocab_size(), bool)
            for token, i in self.whole.get_vocab().items():
                self.ends[i] = token.endswith("</w>")
        self.known = _Words()
        self.ids, self.starts, self.lengths = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int64)

    def _simple_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one kind of letters or marks, which are one part for the tokenizer."""
        ids = np.array(self.simple.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        lengths = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if len(lengths) != len(words):
            raise ValueError("a word without an end")
        return ids, lengths

    def _other_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words: a token belongs to the word it begins in."""
        ends = np.cumsum([len(w) + 1 for w in words])
        found = self.whole.encode(" ".join(words), add_special_tokens=False)
        begins = np.array([begin for begin, _ in found.offsets], np.int64)
        lengths = np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(words))
        return np.array(found.ids, np.uint32), lengths

    def _add_ids(self, words: list[bytes]) -> None:
        """Encode the words: their ids come after the ids there are, those of long words last."""
        simple, other, long = [], [], []
        for i, word in enumerate(words):
            text = word.decode("utf-8", "replace")
            low = text.lower()
            if len(word) > LONG_WORD:
                long.append((i, text))
            elif len(low) == len(text) and _SIMPLE.fullmatch(low):
                simple.append((i, low))
            else:
                other.append((i, text))
        order, first, self.ids_before = [], self.starts.used, self.ids.used
        for some, encode in ((simple, self._simple_ids), (other, self._other_ids), (long, self._other_ids)):
            if some is long:
                self.ids_kept = self.ids.used
            for i in range(0, len(some), IN_A_CALL):
                ids, lengths = encode([w for _, w in some[i : i + IN_A_CALL]])
                self.starts.add(self.ids.used + np.cumsum(lengths) - lengths)
                self.lengths.add(lengths)
                self.ids.add(ids)
            order += [i for i, _ in some]
        # In the order of the words, so that their numbers are places in the arrays.
        back = first + np.argsort(np.array(order, np.int64))
        for of in (self.starts, self.lengths):
            of.data[first : of.used] = of.data[back]

    def _numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of the texts, and how many each text has.

        Words end at white space, and at marks that follow an ASCII letter or digit (not in
        texts with an added token). New words get numbers after the known ones; ``_settle``
        then keeps or forgets them.
        """
        counts, numbers = [], []
        new: dict[bytes, int] = {}
        new_hashes: list[int] = []
        for text in texts:
            counts.append(0)
            raw = any(token in text for token in self.added)
            for data in stretches(text if raw else text.translate(LOWER_BYTES)):
                if raw:
                    hashes, starts, lengths, _ = hash_words(data)
                    found = np.full(len(hashes), -1, np.int64)
                else:
                    splits = np.zeros(len(data), bool)
                    splits[1:] = _IS_MARK[data[1:]] & _IS_ALNUM[data[:-1]]
                    hashes, starts, lengths, chunks = hash_words(data, splits)
                    found = self.known.find(hashes, starts, lengths, chunks)
                    found[lengths > LONG_WORD] = -1
                unknown = np.flatnonzero(found < 0)
                if len(unknown):
                    whole = data.tobytes()
                    begin, end = starts[unknown].tolist(), (starts + lengths)[unknown].tolist()
                    for at, i, j, of in zip(unknown.tolist(), begin, end, hashes[unknown].tolist()):
                        number = new.setdefault(whole[i:j], len(new))
                        if number == len(new_hashes):
                            new_hashes.append(of)
                        found[at] = len(self.known) + number
                counts[-1] += len(found)
                numbers.append(found)
        self.new, self.new_hashes = list(new), new_hashes
        if new:
            self._add_ids(self.new)
        return np.concatenate([np.empty(0, np.int64), *numbers]), np.array(counts, np.int64)

    def _settle(self) -> None:
        """Keep the new words if there is room, but no long ones, or forget them."""
        n, kept = len(self.known), np.empty(0, np.int64)
        if n + len(self.new) <= KEPT_WORDS:
            kept = np.flatnonzero([len(w) <= LONG_WORD for w in self.new])
        if len(kept):
            for of in (self.starts, self.lengths):
                of.data[n : n + len(kept)] = of.data[n + kept]
            self.known.add([self.new[i] for i in kept], np.array(self.new_hashes, np.uint64)[kept])
            self.ids.used = self.ids_kept
        elif self.new:
            self.ids.used = self.ids_before
        self.starts.used = self.lengths.used = n + len(kept)
        self.new = []

    def _groups(self, texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[int]]]:
        """Parts of the texts to be worked on at once, and the text each is from."""
        parts, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for part in _cut(text or b"") if self.by_word else [text or b""]:
                if parts and size + len(part) > AT_ONCE:
                    yield parts, owners
                    parts, owners, size = [], [], 0
                parts.append(part)
                owners.append(i)
                size += len(part)
        if parts:
            yield parts, owners

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; null is the empty text."""
        ids, counts = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64)
        for parts, owners in self._groups(texts):
            if self.by_word:
                numbers, words = self._numbers(parts)
                lengths = self.lengths.data[numbers]
                first = np.cumsum(lengths) - lengths
                place = np.arange(int(lengths.sum())) + np.repeat(self.starts.data[numbers] - first, lengths)
                ids.append(self.ids.data[place])
                found = _sums(lengths, words)
                self._settle()
            else:
                some = [self.whole.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in parts]
                ids += [np.array(x, np.uint32) for x in some]
                found = np.array([len(x) for x in some], np.int64)
            np.add.at(counts, owners, found)
        return np.concatenate(ids), counts

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_word:
            return self.encode(texts)[1]
        counts = np.zeros(len(texts), np.int64)
        for parts, owners in self._groups(texts):
            numbers, words = self._numbers(parts)
            np.add.at(counts, owners, _sums(self.lengths.data[numbers], words))
            self._settle()
        return counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values`` of the given lengths."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def encoder(path: str) -> Encoder:
    """One encoder for a worker, kept from task to task.

    Functions travel to the workers with each task, and module variables of this package with
    them. What outlives a task hangs on a module that the worker itself imports.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
