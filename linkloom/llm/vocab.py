"""Public tokenizer files behind caches: the ids and counts are the libraries' own.

A text made of the plain characters below is cut at white space first, so that
each distinct chunk of many texts meets the library once; any other text, and
any text that may hold a special token, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters whose classes, lower case and normal forms agree between the
#: libraries (tests compare each of them); "<|" may begin a special token.
ODD = re.compile("[^\\t\\n\\r -~\\u00a1-\\u012f\\u0131-\\u024f\\u2010-\\u2027]|<\\|")



def plain(text: str) -> bool:
    if text.isascii() and "<|" not in text and text.replace("\n", "").isprintable():
        return True
    return not ODD.search(text)


#: How the two vocabularies split a text before their merges.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary(name: str) -> str:
    """A path as given, or the place of a public file of that name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


#: Ends of chunks that are a word and punctuation, which need no pattern to part.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"

#: Characters that are cut into chunks at a time; a longer text is cut at white space.
SLICE = 3_000_000


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Runs of values, one after the other."""
    ends = np.cumsum(lens)
    return values[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]


def offsets_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)


def tails(chunks: pa.StringArray, cores: pa.StringArray) -> pa.StringArray:
    """What follows the core of each chunk."""
    n = pc.subtract(pc.binary_length(chunks), pc.binary_length(cores)).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
    own = ragged(data, offsets_of(chunks)[1:] - n, n)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype("<i4")
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(own))


def pieces_of(text: str) -> list[str]:
    """A text in pieces of about SLICE characters, cut at white space."""
    out, at = [], 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(c, at, at + SLICE) for c in " \n")
        if cut <= at:
            later = [i for i in (text.find(c, at + SLICE) for c in " \n") if i >= 0]
            if not later:
                break
            cut = min(later)
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


class ChunkIds:
    """Whole texts to ids, by chunks that the library takes apart one by one.

    The chunks of many texts are told apart at once and only different ones are
    looked up. What they are is held until ``limit`` of them are known, then
    learnt anew.
    """

    def __init__(self, dtype, limit: int) -> None:
        self.dtype, self.limit = dtype, limit
        self._forget()

    def _forget(self) -> None:
        """known: a chunk's number; ids of the chunks one after the other, where each begins and how many it has."""
        self.known: dict[str, int] = {"": 0}
        self.ids, self.size = np.empty(1 << 16, self.dtype), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.count = 1

    def _plain(self, text: str) -> bool:
        """Whether the library's ids of a text are those of its chunks."""
        raise NotImplementedError

    def _cut(self, texts: pa.StringArray) -> pa.ListArray:
        """The chunks of plain texts; an empty text has one."""
        raise NotImplementedError

    def _whole(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words, one after the other, and how many each has."""
        raise NotImplementedError

    def _learn(self, words: list[str]) -> None:
        ids, lens = self._ids_of(words)
        size, count = self.size + len(ids), self.count + len(words)
        if size > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(size, self.dtype)])
        if count > len(self.lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros(count, np.int64)]) for x in (self.starts, self.lens))
        self.ids[self.size : size] = ids
        self.starts[self.count : count] = self.size + np.cumsum(lens) - lens
        self.lens[self.count : count] = lens
        self.known.update(zip(words, range(self.count, count)))
        self.size, self.count = size, count

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of different words."""
        known = self.known
        new = [w for w in words if w not in known]
        for i in range(0, len(new), 8192):
            self._learn(new[i : i + 8192])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks, one after the other, and how many each has."""
        numbers = self._numbers(chunks.to_pylist())
        lens = self.lens[numbers]
        return ragged(self.ids, self.starts[numbers], lens), lens

    def _slice(self, texts: list[str], ends: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts with their ``ends`` behind each, one after the other, and how many each has."""
        if self.count > self.limit or self.size > 8 * self.limit:
            self._forget()
        odd = [i for i, t in enumerate(texts) if not self._plain(t)]
        whole = [np.array(x, self.dtype) for x in self._whole([texts[i] for i in odd])]
        for i in odd:
            texts[i] = ""  # one empty chunk, whose place the whole text takes
        lists = self._cut(pa.array(texts, pa.string()))
        begins = offsets_of(lists).astype(np.int64)
        chunks = pc.dictionary_encode(lists.flatten())
        ids, lens = self._chunks(chunks.dictionary)
        codes = chunks.indices.to_numpy().astype(np.int64)
        codes[begins[odd]] = len(lens) + np.arange(len(odd))
        last = [i for i, e in enumerate(ends) if e]
        codes = np.insert(codes, begins[1:][last], len(lens) + len(odd) + np.arange(len(last)))
        behind = [np.array(ends[i], self.dtype) for i in last]
        begins[1:] += np.cumsum([bool(e) for e in ends])
        ids = np.concatenate([ids, *whole, *behind])
        lens = np.concatenate([lens, [len(x) for x in whole], [len(x) for x in behind]]).astype(np.int64)
        each = lens[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        return ragged(ids, (np.cumsum(lens) - lens)[codes], each), np.diff(upto[begins])

    def flat(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` behind each, one after the other, and how many each has."""
        last = [] if end is None else [end]
        out, counts = [], np.zeros(len(texts), np.int64)
        held: list[tuple[int, str, list[int]]] = []
        size = 0

        def take():
            nonlocal held, size
            if held:
                ids, n = self._slice([t for _, t, _ in held], [e for _, _, e in held])
                out.append(ids)
                np.add.at(counts, [i for i, _, _ in held], n)
            held, size = [], 0

        for i, t in enumerate(texts):
            pieces = self._pieces(t) if len(t) > SLICE and self._plain(t) else [t]
            for k, p in enumerate(pieces, 1):
                if size and size + len(p) > SLICE:
                    take()
                held.append((i, p, last if k == len(pieces) else []))
                size += len(p)
        take()
        return (np.concatenate(out) if out else np.empty(0, self.dtype)), counts

    def _pieces(self, text: str) -> list[str]:
        return pieces_of(text)


class WordIds(ChunkIds):
    """Ids of a vocabulary that lower-cases and drops white space.

    A chunk between white space is a word and marks behind it, or is made of
    several words. New words go to the library's merges many at a time, cut and
    lower-cased: each word's last id, and no other, ends a word in this kind of
    vocabulary, which parts them again.
    """

    def __init__(self, name: str = "word_bpe_49k.json", limit: int = 300_000) -> None:
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = load(name)
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.find = regex.compile(WORD_PATTERN).findall
        size = self.tok.get_vocab_size()
        suffix = json.loads(self.tok.to_str())["model"]["end_of_word_suffix"]
        self.ends, self.bytes = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith(suffix)
            self.bytes[i] = len(token.removesuffix(suffix)) == 1 and not token.isascii()  # part of a character
        super().__init__(np.uint16 if size <= 65536 else np.uint32, limit)

    def _plain(self, text: str) -> bool:
        return plain(text)

    def _cut(self, texts: pa.StringArray) -> pa.ListArray:
        return pc.ascii_split_whitespace(pc.utf8_lower(texts))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [self.tok.encode(t, add_special_tokens=False).ids for t in texts]

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        ids = np.array([i for x in self.merges.encode_batch_fast(lines, add_special_tokens=False) for i in x.ids], self.dtype)
        lens = np.diff(np.nonzero(self.ends[ids])[0] + 1, prepend=0)
        if len(lens) != len(words):
            each = self._whole(words)
            ids, lens = np.array([i for x in each for i in x], self.dtype), np.array([len(x) for x in each], np.int64)
        return ids, lens

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        core = pc.ascii_rtrim(chunks, characters=MARKS)
        simple = pc.utf8_is_alpha(core)
        core, marked = core.filter(simple), chunks.filter(simple)
        simple = simple.to_numpy(zero_copy_only=False)
        others = [self.find(c) for c in chunks.filter(pa.array(~simple)).to_pylist()]
        n = np.full(len(chunks), 2)
        n[~simple] = [len(x) for x in others]
        at = np.cumsum(n) - n
        words = np.empty(int(n.sum()), np.int64)
        for i, column in enumerate((core, tails(marked, core))):
            column = pc.dictionary_encode(column)
            words[at[simple] + i] = self._numbers(column.dictionary.to_pylist())[column.indices.to_numpy()]
        parts = [w for x in others for w in x]
        different = dict.fromkeys(parts)
        number = dict(zip(different, self._numbers(list(different)).tolist()))
        words[np.repeat(~simple, n)] = [number[w] for w in parts]
        lens = self.lens[words]
        upto = np.concatenate([[0], np.cumsum(lens)])
        return ragged(self.ids, self.starts[words], lens), upto[at + n] - upto[at]


#: Fixed value: how this kind of vocabulary writes a space.
SPACE = "\u2581"


class PieceIds(ChunkIds):
    """Ids of a vocabulary that puts a space before a text, changes nothing in it and has no piece with a space behind another character.

    So a text without two spaces together or a space at an end is cut at its
    spaces, and each chunk is a text of its own. A vocabulary of another kind,
    and any other text, goes to the library whole.
    """

    def __init__(self, name: str = "piece_bpe_32k.model", limit: int = 300_000) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        size = self.sp.get_piece_size()
        self.bytes = np.array([self.sp.is_byte(i) for i in range(size)])
        pieces = [self.sp.id_to_piece(i) for i in range(size)]
        probe = "a\u00e9 \uff21 b"
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self.sp.encode(f" {probe} ", out_type=str) == [SPACE, *self.sp.encode(probe, out_type=str), SPACE]
        self.cuts = self.cuts and self.sp.encode(probe) == [i for c in probe.split(" ") for i in self.sp.encode(c)]
        super().__init__(np.uint16 if size <= 65536 else np.uint32, limit)

    def _plain(self, text: str) -> bool:
        return self.cuts and bool(text) and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text

    def _cut(self, texts: pa.StringArray) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1) if texts else []

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self.sp.encode(words, num_threads=1)
        return np.array([i for x in each for i in x], self.dtype), np.array([len(x) for x in each], np.int64)

    def _pieces(self, text: str) -> list[str]:
        """Cut at spaces, which the pieces do not keep."""
        out, at = [], 0
        while len(text) - at > SLICE:
            cut = text.rfind(" ", at, at + SLICE)
            cut = cut if cut > at else text.find(" ", at + SLICE)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]


@lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    """One for each worker process: what it has learnt serves its next tasks too."""
    return WordIds(name)


@lru_cache(maxsize=2)
def piece_ids(name: str) -> PieceIds:
    return PieceIds(name)


class Pieces:
    """Pre-tokens of a byte-level vocabulary and how many pieces each one makes."""

    def __init__(self, name: str = "byte_bpe_50k.json") -> None:
        import json

        import public_tokenizers
        import regex

        self.tok = load(name)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        added = [a["content"] for a in json.loads(self.tok.to_str())["added_tokens"]]
        self.special = re.compile("|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and its special tokens (one piece each)."""
        if plain(text):
            return self.find(text), 0
        parts = self.special.split(text) if self.special else [text]
        out = []
        for p in parts:
            if p:
                out.extend(p[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(p))
        return out, len(parts) - 1

    def count(self, pre_tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(pre_tokens, add_special_tokens=False)]
