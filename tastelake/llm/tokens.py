"""Token ids of whole texts by the tokenizers library, in Arrow batches.

Natural text repeats its words, so a batch is cut at blanks, line ends and marks where no rule of the tokenizer looks across,
each different piece is encoded once, and the ids are put together again with NumPy. Cuts are left out next to
anything unusual (further white space, characters that may be white space), where the longer piece goes to the library as it is.
Strings of added tokens (such as an end mark) in a text become those tokens, as the library does it.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tastelake.llm.common import bytes_of, spread

#: Pieces a worker remembers between batches; the first ones stay, which are the frequent ones.
MEMO_PIECES = 500_000
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of pieces: each non-empty text's start, blanks, line ends and the place after them, marks after a letter.

    A blank or line end counts only between two plain characters of one text: nothing at or below a blank, no DEL, and
    nothing of a multi-byte character whose first byte also begins white space (C2, E1, E2, E3). A mark of ``.,;:!?`` counts
    after an ASCII letter or a letter of the bytes C3 xx: word rules of both kinds end a run of letters there.
    """
    odd = np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))
    odd[1:] |= odd[:-1]
    odd[1:] |= odd[:-1]
    plain = (data > 0x20) & (data != 0x7F) & ~odd
    line = data == 0x0A
    safe = (data == 0x20) | line
    safe[:1] = safe[-1:] = False
    safe[1:-1] &= plain[:-2] & plain[2:]
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    safe[starts] = False
    safe[starts[1:] - 1] = False
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    mark = np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
    mark[1:] &= letter[:-1]
    mark[:1] = False
    line &= safe
    safe |= mark
    safe[1:] |= line[:-1]
    safe[starts] = True
    return np.flatnonzero(safe)


def byte_alphabet() -> dict[int, str]:
    """The printable characters that byte-level models use: printable Latin-1 for itself, the other bytes from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Ids of texts by one tokenizer file.

    The cuts and the short way for single words hold for two kinds of pipeline: byte level with its own word rule, and
    lower-cased words with ends. Any other file gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        kind = json.loads(self.tokenizer.to_str())
        before, split = kind["normalizer"], kind["pre_tokenizer"] or {}
        steps = [x["type"] for x in split.get("pretokenizers", [split or {"type": ""}])]
        self.byte_level = before is None and steps == ["ByteLevel"] and split["use_regex"] and not split["add_prefix_space"]
        self.word_level = (
            before is not None
            and [x["type"] for x in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and steps == ["Split", "ByteLevel"]
        )
        # The library takes added tokens out of a text first; texts are cut only if no cut can fall into one of them.
        plain = all(
            not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and not set(t["content"]) & set(" \n.,;:!?")
            for t in kind["added_tokens"]
        )
        self.byte_level, self.word_level = self.byte_level and plain, self.word_level and plain
        letters = byte_alphabet()
        self.letters = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(256)}

    def one_word(self, piece: str) -> bytes | None:
        """Ids of a blank or line end and Latin-1 letters, which is one word to both rules; None for anything else."""
        word = piece[1:] if piece[0] in " \n" else piece
        if not word.isalpha() or not (word.isascii() or max(word) <= "\xff"):
            return None
        if self.word_level:
            word = word.lower()
        elif piece[0] == "\n":
            return None
        elif piece[0] == " ":
            word = piece
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.translate(self.letters))]).tobytes()

    def pieces(self, values: list[str]) -> list[bytes]:
        memo, one_word = self.memo, self.one_word
        found = [memo.get(v) for v in values]
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = one_word(values[i])
        rest = [i for i in missing if found[i] is None]
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            for i, x in zip(part, self.tokenizer.encode_batch_fast([values[i] for i in part], add_special_tokens=False)):
                found[i] = array("I", x.ids).tobytes()
        for i in missing:
            if len(memo) >= MEMO_PIECES:
                break
            if len(values[i]) <= 40:
                memo[values[i]] = found[i]
        return found

    def encode(self, column: pa.Array, end_id: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by ``end_id``, and the n + 1 offsets. No nulls in ``column``."""
        data, offsets = bytes_of(column)
        n = len(column)
        whole = not (self.byte_level or self.word_level)
        places = offsets[:-1][offsets[1:] > offsets[:-1]] if whole else cut_places(data, offsets)
        if len(places):
            bounds = np.append(places, len(data)).astype(np.int32)
            pieces = pa.StringArray.from_buffers(len(places), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
            coded = pieces.dictionary_encode()
            unique = self.pieces(coded.dictionary.to_pylist())
            lengths = np.array([len(x) for x in unique], np.int64) // 4
            flat = np.frombuffer(b"".join(unique), np.uint32)
            begins = np.cumsum(lengths) - lengths
            index = coded.indices.to_numpy()
            count = lengths[index]
            ids = flat[spread(begins[index], count)]
            done = np.concatenate([[0], np.cumsum(count)])
            ends = done[np.searchsorted(places, offsets)]
        else:
            ids, ends = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if end_id is None:
            return ids, ends
        out = np.full(len(ids) + n, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends[1:] + np.arange(n)] = False
        out[keep] = ids
        return out, ends + np.arange(n + 1)


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Every slice of the batches with its ids and offsets, the end id 0 included."""
    from tastelake.llm.common import slices

    own = encoder(path)
    for part in slices(batches, column, 8 << 20):
        ids, offsets = own.encode(part.column(column))
        yield part, ids, offsets
