"""Token ids of whole texts with the tokenizers library, each distinct blank-separated part encoded once."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes, by a generous estimate, that a worker's remembered parts may take; beyond it they are forgotten and built anew.
REMEMBERED_BYTES = 192 << 20
#: About what a remembered part takes with its ids and its place in a table, and the longest part worth it.
PART_BYTES, LONGEST = 200, 64
#: Letters that stay single through normalization; the tokenizers' patterns cut between them and the signs.
LETTERS = "".join(c for c in map(chr, range(65, 256)) if c.isalpha() and c not in "ªµº")
SIMPLE = re.compile(rf"( ?)([{LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)")


class Encoder:
    """Encodes batches of texts.

    Neither pre-tokenizer joins characters across a single blank between other characters, so a text is
    cut at its blanks, every distinct part is encoded once and the ids are put together by position. Texts
    with two blanks in a row (white space may join there) or with the first signs of a special token are encoded as they are.
    """

    def __init__(self, path: str, keep_blank: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.keep_blank = keep_blank
        levels = ByteLevel(add_prefix_space=False, use_regex=False)
        lower = self.tokenizer.normalizer is not None
        self.bytes = str.maketrans({c: levels.pre_tokenize_str(c.lower() if lower else c)[0][0] for c in LETTERS + " "})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # place of a part's ids
        self.words: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        self.flat, self.start, self.held, self.passing = np.empty(0, np.int32), np.zeros(1, np.int32), 0, []

    def whole(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; a plain word with signs behind it goes straight to the model, which is faster."""
        out, odd, words, signs, tokenize, before = [], [], self.words, self.signs, self.tokenizer.model.tokenize, len(self.words)
        for i, part in enumerate(parts):
            found = SIMPLE.fullmatch(part)
            if found is None:
                odd.append(i)
                out.append(b"")
                continue
            blank, letters, tail = found.groups()
            word = blank + letters
            ids = words.get(word)
            if ids is None:
                ids = array("i", [t.id for t in tokenize(word.translate(self.bytes))]).tobytes()
                if len(word) <= LONGEST:
                    words[word] = ids
            if tail:
                end = signs.get(tail)
                if end is None:
                    end = array("i", self.whole([tail])[0]).tobytes()
                    if len(tail) <= LONGEST:
                        signs[tail] = end
                        self.held += PART_BYTES
                ids += end
            out.append(ids)
        self.held += (len(words) - before) * PART_BYTES
        for i, ids in zip(odd, self.whole([parts[i] for i in odd])):
            out[i] = array("i", ids).tobytes()
        return out

    def _places(self, parts: list[str]) -> np.ndarray:
        """Where the ids of each part lie; long parts stay known until the next call only."""
        if self.held > REMEMBERED_BYTES:
            self.forget()
        for part in self.passing:
            del self.known[part]
        keep = len(self.start) - len(self.passing)
        self.start = self.start[:keep]
        self.flat = self.flat[: self.start[-1]]
        known = self.known
        new = [p for p in parts if p not in known]
        if new:
            new.sort(key=lambda p: len(p) > LONGEST)  # passing parts last, so that they can be cut off
            self.passing = [p for p in new if len(p) > LONGEST]
            ids = self._encode(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            end = self.start[-1]
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.int32)])
            first = len(self.start) - 1
            known.update(zip(new, range(first, first + len(new))))
            self.start = np.concatenate([self.start, (end + np.cumsum(sizes)).astype(np.int32)])
            short = len(new) - len(self.passing)
            self.held += short * PART_BYTES
        else:
            self.passing = []
        return np.fromiter(map(known.__getitem__, parts), np.int32, len(parts))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, position where each text begins, with the end); null is the empty text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, "<|")).to_numpy(zero_copy_only=False)
        if odd.any():
            plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), column)
        else:
            plain = column
        lists = pc.split_pattern(plain, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        first = np.zeros(int(offsets[-1]), bool)
        first[offsets[:-1]] = True
        coded = lists.flatten().dictionary_encode()
        index, parts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if self.keep_blank:  # a part that doesn't begin its text begins with the blank
            code = index * np.int32(2) + first
            held = np.zeros(2 * len(parts), bool)
            held[code] = True
            used = np.flatnonzero(held)
            index = (np.cumsum(held, dtype=np.int32) - 1)[code]
            parts = [parts[c >> 1] if c & 1 else " " + parts[c >> 1] for c in used.tolist()]
        place = self._places(parts)
        begin = self.start[place]
        size = (self.start[place + 1] - begin)[index]
        total = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=total[1:])
        step = np.repeat(begin[index] - total[:-1], size)
        step += np.arange(len(step), dtype=np.int32)
        ids = self.flat[step]
        bounds = total[offsets].astype(np.int64)
        if odd.any():
            pieces = np.split(ids, bounds[1:-1])
            which = np.flatnonzero(odd).tolist()
            for i, own in zip(which, self.whole(column.take(pa.array(which)).to_pylist())):
                pieces[i] = np.array(own, np.int32)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
            ids = np.concatenate(pieces) if pieces else ids
        return ids, bounds
