"""Token ids of texts by a public tokenizer file.

Texts are cut before single spaces, where the tokenizer's own splitting always begins a new piece, so
the ids of the parts put together are those of the whole text. Each worker encodes a part once and
keeps the result, up to ``CACHED_PARTS``; further ones are encoded once per slice of texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PARTS = 400_000
#: Parts in one text handed to the tokenizer, and in one call: what it returns takes much more room than the ids.
ROW_PARTS, CALL_PARTS = 256, 4096
#: Bytes of text encoded at a time (a longer text alone).
SLICE_BYTES = 4 << 20
#: Texts with a space next to other white space are cut by the slower rule.
NEAR_SPACES = r" [\s\x0b\x1c-\x1f\x{85}\pZ]|[\s\x0b\x1c-\x1f\x{85}\pZ] "
CUT = re.compile(r"(?= \S)")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with one of these strings are encoded whole, since the tokenizer takes them out before it cuts.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab()
        space = self.tokenizer.id_to_token(self.tokenizer.encode(" ", add_special_tokens=False).ids[0])
        self.spaced = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in tokens.items() if token.startswith(space)]] = True
        #: The ids of words behind a space, and of other parts.
        self.after: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def after_space(self, words: list[str]) -> list[bytes]:
        """The ids of a space and each word, which holds none; words not in the cache are encoded many to a call."""
        found = list(map(self.after.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        # a space and visible text can stand in a row with others of its kind
        plain = [i for i in missing if (w := words[i]) and not (w[0].isspace() or w[-1].isspace())]
        for k in range(0, len(plain), CALL_PARTS):
            places = plain[k:k + CALL_PARTS]
            new = [words[i] for i in places]
            rows = [" " + " ".join(new[j:j + ROW_PARTS]) for j in range(0, len(new), ROW_PARTS)]
            encoded = self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in encoded])
            # the one space of such a part is its first character
            cuts = (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            raw = ids.tobytes()
            for i, begin, end in zip(places, cuts[:-1], cuts[1:], strict=True):
                found[i] = raw[begin:end]
        for i in missing:
            if found[i] is None:
                found[i] = self.whole(" " + words[i])
        self.after.update((words[i], found[i]) for i in missing[:self.room()])
        return found

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each part."""
        out = []
        for part in parts:
            if part[:1] == " " and part.count(" ") == 1:
                out += self.after_space([part[1:]])
                continue
            ids = self.cache.get(part)
            if ids is None:
                ids = self.whole(part)
                if self.room():
                    self.cache[part] = ids
            out.append(ids)
        return out

    def room(self) -> int:
        return max(0, CACHED_PARTS - len(self.after) - len(self.cache))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, NEAR_SPACES).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(texts, " ")
        at = words.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        dictionary = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        n = len(dictionary)
        first = at[:-1][np.diff(at) > 0]
        heads, place = np.unique(codes[first], return_inverse=True)
        codes[first] = n + place
        table = self.after_space(dictionary) + self.ids_of([dictionary[i] for i in heads])
        added = np.zeros(len(odd), dtype=bool)
        for token in self.added:
            added |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(odd | added)
        if len(rows):
            table += [(self.whole if added[i] else self._cut)(texts[int(i)].as_py()) for i in rows]
            keep = np.ones(len(codes), dtype=bool)
            for i in rows:
                keep[at[i] + 1:at[i + 1]] = False
            codes[at[rows]] = n + len(heads) + np.arange(len(rows))
            at = np.concatenate([[0], np.cumsum(keep)])[at]
            codes = codes[keep]
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        ids = np.frombuffer(b"".join(table), dtype="<u4")
        begin = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        index = np.repeat(begin[codes] - (ends - lengths), lengths)
        index += np.arange(len(index))
        return ids[index], np.concatenate([[0], ends])[at]

    def _cut(self, text: str) -> bytes:
        return b"".join(self.ids_of(CUT.split(text)))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each slice of the texts: its first row, all its ids, and where each text's ids start and end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
            ids, edges = self._slice(texts.slice(begin, end - begin))
            pa.default_memory_pool().release_unused()  # what a slice left would stay with the worker
            yield begin, ids, edges
            begin = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
