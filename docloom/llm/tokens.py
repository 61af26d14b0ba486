"""Token ids of whole texts by a ``tokenizers`` file, with a bounded memo of words.

The regular expression of a byte-level BPE pre-tokenizer never joins

* a space to the character before it, if non-space characters stand on both sides,
* a line break to what is around it, if it is single, or double before other text,
* a letter or digit to a run of marks after it that ends the word.

So texts are cut there, each distinct word of a batch is looked up once, and only new words
go to the library, many in one call.  Texts with other white space, and texts that hold the
string of an added token, are encoded whole.  The memo only saves time: once it is full,
further words go to the library in each batch.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

MEMO = 200_000
#: Most words of a corpus occur once: a word is remembered when it, or another one with
#: the same place among so many, has come before.
SEEN = (1 << 23) - 1
#: Words that are encoded as one text; their ids are told apart by what stands between.
TOGETHER = 2000
#: Characters of text that are cut into words at once.
PART_CHARS = 4 << 20
#: What makes cutting unsafe: runs of white space that hold a space or three line breaks,
#: and white space other than spaces and line breaks.
_UNSAFE = ("  ", " \n", "\n ", "\n\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
#: A word with this sign before it has no space before it in the text.
_BARE = "\r"
#: A letter or digit, the marks after it, and the end of the word.
_ENDS = f"([{''.join(c for c in map(chr, range(0x250)) if c.isalnum())}])([{re.escape(string.punctuation)}]+)( |$)"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, end_id: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        words = self.library.get_vocab(with_added_tokens=True)
        self.line = words.get("Ċ")  # the byte-level sign for a line break
        self.cuttable = "ByteLevel(add_prefix_space=False" in str(self.library.pre_tokenizer) and "use_regex=True" in str(self.library.pre_tokenizer) and self.library.normalizer is None and self.line is not None
        self.unsafe = (*_UNSAFE, *(x.content for x in self.library.get_added_tokens_decoder().values()))
        self.end = np.array([end_id], "<u4").tobytes()
        self.opens = np.zeros(max(words.values(), default=0) + 1, bool)
        self.opens[[i for x, i in words.items() if x.startswith("Ġ")]] = True  # the sign for a space
        self.memo: dict[str, bytes] = {_BARE: b"", "\n": np.array([self.line or 0], "<u4").tobytes()}
        self.seen = bytearray(SEEN + 1)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _together(self, words: list[str], spaced: bool) -> list[bytes]:
        """The ids of each word, with a space before it or bare."""
        out = []
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            data = self._encode([" " + " ".join(part) if spaced else "\n".join(part)])[0]
            ids = np.frombuffer(data, "<u4")
            at = np.flatnonzero(self.opens[ids] if spaced else ids == self.line) * 4
            left, right = (at.tolist(), at.tolist()[1:]) if spaced else ([0, *(at + 4).tolist()], at.tolist())
            right.append(len(data))
            whole = len(left) == len(part) and not left[0]
            out += [data[i:j] for i, j in zip(left, right)] if whole else self._encode([" " + x for x in part] if spaced else part)
        return out

    def _values(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words: a word follows a space, ``_BARE`` and a word nothing,
        and a line break stands for itself."""
        memo, seen = self.memo, self.seen
        out = list(map(memo.get, words))
        spaced, bare = [], []
        for at, ids in enumerate(out):
            if ids is None:
                (bare if words[at][:1] == _BARE else spaced).append(at)
        for places, by_space in ((spaced, True), (bare, False)):
            own = [words[at] for at in places]
            for at, x, ids in zip(places, own, self._together(own if by_space else [x[1:] for x in own], by_space)):
                out[at] = ids
                if len(memo) < MEMO:
                    k = hash(x) & SEEN
                    if seen[k] or len(memo) < MEMO // 2:
                        memo[x] = ids
                    seen[k] = 1
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that may be cut."""
        data = pa.array([_BARE + x.replace("\n", f" \n {_BARE}") for x in texts], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring_regex(data, _ENDS, rf"\1 {_BARE}\2\3"), " ")
        coded = lists.values.dictionary_encode()
        # the words hold no space: one string that is split again is faster than a list
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        values, which = self._values(pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")), coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int32, len(values)) >> 2
        first, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
        stops = np.cumsum(n)
        ids = ids[np.repeat((first - (stops - n)).astype(np.int32), n) + np.arange(len(n) and stops[-1], dtype=np.int32)]
        ends = np.r_[0, stops][lists.offsets.to_numpy()] * 4
        data = ids.tobytes()
        return [data[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, the end id included."""
        cut, whole, out, size = [], [], {}, 0
        for i, text in enumerate(texts):
            if not self.cuttable or text[:1] == " " or text[-1:] == " " or text[-2:] == "\n\n" or any(x in text for x in self.unsafe):
                whole.append(i)
                continue
            cut.append(i)
            size += len(text)
            if size >= PART_CHARS:
                out.update(zip(cut, self._cut([texts[k] for k in cut])))
                cut, size = [], 0
        if cut:
            out.update(zip(cut, self._cut([texts[k] for k in cut])))
        out.update(zip(whole, self._encode([texts[k] for k in whole])))
        return [out[i] + self.end for i in range(len(texts))]


_encoders: dict[tuple[str, int], Encoder] = {}
common.drops.append(_encoders.clear)


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per worker process, as long as its tasks are of one stage."""
    common.begin()
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
