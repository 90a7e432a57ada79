"""Exact token ids of whole texts, fast on text whose words recur."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of bytes, for where a text is cut into pieces.
_OTHER, _LETTER, _SPACE, _APOSTROPHE, _HIGH = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _LETTER
_KINDS[[*b" \t\n\x0b\x0c\r"]] = _SPACE
_KINDS[ord("'")] = _APOSTROPHE
_KINDS[128:] = _HIGH
#: White space that is not one of the six above, or that some call white space: it may join a run of spaces.
_odd_space = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_spaced_word = re.compile(r" ?\S+").fullmatch
#: Pieces that are encoded as one text.
_TOGETHER = 256
_made: dict[tuple, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned integers: two bytes an id where the vocabulary allows it, else four.

    The two supported pre-tokenizers never join what stands before a run of spaces with what follows, nor a letter with a
    sign or a digit beside it (but for letters behind an apostrophe).  So a text's ids are those of its pieces in turn, and a
    piece that was met before need not be encoded again.  Pieces are found and counted in Arrow and NumPy; Python sees each
    distinct one once a batch.  Any other tokenizer file, and texts with unusual white space, are encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: Ids of pieces, in two generations of at most `most` pieces and a batch's.
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kind, names = made.get("pre_tokenizer") or {}, [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        inner = (kind.get("pretokenizers") or [{}])[0]
        self.style, self.suffix = "whole", made["model"].get("end_of_word_suffix")
        if kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not made.get("normalizer"):
            self.style = "leading"
        elif kind.get("type") == "Sequence" and inner.get("type") == "Split" and inner.get("behavior") == "Removed" and inner.get("invert"):
            self.style = "dropped"
        self.lower = "Lowercase" in names
        #: Ids that end a word (style dropped) or stand for a line's end (style leading).
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.style == "dropped" and self.suffix:
            self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(self.suffix)]] = True
        elif self.style == "leading" and len(line := self.tokenizer.encode("\n", add_special_tokens=False).ids) == 1:
            self.closing[line] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width.itemsize == 2 else "I"  # native order: little-endian on every platform Spark runs on here
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _direct(self, texts: list[str]) -> list[bytes]:
        return self._raw(texts) if texts else []

    def _together(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, many encoded as the lines of one text; where the ids don't show one end a piece, one by one."""
        groups = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        out: list[bytes] = []
        for group, raw in zip(groups, self._direct(["\n".join(g) + "\n" for g in groups]), strict=True):
            ends = np.flatnonzero(self.closing[np.frombuffer(raw, self.width)])
            if len(ends) != len(group):
                out += self._direct(group)
                continue
            to = (ends + (self.style == "dropped")) * self.width.itemsize
            begin = np.concatenate(([0], (ends[:-1] + 1) * self.width.itemsize))
            out += [raw[i:j] for i, j in zip(begin.tolist(), to.tolist(), strict=True)]
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        """One word of letters ends once in style dropped; a word behind at most one space holds no line's end."""
        plain = [p.isalpha() if self.style == "dropped" else _spaced_word(p) is not None for p in new]
        found = iter(self._together(list(compress(new, plain))))
        others = iter(self._direct([p for p, x in zip(new, plain, strict=True) if not x]))
        return [next(found if x else others) for x in plain]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        if len(self.seen) > self.most:
            self.old, self.seen = self.seen, {}
        out = list(map(self.seen.get, pieces))
        missing = [k for k, x in enumerate(out) if x is None]
        older = [self.old.get(pieces[k]) for k in missing]
        new = [k for k, x in zip(missing, older, strict=True) if x is None]
        for k, x in zip(missing, older, strict=True):
            out[k] = x
        for k, x in zip(new, self._learn([pieces[k] for k in new]), strict=True):
            out[k] = x
        self.seen.update((pieces[k], out[k]) for k in missing)
        return out

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts end to end, and for each text the number of pieces up to its end."""
        limits = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[limits[0] : limits[-1]]
        limits -= limits[0]
        kinds = _KINDS[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        kinds[latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]] = _LETTER  # the last byte of a letter
        was, now = kinds[:-1], kinds[1:]
        space = kinds == _SPACE
        first = np.empty(len(data), bool)
        first[0] = True
        first[1:] = (now != was) & (space[1:] | (was == _LETTER) & ((now == _OTHER) | (now == _APOSTROPHE)) | (was == _OTHER) & (now == _LETTER) & (data[1:] < 128))
        first[limits[:-1][limits[:-1] < len(data)]] = True
        at = np.flatnonzero(first)
        upto = np.searchsorted(at, limits[1:], side="left")
        if self.style == "dropped":
            gone = np.cumsum(space, dtype=np.int32)
            at = at - (gone[at] - space[at])
            data = data[~space]
            if self.lower:
                data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
        offsets = np.append(at, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))), upto

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) end to end, and where each text's end."""
        texts = texts.cast(pa.string()).fill_null("")
        if self.style == "whole" or not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
            return self._laid(self._direct(texts.to_pylist()))
        odd = pc.match_substring_regex(texts, _odd_space) if self.style == "leading" else None
        if odd is not None and pc.any(odd).as_py():
            whole = self._direct(texts.filter(odd).to_pylist())
            ids, ends = self.flat(pc.if_else(odd, "", texts))
            parts, direct = np.split(ids, ends[:-1]), iter(whole)
            return self._laid([next(direct) if x else p.tobytes() for x, p in zip(odd.to_pylist(), parts, strict=True)])
        pieces, upto = self._pieces(texts)
        coded = pieces.dictionary_encode()
        own = self._ids_of(coded.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(own), self.width)
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // self.width.itemsize
        which = coded.indices.to_numpy()
        counts = lengths[which]
        ends = np.cumsum(counts)
        places = np.repeat((np.cumsum(lengths) - lengths)[which] - (ends - counts), counts) + np.arange(ends[-1])
        return ids[places], np.concatenate(([0], ends))[upto]

    def _laid(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(raw), self.width), np.cumsum([len(x) // self.width.itemsize for x in raw], dtype=np.int64)

    def closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As flat(), with end_id behind each text's ids."""
        ids, ends = self.flat(texts)
        return np.insert(ids, ends, self.width.type(end_id)), ends + np.arange(1, len(ends) + 1)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        return [p.tobytes() for p in np.split(ids, ends[:-1])] if texts else []


def encoder(path: str, most: int = 400_000) -> Encoder:
    """One Encoder for each worker process, file and size of its caches."""
    if (path, most) not in _made:
        _made[path, most] = Encoder(path, most)
    return _made[path, most]
