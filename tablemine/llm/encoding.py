"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts a worker remembers from call to call, the last used ones; bounds its memory, never the result.
PIECES = 300_000

_UNSAFE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
# Letters that end in a mark once composed and in lower case, so a stop behind them may belong to the mark's token.
_MARKED = (
    "\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69"
    "\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40\ufb41\ufb43\ufb44\ufb46-\ufb4e"
)
_STOPS = re.compile(rf"(?<=[^\W_{_MARKED}])(?=[.,;:!?])|(?<=\S)(?=\n)")
_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space before a space: such texts are cut one by one.
_ODD = rf"[{_BLANK}] "


def segments(text: str) -> list[str]:
    """``text`` cut wherever a space follows a character that is no white space; the first may be empty."""
    if _UNSAFE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


# Byte-level files write the bytes 33-126, 161-172 and 174-255 as those characters, the others as 256, 257, ... in order.
_KEPT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _KEPT]
BYTE_SYMBOLS = {b: 256 + i for i, b in enumerate(_OTHERS)}
_SYMBOLS = np.array([BYTE_SYMBOLS.get(b, b) for b in range(256)], "<u4")


def symbols(words: Sequence[str]) -> list[str]:
    """The UTF-8 bytes of each word as byte-level files spell them; no word holds a line end."""
    data = np.frombuffer("\n".join(words).encode(), np.uint8)
    return _SYMBOLS[data].tobytes().decode("utf-32-le").split(chr(BYTE_SYMBOLS[10]))


def _plain(piece: str) -> bool:
    """Whether ``piece`` is one word of letters up to U+00FF, maybe after a space: no tokenizer here parts or composes it."""
    body = piece[1:] if piece[:1] == " " else piece
    return body.isalpha() and (body.isascii() or max(body) < "\u0100")


def _unused(texts: pa.Array) -> str:
    """A character that no text holds, to mark cuts with."""
    return next(c for c in map(chr, chain(range(9), range(0xF0000, 0x10FFFE))) if not pc.any(pc.match_substring(texts, c)).as_py())


def _parted(pieces: pa.Array, mark: str) -> pa.ListArray:
    """Each piece cut as by ``_STOPS``, all at once; no piece holds the mark."""
    stop = pc.match_substring_regex(pieces, r"[.,;:!?\n]")
    cut = pc.replace_substring_regex(pieces.filter(stop), rf"([^\P{{L}}{_MARKED}]|\p{{N}})([.,;:!?])", rf"\1{mark}\2")
    cut = pc.replace_substring_regex(cut, rf"([^{_BLANK}])\n", f"\\1{mark}\n")
    return pc.split_pattern(pc.replace_with_mask(pieces, stop, cut), mark)


def _runs(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs ``at`` of ``flat`` one after the other, where each ends); ``size`` holds the lengths of all runs of ``flat``."""
    n = size[at]
    end = np.cumsum(n)
    start = (np.cumsum(size) - size)[at]
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - n), n)], end


class Pieces:
    """Encodes texts as little-endian unsigned 32-bit ids.

    Where the tokenizer itself always parts a text, it may be cut without changing its tokens: before white space that
    follows other characters, and between a letter or digit (but for those that end in a mark) and a stop. That holds for
    byte-level files that split by the usual pattern and for files that drop white space. Others encode every text whole.
    Special strings are never cut. A text is cut before spaces; each distinct piece of a call is cut further, so that the
    tokenizer sees each word without its stops. A word of plain letters is left whole by all steps before the tokenizer's model,
    so the model alone encodes it, in half the time. What is known lies in arrays: all look-ups of a call are one, and a part
    takes about as many bytes as it and its ids have.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = spec.get("pre_tokenizer") or {}
        kinds = splits.get("pretokenizers") or [splits]
        byte_level = [k for k in kinds if k.get("type") == "ByteLevel"]
        drops = any(k.get("type") == "Split" and k.get("behavior") == "Removed" and k.get("invert") for k in kinds)
        own = bool(byte_level) and not byte_level[0].get("add_prefix_space") and byte_level[0].get("use_regex", True) and not spec.get("normalizer")
        uncut = all(len(_STOPS.split(t["content"])) == 1 and " " not in t["content"] for t in spec.get("added_tokens") or [])
        self.separable = (own or drops) and uncut
        self.spell = None
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if self.separable and spec["model"].get("type") == "BPE" and not any(t["content"].isalpha() for t in spec.get("added_tokens") or []):
            if own:
                self.spell = symbols
            elif byte_level and not byte_level[0].get("add_prefix_space") and len(kinds) == 2 and "Lowercase" in steps and {*steps} <= {"NFC", "Replace", "Lowercase"}:
                self.spell = lambda words: symbols("\n".join(words).replace(" ", "").lower().split("\n"))
        self.width = self.tokenizer.get_vocab_size()
        self.parts = pa.array([], pa.large_string())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.calls, self.used = 0, np.zeros(0, np.int64)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text, begin, end and padding left out; NULL is empty.

        The texts of a call are cut together, each distinct piece is cut further once, each distinct part is looked up once,
        and the ids are laid out by arrays.
        """
        self._trim()
        clean = [t or "" for t in texts]
        rows = pa.array(clean, pa.large_string())
        even = np.asarray(pc.invert(pc.match_substring_regex(rows, _ODD))) if self.separable else np.zeros(len(clean), bool)
        out = [b""] * len(clean)
        odd = np.flatnonzero(~even).tolist()
        if odd:
            cut = [segments(clean[i]) if self.separable else [clean[i]] for i in odd]
            self._deal(out, odd, pa.array(chain.from_iterable(cut), pa.large_string()), np.fromiter(map(len, cut), np.int64, len(cut)))
        if len(odd) < len(clean):
            rows = rows.filter(pa.array(even))
            mark = _unused(rows)
            split = pc.split_pattern(pc.replace_substring(rows, " ", mark + " "), mark)
            self._deal(out, np.flatnonzero(even).tolist(), pc.list_flatten(split), np.asarray(pc.list_value_length(split)))
        return out

    def _deal(self, out: list[bytes], rows: list[int], pieces: pa.Array, counts: np.ndarray) -> None:
        """Give each of the ``rows`` the ids of its ``counts`` pieces."""
        coded = pieces.dictionary_encode()
        if self.separable:
            parted = _parted(coded.dictionary, _unused(coded.dictionary))
            ids, end = self._ids(pc.list_flatten(parted))
            last = np.cumsum(np.asarray(pc.list_value_length(parted)))
        else:
            ids, end = self._ids(coded.dictionary)
            last = np.arange(1, len(end) + 1)
        size = np.diff(np.r_[0, end][np.r_[0, last]])
        ids, end = _runs(ids, size, np.asarray(coded.indices))
        cut = np.r_[0, end][np.r_[0, np.cumsum(counts)]].tolist()
        for i, a, b in zip(rows, cut, cut[1:]):
            out[i] = ids[a:b].tobytes()

    def _ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts one after the other, where those of each part end)."""
        coded = parts.dictionary_encode()
        at = np.array(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.parts), -1))
        self.calls += 1
        self.used[at[at >= 0]] = self.calls
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.parts) + np.arange(len(new))
            self._learn(coded.dictionary.take(pa.array(new)))
        return _runs(self.flat, self.size, at[np.asarray(coded.indices)])

    def _learn(self, new: pa.Array) -> None:
        """Encode parts met for the first time and remember them."""
        parts = new.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist
        found: list[list[int] | None] = [None] * len(parts)
        if self.spell is not None:
            tokens, plain = self.tokenizer.model.tokenize, [i for i, p in enumerate(parts) if _plain(p)]
            for i, p in zip(plain, self.spell([parts[i] for i in plain])):
                found[i] = [t.id for t in tokens(p)]
        other = [i for i, x in enumerate(found) if x is None]
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([parts[i] for i in some], add_special_tokens=False)):
                found[i] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))])
        self.size, self.used = np.concatenate([self.size, size]), np.concatenate([self.used, np.full(len(new), self.calls)])
        self.parts = pa.concat_arrays([self.parts, new])

    def _trim(self) -> None:
        """Forget the parts used longest ago, beyond PIECES."""
        if len(self.parts) > PIECES:
            keep = np.argpartition(-self.used, PIECES)[:PIECES]
            self.flat, _ = _runs(self.flat, self.size, keep)
            self.size, self.used, self.parts = self.size[keep], self.used[keep], self.parts.take(pa.array(keep))


def pieces_of(path: str) -> Pieces:
    """The worker's own encoder for ``path``; workers are reused from task to task, and so is what they have encoded."""
    shelf = sys.modules.setdefault("_tablemine_worker", types.ModuleType("_tablemine_worker"))
    found = shelf.__dict__.setdefault("encoders", {})
    if path not in found:
        found[path] = Pieces(path)
    return found[path]


def forget() -> None:
    """Free what this worker's encoders remember, for a later stage that doesn't encode."""
    shelf = sys.modules.get("_tablemine_worker")
    if shelf is not None and shelf.__dict__.get("encoders"):
        shelf.__dict__["encoders"].clear()
        pa.default_memory_pool().release_unused()


def batches(texts: Iterable, most_chars: int = 4_000_000) -> Iterable[tuple[int, int]]:
    """(from, to) of runs of texts with about ``most_chars`` characters each, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most_chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(texts: pa.Array, most_bytes: int = 4_000_000) -> Iterable[tuple[int, list[str | None]]]:
    """(from, texts) of runs of about ``most_bytes`` bytes each, one text at least; only the run at hand is Python strings."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cut = [0, *(np.flatnonzero(np.diff(end // most_bytes)) + 1).tolist(), len(texts)]
    for i, j in zip(cut, cut[1:]):
        if i < j:
            yield i, texts.slice(i, j - i).to_pylist()
