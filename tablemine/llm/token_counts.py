"""Token counts by a transducer compiled from the tokenizer's merges; chunks of long texts compose by a parallel scan.

A byte-level tokenizer splits a text by a pattern and joins bytes within each part by merges in order of rank. The joined
result of a prefix of a part is fixed by its last token, and a token may follow another exactly if the two, spelled out and
merged anew, give themselves again. So a left-to-right machine over bytes suffices: its state holds the bytes that a token
could still reach back to and the last tokens at those places; its transitions carry how many tokens the byte adds. States
are made when first reached and shared by all parts.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.llm.common import written
from tablemine.llm.encoding import batches, segments

# Fixed value: the pattern by which byte-level files with their own splitting part a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Above every rank of a merge.
NEVER = 1 << 60
#: Code points in a chunk; longer texts are spread over tasks.
CHUNK = 65_536
#: Maps of chunks that one step of the scan composes.
FAN = 256
#: States and remembered parts after which a worker starts afresh; bounds its memory, never the result.
STATES, PARTS = 300_000, 700_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: itself if visible, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Deterministic, over the bytes of one part; ``steps[state][byte]`` is (next state, tokens added)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        raw = lambda t: bytes(byte_of[c] for c in t)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.spelled = {i: t for t, i in self.tokens.items()}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.parts = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.follows: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, bool], list] = {}
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        # a state: bytes in reach, and for each place in them the token that ends there (-1: the part begins) and its count
        self.states: list[tuple[bytes, tuple]] = [(b"", ((-1, 0),))]
        self.numbers = {self.states[0]: 0}

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of ``data`` by the merges themselves."""
        out = [data[i : i + 1] for i in range(len(data))]
        while len(out) > 1:
            rank, i = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(out, out[1:])))
            if rank == NEVER:
                break
            out[i : i + 2] = [out[i] + out[i + 1]]
        return out

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """(bytes, rank of the merge that takes them in) from the outermost byte of ``token`` up to itself, on one side."""
        data = self.spelled[token]
        if self.merged(data) != [data]:
            return []  # the merges never give this token
        chain, rank = [], NEVER
        while True:
            chain.append((data, rank))
            if len(data) == 1:
                return chain[::-1]
            rank, k = min((self.ranks.get((data[:k], data[k:]), NEVER), k) for k in range(1, len(data)))
            data = data[k:] if right else data[:k]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of tokens ``a`` and ``b`` while both are being merged, lowest rank first.

        At the border stand the two outermost parts that are merged so far; both grow along one side of their token. The
        border holds unless the pair across it comes before the next merge on either side; of equal ranks the left one comes first.
        """
        found = self.follows.get((a, b))
        if found is not None:
            return found
        if len(self.follows) > PARTS:
            self.follows = {}
        for token, side in ((a, True), (b, False)):
            if (token, side) not in self.spines:
                self.spines[token, side] = self._spine(token, side)
        left, right = self.spines[a, True], self.spines[b, False]
        i = j = 0
        holds = bool(left) and bool(right)
        while holds:
            (x, up), (y, down) = left[i], right[j]
            across = self.ranks.get((x, y), NEVER)
            if across < up and across <= down and across < NEVER:
                holds = False
            elif up == down == NEVER:
                break
            elif up <= down:
                i += 1
            else:
                j += 1
        self.follows[a, b] = holds
        return holds

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        reach, ends = self.states[state]
        data = reach + bytes([byte])
        for at in range(len(data)):
            token = self.tokens.get(data[at:])
            if token is not None and ends[at] is not None and (ends[at][0] < 0 or self.may_follow(ends[at][0], token)):
                break
        else:
            raise ValueError(f"byte {byte} has no token")
        added = ends[at][1] + 1
        first = next(i for i in range(len(data) + 1) if data[i:] in self.prefixes)
        kept = data[first:]
        places = [*ends[first:], (token, added)]
        new = (kept, tuple((e[0], e[1] - added) if e is not None and kept[i:] in self.prefixes else None for i, e in enumerate(places)))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
            self.steps.append({})
        self.steps[state][byte] = (number, added)
        return number, added

    def part(self, data: bytes) -> int:
        """Tokens of one part."""
        if len(self.states) > STATES:
            self._reset()
        state = total = 0
        steps = self.steps
        for b in data:
            step = steps[state].get(b)
            state, added = step if step is not None else self._compile(state, b)
            total += added
        return total

    def _segment(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            total, known = 0, self.known
            for p in self.parts.findall(text):
                n = known.get(p)
                if n is None:
                    n = known[p] = self.part(p.encode())
                total += n
            return total
        marks = len(self.special.findall(text))
        return marks + sum(self._segment(x) for x in self.special.split(text))

    def count(self, cut: list[str]) -> int:
        """Tokens of a text given as its segments."""
        return sum(map(self.known.__getitem__, cut))

    def learn(self, cuts: list[list[str]]) -> None:
        """Make sure the segments are known."""
        new: set[str] = set()
        for c in cuts:
            new.update(c)
        if len(self.known) + len(new) > PARTS:
            self.known = {}
        for s in new.difference(self.known):
            self.known[s] = self._segment(s)

    def total(self, text: str) -> int:
        cut = segments(text)
        self.learn([cut])
        return self.count(cut)


# --- state maps of chunks: a text without a safe cut, or (text before the first cut, tokens between, text after the last) ---


def chunk_map(t: Transducer, text: str) -> tuple[str, int, str | None]:
    """What ``text`` does to whatever comes before it. The third part is None if the text has no safe cut."""
    cut = segments(text)
    if len(cut) > 1 and not cut[0]:
        cut[:2] = [cut[1]]  # what stands before a leading space isn't known here
    if len(cut) == 1:
        return cut[0], 0, None
    t.learn([cut])
    return cut[0], t.count(cut[1:-1]), cut[-1]


def compose(t: Transducer, a: tuple, b: tuple) -> tuple:
    """The map of ``a`` followed by ``b``; associative."""
    (ah, an, at), (bh, bn, bt) = a, b
    if at is None and bt is None:
        return chunk_map(t, ah + bh)
    middle = chunk_map(t, (ah if at is None else at) + bh)
    if at is not None and bt is not None:
        return ah, an + finish(t, middle) + bn, bt
    if middle[2] is None:
        return (middle[0], bn, bt) if at is None else (ah, an, middle[0])
    if at is None:
        return middle[0], middle[1] + t.total(middle[2]) + bn, bt
    return ah, an + t.total(middle[0]) + middle[1], middle[2]


def finish(t: Transducer, m: tuple) -> int:
    """Tokens of a text that is all there is."""
    return t.total(m[0]) + m[1] + (0 if m[2] is None else t.total(m[2]))


def transducer(path: str) -> Transducer:
    """The worker's own transducer; what is compiled stays for its later tasks."""
    shelf = sys.modules.setdefault("_tablemine_worker", types.ModuleType("_tablemine_worker"))
    found = shelf.__dict__.setdefault("transducers", {})
    if path not in found:
        found[path] = Transducer(path)
    return found[path]


def token_counts(df: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``df``: tokens of the whole text, without added begin or end.

    ``tokenizer`` is a byte-level vocabulary file with merges. Texts up to ``chunk`` code points are counted where they lie.
    Longer ones are cut there, the chunks spread over all tasks, each turned into its state map, and the maps composed FAN at
    a time: two rounds join 65,536 chunks, more than a text can have. NULL and empty texts have no tokens. Special strings in
    a text count as one token, as in the library. Repeated rows and NULL keys are counted like any other row.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.length("text") > chunk

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for b in parts:
            texts, counts = b.column(1).to_pylist(), []
            for i, j in batches(texts):
                cuts = [segments(x) for x in texts[i:j]]
                machine.learn(cuts)
                counts += map(machine.count, cuts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    short = rows.where(~long).mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long")

    numbered = rows.where(long).select("doc_id", "n_bytes", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), 0).alias("chunks"))
    numbered = numbered.withColumn("row", F.monotonically_increasing_id())
    chunks = written(numbered.select("row", "doc_id", "n_bytes", F.posexplode("chunks").alias("k", "chunk")), "chunks")

    def maps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for b in parts:
            head, n, tail = zip(*[chunk_map(machine, x) for x in b.column(4).to_pylist()]) if b.num_rows else ((), (), ())
            arrays = [pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], *arrays], ["row", "doc_id", "n_bytes", "k", "head", "n", "tail"])

    mapped = chunks.repartition("row", "k").mapInArrow(maps, f"row long, doc_id {kind}, n_bytes long, k int, head string, n long, tail string")

    def fold(group: pd.DataFrame):
        machine, group = transducer(tokenizer), group.sort_values("k")
        out = None
        for head, n, tail in zip(group["head"], group["n"], group["tail"]):
            m = (head, int(n), tail if isinstance(tail, str) else None)
            out = m if out is None else compose(machine, out, m)
        return machine, out

    def step(group: pd.DataFrame) -> pd.DataFrame:
        _, (head, n, tail) = fold(group)
        return pd.DataFrame({"row": group["row"].iloc[:1], "doc_id": group["doc_id"].iloc[:1], "n_bytes": group["n_bytes"].iloc[:1],
                             "k": [int(group["k"].iloc[0]) // FAN], "head": [head], "n": [n], "tail": [tail]})

    def last(group: pd.DataFrame) -> pd.DataFrame:
        machine, m = fold(group)
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "n_bytes": group["n_bytes"].iloc[:1], "n_tokens": [finish(machine, m)]})

    folded = mapped.groupBy("row", (F.col("k") / FAN).cast("int").alias("block")).applyInPandas(step, mapped.schema)
    totals = folded.groupBy("row").applyInPandas(last, f"doc_id {kind}, n_bytes long, n_tokens long")
    return short.unionByName(totals)
