"""Secrets in texts: fixed patterns, and strings in sensitive places that zstandard can't tell from anything around them."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemine.llm.vocabulary import counted, frequent, word_table

#: An identifier of the corpus is in the dictionary if it makes up 1 / IDENTIFIERS of all: so there are at most that many.
IDENTIFIERS = 8192
#: Code points around a candidate that it is compared with, on each side.
AROUND = 512
#: Code points behind a sensitive word in which a candidate may begin.
REACH = 80
#: Marginal bytes per byte from which a candidate is reported.
NOVELTY = 0.9
#: Longest candidate that is measured as a whole; of longer ones, every piece of this length is measured.
PIECE = 4096

# The patterns of the base kinds, in the order of their names, and the least code points of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

# Words that announce a secret, and what a candidate looks like.
SENSITIVE = re.compile(
    r"passw|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|authoriz|bearer|client[ _-]?id|signature|cookie|AKIA",
    re.IGNORECASE | re.ASCII,
)
LEAST_CANDIDATE = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_~!@%^*$-]{12,}={0,2}")
#: Texts with none of these hold no span; RE2 looks for all at once.
ANY = "(?i)" + SENSITIVE.pattern + "|[0-9a-f]{24}"

# Identifiers and phrases of code and settings that the dictionary begins with.
CODE = (
    "abstract assert async await boolean break case catch class const continue def default delete elif else enum except export extends false final finally float for "
    "from function global if implements import in instanceof int interface is lambda let long namespace new none not null object or package pass private protected "
    "public raise return select self static string struct super switch this throw throws true try type undefined union unsigned using var void volatile where while "
    "with yield username password passwd secret token api_key apikey access_key private_key client_id client_secret credential authorization bearer signature "
    "cookie session localhost http:// https:// www. .com .org .net .json .yaml .html index.html config settings environment variable example placeholder changeme "
    "your_password_here your_token_here your_api_key_here insert_your_key_here xxxxxxxxxxxxxxxxxxxxxxxx 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ -----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- -----BEGIN PUBLIC KEY----- -----END PUBLIC KEY-----"
)

_LETTERS = word_table(str.isalpha, lower=False)


def identifiers(text: bytes) -> list[bytes]:
    """The words that identifiers are made of: letters in one case, but for the first. Pieces of random strings are seldom such."""
    return [w for w in text.translate(_LETTERS).split() if len(w) > 2 and (w[1:].islower() or w.isupper())]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlaps within a kind, in that order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def odd(s: str) -> bool:
    """Whether a string mixes kinds of characters as words and numbers don't: digits with letters, or capitals inside."""
    inner = s[1:]
    return (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or (any(c.isupper() for c in inner) and any(c.islower() for c in s))


def candidates(text: str, taken: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of odd strings that begin up to REACH code points behind a sensitive word and touch no taken span."""
    ends, last = [], 0
    for s, _, e in taken:  # where the taken spans reach, by their starts
        last = max(last, e)
        ends.append(last)
    starts = [s for s, _, _ in taken]
    at = 0  # what lies before was looked at, so a text is gone through once
    for word in SENSITIVE.finditer(text):
        limit = word.end() + REACH
        at = max(at, word.end())
        while at < limit:
            begun = CANDIDATE.search(text, at, limit + LEAST_CANDIDATE - 1)
            if begun is None:
                break
            m = CANDIDATE.match(text, begun.start())
            at = m.end()
            before = bisect.bisect_left(starts, m.end())
            if odd(m.group()) and not (before and ends[before - 1] > m.start()):
                yield m.start(), m.end()


class Novelty:
    """Marginal compressed size of a string in its surroundings, by zstandard primed with a dictionary of identifiers."""

    def __init__(self, found: Sequence[bytes]):
        import zstandard

        primed = b" ".join([CODE.encode(), *reversed(found)])  # the most frequent last, where matches are cheapest
        shared = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=9)
        self.coder = zstandard.ZstdCompressor(dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, data: bytes) -> int:
        return len(self.coder.compress(data))

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that ``text[start:end]`` adds to what surrounds it, per byte of its own; the highest of its pieces.

        Other places of the same string nearby don't count as surroundings.
        """
        own = text[start:end]
        before, after = (x.replace(own, "").encode() for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        plain = self.size(before + after)
        pieces = [own[i : i + PIECE].encode() for i in range(0, len(own), PIECE)]
        return max((self.size(before + p + after) - plain) / len(p) for p in pieces)


def spans(text: str, novelty: Novelty) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, novelty) of all spans of a text: the fixed ones, which are not measured, and the reported candidates."""
    base = base_spans(text)
    more = [(s, 3, e, n) for s, e in candidates(text, base) if (n := novelty.of(text, s, e)) >= NOVELTY]
    return sorted([*((s, k, e, None) for s, k, e in base), *more], key=lambda x: x[:3])


_SPAN = "array<struct<kind: string, start: long, end: long, secret: string, novelty: double>>"


def scan(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for every row of ``df``: spans are (kind, start, end, secret, novelty) by start, then kind.

    Kinds: assign (a value given to a password, token or key), access (access key ids), hex (long hexadecimal runs), novel. A novel span
    is a string of mixed characters shortly behind a sensitive word which adds NOVELTY bytes per byte or more to its
    compressed surroundings, whatever identifiers code and this corpus use; it overlaps none of the other kinds. Identifiers are counted
    exactly over all rows. Places are code points, ends exclusive. NULL and empty texts have no spans; long texts are
    searched whole; repeated rows and NULL keys are rows as any other; an empty table gives none. Other columns are ignored.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(frequent(counted(df, identifiers, text=text), IDENTIFIERS, "identifiers"))
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("novelty", pa.float64())]))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(shared.value)
        for b in parts:
            texts = b.column("text")
            hit = pc.match_substring_regex(texts, ANY).to_pylist()
            out = []
            for i, h in enumerate(hit):
                t = texts[i].as_py() if h else ""
                out.append([{"kind": KINDS[k], "start": s, "end": e, "secret": t[s:e], "novelty": n} for s, k, e, n in spans(t, novelty)] if h else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {_SPAN}")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
