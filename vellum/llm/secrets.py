"""Secret scans: fixed patterns, and random strings that a tokenizer needs many tokens for."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm._store import ship

#: The base kinds, in the order in which spans at one place are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: A candidate is MIN_RUN or more of these characters with a letter: a run, or segments of it between / _ - and =.
MIN_RUN = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
LETTER, DIGIT, SEGMENT = re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile(r"[A-Za-z0-9+]+")
#: Tokens are counted in slices of so many characters, so that long runs take linear time.
SLICE = 1024
#: At most so many characters for each token: prose has 3 or more, random letters and digits 1 to 2.
MAX_CHARS_PER_TOKEN = 2.0
#: Not secrets: digests by their length (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and UUIDs.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.IGNORECASE)
UUID = re.compile(r"(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])", re.IGNORECASE)

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False
)


def vocabulary(path: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base kinds: leftmost matches of each kind, those too short dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def n_tokens(s: str, encoding) -> int:
    return sum(len(encoding.encode_ordinary(s[i : i + SLICE])) for i in range(0, len(s), SLICE))


def dense_spans(s: str, encoding) -> Iterator[tuple[int, int]]:
    """The run `s` if it is badly compressed as a whole, else its longest rows of segments that are so one by one."""

    def dense(x: str, chars: int, tokens: int) -> bool:
        return len(x) >= MIN_RUN and chars <= MAX_CHARS_PER_TOKEN * tokens and LETTER.search(x) and not DIGEST.match(x)

    if len(s) < MIN_RUN or not LETTER.search(s):
        return
    parts = [(m.start(), m.end(), n_tokens(m[0], encoding)) for m in SEGMENT.finditer(s)]
    # words of one or two letters between separators are no secret: without a digit, separators do not count
    counts = (len(s), n_tokens(s, encoding)) if DIGIT.search(s) else (sum(b - a for a, b, _ in parts), sum(n for *_, n in parts))
    if dense(s, *counts):
        yield 0, len(s)
        return
    rows: list[list[tuple[int, int, int]]] = [[]]
    for a, b, n in parts:
        if b - a <= MAX_CHARS_PER_TOKEN * n and not DIGEST.match(s[a:b]):
            rows[-1].append((a, b, n))
        else:
            rows.append([])
    for row in rows:
        if row and dense(s[row[0][0] : row[-1][1]], sum(b - a for a, b, _ in row), sum(n for *_, n in row)):
            yield row[0][0], row[-1][1]


def random_spans(text: str, encoding, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """Strings outside base spans that the vocabulary compresses badly and that are no known digest or identifier."""
    found, at, ends = [], 0, []
    for x, y in sorted((x, y) for x, _, y in taken):
        if ends and x <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(y, ends[-1][1]))
        else:
            ends.append((x, y))
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(ends) and ends[at][1] <= a:  # both go forward: linear
            at += 1
        cuts, k = [(u.start(), u.end()) for u in UUID.finditer(text, a, b)], at
        while k < len(ends) and ends[k][0] < b:
            cuts.append(ends[k])
            k += 1
        for x, y in [*sorted(cuts), (b, b)]:
            found += [(a + i, 3, a + j) for i, j in dense_spans(text[a : max(a, x)], encoding)]
            a = max(a, y)
    return found


def find_secrets(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` with secrets: all spans (kind, start, end) of each whole text, by start, then kind as KINDS lists it.

    Offsets are code points, the end exclusive. `path` is a tiktoken rank file at the same place on all
    machines. Base kinds are found by their patterns; random ones by characters for each token.

    A random one is of A-Z a-z 0-9 + / _ = -, outside base spans and UUIDs, of 20 characters or more, with a
    letter, and no MD5 or SHA digest in hex. It is a whole run of these characters with at most two for
    each token (without a digit, / _ - and = do not count), or else the longest row of segments between
    / _ - and = that each have at most two for each token. Nothing else is left out before tokens are counted;
    random strings that happen to hold many known syllables have more than two and are missed.

    Null and empty texts have no spans. Repeated rows are scanned one by one; an empty table gives an
    empty one. A column of `docs` named secrets is replaced. No shuffle; one Arrow batch at a time.
    """
    ship(docs.sparkSession)
    base = docs.drop("secrets")
    where, schema = base.columns.index(text_col), T.StructType([*base.schema.fields, T.StructField("secrets", SPANS, False)])
    arrow = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        for batch in batches:
            out = []
            for t in batch.column(where):
                text = t.as_py() or ""
                spans = base_spans(text)
                spans = sorted(spans + random_spans(text, encoding, spans))
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=schema.names)

    return base.mapInArrow(run, schema)
