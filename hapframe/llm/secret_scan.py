r"""Secret scan: fixed patterns, and random strings by token efficiency.

Base spans come from three patterns (assignments, access keys, hexadecimal runs). The method adds runs of key characters
that a tokenizer made for text can't shorten: fewer than ``RATIO`` characters a token under a byte-level vocabulary.
Before the test known digests and identifiers are set aside: hexadecimal digests of the usual lengths, UUIDs, numbers, and names made of
plain words and short numbers. A run that is not random as a whole may be text that signs glue to a random string: of its parts between signs, sequences
of ``LEAST`` characters or more are tested too, their parts encoded alone; those with the most tokens beyond the ratio come first. Nothing
that touches a base span counts.

Defined results: null and empty texts have no spans; texts of any length are scanned whole, in time linear in them but for a single run of very many parts;
repeated rows and ids give one row each; an empty table gives an empty result; other columns, whatever their names, are ignored. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapframe.llm.common import table
from hapframe.llm.tokens import bounded_batches, vocabulary_path

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, RATIO = 6, 20, 2.0
LEAST = 20
#: Hexadecimal digits of CRC64/MD5/SHA-1/SHA-224/SHA-256/SHA-384/SHA-512.
DIGESTS = (16, 32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: Words with at most a short number each, joined by signs: a path, a file name, a slug.
NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_=-]*")
PART = re.compile(r"[A-Za-z0-9+]+")
VOCABULARY = "byte_bpe_50k.tiktoken"


def load_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kinds are indices of KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """A digest, an identifier, a name with numbers, or nothing with letters."""
    return (
        not any(c.isalpha() for c in run) or (len(run) in DIGESTS and DIGEST.fullmatch(run) is not None) or UUID.fullmatch(run) is not None
        or (any(c.isdigit() for c in run) and NAME.fullmatch(run) is not None)
    )


def glued(run: str, free, encoding) -> Iterator[tuple[int, int]]:
    """Spans of the random sequences of parts of a run; ``free(a, b)`` tells whether a span may be part of one."""
    uuids = [m.span() for m in UUID.finditer(run)]
    pieces: list[list[tuple[int, int, float]]] = [[]]
    for m in PART.finditer(run):
        a, b = m.span()
        if not free(a, b) or any(s < b and a < e for s, e in uuids) or (len(m[0]) in DIGESTS and DIGEST.fullmatch(m[0]) and not m[0].isalpha()):
            pieces.append([])
        else:
            pieces[-1].append((a, b, 0 if m[0].isdigit() else RATIO * len(encoding.encode_ordinary(m[0])) - (b - a)))
    while pieces:
        parts = pieces.pop()
        best, total, low, i = (0.0, 0, 0), 0.0, (), 0
        # Of each last part the best first one, by the least sum before it; low has (sum before, first part) of those far enough.
        sums = [0.0]
        for j, (_, end, score) in enumerate(parts):
            total += score
            sums.append(total)
            while i <= j and end - parts[i][0] >= LEAST:
                low = min(low, (sums[i], i)) if low else (sums[i], i)
                i += 1
            if low and total - low[0] > best[0]:
                best = total - low[0], low[1], j
        if best[0] > 0:
            _, first, last = best
            a, b = parts[first][0], parts[last][1]
            if not known(run[a:b]):
                yield a, b
            pieces += [parts[:first], parts[last + 1 :]]


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding) -> list[tuple[int, int, int]]:
    found = []
    for m in RUN.finditer(text):
        a, b = m.span()
        near = [(s, e) for s, _, e in taken if s < b and a < e]
        if not near and not known(m[0]) and b - a < RATIO * len(encoding.encode_ordinary(m[0])):
            found.append((a, 3, b))
        else:
            more = glued(m[0], lambda x, y, a=a, near=near: not any(s < a + y and a + x < e for s, e in near), encoding)
            found += sorted((a + x, 3, a + y) for x, y in more)
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` with one row a document."""
    bounded_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path(VOCABULARY)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch, rows = whole.slice(at, 2000), []
                for text in batch.column(1).to_pylist():
                    base = base_spans(text or "")
                    more = random_spans(text or "", base, encoding)
                    kinds = [k for _, k, _ in base]
                    rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more)))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
