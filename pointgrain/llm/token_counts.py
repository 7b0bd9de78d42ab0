"""Token counts of fields and sections from one encoding of each whole text."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrain.llm.common import bounded_batches, packed, table, unpacked, without

SECTION_BREAK = "\n"


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte-pair ranks of a vocabulary file: base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def attribute(lengths: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each section gets and how many of these cross a border of it.

    lengths: bytes of the tokens in order; edges: byte offsets 0 .. total of the sections' borders, rising. A token
    belongs to the section that holds most of its bytes, the earliest of these if several hold as many."""
    n = len(edges) - 1
    counts, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first, last = np.searchsorted(edges, starts, "right") - 1, np.searchsorted(edges, ends, "left") - 1
    inside = first == last
    counts += np.bincount(first[inside], minlength=n)
    for i in np.flatnonzero(~inside):
        among = range(first[i], last[i] + 1)
        best = max(among, key=lambda s: (min(ends[i], edges[s + 1]) - max(starts[i], edges[s]), -s))
        counts[best] += 1
        crossing[best] += 1
    return counts, crossing


def count_sections(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", separator: str = SECTION_BREAK) -> DataFrame:
    """One row for each section of each row of df: its columns but the text, with section (from 0), begin and end (in
    code points; the separator belongs to the section before it), n_tokens, n_crossing and doc_tokens.

    The whole text is encoded once; the tokens' byte spans tile it, and sections tile it too, so a text's section
    counts sum up to its tokens. The vocabulary travels in a broadcast, so executors need no file.

    Defined cases: a null or empty text has one empty section with no tokens; a very long one is encoded whole; a closing separator opens no section;
    rows may repeat; an empty table gives no rows; input columns named as an output are replaced."""
    spark = df.sparkSession
    bounded_batches(spark)
    outputs = ["section", "begin", "end", "n_tokens", "n_crossing", "doc_tokens"]
    kept = [c for c in without(df, *outputs).columns if c != text]
    rows = df.select(packed(df, kept).alias("own"), F.col(f"`{text}`").alias("body"))
    schema = rows.select("own").withColumns({o: F.lit(0).cast("long") for o in outputs}).schema
    held = spark.sparkContext.broadcast(ranks)  # a vocabulary: of fixed size

    def counted(batches):
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=held.value, special_tokens={})
        size_of = np.zeros(max(held.value.values(), default=0) + 1, np.int64)
        for token, rank in held.value.items():
            size_of[rank] = len(token)
        for batch in batches:
            place, found = [], []
            for at, value in enumerate(batch.column(1).to_pylist()):
                value = value or ""
                parts = value.split(separator)
                parts = [p + separator for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
                lengths = size_of[np.array(encoder.encode_ordinary(value), np.int64)]
                edges = np.cumsum([0, *(len(p.encode()) for p in parts)])
                points = np.cumsum([0, *map(len, parts)])
                tokens, crossing = attribute(lengths, edges) if len(lengths) else (np.zeros(len(parts), np.int64),) * 2
                place.append(np.full(len(parts), at))
                found.append(np.stack([np.arange(len(parts)), points[:-1], points[1:], tokens, crossing, np.full(len(parts), len(lengths))]))
            if place:
                take = pa.array(np.concatenate(place))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *(pa.array(x) for x in np.concatenate(found, 1))], ["own", *outputs])

    return rows.mapInArrow(counted, schema).select(*unpacked(kept), *outputs)


def op6_token_counts(spark, sf_dir, vocabulary: str | None = None):
    import public_tokenizers

    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return count_sections(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


QUERIES = {"op6_token_counts": op6_token_counts}
#: Byte-pair encoding is not SQL's to give; tests hold the query to a round trip and a plain version.
ORACLE_SQL = {}
