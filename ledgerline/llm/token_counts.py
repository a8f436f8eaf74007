"""Token counts by whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that give exactly
one token form the proven set. In the workers a text is cut into
pre-tokens: a pre-token in the proven set counts one, and only the rest is
merged by the tokenizer.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import table
from ledgerline.llm.wordtokens import Memo, chunks, load_tokenizer, worker_cache

#: The pre-tokenizer's pattern and end-of-word mark, from the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_single_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, encoded alone, give one token."""
    tok, of = load_tokenizer(path), byte_alphabet()
    found = []
    for piece in tok.get_vocab(with_added_tokens=False):
        if not piece.endswith(END):
            continue
        try:
            found.append(bytes(of[c] for c in piece[: -len(END)]).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    ids = tok.encode_batch(found, add_special_tokens=False)
    whole = regex.compile(PATTERN)
    return frozenset(s for s, e in zip(found, ids, strict=True) if len(e.ids) == 1 and whole.fullmatch(s) and s.isascii())


class Counter:
    """Counts the tokens of texts exactly as the library does."""

    def __init__(self, path: str, proven: frozenset[str], limit: int):
        self.tok, self.proven = load_tokenizer(path), proven
        self.memo = Memo(self.count_chunk, limit)
        self.pieces = regex.compile(PATTERN).findall

    def merged(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def count_chunk(self, chunk: str) -> int:
        if chunk in self.proven:
            return 1
        if not chunk.isascii():
            return self.merged(chunk)
        return sum(1 if p in self.proven else self.merged(p) for p in self.pieces(chunk.lower()))

    def count(self, text: str) -> int:
        keys = chunks(text)
        return self.merged(text) if keys is None else sum(map(self.memo.__getitem__, keys))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, memo_entries: int = 700_000) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Null and empty texts count zero bytes and tokens; repeated rows and null
    ids each keep their row; other columns are not read. One narrow pass
    without a shuffle: a lost executor's tasks just run again. A worker
    holds one Arrow batch and a memo of at most ``memo_entries`` words.
    """
    proven = docs.sparkSession.sparkContext.broadcast(prove_single_tokens(path))  # at most the vocabulary
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = worker_cache(("count", path, memo_entries), lambda: Counter(path, proven.value, memo_entries))
        for b in batches:
            texts = b.column(1)
            n = [counter.count(t) if t else 0 for t in texts.to_pylist()]
            size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
