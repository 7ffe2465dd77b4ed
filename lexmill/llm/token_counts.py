"""Token counts by the whole-token shortcut.

For a byte-level BPE tokenizer file, the driver proves two things once:

* which vocabulary strings form one pre-token and encode alone as one token;
* for which characters the pre-token pattern, run by the ``regex`` module,
  splits as the tokenizer's own splitter does.

Over the documents a pre-token found in the first set counts one directly, and
only the rest are merged (by the tokenizer, each distinct one once per worker
while a bounded memo has room).  A text that holds an added token's string, or
a character outside the proven set, is given to the tokenizer whole.

Defined edge cases: null text counts as empty (0 bytes, 0 tokens); a null
doc_id is passed through; repeated rows each give a row; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_ENTRIES = 400_000
#: longer pre-tokens are merged but not remembered; longer texts are split lazily
MEMO_CHARS = 64
LAZY_CHARS = 2_000_000


def load_tokenizer(spec: str):
    """A tokenizer from the text of its JSON file, single-threaded as executors want it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def prove(spec: str) -> dict:
    """What the shortcut may rely on: ``whole`` strings, ``odd`` characters and ``added`` strings."""
    import regex

    tok, split = load_tokenizer(spec), regex.compile(PATTERN)
    conf = json.loads(spec)
    added = [t["content"] for t in conf["added_tokens"]]
    odd = []
    for code in range(1, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        probe = f"a{ch}1{ch}.{ch} {ch}b{ch}{ch}"
        if [m.span() for m in split.finditer(probe)] != [s for _, s in tok.pre_tokenizer.pre_tokenize_str(probe)]:
            odd.append(ch)
    back = byte_chars()
    texts = []
    for entry in conf["model"]["vocab"]:
        try:
            texts.append(bytes(back[c] for c in entry).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    texts = [t for t in texts if t and not any(a in t for a in added) and split.findall(t) == [t] and not set(t) & set(odd)]
    whole = [t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1]
    return {"whole": whole, "odd": odd, "added": added}


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        spec, proof = shared.value
        tok = load_tokenizer(spec)
        split = regex.compile(PATTERN)
        odd = regex.compile("[" + regex.escape("".join(proof["odd"])) + "\U00010000-\U0010ffff\x00]")
        added = proof["added"]
        memo = dict.fromkeys(proof["whole"], 1)
        room = len(memo) + MEMO_ENTRIES

        def merged(parts: list[str]) -> dict[str, int]:
            return {p: len(e.ids) for p, e in zip(parts, tok.encode_batch(parts, add_special_tokens=False), strict=True)}

        def pieces(parts: list[str]) -> int:
            try:
                return sum(map(memo.__getitem__, parts))
            except KeyError:
                pass
            new = merged([p for p in set(parts) if p not in memo])
            keep = {p: n for p, n in new.items() if len(p) <= MEMO_CHARS}
            if len(memo) + len(keep) <= room:
                memo.update(keep)
            return sum(memo[p] if p in memo else new[p] for p in parts)

        def count(text: str | None) -> int:
            if not text:
                return 0
            if any(a in text for a in added) or odd.search(text):
                return len(tok.encode(text, add_special_tokens=False).ids)
            if len(text) <= LAZY_CHARS:
                return pieces(split.findall(text))
            total, held = 0, []
            for m in split.finditer(text):
                held.append(m.group())
                if len(held) == 100_000:
                    total, held = total + pieces(held), []
            return total + pieces(held)

        for batch in batches:
            n = [count(t) for t in batch.column(1).to_pylist()]
            size = pc.fill_null(pc.binary_length(batch.column(1)).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, as the tokenizer's library counts."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, prove(spec)))
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_counter(shared), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
