"""Words of whole Arrow batches: split and numbered in Arrow, so that Python meets each distinct word once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PART_BYTES = 8 << 20


def numbered_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts (null: empty), A-Z lower-cased if `lower`, and split at ASCII white space: the number of each word, the distinct words, and each text's first word (and the end)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, first = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    first -= first[0]
    some = pc.binary_length(flat).to_numpy() > 0
    if not some.all():
        flat = flat.filter(pa.array(some))
        first = np.concatenate(([0], np.cumsum(some)))[first]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, first


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """XXH64 of each word, unsigned."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def text_parts(batches, part_bytes: int = PART_BYTES):
    """Slices of record batches with about `part_bytes` of `text` each, at least one row; rows are never split."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + part_bytes, "right")))
            yield batch.slice(a, b - a)
            a = b
