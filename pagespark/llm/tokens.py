"""Token counts under a public tokenizer whose file lies outside the repository."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import DataFrame

#: Where the public vocabularies lie; a parameter of every operator that counts tokens.
DEFAULT = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern these byte-level vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache
def encoding(path: str = DEFAULT):
    """The tokenizer of a rank file; made once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, key: str, text: str = "text", extra: tuple[str, ...] = (), path: str = DEFAULT) -> DataFrame:
    """(key, extra..., tokens): tokens of each whole text; NULL texts count 0."""
    types = dict(docs.dtypes)

    def run(it):
        enc = encoding(path)
        for pdf in it:
            out = pdf[[key, *extra]].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield out

    head = ", ".join(f"{c} {types[c]}" for c in (key, *extra))
    return docs.select(key, *extra, text).mapInPandas(run, f"{head}, tokens long")


def token_slices(text: str, starts: list[int], size: int, path: str = DEFAULT) -> list[str]:
    """Pieces of ``size`` tokens from each start; decoding replaces cut characters, joining token ids does not."""
    enc = encoding(path)
    ids = enc.encode_ordinary(text)
    return [enc.decode(ids[s : s + size]) for s in starts]
